"""Readers: lenient comma-separated text, and stand-ins over the star-schema parquet tables."""

from kinweave.sources.standin import StandIn
from kinweave.sources.text import activity, count_lines, follows, page_rows, pages, read_activity, read_follows, read_page_rows, read_pages

__all__ = ["StandIn", "activity", "count_lines", "follows", "page_rows", "pages", "read_activity", "read_follows", "read_page_rows", "read_pages"]
