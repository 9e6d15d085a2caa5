"""The queries of this subpackage. Each is a thin form of its operator over the whole of its table."""

from __future__ import annotations

from kinweave.llm import query_bpe, query_classifier, query_conversations, query_divergence, query_license, query_lm, query_native, query_packing, query_pii, query_repeats, query_simhash, query_topk

MODULES = [query_native, query_simhash, query_license, query_bpe, query_classifier, query_repeats, query_topk, query_lm, query_pii, query_divergence, query_packing, query_conversations]


def queries():
    return {name: f for m in MODULES for name, f in m.QUERIES.items()}


def oracle_sql():
    return {name: sql for m in MODULES for name, sql in m.SQL.items()}
