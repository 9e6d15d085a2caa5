"""The eight questions as functions from DataFrames to a DataFrame."""

from kinweave.plans.questions import (
    above_average, activity_totals, follower_totals, hobby_frequency,
    one_way_in_region, outdated, top_pages, users_by_hobby,
)

__all__ = [
    "above_average", "activity_totals", "follower_totals", "hobby_frequency",
    "one_way_in_region", "outdated", "top_pages", "users_by_hobby",
]
