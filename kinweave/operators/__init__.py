"""The relational building blocks that the eight questions share."""

from kinweave.operators.graph import one_way_followers, same_region_edges
from kinweave.operators.grouping import count_by, global_average, global_max, latest_by_actor, max_by_user, rank_top
from kinweave.operators.joining import checked_join, left_with_zero

__all__ = [
    "checked_join", "count_by", "global_average", "global_max", "latest_by_actor", "left_with_zero",
    "max_by_user", "one_way_followers", "rank_top", "same_region_edges",
]
