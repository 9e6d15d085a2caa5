"""Joins with a choice of physical form."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: A side is replicated only below this estimate of its size, in bytes as its files hold them, which is compressed: for
#: two number columns some tenth of what the side takes in memory, so about 160 MB there.
BROADCAST_LIMIT = 16 << 20
STRATEGIES = (None, "broadcast", "merge", "shuffle_hash")


def estimated_bytes(rows: DataFrame) -> int:
    """The optimizer's own estimate, as shown by EXPLAIN COST; PySpark gives it by no other way."""
    return int(str(rows._jdf.queryExecution().optimizedPlan().stats().sizeInBytes()))


def hinted(side: DataFrame, strategy: str | None) -> DataFrame:
    """Hint one side of a join. None leaves the choice to the optimizer and adaptive execution.
    'broadcast' holds only for a side whose estimate is under BROADCAST_LIMIT; else it becomes 'merge', in
    which adaptive execution splits hot keys."""
    if strategy not in STRATEGIES:
        raise ValueError(f"unknown join strategy {strategy!r}; one of {STRATEGIES}")
    if strategy is None:
        return side
    if strategy == "broadcast" and estimated_bytes(side) > BROADCAST_LIMIT:
        strategy = "merge"
    return side.hint(strategy)


def checked_join(left: DataFrame, right: DataFrame, key: str, how: str, strategy: str | None = None) -> DataFrame:
    return left.join(hinted(right, strategy), key, how)


def left_with_zero(left: DataFrame, right: DataFrame, key: str, columns: list[str], strategy: str | None = None) -> DataFrame:
    """Left join in which a missing count is zero."""
    joined = checked_join(left, right, key, "left", strategy)
    return joined.withColumns({c: F.coalesce(F.col(c), F.lit(0).cast("bigint")) for c in columns})
