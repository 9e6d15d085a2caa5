"""Grouped and global aggregates. Spark combines on the map side before it shuffles."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def count_by(rows: DataFrame, key: str, name: str = "id") -> DataFrame:
    """Rows per non-null key: (name, n)."""
    return rows.where(F.col(key).isNotNull()).groupBy(F.col(key).alias(name)).agg(F.count(F.lit(1)).alias("n"))


def max_by_user(activity: DataFrame) -> DataFrame:
    """The latest valid time of each actor with a positive id: (id, t)."""
    valid = activity.where("by_who > 0 and action_time >= 0")
    return valid.groupBy(F.col("by_who").alias("id")).agg(F.max("action_time").alias("t"))


def latest_by_actor(activity: DataFrame) -> DataFrame:
    """The latest valid time of each actor, whoever that is: (id, t), of which `max_by_user` and `global_max` follow.
    The id comes out of the aggregate, so no later condition on it makes the rows differ that are aggregated: plans that
    read this twice scan and shuffle the log once."""
    valid = activity.where("action_time >= 0")
    return valid.groupBy("by_who").agg(F.max("by_who").alias("id"), F.max("action_time").alias("t")).select("id", "t")


def global_max(activity: DataFrame) -> DataFrame:
    """The latest valid time over all rows, whoever acted; 0 without any."""
    return activity.where("action_time >= 0").agg(F.coalesce(F.max("action_time"), F.lit(0)).alias("t"))


def global_average(rows: DataFrame, column: str = "n") -> DataFrame:
    """The mean of a column as a double, 0.0 without rows."""
    return rows.agg(F.coalesce(F.avg(column), F.lit(0.0)).alias("average"))


def rank_top(rows: DataFrame, k: int) -> DataFrame:
    """The k largest n, ties to the smaller id; each partition keeps k rows before they meet."""
    return rows.orderBy(F.desc("n"), F.asc("id")).limit(k)
