"""Directed edges inside a region, and the people who follow without being followed back."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from kinweave.operators.joining import BROADCAST_LIMIT, estimated_bytes, hinted


def region_edges(pages: DataFrame, follows: DataFrame, strategy: str | None = None) -> DataFrame:
    """Edges (id1, id2) whose two ends are known, differ, and share a region. Repeats may be left in.

    By default (id, region) is broadcast where its checked size allows, so edges don't move at all. Beyond
    it, edges move without repeats, and adaptive execution splits hot ids.
    """
    known = pages.where("region_code is not null").select("id", "region_code")
    first = known.select(F.col("id").alias("id1"), F.col("region_code").alias("region1"))
    second = known.select(F.col("id").alias("id2"), F.col("region_code").alias("region2"))
    edges = follows.select("id1", "id2").where("id1 <> id2")
    if strategy is None and estimated_bytes(known) <= BROADCAST_LIMIT:
        strategy = "broadcast"
    elif strategy is None:
        edges = edges.distinct()
    return (
        edges.join(hinted(first, strategy), "id1")
        .join(hinted(second, strategy), "id2")
        .where("region1 = region2")
        .select("id1", "id2")
    )


def same_region_edges(pages: DataFrame, follows: DataFrame, strategy: str | None = None) -> DataFrame:
    return region_edges(pages, follows, strategy).distinct()


def one_way_followers(edges: DataFrame, plan: str = "pair") -> DataFrame:
    """Ids with an edge that has no reverse edge. Repeated edges change nothing.

    'pair' groups on the unordered pair with one flag per direction: a single shuffle, combined on
    the map side. 'anti' is a self anti-join on the swapped edge. Both give the same ids.
    """
    if plan == "pair":
        flags = edges.groupBy(F.least("id1", "id2").alias("low"), F.greatest("id1", "id2").alias("high")).agg(
            F.bool_or(F.col("id1") < F.col("id2")).alias("up"), F.bool_or(F.col("id1") > F.col("id2")).alias("down")
        )
        one_way = flags.where("up <> down").select(F.when(F.col("up"), F.col("low")).otherwise(F.col("high")).alias("id"))
    elif plan == "anti":
        edge = edges.distinct()
        back = edge.select(F.col("id1").alias("b1"), F.col("id2").alias("b2"))
        one_way = edge.join(back, (F.col("id1") == F.col("b2")) & (F.col("id2") == F.col("b1")), "left_anti").select(F.col("id1").alias("id"))
    else:
        raise ValueError(f"unknown plan {plan!r}; 'pair' or 'anti'")
    return one_way.distinct()
