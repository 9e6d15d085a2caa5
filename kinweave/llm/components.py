"""Connected components of an edge list, by alternating large and small stars."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from kinweave.llm.common import cut_files, delete, join_hot


def _digest(edges: DataFrame) -> tuple:
    return tuple(edges.agg(F.count(F.lit(1)), F.sum(F.xxhash64("u", "v").cast("decimal(20,0)"))).first())


def _with_minimum(edges: DataFrame, total: int) -> DataFrame:
    """edges with m, the smallest node among u and its neighbours; a star's centre may have most of the edges."""
    least = edges.groupBy("u").agg(F.least(F.min("v"), F.col("u")).alias("m"), F.count(F.lit(1)).alias("n"))
    return join_hot(edges, least, "u", "n", total)


def components(edges: DataFrame, most_rounds: int = 60) -> DataFrame:
    """(node, label): the smallest node reachable over edges (a, b), for every node with an edge to another.

    Each round moves every node's edges to the smallest neighbour known; rounds grow with the logarithm
    of the longest path. The edges stay distributed; each round is kept in the shared folder until the next
    one is there.
    """
    spark = edges.sparkSession

    def kept(rows: DataFrame) -> tuple[str, DataFrame]:
        path = cut_files(rows)
        return path, spark.read.schema(rows.schema).parquet(path)

    path, e = kept(edges.where("a <> b").select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).distinct())
    before = _digest(e)
    for _ in range(most_rounds):
        both = e.union(e.select(F.col("v").alias("u"), F.col("u").alias("v")))
        large = _with_minimum(both, 2 * before[0]).where("v > u").select(F.col("v").alias("u"), F.col("m").alias("v")).where("u <> v").distinct()
        large_path, large = kept(large)
        joined = _with_minimum(large, before[0])
        small = joined.select(F.col("v").alias("u"), F.col("m").alias("v")).union(joined.select("u", F.col("m").alias("v")))
        before_path, (path, e) = path, kept(small.where("u <> v").distinct())
        for old in (before_path, large_path):
            delete(spark, old)
        if (now := _digest(e)) == before:
            labels = e.select(F.col("u").alias("node"), F.col("v").alias("label"))
            roots = e.select(F.col("v").alias("node"), F.col("v").alias("label")).distinct()
            return labels.union(roots)
        before = now
    raise RuntimeError(f"components did not settle in {most_rounds} rounds")
