"""People, follow edges and visits taken from star-schema parquet tables, for tests and benches."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F


def _hours(ts: str) -> Column:
    return F.floor(F.unix_seconds(F.col(ts).cast("timestamp")) / 3600).cast("int")


class StandIn:
    """Each method reads only the columns it needs."""

    def __init__(self, spark: SparkSession, sf_dir: str):
        self.spark, self.dir = spark, sf_dir.rstrip("/")

    def table(self, name: str) -> DataFrame:
        return self.spark.read.parquet(f"{self.dir}/{name}.parquet")

    def pages(self) -> DataFrame:
        return self.table("customer").select(
            F.col("c_custkey").cast("bigint").alias("id"),
            F.col("c_name").alias("nick_name"),
            F.col("c_name").alias("job_title"),
            F.col("c_nationkey").cast("int").alias("region_code"),
            F.col("c_mktsegment").alias("favorite_hobby"),
        )

    def _ordered(self, target: str) -> DataFrame:
        orders = self.table("orders").select("o_orderkey", "o_custkey", "o_orderdate")
        lines = self.table("lineitem").select("l_orderkey", F.col(target).cast("bigint").alias("target"))
        return lines.join(orders, F.col("l_orderkey") == F.col("o_orderkey"))

    def _follows(self, target: str) -> DataFrame:
        return (
            self._ordered(target)
            .select(F.col("o_custkey").cast("bigint").alias("id1"), F.col("target").alias("id2"))
            .where("id1 <> id2")
        )

    def follows_part(self) -> DataFrame:
        """Edges of which a quarter lead to unknown people."""
        return self._follows("l_partkey")

    def follows_supp(self) -> DataFrame:
        """Edges to few people; most people have no follower."""
        return self._follows("l_suppkey")

    def activity_orders(self) -> DataFrame:
        return self._ordered("l_partkey").select(
            F.col("o_custkey").cast("bigint").alias("by_who"),
            F.col("target").alias("what_page"),
            _hours("o_orderdate").alias("action_time"),
        )

    def page_lines(self) -> DataFrame:
        """People as text lines (a column value), with the flaws that the text readers bear: extra and missing
        fields, blanks around a field, numbers that aren't."""
        c = self.table("customer")
        at = F.col("c_custkey") % 8
        hobby = F.when(at == 1, F.concat(F.lit(" "), "c_mktsegment", F.lit("\t"))).when(at == 2, F.concat("c_mktsegment", F.lit(",more"))).when(at == 3, F.lit(",,")).otherwise(F.col("c_mktsegment"))
        region = F.when(at == 4, F.lit("x")).when(at == 5, F.concat(F.lit(" +"), F.col("c_nationkey"))).otherwise(F.col("c_nationkey").cast("string"))
        whole = F.concat_ws(",", F.when(at == 6, F.lit("id")).otherwise(F.col("c_custkey").cast("string")), F.concat(F.lit(" "), "c_name"), F.concat(F.lit("Job "), "c_custkey"), region, hobby)
        return c.select(F.when(at == 7, F.concat(F.col("c_custkey").cast("string"), F.lit(",short"))).otherwise(whole).alias("value"))

    def follow_lines(self) -> DataFrame:
        """Follow edges as text lines; every fifth order's have a blank or bad number or end early."""
        at = F.col("o_orderkey") % 5
        second = F.when(at == 1, F.lit("")).when(at == 2, F.concat(F.lit(" "), F.col("target"), F.lit(" "))).otherwise(F.col("target").cast("string"))
        rest = F.when(at == 3, F.lit("1.5")).when(at == 4, F.lit("99999999999,late")).otherwise(F.lit("7,a friend"))
        return self._ordered("l_suppkey").select(F.concat_ws(",", "o_orderkey", "o_custkey", second, rest).alias("value"))

    def activity_lines(self) -> DataFrame:
        """Actions as text lines; some lack their time, and some have a number that isn't one."""
        at = F.col("o_orderkey") % 4
        actor = F.when(at == 1, F.lit("nobody")).otherwise(F.col("o_custkey").cast("string"))
        time = F.when(at == 2, F.lit("viewed")).otherwise(F.concat_ws(",", F.lit("viewed"), _hours("o_orderdate")))
        return self._ordered("l_partkey").select(F.concat_ws(",", "o_orderkey", actor, "target", time).alias("value"))

    def activity_events(self) -> DataFrame:
        return self.table("events").select(
            F.col("user_id").cast("bigint").alias("by_who"),
            F.get_json_object("props", "$.k").try_cast("bigint").alias("what_page"),
            _hours("ts").alias("action_time"),
        )
