"""Text readers. A short row leaves its missing columns null, a bad number becomes null;
the queries decide which columns they need. Nothing raises on a bad row."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from kinweave.functions import fields, part, to_int, trim_controls


def _parts(lines: DataFrame) -> DataFrame:
    return lines.select(fields("value").alias("parts"))


def count_lines(spark: SparkSession, path: str) -> DataFrame:
    """One row, one column n: the physical lines of a file, malformed ones included."""
    return spark.read.text(path).agg(F.count(F.lit(1)).alias("n"))


def read_page_rows(spark: SparkSession, path: str, strict: bool = False) -> DataFrame:
    return page_rows(spark.read.text(path), strict)


def page_rows(lines: DataFrame, strict: bool = False) -> DataFrame:
    """Every line (a column value) of a people file. `strict` keeps only rows of exactly five fields, trailing empty
    fields not counted, and leaves the hobby untrimmed."""
    if strict:
        split = lines.select(fields(F.regexp_replace("value", ",+$", "")).alias("parts"))
        rows = split.where(F.size("parts") == 5)
        hobby = part(F.col("parts"), 4)
    else:
        rows = _parts(lines)
        hobby = trim_controls(part(F.col("parts"), 4))
    region = part(F.col("parts"), 3)
    return rows.select(
        to_int(part(F.col("parts"), 0)).alias("id"),
        trim_controls(part(F.col("parts"), 1)).alias("nick_name"),
        trim_controls(part(F.col("parts"), 2)).alias("job_title"),
        # An unreadable region is -1, and such regions equal each other; a missing one is null.
        F.when(region.isNotNull(), to_int(region, -1, "int")).alias("region_code"),
        hobby.alias("favorite_hobby"),
    )


def read_pages(spark: SparkSession, path: str) -> DataFrame:
    return pages(spark.read.text(path))


def pages(lines: DataFrame) -> DataFrame:
    """People, one row per readable id. A repeated id keeps the row with the largest nickname."""
    rest = ["nick_name", "job_title", "region_code", "favorite_hobby"]
    rows = page_rows(lines).where("id is not null")
    return rows.groupBy("id").agg(F.max(F.struct(*rest)).alias("r")).select("id", *[F.col(f"r.{c}") for c in rest])


def read_follows(spark: SparkSession, path: str) -> DataFrame:
    return follows(spark.read.text(path))


def follows(lines: DataFrame) -> DataFrame:
    parts = F.col("parts")
    return _parts(lines).select(
        to_int(part(parts, 0)).alias("col_rel"),
        to_int(part(parts, 1)).alias("id1"),
        to_int(part(parts, 2)).alias("id2"),
        to_int(part(parts, 3), kind="int").alias("date_of_relation"),
        part(parts, 4).alias("description"),
    )


def read_activity(spark: SparkSession, path: str) -> DataFrame:
    return activity(spark.read.text(path))


def activity(lines: DataFrame) -> DataFrame:
    parts = F.col("parts")
    return _parts(lines).select(
        to_int(part(parts, 0)).alias("action_id"),
        to_int(part(parts, 1)).alias("by_who"),
        to_int(part(parts, 2)).alias("what_page"),
        part(parts, 3).alias("action_type"),
        to_int(part(parts, 4), kind="int").alias("action_time"),
    )
