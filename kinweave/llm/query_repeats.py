from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from kinweave.llm import repeats
from kinweave.llm.common import placed, table


def op6(spark: SparkSession, sf_dir: str) -> DataFrame:
    return repeats.remove(table(spark, sf_dir, "documents"), number=placed, with_kept=False).drop("kept", "spans")


QUERIES = {"op6_suffix_dedup": op6}
SQL: dict[str, str] = {}
