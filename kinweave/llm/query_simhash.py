from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from kinweave.llm import simhash
from kinweave.llm.common import table


def op2(spark: SparkSession, sf_dir: str) -> DataFrame:
    return simhash.near_duplicates(table(spark, sf_dir, "documents").select("doc_id", "text"))


QUERIES = {"op2_simhash_near_dedup": op2}
SQL: dict[str, str] = {}
