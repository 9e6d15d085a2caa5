from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from kinweave.llm import license
from kinweave.llm.common import table


def op3(spark: SparkSession, sf_dir: str) -> DataFrame:
    return license.scan(table(spark, sf_dir, "documents").select("doc_id", "text")).drop("spans")


QUERIES = {"op3_license_scan": op3}
SQL: dict[str, str] = {}
