from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from kinweave.llm import pii
from kinweave.llm.common import table


def op10(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pii.find(table(spark, sf_dir, "documents").select("doc_id", "text")).drop("text")


QUERIES = {"op10_pii_deobfuscation": op10}
SQL: dict[str, str] = {}
