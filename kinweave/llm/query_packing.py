from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from kinweave.llm import packing
from kinweave.llm.common import placed, table


def op12(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.pack(table(spark, sf_dir, "documents").select("doc_id", "text"), number=placed)


QUERIES = {"op12_packing": op12}
SQL: dict[str, str] = {}
