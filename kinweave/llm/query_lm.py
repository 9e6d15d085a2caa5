from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from kinweave.llm import lm
from kinweave.llm.common import table


def op8(spark: SparkSession, sf_dir: str) -> DataFrame:
    return lm.learn_and_score(table(spark, sf_dir, "documents").select("doc_id", "text"))


QUERIES = {"op8_lm_scoring": op8}
SQL: dict[str, str] = {}
