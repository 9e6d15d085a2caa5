from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from kinweave.llm import classifier
from kinweave.llm.common import table


def op5(spark: SparkSession, sf_dir: str) -> DataFrame:
    labels = table(spark, sf_dir, "labels").select("doc_id", F.col("quality").alias("label"))
    return classifier.classify(table(spark, sf_dir, "documents"), labels)


QUERIES = {"op5_quality_classifier": op5}
SQL: dict[str, str] = {}
