from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from kinweave.llm import bpe
from kinweave.llm.common import table


def op4(spark: SparkSession, sf_dir: str) -> DataFrame:
    return bpe.digests(bpe.encode_decode(table(spark, sf_dir, "documents").select("doc_id", "text")))


QUERIES = {"op4_bpe_chunks": op4}
SQL: dict[str, str] = {}
