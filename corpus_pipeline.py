"""From raw documents to encoded training data, in five stages.

Each stage is a function of (spark, docs, sf_dir) that works on every row its predecessor kept. All but
the last return the columns that documents has; between stages the rows are written as Parquet in the
shared folder and read again. Nulls, empty texts, repeated rows and empty tables pass as the stage's
operator defines it. A column n_chars, where there is one, follows the text.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from kinweave.llm import bpe, mixing, pii, quality, simhash
from kinweave.llm.common import cut_table, placed, table


def _recounted(docs: DataFrame) -> DataFrame:
    if "n_chars" not in docs.columns:
        return docs
    kind = dict(docs.dtypes)["n_chars"]
    return docs.withColumn("n_chars", F.length("text").cast(kind))


def quality_rules(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Rows that pass the quality rules."""
    return quality.reject(docs)


def near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One row of each group of near duplicates, that with the smallest doc_id."""
    return simhash.keep_first(docs, number=placed)


def redact_pii(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All rows, with personal data in the texts replaced by its kind."""
    return _recounted(pii.redact(docs))


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Rows as often as the mix takes them; where a quota ends inside a text, its leading words."""
    return _recounted(mixing.resample(docs, number=placed))


def encode(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Token counts and digests of the ids and of the decoded text of each row."""
    return bpe.digests(bpe.encode_decode(docs.select("doc_id", "text")))


STAGES = [
    ("quality rules", quality_rules),
    ("near duplicates", near_dedup),
    ("personal data", redact_pii),
    ("source mix", mix_sources),
    ("encoding", encode),
]

#: SQL has neither the fingerprints' hash nor the encoding; tests/llm/test_pipeline.py has a brute-force version.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for at, (_, stage) in enumerate(STAGES):
        docs = stage(spark, docs, sf_dir)
        if at + 1 < len(STAGES):
            docs = cut_table(docs)
    return docs
