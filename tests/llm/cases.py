"""Rows that every operator has to bear, and tables to put them in."""

from pyspark.sql import functions as F

SCHEMA = "doc_id bigint, text string, lang string, source string, n_chars bigint, row bigint, size string, score string, label int, f string, shards int, kept boolean, words string"
BASE = "the quick fox and the lazy dog went to that old house with a red door for tea in the morning"
TEXTS = [
    None, "", " \t\n\x0b\f\r", "word", BASE, BASE, BASE.upper(), BASE + " once more", "a" * 200_000, "x y " * 20_000,
    "é ü ñ 漢字 \U0001f600 " * 30, "line one here\nline one here\n\nline two", "mail a@b.co or 10.0.0.1, +1 (782) 555-0489",
    "Released under the MIT License", "<|endoftext|>", "0\x00nul",
]


def rows():
    out = [(i, t, None if i % 5 == 0 else "en", None if i % 4 == 0 else f"src{i % 3}", None if t is None else len(t)) for i, t in enumerate(TEXTS)]
    out += [out[4], (None, BASE, None, None, None), (None, None, None, None, None)]
    return [(*r, 7, "s", "x", 1, "f", 3, False, "w") for r in out]


def docs(spark):
    return spark.createDataFrame(rows(), SCHEMA).coalesce(1)


def empty(spark):
    return spark.createDataFrame([], SCHEMA)


def small(spark, n=300):
    """Real texts, few enough for brute force."""
    return spark.read.parquet("/root/testdata/sf0.001/documents.parquet").where(F.col("doc_id") < n).coalesce(2)
