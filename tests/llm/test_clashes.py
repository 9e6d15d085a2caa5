"""Extra columns that are named like what an operator works with, in any case of letters, or that need
quoting, pass through every stage untouched."""

from __future__ import annotations

import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from kinweave.llm import mixing, quality

NAMES = [
    "_f", "_label", "_component", "_row", "_copies", "_cut", "_redacted", "_t", "_w", "_n", "_r1", "_common", "_lines", "_part", "_shard", "_shards",
    "_source", "_in", "_words", "_quota", "f", "label", "words", "shards", "blocks", "quota", "kept", "size", "taken", "component_id", "given 0", "given 7", "given0", "given3", "a.b", "c`d",
    "_F2", "_T2", "LABELS", "Place", "KEY_row", "key_file", "Redacted", "tie", "salt", "is_hot", "n", "Cut", "PART", "copies", "_Size", "f.F",
]
BASE = ["doc_id", "text", "source"]


def _docs(spark):
    prose = "the cat of the house and the dog that was in it went to a hill for the sun with a friend on %s as it is"
    rows = [(i, (prose % f"day {i % 5}") + f" and then write to me{i}@example.org", "ab"[i % 2]) for i in range(20)]
    rows += [(20, None, None), (21, "", "a"), (None, "few words", "b")]
    return spark.createDataFrame(rows, "doc_id bigint, text string, source string")


def _with_extras(docs):
    return docs.select(*[F.concat_ws(":", F.lit(n), F.col("doc_id")).alias(n) for n in NAMES[:9]], *BASE, *[F.concat_ws(":", F.lit(n), F.col("doc_id")).alias(n) for n in NAMES[9:]])


@pytest.mark.parametrize("name,stage", corpus_pipeline.STAGES[:-1], ids=lambda x: x if isinstance(x, str) else "")
def test_stages(spark, name, stage):
    docs = _docs(spark)
    plain = sorted(map(tuple, stage(spark, docs, "").select(*BASE).collect()), key=repr)
    assert plain
    wide = stage(spark, _with_extras(docs), "")
    assert wide.columns == _with_extras(docs).columns
    rows = wide.collect()
    at = wide.columns.index("doc_id")
    assert sorted((tuple(r[at : at + 3]) for r in rows), key=repr) == plain
    for r in rows:
        for n, value in zip(wide.columns, r, strict=True):
            assert n in BASE or value == (n if r[at] is None else f"{n}:{r[at]}")


@pytest.mark.parametrize("operator,adds", [(quality.assess, quality.OUTPUTS), (mixing.mix, mixing.OUTPUTS)], ids=["assess", "mix"])
def test_operators(spark, operator, adds):
    docs = _docs(spark)
    plain = sorted(map(tuple, operator(docs).select("doc_id", *adds).collect()), key=repr)
    wide = operator(_with_extras(docs))
    left_out = {*adds, "text"} if operator is mixing.mix else {*adds}
    assert wide.columns == [*[c for c in _with_extras(docs).columns if c.lower() not in left_out], *adds]
    assert sorted(map(tuple, wide.select("doc_id", *adds).collect()), key=repr) == plain
