"""Every operator and stage gives the same rows when each row has a task of its own, so that some tasks see
nothing but a null or an empty text, and bears tables of such texts only."""

from __future__ import annotations

import pytest

import corpus_pipeline
from kinweave.llm import bpe, classifier, license, lm, mixing, pii, quality, repeats, simhash
from tests.llm import cases


def _classify(docs):
    labels = docs.sparkSession.createDataFrame([(i, i % 2) for i in range(16)], "doc_id bigint, label int")
    return classifier.classify(docs, labels).select("doc_id", "held_out")


OPERATORS = {
    "assess": lambda d: quality.assess(d).drop("text"),
    "near_duplicates": simhash.near_duplicates,
    "scan": license.scan,
    "encode": lambda d: bpe.digests(bpe.encode_decode(d.select("doc_id", "text"))),
    "classify": _classify,
    "remove": lambda d: repeats.remove(d.select("doc_id", "text"), 40, 16).drop("kept", "spans"),
    "score": lambda d: lm.learn_and_score(d).drop("token_score"),
    "mix": lambda d: mixing.mix(d.select("doc_id", "text", "source")),
    "find": lambda d: pii.find(d.select("doc_id", "text")),
}
STAGES = {name: (lambda d, f=f: f(d.sparkSession, d, "")) for name, f in corpus_pipeline.STAGES}


def apart(spark, rows):
    return spark.createDataFrame(spark.sparkContext.parallelize(rows, len(rows)), cases.SCHEMA)


def listed(df):
    return sorted((tuple(round(x, 9) if isinstance(x, float) else x for x in r) for r in df.collect()), key=repr)


ALL = OPERATORS | STAGES


@pytest.mark.parametrize("name", ALL)
def test_a_task_for_each_row(spark, name):
    rows = [r for r in cases.rows() if len(r[1] or "") < 1000]
    together = listed(ALL[name](spark.createDataFrame(rows, cases.SCHEMA).coalesce(1)))
    assert together and listed(ALL[name](apart(spark, rows))) == together


@pytest.mark.parametrize("name,text", [*((n, None) for n in ALL), *((n, t) for n in ("score", "encode") for t in ("", " \t\n"))])
def test_nothing_but_empty_texts(spark, name, text):
    rows = [(*r[:1], text, *r[2:]) for r in cases.rows()[:6]]
    out = ALL[name](apart(spark, rows))
    assert len(out.collect()) in ((0, 1, 6) if name in STAGES else (6,))
