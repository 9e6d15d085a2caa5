import re
from collections import Counter

import pytest

from kinweave.llm import mixing, quality, query_native
from tests.llm import cases
from tests.oracle import compare, connect

WORD = re.compile(r"[^\x20\x09-\x0D]+")


@pytest.mark.parametrize("name", sorted(query_native.QUERIES))
def test_equals_sql(spark, sf_dir, name):
    assert compare(query_native.QUERIES[name](spark, sf_dir), query_native.SQL[name], connect(sf_dir)) == 200


def expected(text):
    text = text or ""
    w = WORD.findall(text)
    g = [tuple(w[i : i + 5]) for i in range(len(w) - 4)]
    c = Counter(g)
    lines = [x for x in text.split("\n") if WORD.search(x)]
    again = {i + j for i, x in enumerate(g) if c[x] > 1 for j in range(5)}
    return len(w), sum(map(len, w)), len(re.findall(r"[#*$%&|<>]", text)), len(lines) - len(set(lines)), len(again)


def test_quality_edges(spark):
    got = sorted((r.doc_id is None, r.doc_id or 0, r.n_words, r.word_chars, r.n_symbols, r.n_dup_lines, r.n_repeat_words) for r in quality.assess(cases.docs(spark)).collect())
    want = sorted((r[0] is None, r[0] or 0, *expected(r[1])) for r in cases.rows())
    assert got == want
    assert quality.assess(cases.empty(spark)).count() == 0


def test_quality_verdicts(spark):
    clean = "The house of the old man was in a valley that is far from the sea, and for many years it stood there with the doors open. " * 1
    texts = [clean, "erh*** reed*** ndsh*** ing&&& erhe*** of%%% to%%% inrent$$$ antion&&& ou%%% ab*** cd*** reth*** iser$$$ ther&&& oned%%% eas*** tion$$$ here*** ates&&& ingl%%%", " | ".join(f"keyword{chr(97 + i % 26)}{chr(97 + i // 26)}" for i in range(60))]
    kept = [r.kept for r in quality.assess(spark.createDataFrame([(t,) for t in texts], "text string")).collect()]
    assert kept == [True, False, False]


def test_reject_keeps_columns(spark):
    out = quality.reject(cases.docs(spark))
    assert out.columns == cases.docs(spark).columns
    assert {r.doc_id for r in out.collect()} == {r.doc_id for r in quality.assess(cases.docs(spark)).where("kept").collect()}


def test_mixing_edges(spark):
    out = mixing.mix(cases.docs(spark)).collect()
    assert len(out) == len(cases.rows())
    assert all(0 <= r.taken <= 2 * r["size"] for r in out)
    by = {}
    for r in out:
        by.setdefault(r.source, []).append(r)
    whole = sum(r["size"] for r in out)
    assert abs(sum(v[0].target for v in by.values()) - 1.5 * whole) < 1e-6 * whole
    for v in by.values():
        assert v[0].source_size == sum(r["size"] for r in v)
        assert abs(sum(r.taken for r in v) - v[0].target) <= 16
    assert mixing.mix(cases.empty(spark)).count() == 0


def test_mixing_many_shards_and_reruns(spark):
    docs = spark.range(3000).selectExpr("id as doc_id", "repeat('w ', int(id % 37)) as text", "if(id % 3 = 0, 'hot', concat('s', id % 5)) as source")
    out = mixing.mix(docs, shard_docs=100)
    again = mixing.mix(docs.repartition(7), shard_docs=100)
    assert sorted(map(tuple, out.collect())) == sorted(map(tuple, again.collect()))
    for r in out.groupBy("source").agg({"taken": "sum", "target": "max"}).collect():
        assert abs(r["sum(taken)"] - r["max(target)"]) <= 16


def test_apportion_is_highest_quotients(spark):
    from pyspark.sql import functions as F

    for votes, seats in (([340, 280, 160, 60, 15], 8), ([1, 1, 1], 2), ([1000, 1, 1, 1], 50), ([5, 0, 7], 13), ([10] * 7, 3)):
        df = spark.createDataFrame(list(enumerate(votes)), "k int, v bigint")
        got = {r.k: r.s for r in mixing.apportion(df, [], [F.col("k")], "v", F.lit(seats), "s").collect()}
        won = Counter(k for _, k, _ in sorted((-v / (2 * j + 1), k, j) for k, v in enumerate(votes) if v for j in range(seats))[:seats])
        assert got == {k: won[k] for k in range(len(votes))}


def test_mixing_plan_stays_small(spark):
    """The apportionments are read back, not worked out again wherever they are used."""
    plan = mixing.mix(cases.docs(spark))._jdf.queryExecution().executedPlan().toString()
    assert plan.count("Exchange") <= 12


def test_resample(spark):
    docs = cases.docs(spark)
    taken = {r.doc_id: r.taken for r in mixing.mix(docs).where("doc_id is not null and doc_id <> 4 and doc_id <> 5").collect()}
    out = mixing.resample(docs)
    assert out.columns == docs.columns
    words = Counter()
    for r in out.collect():
        words[r.doc_id] += len(WORD.findall(r.text))
    assert all(words[k] == n for k, n in taken.items())
    assert mixing.resample(cases.empty(spark)).count() == 0


def test_parts_grow_with_the_documents():
    """A source with all documents has a part for each of its shards, however many."""
    assert mixing.parts_for(0, 4096) == mixing.parts_for(4096 * 4096, 4096) == 4096
    assert mixing.parts_for(4096 * 4096 + 1, 4096) == 8192 and mixing.parts_for(10**9, 4096) == 1 << 18
    for n in (1, 10**5, 10**8, 10**10):
        assert mixing.parts_for(n, 4096) >= n / 4096


def test_more_parts_take_the_same_words(spark, monkeypatch):
    """With few parts to begin with they grow, and each source still comes to its target."""
    monkeypatch.setattr(mixing, "PARTS", 4)
    rows = [(i, " ".join(["w"] * (1 + i % 50)), "abc"[i % 3]) for i in range(900)]
    got = mixing.mix(spark.createDataFrame(rows, "doc_id bigint, text string, source string"), shard_docs=20).collect()
    for s in "abc":
        of = [r for r in got if r.source == s]
        assert len(of) == 300 and abs(sum(r.taken for r in of) - of[0].target) <= 16 * 16 and all(r.taken <= 2 * r.size for r in of)
