import random
import re
from itertools import combinations

import numpy as np
import pytest
import xxhash
from pyspark.sql import functions as F

from kinweave.llm import common, golay, simhash
from kinweave.llm.components import components
from tests.llm import cases


def brute_components(edges, nodes):
    label = {n: n for n in nodes}

    def find(x):
        while label[x] != x:
            x = label[x]
        return x

    for a, b in edges:
        a, b = find(a), find(b)
        label[max(a, b)] = min(a, b)
    return {n: find(n) for n in nodes}


def test_golay_indices_are_shared_within_two_bits():
    # The code is linear, so one word of each syndrome stands for all words.
    leaders = {}
    for w in range(4):
        for c in combinations(range(23), w):
            word = sum(1 << i for i in c)
            leaders.setdefault(int(golay.syndromes(np.array([word]))[0]), word)
    assert len(leaders) == 2048
    words = np.array(list(leaders.values()), np.uint32)
    near = np.array([sum(1 << i for i in c) for w in (0, 1, 2) for c in combinations(range(23), w)], np.uint32)
    own, n = golay.indices(words)
    assert set(n) == {1, 6}
    for i, word in enumerate(words):
        theirs, m = golay.indices(near ^ word)
        mine = own[i, : n[i]]
        shared = (theirs[:, :, None] == mine) & (np.arange(6)[None, :, None] < m[:, None, None])
        assert shared.any(axis=(1, 2)).all()


def test_fingerprint():
    def plain(text):
        w = text.encode().lower().split()
        s = [b" ".join(w[i : i + 4]) for i in range(max(1, len(w) - 3))] if w else []
        h = [xxhash.xxh64_intdigest(x, 42) for x in s]
        return sum(1 << b for b in range(64) if 2 * sum(x >> b & 1 for x in h) > len(h))

    for t in cases.TEXTS:
        assert simhash.fingerprint(t) % (1 << 64) == plain(t or "")


def test_hash_is_sparks(spark):
    h = spark.createDataFrame([("a b c d",)], "t string").select(F.xxhash64("t")).first()[0]
    assert h % (1 << 64) == xxhash.xxh64_intdigest(b"a b c d", 42)


@pytest.mark.parametrize("most", [1 << 16, 64])
def test_links(spark, most):
    r = np.random.Generator(np.random.PCG64(1))
    centre = int(r.integers(1 << 62))
    f = [int(x) for x in r.integers(-(1 << 62), 1 << 62, 300)]
    for _ in range(600):  # a dense group around one value, others around scattered ones
        x = centre if r.random() < 0.7 else f[int(r.integers(300))]
        for b in r.choice(63, int(r.integers(1, 6)), replace=False):
            x ^= 1 << int(b)
        f.append(x)
    f = sorted(set(f))
    u = np.array(f, np.int64).view(np.uint64)
    edges = [(f[i], f[j]) for i in range(len(f)) for j in (np.flatnonzero(np.bitwise_count(u[i + 1 :] ^ u[i]) <= 4) + i + 1).tolist()]
    df = spark.createDataFrame([(x,) for x in f], "f bigint")
    found = [tuple(x) for x in simhash.link(df, most=most).collect()]
    assert all(bin((a ^ b) % (1 << 64)).count("1") <= 4 for a, b in found)
    assert brute_components(found, f) == brute_components(edges, f)
    got = {x.node: x.label for x in components(simhash.link(df, most=most)).collect()}
    want = brute_components(edges, f)
    assert all(got.get(x, x) == want[x] for x in f)


def test_components_path(spark):
    df = spark.createDataFrame([(i, i + 1) for i in range(60)] + [(100, 101), (7, 7)], "a bigint, b bigint")
    assert {x.node: x.label for x in components(df).collect()} == {**{i: 0 for i in range(61)}, 100: 100, 101: 100}


def check(rows, got):
    prints = {(d, simhash.fingerprint(t)) for d, t in rows}
    f = sorted({x for _, x in prints})
    edges = [(a, b) for a, b in combinations(f, 2) if bin((a ^ b) % (1 << 64)).count("1") <= 4]
    of = brute_components(edges, f)
    first = {}
    for d, x in prints:
        if d is not None:
            first[of[x]] = min(first.get(of[x], d), d)
    want = sorted((d is None, d or 0, f"{simhash.fingerprint(t) % (1 << 64):016x}", first.get(of[simhash.fingerprint(t)])) for d, t in rows)
    assert sorted((r.doc_id is None, r.doc_id or 0, r.fingerprint, r.component_id) for r in got) == want


def test_near_duplicates(spark):
    docs = cases.small(spark)
    check([(r.doc_id, r.text) for r in docs.collect()], simhash.near_duplicates(docs).collect())
    check([(r[0], r[1]) for r in cases.rows()], simhash.near_duplicates(cases.docs(spark)).collect())
    assert simhash.near_duplicates(cases.empty(spark)).count() == 0


def similar_groups(texts, similarity=0.8, width=5):
    """For each text the first one of its group, by comparing all pairs."""
    sets = []
    for t in texts:
        w = re.sub("[A-Z]", lambda m: m[0].lower(), t or "").encode().split()
        sets.append({tuple(w[i : i + width]) for i in range(max(1, len(w) - width + 1))} if w else set())
    of = list(range(len(texts)))

    def root(i):
        while of[i] != i:
            i = of[i]
        return i

    for i in range(len(texts)):
        for j in range(i):
            both = len(sets[i] & sets[j])
            if both >= similarity * (len(sets[i]) + len(sets[j]) - both) and bool(sets[i]) == bool(sets[j]):
                x, y = sorted((root(i), root(j)))
                of[y] = x
    return [root(i) for i in range(len(texts))]


def test_keep_first(spark):
    """Copies with a few words changed, a chain of them, many copies, short, empty and null texts, and ties."""
    rnd = random.Random(5)
    vocabulary = [f"w{i}" for i in range(3000)]
    rows = []
    for _ in range(25):
        base = [rnd.choice(vocabulary) for _ in range(rnd.randrange(30, 400))]
        for _ in range(rnd.randrange(1, 6)):
            edited = [rnd.choice(vocabulary) if rnd.random() < 0.015 else x for x in base]
            rows.append(" ".join(edited).upper() if rnd.random() < 0.3 else "  ".join(edited))
    chain = [rnd.choice(vocabulary) for _ in range(300)]
    for i in range(20):
        chain = [*chain[:10 * i], *[rnd.choice(vocabulary) for _ in range(5)], *chain[10 * i + 5 :]]
        rows.append(" ".join(chain))
    rows += [rows[3]] * 200 + [None, "", " \t", "one", "one", "two words", "one two three four five"]
    docs = spark.createDataFrame(list(enumerate(rows)), "doc_id bigint, text string")
    first = similar_groups(rows)
    assert len(set(first)) < 80
    for number, given in ((common.stored, docs), (common.placed, docs.repartition(7))):
        assert sorted(r.doc_id for r in simhash.keep_first(given, number=number).collect()) == sorted(set(first))
    same = [(1, "a b c d e f g", "x"), (1, "a b c d e f g h", "y"), (None, "a b c d e f g", "z"), (None, None, "n"), (2, "", "m")]
    want = None
    for order in (same, same[::-1]):
        kept = sorted(map(tuple, simhash.keep_first(spark.createDataFrame(order, "doc_id bigint, text string, extra string").coalesce(1)).collect()), key=repr)
        assert want is None or kept == want
        want = kept
    assert [r[2] for r in want if r[0] == 2] == ["m"] and all(r[0] is not None for r in want)
    docs = cases.docs(spark)
    kept = simhash.keep_first(docs)
    assert kept.columns == docs.columns and 0 < kept.count() < docs.count()
    assert simhash.keep_first(cases.empty(spark)).count() == 0


def test_keep_first_on_documents(spark, sf_dir):
    """All documents of the smallest scale against all pairs."""
    rows = sorted((r.doc_id, r.text) for r in spark.read.parquet(f"{sf_dir}/documents.parquet").collect())
    first = similar_groups([t for _, t in rows])
    got = [r.doc_id for r in simhash.keep_first(spark.read.parquet(f"{sf_dir}/documents.parquet"), number=common.placed).collect()]
    assert sorted(got) == sorted(rows[i][0] for i in set(first))


def test_nearest_codewords():
    r = np.random.default_rng(6)
    margins = r.normal(size=(200, 23))
    words = np.arange(1 << 23, dtype=np.uint32)
    words = words[golay.syndromes(words) == 0]
    signs = np.where(words[:, None] >> np.arange(23, dtype=np.uint32) & 1, 1, -1)
    want = np.argsort(-(margins @ signs.T), axis=1)[:, :3]
    assert len(words) == 4096 and (words[want] >> 11 == golay.nearest(margins, 3)).all()
