"""The exact completion of similarity links: nothing is lost, whatever the sizes at which it goes another way."""

import random
from itertools import combinations

import numpy as np
import pytest

from kinweave.llm import setjoin, simhash
from tests.llm.test_simhash import brute_components, similar_groups

VOCABULARY = [f"w{i}" for i in range(4000)]


def families(rnd, count, size, words=(60, 160)):
    """Chains, trees and stars of texts whose neighbours have similarities from 0.80 to 0.93, near the threshold."""
    texts = []
    for f in range(count):
        base = [rnd.choice(VOCABULARY) for _ in range(rnd.randrange(*words))]
        members = [base]
        while len(members) < size:
            parent = members[-1] if f % 3 == 0 else rnd.choice(members) if f % 3 == 1 else base
            child = list(parent)
            for _ in range(rnd.choice([1, 1, 2])):
                at = rnd.randrange(len(child) - 6)
                child[at : at + rnd.choice([1, 3])] = [rnd.choice(VOCABULARY) for _ in range(rnd.choice([1, 2, 3]))]
            members.append(child)
        texts += [" ".join(m) for m in members]
    return texts


def passages(rnd, count):
    """Texts that share passages, and some that are little else."""
    shared = [[rnd.choice(VOCABULARY) for _ in range(60)] for _ in range(3)]
    return [" ".join([rnd.choice(VOCABULARY) for _ in range(rnd.choice([3, 8, 15, 40]))] + rnd.choice(shared) + [rnd.choice(VOCABULARY) for _ in range(rnd.choice([0, 3, 9]))]) for _ in range(count)]


@pytest.mark.parametrize("few,most,block", [(64, 1 << 16, 4096), (3, 1 << 16, 5), (2, 12, 3)])
def test_pairs(spark, few, most, block):
    """All similar pairs of different labels, from nothing known and from some labels known."""
    rnd = random.Random(few)
    texts = families(rnd, 5, 9) + passages(rnd, 60) + ["a b c", "a b c d e f", "a b c d e f g", "", "one"]
    hashes = simhash._elements(5)
    sets = [hashes(t) for t in texts]
    rows = spark.createDataFrame(list(enumerate(texts)), "row bigint, text string").repartition(4)
    similar = {(i, j) for i, j in combinations(range(len(texts)), 2) if len(sets[i]) and (both := len(np.intersect1d(sets[i], sets[j]))) >= 0.8 * (len(sets[i]) + len(sets[j]) - both)}
    assert len(similar) > 40
    for label in (list(range(len(texts))), [i // 9 if i < 20 else i for i in range(len(texts))]):
        nodes = spark.createDataFrame([(i, label[i]) for i in range(len(sets))], "row bigint, label bigint")
        pairs = setjoin.missing_pairs(rows, nodes, 0.8, hashes, few, most, block)
        got = {tuple(r) for r in pairs.collect()}
        want = {p for p in similar if label[p[0]] != label[p[1]]}
        assert want <= got and all(label[a] != label[b] and a < b for a, b in got)
        assert {tuple(r) for r in setjoin.verified(rows, pairs, 0.8, hashes).collect()} == want


@pytest.mark.parametrize("few", [64, 3])
def test_families_stay_whole(spark, few):
    rnd = random.Random(9)
    texts = families(rnd, 6, 60) + passages(rnd, 80)
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id bigint, text string").repartition(5)
    assert sorted(r.doc_id for r in simhash.keep_first(docs, few=few).collect()) == sorted(set(similar_groups(texts)))


def test_completion_finds_what_fingerprints_miss(spark, monkeypatch):
    """With hardly any link found by fingerprints the groups are the same."""
    monkeypatch.setattr(simhash, "REACH", 2)
    rnd = random.Random(11)
    texts = families(rnd, 6, 10)
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id bigint, text string").repartition(3)
    assert sorted(r.doc_id for r in simhash.keep_first(docs).collect()) == sorted(set(similar_groups(texts)))


def test_sketches_bound_what_sets_share():
    r = np.random.default_rng(5)
    for _ in range(200):
        pool = r.integers(-(1 << 62), 1 << 62, 400)
        a, b = (np.unique(r.choice(pool, r.integers(1, 300))) for _ in range(2))
        x, y = (np.frombuffer(setjoin.sketch(e), "<u2").astype(int) for e in (a, b))
        assert x.sum() == len(a) and np.minimum(x, y).sum() >= len(np.intersect1d(a, b))
    assert setjoin.sketch(np.arange(1 << 16) << 8) == b"" and len(setjoin.sketch(np.empty(0, np.int64))) == 2 * setjoin.BUCKETS


def test_crowded_elements_hand_a_pair_on_once(spark):
    """Rows meet at each of their 50 common elements; the pair comes from one of them."""
    rnd = random.Random(6)
    common = [rnd.randrange(-(1 << 62), 1 << 62) for _ in range(50)]
    sets = {r: np.array(sorted(common + [rnd.randrange(-(1 << 62), 1 << 62) for _ in range(rnd.randrange(3))])) for r in range(20)}
    over = spark.createDataFrame([(r, None, int(k), r, len(e)) for r, e in sets.items() for k in e], setjoin.SCHEMA)
    rows = [(r, setjoin.sketch(e), *([setjoin._firsts(e)] if hasattr(setjoin, "_firsts") else [])) for r, e in sets.items()]
    sketches = spark.createDataFrame(rows, "row bigint, sketch binary" + ", firsts binary" * (len(rows[0]) - 2))
    got = sorted(tuple(r) for r in setjoin._blockwise(over, sketches, 0.8, 6).collect())
    assert got == list(combinations(range(20), 2))


def test_fine_sketches_keep_what_is_similar(spark):
    """Large sets on both sides of a number of buckets, beside small ones: similar pairs stay, unlike ones of large sets go."""
    rnd = np.random.default_rng(4)
    draw = lambda n: rnd.integers(-(1 << 62), 1 << 62, n)
    sets = []
    for n in (1500, 2040, 2300, 4000, 4500, 9000):
        base = draw(n)
        sets += [np.unique(x) for x in (base, base[: int(0.81 * n)], np.r_[base, draw(n // 5)], np.r_[base[n // 10 :], draw(n // 10)], draw(n), draw(int(1.2 * n)))]
    texts = spark.createDataFrame([(i, str(i)) for i in range(len(sets))], "row bigint, text string").repartition(3)
    near = [p for p in combinations(range(len(sets)), 2) if 0.8 * max(len(sets[p[0]]), len(sets[p[1]])) <= min(len(sets[p[0]]), len(sets[p[1]]))]
    similar = {(i, j) for i, j in near if (both := len(np.intersect1d(sets[i], sets[j]))) >= 0.8 * (len(sets[i]) + len(sets[j]) - both)}
    got = {tuple(r) for r in setjoin.finely_possible(texts, spark.createDataFrame(near, "a bigint, b bigint"), 0.8, lambda text: sets[int(text)]).collect()}
    large = {(i, j) for i, j in near if min(len(sets[i]), len(sets[j])) > 8 * setjoin.BUCKETS}
    assert len(similar & large) > 10 and len(large - similar) > 40 and any(len(setjoin.fine_sketch(sets[i])) != len(setjoin.fine_sketch(sets[j])) for i, j in similar & large)
    assert similar <= got and set(near) - large <= got
    unlike = {(i, j) for i, j in large if not len(np.intersect1d(sets[i], sets[j]))}
    assert unlike and not unlike & got


def test_brute_components_agree():
    assert brute_components([(0, 1), (1, 2)], range(4)) == {0: 0, 1: 0, 2: 0, 3: 3}
