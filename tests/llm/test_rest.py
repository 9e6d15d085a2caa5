"""License scan, classifier, repeats, top-k, language model and personal data against plain versions."""

import hashlib
import math
import random
import re
import tracemalloc
import zlib
from collections import Counter

import numpy as np
import pyarrow as pa
import pytest

from kinweave.llm import classifier, common, eliasfano, license, lm, pii, query_topk, repeats, topk
from tests.llm import cases
from tests.oracle import compare, connect


# License scan

FOLDED = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")


def lower(text):
    return re.sub("[A-Z]", lambda m: m[0].lower(), text or "")


def test_license(spark):
    mit, apache = license.TEMPLATES[0][1], license.TEMPLATES[3][1]
    changed = mit.replace("free of charge", "wholly free of any charge").replace("to deal in the Software", "to deal in this Software")
    extra = [(50, "some words before " + changed + " and after"), (51, apache), (52, "MIT license, mit LICENSE; General Public License"), (53, "mit apache license"), (54, mit[:60])]
    docs = spark.createDataFrame([(r[0], r[1]) for r in cases.rows()] + extra, "doc_id bigint, text string")
    got = license.scan(docs).collect()
    assert len(got) == docs.count()
    texts = Counter((r.doc_id, r.text) for r in docs.collect())
    base = Counter()
    for (d, t), n in texts.items():
        w = FOLDED.findall(lower(t))
        places = sorted((i, x) for p, x in license.PHRASES.items() for i in range(len(w)) if w[i : i + len(p.split())] == p.split())
        base[(d, len(w), len(places), places[0][0] if places else None, places[-1][0] if places else None, ",".join(sorted({x for _, x in places})))] += n
    assert Counter((r.doc_id, r.n_words, r.n_base, r.first_word, r.last_word, r.base_labels) for r in got) == base
    by = {r.doc_id: r for r in got}
    assert by[50].labels == "mit" and by[50].n_base == 0 and 0.6 <= by[50].score <= 1 and by[50].spans[0]["first"] == 3
    assert "apache" in by[51].labels.split(",") and by[52].labels == "gpl,mit" and by[52].n_base == 3
    assert by[53].labels == "apache" and by[54].labels == "" and by[4].score == 0
    assert license.scan(cases.empty(spark)).count() == 0


def test_license_inserted_words(spark):
    """Repeated 4-grams give stray diagonals; every long template is found with one word put in anywhere, BSD with two."""
    rows = []
    for t, (label, text) in enumerate(license.TEMPLATES):
        w = FOLDED.findall(lower(text))
        if len(w) < 30:
            continue
        places = [(i,) for i in range(1, len(w))]
        if label == "bsd":
            places += [(i, j) for i in range(1, len(w)) for j in range(i, len(w))]
        for at in places:
            edited = list(w)
            for i in reversed(at):
                edited.insert(i, "zzz")
            rows.append((f"{label} {t} {at}", " ".join(edited)))
    docs = spark.createDataFrame(rows, "doc_id string, text string")
    missed = [r.doc_id for r in license.scan(docs).collect() if r.doc_id.split()[0] not in [s.label for s in r.spans]]
    assert len(rows) > 2000 and not missed


def test_license_repeated_phrases(spark):
    """A phrase said again and again is not a license, however often; a license beside it is still found."""
    mit, wide = license.TEMPLATES[0][1], " ".join(f"w{i}" for i in range(40))
    periodic = ["to deal in the " * 25, "of the software and " * 30, "the following conditions " * 5000, "to deal in the " * 4000]
    rows = [*enumerate(periodic), (10, periodic[0] + mit), (11, f"{mit} {periodic[0]}"), (12, f"{periodic[3]}{wide} {mit} {wide} {periodic[3]}"), (13, f"{mit} {wide} {mit}")]
    got = {r.doc_id: r for r in license.scan(spark.createDataFrame(rows, "doc_id bigint, text string")).collect()}
    assert all(got[i].labels == "" and got[i].score == 0 and not got[i].spans for i in range(4))
    n = len(FOLDED.findall(lower(mit)))
    for i, starts in ((10, [100]), (11, [0]), (12, [16040]), (13, [0, n + 40])):
        assert got[i].labels == "mit" and [(s["first"], s["end"]) for s in got[i].spans if s["cover"] == 1] == [(a, a + n) for a in starts]


def test_license_recall_and_brute_force(spark):
    """Copies with words changed, put in or left out, against an alignment of every window of the text."""
    rnd, rows = random.Random(4), []
    for t, (label, text) in enumerate(license.TEMPLATES):
        w = FOLDED.findall(lower(text))
        for rate in (0.02, 0.05, 0.1, 0.3, 0.6) if len(w) >= 30 else ():
            for _ in range(12):
                edited = []
                for x in w:
                    r = rnd.random()
                    edited += [x] if r > rate else [rnd.choice(w)] if r < rate / 3 else [x, "zzz"] if r < 2 * rate / 3 else []
                rows.append((f"{label} {t} {rate}", " ".join([*["aa"] * rnd.randrange(9), *edited, *["bb"] * rnd.randrange(9)])))
    got = Counter()
    for r in license.scan(spark.createDataFrame(rows, "doc_id string, text string").coalesce(2)).collect():
        label, _, rate = r.doc_id.split()
        got[rate] += label in [s.label for s in r.spans]
    each = len(rows) / 5
    assert got["0.02"] == each and got["0.05"] == each and got["0.1"] >= 0.9 * each

    def aligned(text, template, k=4):
        """Whether the common k-grams, chained in order, cover the template densely, by plain dynamic programming."""
        a, b = FOLDED.findall(lower(text)), FOLDED.findall(lower(template))
        pairs = sorted({(i + d, j + d) for i in range(len(a) - k + 1) for j in range(len(b) - k + 1) if a[i : i + k] == b[j : j + k] for d in range(k)})
        best = [1] * len(pairs)
        for x in range(len(pairs)):
            for y in range(x):
                if pairs[y][0] < pairs[x][0] and pairs[y][1] < pairs[x][1]:
                    best[x] = max(best[x], best[y] + 1)
        return max(best, default=0) / len(b)

    few = [r for r in rows if r[0].endswith("0.3")][::3] + [r for r in rows if r[0].endswith("0.1")][::8]
    for name, text in few:
        t = int(name.split()[1])
        pos, at = [], []
        a, b = FOLDED.findall(lower(text)), FOLDED.findall(lower(license.TEMPLATES[t][1]))
        for i in range(len(a) - 3):
            for j in range(len(b) - 3):
                if a[i : i + 4] == b[j : j + 4]:
                    pos.append(i)
                    at.append(j)
        assert len(license.chain(np.array(pos, np.int64), np.array(at, np.int64), 4)) / len(b) == aligned(text, license.TEMPLATES[t][1])


# Quality classifier


def test_classifier(spark, sf_dir):
    docs, labels = spark.read.parquet(f"{sf_dir}/documents.parquet"), spark.read.parquet(f"{sf_dir}/labels.parquet").selectExpr("doc_id", "quality as label")
    got = {r.doc_id: r for r in classifier.classify(docs, labels).collect()}
    known = {r.doc_id: r.label for r in labels.collect()}
    assert all(r.held_out == (zlib.crc32(str(k).encode()) % 3 == 1) and 0 <= r.score <= 1 and r.predicted == int(r.score >= 0.5) for k, r in got.items())
    held = [got[k].predicted == y for k, y in known.items() if k in got and got[k].held_out]
    assert sum(held) >= 0.9 * len(held)
    # Labels of held-out rows change nothing.
    flipped = labels.selectExpr("doc_id", "if(crc32(cast(doc_id as string)) % 3 = 1, 1 - label, label) as label")
    assert {r.doc_id: r.score for r in classifier.classify(docs, flipped).collect()} == {k: r.score for k, r in got.items()}


def test_classifier_edges(spark):
    labels = spark.createDataFrame([(1, 1), (2, None), (None, 0), (3, 7)], "doc_id bigint, label int")
    out = classifier.classify(cases.docs(spark), labels).collect()
    assert len(out) == len(cases.rows()) and len({r.score for r in out}) == 1
    assert classifier.classify(cases.empty(spark), labels).count() == 0


def test_context_sums():
    texts, buckets, size, ones, window = [np.array([1, 2, 1, 3]), np.array([2, 2])], 5, 8, 2, 2
    place, sign = classifier.index_vectors(buckets, size, ones)
    want = np.zeros((buckets, size + 1))
    for t in texts:
        for i, w in enumerate(t):
            want[w, -1] += 1
            for j in range(max(0, i - window), min(len(t), i + window + 1)):
                if j != i:
                    for k in range(ones):
                        want[w, (place[t[j], k] + (classifier.TURN if j > i else 0)) % size] += sign[t[j], k]
    assert (classifier.context_sums(texts, buckets, size, ones, window) == want).all()


def test_pooled():
    vectors = np.random.default_rng(2).normal(size=(50, 6)).astype(np.float32)
    texts = [None, "", "one", "a b c a b", " ".join(f"w{i % 13}" for i in range(400))]
    for text, got in zip(texts, classifier.pooled(texts, vectors, piece=64), strict=True):
        v = [vectors[k].astype(float) for k in classifier.tokens(text, 50)]
        mean = sum(v) / len(v) if v else np.zeros(6)
        spread = (sum((x - mean) ** 2 for x in v) / len(v)) ** 0.5 if v else np.zeros(6)
        pairs = sum((x * y for x, y in zip(v, v[1:])), np.zeros(6)) / max(len(v) - 1, 1)
        assert np.allclose(got, np.r_[mean, spread, pairs], atol=2e-3 if len(v) < 2 else 1e-5)


def test_network():
    """The forward pass against plain loops, and on held-out rows of a known law a small loss and calibrated scores."""
    r = np.random.default_rng(3)
    x = r.normal(size=(6000, 5)) * 3 + 2
    chance = 1 / (1 + np.exp(-(1.5 * (x[:, 0] - 2) / 3 - 1.0 * (x[:, 1] - 2) / 3)))
    y = (r.random(6000) < chance).astype(float)
    n = classifier.Network(x[:4000], y[:4000])
    got = n.score(x[4000:])
    for i in range(3):
        z = [(a - m) / s for a, m, s in zip(x[4000 + i], n.mean, n.scale, strict=True)]
        hidden = [math.tanh(sum(z[j] * n.w[0][j, h] for j in range(5)) + n.w[1][h]) for h in range(32)]
        logit = sum(a * b for a, b in zip(hidden, n.w[2], strict=True)) + n.w[3][0]
        assert math.isclose(got[i], 1 / (1 + math.exp(-logit / n.temperature)), rel_tol=1e-9)
    loss = lambda p: -np.mean(y[4000:] * np.log(p) + (1 - y[4000:]) * np.log(1 - p))
    assert loss(got) < loss(chance[4000:]) + 0.03
    part = (got * 5).astype(int).clip(0, 4)
    assert sum((part == k).mean() * abs(got[part == k].mean() - y[4000:][part == k].mean()) for k in range(5) if (part == k).any()) < 0.05


# Repeats


def brute_repeats(texts, length):
    data = [(t or "").encode() for t in texts]
    count = Counter(hash(d[i : i + length]) for d in data for i in range(len(d) - length + 1))
    for d in data:
        gone = np.zeros(len(d), bool)
        for i in range(len(d) - length + 1):
            if count[hash(d[i : i + length])] > 1:
                gone[i : i + length] = True
        kept = np.frombuffer(d, np.uint8)[~gone].tobytes()
        yield len(d), int(gone.sum()), int((np.diff(np.r_[0, gone.astype(int)]) == 1).sum()), hashlib.sha256(kept).hexdigest()


def test_repeats(spark, monkeypatch):
    rnd = random.Random(1)
    parts = ["".join(rnd.choice("ab c") for _ in range(rnd.randrange(5, 60))) for _ in range(20)]
    rows = [(i, None if i % 50 == 0 else "".join(rnd.choice(parts) if rnd.random() < 0.5 else "".join(rnd.choice("abcdé ") for _ in range(rnd.randrange(1, 40))) for _ in range(rnd.randrange(0, 8)))) for i in range(200)]
    rows += [rows[7], (900, "a" * 300), (None, "xyz" * 50), (901, ""), (902, "short")]
    df = spark.createDataFrame(rows, "doc_id bigint, text string").repartition(3).cache()
    rows = [(r.doc_id, r.text) for r in df.collect()]
    monkeypatch.setattr(repeats, "BATCH_WINDOWS", 200)
    got = Counter((r.doc_id, r.n_bytes, r.n_removed, r.n_spans, r.kept_sha256) for r in repeats.remove(df, 24, 4).collect())
    assert got == Counter((d, *x) for (d, _), x in zip(rows, brute_repeats([t for _, t in rows], 24), strict=True))
    assert repeats.remove(cases.empty(spark)).count() == 0
    df.unpersist()


def test_repeats_memory(monkeypatch):
    """However many open positions a task meets, it holds a bounded number of them."""
    n, column = 20_000, lambda *x: np.array(x, np.int64)
    whole = {"at": column(0), "lo": column(0), "hi": column(n - 400), "g": column(1), "n": column(1)}
    monkeypatch.setattr(repeats, "Beside", type("Everywhere", (), {"__init__": lambda self, uri: None, "of": lambda self, row: whole}))
    rnd = np.random.default_rng(2)
    texts = [bytes(rnd.integers(97, 123, n, dtype=np.uint8)).decode() for _ in range(80)]
    batch = pa.RecordBatch.from_arrays([pa.array(range(80)), pa.array(texts)], names=["row", "text"])
    tracemalloc.start()
    out = sum(x.num_rows for x in repeats._windows(400, 200, 80, "", "", "lower")([batch]))
    most = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert out > 80 * (n - 800) and most < 120e6


def test_repeats_edges(spark):
    rows = [(r[0], r[1]) for r in cases.rows()]
    docs = spark.createDataFrame(rows, "doc_id bigint, text string").coalesce(1)
    got = Counter((r.doc_id, r.n_bytes, r.n_removed, r.n_spans, r.kept_sha256) for r in repeats.remove(docs, 40, 16).collect())
    assert got == Counter((d, *x) for (d, _), x in zip(rows, brute_repeats([t for _, t in rows], 40), strict=True))


def test_repeats_at_ends(spark):
    """Grams with nothing on one side, alone in their batch."""
    rnd = random.Random(12)
    piece = lambda n: "".join(rnd.choice("abcdefghij") for _ in range(n))
    shared = piece(12)
    for rows in ([piece(30) + shared, piece(31) + shared], [shared + piece(30), shared + piece(31)], [shared, shared], [piece(24)], [piece(60), shared * 3]):
        docs = spark.createDataFrame(list(enumerate(rows)), "doc_id bigint, text string").coalesce(1)
        got = sorted((r.n_bytes, r.n_removed, r.n_spans, r.kept_sha256) for r in repeats.remove(docs, 24, 8).collect())
        assert got == sorted(brute_repeats(rows, 24))


def test_repeats_documents(spark, sf_dir):
    """Production lengths on all documents of the smallest scale, longest_repeat too, with some long texts added."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text")
    rnd = random.Random(8)
    first = [r.text for r in docs.where("doc_id < 6").collect()]
    long = [" ".join(f"{rnd.random()}" for _ in range(8000)) + x for x in first[:2]] + [first[3][:300] + "x" * 1000]
    docs = docs.union(spark.createDataFrame([(10**9 + i, t) for i, t in enumerate(long)], "doc_id bigint, text string"))
    rows = [tuple(r) for r in docs.collect()]
    data = [(t or "").encode() for _, t in rows]
    longest = [0] * len(rows)
    for length in (200, 400):
        count = Counter(hash(d[i : i + length]) for d in data for i in range(len(d) - length + 1))
        longest = [length if any(count[hash(d[i : i + length])] > 1 for i in range(len(d) - length + 1)) else x for d, x in zip(data, longest, strict=True)]
    got = Counter((r.doc_id, r.n_bytes, r.n_removed, r.n_spans, r.kept_sha256, r.longest_repeat) for r in repeats.remove(docs).collect())
    assert got == Counter((d, *x, n) for (d, _), x, n in zip(rows, brute_repeats([t for _, t in rows], 400), longest, strict=True))
    assert {0, 200, 400} == set(longest)


@pytest.mark.parametrize("way", ["stored", "placed"])
def test_repeats_other_splits(spark, tmp_path, way):
    """Files are split anew between the jobs, as when an executor joins or is lost."""
    rnd = random.Random(2)
    passage = "".join(rnd.choice("abcdefgh ") for _ in range(60))
    rows = [(i, "".join(rnd.choice("abcdefgh ") for _ in range(rnd.randrange(40, 90))) + (passage if i % 3 == 0 else "")) for i in range(70)]
    spark.createDataFrame(rows, "doc_id bigint, text string").repartition(9).write.parquet(f"{tmp_path}/documents.parquet")
    name = "spark.sql.files.maxPartitionBytes"
    before = spark.conf.get(name)
    try:
        docs = spark.read.parquet(f"{tmp_path}/documents.parquet")
        assert docs.rdd.getNumPartitions() < 9
        out = repeats.remove(docs, 24, 8, number=getattr(common, way))
        spark.conf.set(name, "1m")
        got = Counter((r.doc_id, r.n_bytes, r.n_removed, r.n_spans, r.kept_sha256) for r in out.collect())
    finally:
        spark.conf.set(name, before)
    assert got == Counter((d, *x) for (d, _), x in zip(rows, brute_repeats([t for _, t in rows], 24), strict=True))


# Top-k


def test_topk_equals_sql(spark, sf_dir):
    assert compare(query_topk.op7(spark, sf_dir), query_topk.SQL["op7_exact_topk"], connect(sf_dir)) == 50


def test_topk_edges(spark):
    nan, inf = float("nan"), float("inf")
    rows = [(0, [1.0, 0.5]), (1, [1.0, 0.5]), (2, [1.0, 0.5]), (2, [1.0, 0.5]), (3, None), (4, [nan, 1.0]), (5, [inf, 1.0]), (6, [None, 1.0]), (7, []), (8, [-1.0]), (9, [0.0, 0.0, 3.0]), (None, [1.0])]
    df = spark.createDataFrame(rows, "id bigint, v array<double>")
    got = [(r.query_id, r["rank"], r.vec_id, r.score) for r in topk.search(df.where("id in (0, 3)"), df, k=4).orderBy("rank").collect()]
    same = 1024 * 1024 + 512 * 512
    assert got == [(0, 1, 1, same), (0, 2, 2, same), (0, 3, 2, same), (0, 4, 7, 0)]
    assert topk.search(df.limit(0), df).count() == 0 and topk.search(df.where("id = 0"), df.limit(0)).count() == 0


# Language model


def test_elias_fano():
    r = np.random.default_rng(1)
    for n, u in ((0, 1), (1, 1), (5, 10), (5000, 10**6), (20000, 2**40), (3000, 2**62), (1000, 70)):
        v = np.sort(r.integers(0, u, n).astype(np.uint64))
        c = eliasfano.Codes(np.r_[eliasfano.encode(v, u), np.uint64(9)])
        assert (c.all() == v).all()
        if n:
            x = r.integers(0, u, 2000).astype(np.uint64)
            assert (c.get(np.arange(n)) == v).all() and (c.successor(x) == np.searchsorted(v, x)).all()
            assert ((c.find(x) >= 0) == np.isin(x, v)).all()


@pytest.mark.parametrize("options", [{}, {"range_tokens": 500, "range_words": 40}, {"order": 4, "range_tokens": 90}, {"order": 2}])
def test_language_model(spark, options):
    rows = [(r.doc_id, r.text) for r in cases.small(spark, 120).collect()] + [(r[0], r[1]) for r in cases.rows() if r[0] is not None]
    got = lm.learn_and_score(spark.createDataFrame(rows, "doc_id bigint, text string"), **options).collect()
    order = options.get("order", 3)

    def tokens(t):
        return [*lower(t).encode().split(), b" "]

    def grams(t, n):
        """(context, word) for each token that has n - 1 before it, the end that a text begins after among them."""
        s = [b" ", *tokens(t)]
        return [(tuple(s[i - n + 1 : i]), s[i]) if i >= n - 1 else None for i in range(1, len(s))]

    word, gram, context = Counter(), Counter(), Counter()
    for d, t in rows:
        if zlib.crc32(str(d).encode()) % 7 != 2:
            word.update(tokens(t))
            for m in range(2, order + 1):
                gram.update(found := [g for g in grams(t, m) if g])
                context.update(c for c, _ in found)
    n, v, followers = sum(word.values()), len(word), Counter(c for c, _ in gram)
    want, own = Counter(), {}
    for d, t in rows:
        k = tokens(t)
        p = [(word[w] + 1) / (n + v + 1) for w in k]
        base = sum(map(math.log10, p))
        want[(d, zlib.crc32(str(d).encode()) % 7 == 2, len(k), sum(word[w] > 0 for w in k), n, round(base, 4))] += 1
        for m in range(2, order + 1):
            p = [x if g is None or not context[g[0]] else max(gram[g] - 0.75, 0) / context[g[0]] + 0.75 * followers[g[0]] / context[g[0]] * x for g, x in zip(grams(t, m), p, strict=True)]
        own[(d, len(k), round(base, 4))] = sum(map(math.log10, p))
    assert Counter((r.doc_id, r.held_out, r.n_tokens, r.n_known, r.train_tokens, round(r.base_score, 4)) for r in got) == want
    # Quantising moves each level's part of a token's probability by at most half a step.
    assert all(abs(r.score - own[(r.doc_id, r.n_tokens, round(r.base_score, 4))]) <= (order - 1) * r.n_tokens * math.log10(2) / lm.STEPS / 2 + 1e-6 for r in got)
    assert all(math.isclose(r.token_score, r.score / r.n_tokens) for r in got)


def test_word_ranges(spark):
    """Ranges of words follow the different words, not the texts; many small ones; blocks fold in bounded memory."""
    for n, copies in ((3, 1), (500, 1), (500, 9), (60_000, 1)):
        text = " ".join(f"w{i}" for i in range(n))
        texts = spark.createDataFrame([(text,)] * copies, "text string").repartition(4)
        found = lm.different_words(texts)
        assert abs(found - (n + 1)) <= max(2, 0.12 * n), (n, found)
    assert lm.different_words(cases.empty(spark).select("text")) == 0
    docs = cases.small(spark, 60).select("text")
    one, many = lm.train(docs), lm.train(docs, range_words=50, range_tokens=200)
    assert len(many.words.bounds) == -(-lm.different_words(docs) // 50) > 20 and len(one.words.bounds) == 2
    assert (one.tokens, one.size, one.ends) == (many.tokens, many.size, many.ends)
    r = np.random.default_rng(2)
    parts = [np.unique(r.integers(0, 5000, 400).astype(np.uint64), return_counts=True) for _ in range(60)]
    keys, counts = lm.merge((lm.block(*x) for x in parts), most=700)
    want = Counter()
    for k, c in parts:
        want.update(dict(zip(k.tolist(), c.tolist(), strict=True)))
    assert dict(zip(keys.tolist(), counts.tolist(), strict=True)) == want and (np.diff(keys.astype(np.int64)) > 0).all()


def test_models_leave_no_copies(spark, tmp_path, monkeypatch):
    files = lm.Files(f"file://{tmp_path}/model")
    files.write("a", np.arange(9, dtype=np.uint64))
    files.local = False
    (tmp_path / "own").mkdir()
    monkeypatch.setattr(lm.tempfile, "tempdir", str(tmp_path / "own"))
    x = files.read("a")
    assert x.tolist() == list(range(9)) and not list((tmp_path / "own").iterdir())


def test_language_model_edges(spark):
    assert lm.learn_and_score(cases.empty(spark)).count() == 0
    assert lm.learn_and_score(cases.docs(spark)).count() == len(cases.rows())
    none = spark.createDataFrame([(3, "a b")], "doc_id bigint, text string")
    held = next(i for i in range(100) if zlib.crc32(str(i).encode()) % 7 == 2)
    r = lm.learn_and_score(none.selectExpr(f"bigint({held}) as doc_id", "text")).first()
    assert (r.n_tokens, r.n_known, r.train_tokens, r.base_score) == (3, 0, 0, 0.0)


# Personal data

PATTERNS = {"email": r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+", "ip": r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)", "card": r"[0-9]([\x20-]?[0-9])+", "phone": r"\+[0-9][\x20().0-9-]+[0-9]"}


def brute_spans(t):
    def holds(k, s):
        d = [int(c) for c in s if c in "0123456789"]
        return k == "email" or (k == "ip" and all(int(p) <= 255 for p in s.split("."))) or (k == "card" and 12 <= len(d) <= 19 and pii.luhn(d)) or (k == "phone" and 9 <= len(d) <= 15)

    return sorted(((k, m.start(), m.end()) for k in pii.KINDS if k != "email" or "@" in t for m in re.finditer(PATTERNS[k], t) if holds(k, m[0])), key=lambda s: (s[1], pii.KINDS.index(s[0])))


def test_base_spans():
    rnd = random.Random(1)
    for _ in range(40_000):
        t = "".join(rnd.choice("a.@-1+ 2(é0") for _ in range(rnd.randrange(40)))
        assert pii.base_spans(t) == brute_spans(t)
    assert pii.luhn([int(c) for c in "4111111111111111"]) and not pii.luhn([int(c) for c in "4111111111111112"])


@pytest.mark.parametrize(
    ("text", "kind", "found"),
    [
        ("write jane [at] example [dot] com now", "email", "jane [at] example [dot] com"),
        ("jane (at) example.com", "email", "jane (at) example.com"),
        ("so b at mail dot example dot com", "email", "b at mail dot example dot com"),
        ("jаne@еxample.com", "email", "jаne@еxample.com"),
        ("ｊａｎｅ＠ｅｘａｍｐｌｅ．ｃｏｍ", "email", "ｊａｎｅ＠ｅｘａｍｐｌｅ．ｃｏｍ"),
        ("x j​ane@exa​mple.com", "email", "j​ane@exa​mple.com"),
        ("call plus four nine one five one two three four five six", "phone", "plus four nine one five one two three four five six"),
        ("ip one nine two dot one six eight dot one dot two", "ip", "one nine two dot one six eight dot one dot two"),
        ("card four " + "one " * 14 + "one!", "card", "four " + "one " * 14 + "one"),
    ],
)
def test_disguises(text, kind, found):
    base = pii.base_spans(text)
    spans = pii.all_spans(text, base)
    assert set(base) <= set(spans)
    assert (kind, found) in [(k, text[a:b]) for k, a, b in spans]
    assert found not in pii.redacted(text)


def test_recall_of_disguises():
    """Identifiers disguised at random, in random prose: nearly all are found where they stand."""
    rnd, found, all_ = random.Random(9), Counter(), Counter()
    names = ["zero", "one", "two", "three", "four", "five", "six", "seven", "eight", "nine"]
    looks = {"a": "а", "e": "е", "o": "о", "c": "с", "p": "р"}
    word = lambda: "".join(rnd.choice("bdfghklmnrstaeiou") for _ in range(rnd.randrange(3, 9)))
    for _ in range(1500):
        user, host, end = word(), word(), rnd.choice(["com", "org", "net", "de", "fr", "io"])
        digits = "".join(rnd.choice("0123456789") for _ in range(10))
        card = next(x for x in (f"4{digits}{digits[:4]}{n}" for n in range(10)) if pii.luhn(list(map(int, x))))
        how = rnd.choice(["brackets", "words", "looks", "wide", "unseen", "phone", "ip", "card"])
        kind, disguised = {
            "brackets": ("email", f"{user} {rnd.choice(['[at]', '(at)', '{at}', '[@]'])} {host}{rnd.choice([' [dot] ', '(dot)', '.', ' (dot) '])}{end}"),
            "words": ("email", f"{user} at {host} dot {end}"),
            "looks": ("email", "".join(looks.get(c, c) for c in f"{user}e@{host}a.{end}")),
            "wide": ("email", "".join(chr(ord(c) + 0xFEE0) for c in f"{user}@{host}.{end}")),
            "unseen": ("email", f"{user[:2]}\u200b{user[2:]}@{host[:1]}\u200b{host[1:]}.{end}"),
            "phone": ("phone", "plus " + " ".join(names[int(c)] for c in "1" + digits)),
            "ip": ("ip", " dot ".join(" ".join(names[int(c)] for c in str(rnd.randrange(256))) for _ in range(4))),
            "card": ("card", " ".join(names[int(c)] for c in card)),
        }[how]
        text = f"{word()} {word()}, {disguised} {word()}."
        at = text.index(disguised)
        all_[how] += 1
        found[how] += any(k == kind and a <= at + 1 and b >= at + len(disguised) - 1 for k, a, b in pii.all_spans(text, pii.base_spans(text)))
    assert all(found[h] >= 0.95 * n for h, n in all_.items()), (found, all_)


@pytest.mark.parametrize("text", ["look at the dot on the map", "one two three", "she is at home (at last) and one or two more came", "a [b] c"])
def test_plain_texts_stay(text):
    assert pii.all_spans(text, []) == [] and pii.redacted(text) == text


def test_mapping_keeps_offsets():
    m = pii.Mapped("ab one two cd").apply([(3, 6, "1"), (6, 7, ""), (7, 10, "2")])
    assert m.text == "ab 12 cd"
    assert [(m.first(i), m.last(i)) for i in range(len(m.text))] == [(0, 1), (1, 2), (2, 3), (3, 6), (7, 10), (10, 11), (11, 12), (12, 13)]


def test_pii_documents(spark):
    docs = cases.docs(spark)
    got = pii.find(docs)
    assert got.count() == len(cases.rows())
    for r in got.collect():
        base = brute_spans(r.text or "")
        assert (r.n_email, r.n_ip, r.n_card, r.n_phone) == tuple(sum(k == x for k, _, _ in base) for x in pii.KINDS)
        assert r.base_sha256 == hashlib.sha256(",".join(f"{k}:{a}:{b}" for k, a, b in base).encode()).hexdigest()
    assert pii.redact(docs).columns == docs.columns
    assert pii.find(cases.empty(spark)).count() == 0
