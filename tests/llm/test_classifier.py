"""The classifier from texts to scores against a version with plain loops: other sums, pooling and training."""

import math
import random
import re
import zlib

import numpy as np
import xxhash

from kinweave.llm import classifier

WORD = re.compile(rb"[0-9a-z\x80-\xff]+|[^0-9a-z\x80-\xff\x00-\x20]+")


def plain_scores(rows, labels, size=64, ones=2, window=2, buckets=16384, hidden=32, epochs=60):
    place, sign = classifier.index_vectors(buckets, size, ones)
    texts = {d: [xxhash.xxh64_intdigest(w) % buckets for w in WORD.findall(re.sub("[A-Z]", lambda m: m[0].lower(), t or "").encode())] for d, t in rows}
    sums, count = {}, {}
    for words in texts.values():
        for i, w in enumerate(words):
            v = sums.setdefault(w, [0.0] * size)
            count[w] = count.get(w, 0) + 1
            for j in range(max(0, i - window), min(len(words), i + window + 1)):
                for k in range(ones if j != i else 0):
                    v[(place[words[j], k] + (classifier.TURN if j > i else 0)) % size] += sign[words[j], k]
    total = [sum(v[c] for v in sums.values()) for c in range(size)]
    n = sum(count.values())
    vectors = {}
    for w, v in sums.items():
        v = [x - count[w] * t / n for x, t in zip(v, total, strict=True)]
        length = max(math.sqrt(sum(x * x for x in v)), 1e-9)
        vectors[w] = [x / length for x in v]
    inputs = {}
    for d, words in texts.items():
        vs = [vectors[w] for w in words]
        mean = [sum(c) / len(vs) for c in zip(*vs, strict=True)] if vs else [0.0] * size
        spread = [math.sqrt(max(sum(x * x for x in c) / len(vs) - m * m, 0)) for c, m in zip(zip(*vs, strict=True), mean, strict=True)] if vs else [0.0] * size
        beside = [sum(a[c] * b[c] for a, b in zip(vs, vs[1:], strict=False)) / max(len(vs) - 1, 1) for c in range(size)]
        inputs[d] = np.array([*mean, *spread, *beside])
    known = sorted(d for d in labels if d in inputs and zlib.crc32(str(d).encode()) % 3 != 1)
    x, y = np.array([inputs[d] for d in known]), [labels[d] for d in known]
    # Two layers trained one row at a time within a batch.
    r = np.random.Generator(np.random.PCG64(3))
    order = r.permutation(len(y))
    keep, fit = order[: len(y) // 5], order[len(y) // 5 :]
    mean, scale = x[fit].mean(axis=0), x[fit].std(axis=0) + 1e-6
    w1, b1, w2, b2 = r.normal(0, x.shape[1] ** -0.5, (x.shape[1], hidden)), np.zeros(hidden), r.normal(0, hidden**-0.5, hidden), np.zeros(1)
    weights = [w1, b1, w2, b2]
    moments = [(np.zeros_like(w), np.zeros_like(w)) for w in weights]

    def forward(row):
        a = np.tanh((row - mean) / scale @ weights[0] + weights[1])
        return a, float(a @ weights[2] + weights[3][0])

    step = 0
    for _ in range(epochs):
        for at in np.array_split(r.permutation(fit), max(1, len(fit) // 128)):
            grads = [1e-4 * weights[0], np.zeros(hidden), 1e-4 * weights[2], np.zeros(1)]
            for i in at:
                a, logit = forward(x[i])
                error = (1 / (1 + math.exp(-logit)) - y[i]) / len(at)
                back = error * weights[2] * (1 - a * a)
                for g, more in zip(grads, (np.outer((x[i] - mean) / scale, back), back, error * a, np.array([error])), strict=True):
                    g += more
            step += 1
            for w, g, (m, v) in zip(weights, grads, moments, strict=True):
                m[...] = 0.9 * m + 0.1 * g
                v[...] = 0.999 * v + 0.001 * g * g
                w -= 0.003 * (m / (1 - 0.9**step)) / (np.sqrt(v / (1 - 0.999**step)) + 1e-8)
    tried = [math.exp(math.log(0.25) + i * (math.log(8) - math.log(0.25)) / 59) for i in range(60)]
    logits = [forward(x[i])[1] for i in keep]
    loss = [sum(math.log1p(math.exp(-abs(z / t))) + max(z / t, 0) - y[i] * z / t for z, i in zip(logits, keep, strict=True)) for t in tried]
    t = tried[loss.index(min(loss))]
    return {d: 1 / (1 + math.exp(-forward(v)[1] / t)) for d, v in inputs.items()}


def test_scores_from_texts(spark):
    rnd = random.Random(8)
    good, bad = [f"good{i}" for i in range(60)], [f"bad{i}" for i in range(60)]
    rows, labels = [], {}
    for d in range(150):
        y = d % 2
        words = [rnd.choice((good if y else bad) if rnd.random() < 0.3 else [f"w{i}" for i in range(90)]) for _ in range(rnd.randrange(0, 50))]
        rows.append((d, None if d == 9 else " ".join(words) + rnd.choice([".", " !?", ""])))
        if d % 5:
            labels[d] = y
    docs = spark.createDataFrame(rows, "doc_id bigint, text string").repartition(4)
    got = classifier.classify(docs, spark.createDataFrame(list(labels.items()), "doc_id bigint, label int")).collect()
    want = plain_scores(rows, labels)
    assert len(got) == len(rows)
    for r in got:
        assert abs(r.score - want[r.doc_id]) < 2e-3 and r.predicted == (r.score >= 0.5) and r.held_out == (zlib.crc32(str(r.doc_id).encode()) % 3 == 1)
