"""Quality classifier: random-indexing word vectors, pooled for each text, and a two-layer network.

1. Word vectors. Words (runs of letters and digits, runs of other signs, A-Z in lower case) fall into
   `buckets` by hash. Every bucket has a sparse random index vector; a bucket's vector is the sum of the
   index vectors of all its words' neighbours, those that follow rotated so that order shows, over all
   texts, less what chance alone would give, and scaled to length one. Each batch's sums meet in two
   steps, so nothing but the final table of fixed size comes together.
2. Pooling. A text is the mean of its words' vectors, their standard deviation, and the mean product of
   the vectors of neighbouring words. Nothing else of the text goes in.
3. Network. Two layers, trained in numpy on at most `most_rows` labelled rows, those with the smallest
   hashes of their ids; the limit is the only one here. A fifth of them is kept to fit a temperature,
   which makes scores probabilities.

Only texts are inputs of a score. A null text counts as an empty one, with a pooled vector of zeros.
Repeated rows score alike. An empty table gives an empty one. A very long text is pooled a piece at a time.
A null doc_id has no label and is not held out. Labels that are null, or not 0 or 1, are left out; if one
of the two is missing, every score is the share of ones (0.5 without any). Other columns are not read.
"""

from __future__ import annotations

import re

import numpy as np
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from kinweave.llm.common import append, by_range, cut_table

_WORD = re.compile(rb"[0-9a-z\x80-\xff]+|[^0-9a-z\x80-\xff\x00-\x20]+")
_BLOCK = 128  # buckets that travel together
_SPREAD = 16  # parts of a block in the first of two steps


def tokens(text: str | None, buckets: int) -> np.ndarray:
    w = _WORD.findall((text or "").encode().lower())
    return (np.fromiter(map(xxhash.xxh64_intdigest, w), np.uint64, len(w)) % np.uint64(buckets)).astype(np.int64)


def index_vectors(buckets: int, size: int, ones: int, seed: int = 5) -> tuple[np.ndarray, np.ndarray]:
    """Places and signs of each bucket's nonzero components."""
    r = np.random.Generator(np.random.PCG64(seed))
    return r.integers(0, size, (buckets, ones)), r.choice(np.array([-1.0, 1.0]), (buckets, ones))


#: How far the index vector of a following word is rotated.
TURN = 7


def context_sums(texts: list[np.ndarray], buckets: int, size: int, ones: int, window: int) -> np.ndarray:
    """For each bucket the summed index vectors of its words' neighbours in the same text, and its count."""
    place, sign = index_vectors(buckets, size, ones)
    gap = np.full(window, buckets)  # keeps texts apart
    t = np.concatenate([x for text in texts for x in (text, gap)]) if texts else gap
    out = np.zeros(buckets * size)
    for d in range(1, window + 1):
        a, b = t[:-d], t[d:]
        both = (a < buckets) & (b < buckets)
        a, b = a[both], b[both]
        for word, other, turn in ((a, b, TURN), (b, a, 0)):
            for k in range(ones):
                out += np.bincount(word * size + (place[other, k] + turn) % size, sign[other, k], buckets * size)
    count = np.bincount(t, minlength=buckets + 1)[:buckets]
    return np.concatenate([out.reshape(buckets, size), count[:, None]], axis=1).astype(np.int64)


def word_vectors(texts: DataFrame, buckets: int = 16384, size: int = 64, ones: int = 2, window: int = 2, most: int = 1 << 21) -> np.ndarray:
    """(buckets, size) vectors from all of texts (a column text)."""

    def count(batches):
        import pyarrow as pa
        from pyspark import TaskContext

        part = TaskContext.get().partitionId() % _SPREAD

        def rows(held):
            sums = context_sums(held, buckets, size, ones, window)
            n = -(-buckets // _BLOCK)
            blocks = [sums[i * _BLOCK : (i + 1) * _BLOCK].astype(np.int32).tobytes() for i in range(n)]
            return pa.RecordBatch.from_arrays([pa.array([i * _SPREAD + part for i in range(n)], pa.int64()), pa.array(blocks, pa.binary())], names=["range", "block"])

        held, length = [], 0
        for batch in batches:
            for text in batch.column("text"):
                held.append(tokens(text.as_py(), buckets))
                length += len(held[-1])
                if length >= most:
                    yield rows(held)
                    held, length = [], 0
        if held:
            yield rows(held)

    def total(kind):
        def finish(r, blocks):
            whole = None
            for b in blocks:
                x = np.frombuffer(b, kind).astype(np.int64)
                whole = x if whole is None else whole + x
            return {"range": r if kind is np.int64 else r // _SPREAD, "block": whole.tobytes()}

        return finish

    first = by_range(texts.mapInArrow(count, "range bigint, block binary"), total(np.int32), "range bigint, block binary")
    rows = by_range(first, total(np.int64), "range bigint, block binary").collect()
    sums = np.zeros((-(-buckets // _BLOCK) * _BLOCK, size + 1))
    for r in rows:
        x = np.frombuffer(r["block"], np.int64).reshape(-1, size + 1)
        sums[r["range"] * _BLOCK : r["range"] * _BLOCK + len(x)] = x
    v, count = sums[:buckets, :-1], sums[:buckets, -1:]
    v = v - count * (v.sum(axis=0) / max(count.sum(), 1))
    return (v / np.maximum(np.linalg.norm(v, axis=1, keepdims=True), 1e-9)).astype(np.float32)


def pooled(texts: list[str | None], vectors: np.ndarray, piece: int = 1 << 16) -> np.ndarray:
    """One row for each text: the mean of its words' vectors, their standard deviation, and the mean
    product of the vectors of neighbours; zeros for what a text lacks."""
    size = vectors.shape[1]
    out = np.zeros((len(texts), 3 * size), np.float32)
    for i, text in enumerate(texts):
        t = tokens(text, len(vectors))
        if n := len(t):
            sums = np.zeros((3, size))
            for at in range(0, n, piece):
                v = vectors[t[at : at + piece + 1]]  # one more, for the last one's neighbour
                own = v[:piece]
                sums += own.sum(axis=0), np.einsum("ij,ij->j", own, own), np.einsum("ij,ij->j", v[:-1], v[1:])
            mean = sums[0] / n
            out[i] = np.r_[mean, np.sqrt(np.maximum(sums[1] / n - mean * mean, 0)), sums[2] / max(n - 1, 1)]
    return out


class Network:
    """Two layers over standardised inputs, a temperature, and nothing else."""

    def __init__(self, x: np.ndarray, y: np.ndarray, hidden: int = 32, epochs: int = 60, seed: int = 3):
        r = np.random.Generator(np.random.PCG64(seed))
        self.temperature, self.constant = 1.0, None
        if len(np.unique(y)) < 2:
            self.constant = float(y.mean()) if len(y) else 0.5
            return
        order = r.permutation(len(y))
        keep, fit = order[: len(y) // 5], order[len(y) // 5 :]
        if len(np.unique(y[fit])) < 2:
            fit = order
        self.mean, self.scale = x[fit].mean(axis=0), x[fit].std(axis=0) + 1e-6
        z = (x - self.mean) / self.scale
        d = z.shape[1]
        self.w = [r.normal(0, d**-0.5, (d, hidden)), np.zeros(hidden), r.normal(0, hidden**-0.5, hidden), np.zeros(1)]
        first, second, step = [np.zeros_like(w) for w in self.w], [np.zeros_like(w) for w in self.w], 0
        for _ in range(epochs):
            for at in np.array_split(r.permutation(fit), max(1, len(fit) // 128)):
                a, logit = self._forward(z[at])
                error = (_sigmoid(logit) - y[at]) / len(at)
                back = error[:, None] * self.w[2] * (1 - a * a)
                gradients = [z[at].T @ back + 1e-4 * self.w[0], back.sum(axis=0), a.T @ error + 1e-4 * self.w[2], error.sum(keepdims=True)]
                step += 1
                for w, g, m, v in zip(self.w, gradients, first, second, strict=True):
                    m += 0.1 * (g - m)
                    v += 0.001 * (g * g - v)
                    w -= 0.003 * (m / (1 - 0.9**step)) / (np.sqrt(v / (1 - 0.999**step)) + 1e-8)
        if len(keep):
            logit = self._forward(z[keep])[1]
            tried = np.exp(np.linspace(np.log(0.25), np.log(8), 60))
            loss = [np.mean(np.logaddexp(0, logit / t) - y[keep] * logit / t) for t in tried]
            self.temperature = float(tried[int(np.argmin(loss))])

    def _forward(self, z: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        a = np.tanh(z @ self.w[0] + self.w[1])
        return a, a @ self.w[2] + self.w[3]

    def score(self, x: np.ndarray) -> np.ndarray:
        if self.constant is not None:
            return np.full(len(x), self.constant)
        return _sigmoid(self._forward((x - self.mean) / self.scale)[1] / self.temperature)


def _sigmoid(x: np.ndarray) -> np.ndarray:
    return 1 / (1 + np.exp(-np.clip(x, -60, 60)))


def held_out(doc_id: Column, parts: int = 3, part: int = 1) -> Column:
    return F.coalesce(F.crc32(doc_id.cast("string")) % parts == part, F.lit(False))


def classify(docs: DataFrame, labels: DataFrame, most_rows: int = 20_000) -> DataFrame:
    """(doc_id, held_out, score, predicted) for each row of docs (doc_id, text); labels are (doc_id, label)."""
    texts = docs.select("doc_id", "text")
    vectors = word_vectors(texts.select("text"))

    def make():
        return lambda batch: [[r.tobytes() for r in pooled(batch, vectors)]]

    features = cut_table(append(texts, "pooled binary", make).drop("text"))
    known = labels.where(F.col("label").isin(0, 1) & F.col("doc_id").isNotNull() & ~held_out(F.col("doc_id")))
    sample = known.select("doc_id", F.col("label").cast("int").alias("label")).orderBy(F.xxhash64("doc_id"), "doc_id", "label").limit(most_rows)
    # The sample is bounded by most_rows, so it can be sent everywhere; repeated texts of an id count once.
    rows = features.join(F.broadcast(sample), "doc_id").groupBy("doc_id", "label").agg(F.min("pooled").alias("pooled"))
    rows = sorted((r["doc_id"], r["label"], bytes(r["pooled"])) for r in rows.collect())
    x = np.frombuffer(b"".join(r[2] for r in rows), np.float32).reshape(len(rows), -1) if rows else np.zeros((0, 3 * vectors.shape[1]), np.float32)
    network = Network(x.astype(float), np.array([r[1] for r in rows], float))

    def apply():
        return lambda batch: [network.score(np.frombuffer(b"".join(batch), np.float32).reshape(len(batch), -1).astype(float)).tolist()]

    scored = append(features, "score double", apply, column="pooled", rows=4096)
    return scored.select("doc_id", held_out(F.col("doc_id")).alias("held_out"), "score", (F.col("score") >= 0.5).cast("int").alias("predicted"))
