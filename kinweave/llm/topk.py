"""Exact top-k search over integer vectors by exhaustive term-at-a-time accumulation.

A vector's component x becomes the integer floor(scale * x); a term is a component's position. Queries
are packed into blocks, which are written down once in the shared folder. Candidates stay where they are
read: each task holds up to `hold` of them at a time as blocks of postings, and streams the query blocks
past them. There, term by term, a query's nonzero weights times the term's postings are scattered into a
dense array of scores; the k best are selected by partition, block after block. Only those k rows for each
query and held part are shuffled, and merged. Memory is what is held, one query block and one block of
scores, however many rows there are.

Vectors that are null, or hold a null or a value that isn't finite, take no part; an empty vector has
score 0 with all. Vectors of unequal length are padded with zeros. A query's own id is never among its
results. Query rows that repeat an id are one query, by the smallest vector; candidate rows that repeat
an id stay rows of their own. Scores are 64-bit integers and must fit into that. Ties go to the smaller
id. Empty tables give an empty result. Columns other than id and v are not read. The shared folder must be
one that pyarrow can open.
"""

from __future__ import annotations

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from kinweave.llm.common import cut_files


def usable(vector: Column) -> Column:
    """True for a vector without nulls whose components are all finite."""
    v = F.transform(vector, lambda x: x.cast("double"))
    return vector.isNotNull() & F.coalesce(F.forall(v, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < F.lit(float("inf")))), F.lit(False))


def weights(vectors: DataFrame, scale: int) -> DataFrame:
    """(id, w): the usable rows with integer weights; trailing zeros don't matter."""
    return vectors.where(F.col("id").isNotNull() & usable(F.col("v"))).select("id", F.transform("v", lambda x: F.floor(x.cast("double") * scale)).alias("w"))


def _pack(rows: int):
    """Rows (id, w) to blocks (n, terms, ids, weights); weights are packed term by term."""

    def run(batches):
        import pyarrow as pa

        for batch in batches:
            for at in range(0, batch.num_rows, rows):
                piece = batch.slice(at, rows)
                w = piece.column("w")
                lengths = np.asarray(w.value_lengths())
                terms = int(lengths.max(initial=0))
                dense = np.zeros((piece.num_rows, terms), np.int64)
                dense[np.arange(terms) < lengths[:, None]] = np.asarray(w.flatten())
                ids = np.ascontiguousarray(piece.column("id"), np.int64)
                yield pa.RecordBatch.from_arrays(
                    [pa.array([piece.num_rows]), pa.array([terms]), pa.array([ids.tobytes()]), pa.array([np.ascontiguousarray(dense.T).tobytes()])],
                    names=["n", "terms", "ids", "weights"],
                )

    return run


def scores(query: np.ndarray, candidate: np.ndarray) -> np.ndarray:
    """Scores of all queries (terms, q) with all candidates (terms, n), one term after another."""
    out = np.zeros((query.shape[1], candidate.shape[1]), np.int64)
    for q, c in zip(query, candidate, strict=False):  # a term that one side lacks adds nothing
        rows, postings = np.flatnonzero(q), np.flatnonzero(c)
        if len(rows) == len(q) and len(postings) == len(c):
            out += q[:, None] * c
        elif len(rows) and len(postings):
            out[np.ix_(rows, postings)] += q[rows, None] * c[postings]
    return out


def best(found: np.ndarray, ids: np.ndarray, own: int, k: int) -> np.ndarray:
    """Positions of the k highest scores of one query, ties to the smaller id, without its own id."""
    at = np.flatnonzero(ids != own)
    if len(at) > k:
        least = np.partition(found[at], len(at) - k)[len(at) - k]
        at = at[found[at] >= least]
    return at[np.lexsort((ids[at], -found[at]))[:k]]


def _blocks(packed, names=("n", "terms", "ids", "weights")):
    """Ids and postings (terms, n) of each packed block of a record batch."""
    for r in packed.select(list(names)).to_pylist():
        yield np.frombuffer(r["ids"], np.int64), np.frombuffer(r["weights"], np.int64).reshape(r["terms"], r["n"])


def _search(k: int, uri: str, block: int, hold: int):
    """Rows (id, w) of candidates to (query_id, vec_id, score), the k best of what is held, for each query."""

    def found(held):
        import pyarrow as pa
        from pyarrow import dataset, fs

        system, path = fs.FileSystem.from_uri(uri)
        for queries in dataset.dataset(path, filesystem=system, format="parquet").to_batches(batch_size=1):
            for own, q in _blocks(queries):
                ids, best_scores, owner = (np.empty(0, np.int64) for _ in range(3))
                for c_ids, c in held:
                    s = scores(q, c)
                    at = [best(s[i], c_ids, x, k) for i, x in enumerate(own)]
                    row = np.repeat(np.arange(len(own)), [len(a) for a in at])
                    flat = np.concatenate(at)
                    owner, ids, best_scores = np.r_[owner, row], np.r_[ids, c_ids[flat]], np.r_[best_scores, s[row, flat]]
                    order = np.lexsort((ids, -best_scores, owner))
                    owner, ids, best_scores = owner[order], ids[order], best_scores[order]
                    place = np.arange(len(owner)) - np.searchsorted(owner, owner)
                    owner, ids, best_scores = owner[place < k], ids[place < k], best_scores[place < k]
                yield pa.RecordBatch.from_arrays([pa.array(own[owner]), pa.array(ids), pa.array(best_scores)], names=["query_id", "vec_id", "score"])

    def run(batches):
        held, count = [], 0
        for packed in _pack(block)(batches):
            held += _blocks(packed)
            count += len(held[-1][0])
            if count >= hold:
                yield from found(held)
                held, count = [], 0
        if held:
            yield from found(held)

    return run


def search(queries: DataFrame, candidates: DataFrame, k: int = 10, scale: int = 1024, query_block: int = 128, block: int = 1024, hold: int = 1 << 16) -> DataFrame:
    """(query_id, rank, vec_id, score): the k best candidates (id, v) of each query (id, v)."""
    q = weights(queries, scale).groupBy("id").agg(F.min("w").alias("w"))
    packed = q.mapInArrow(_pack(query_block), "n bigint, terms bigint, ids binary, weights binary")
    uri = cut_files(packed)
    found = weights(candidates, scale).mapInArrow(_search(k, uri, block, hold), "query_id bigint, vec_id bigint, score bigint")
    rank = F.row_number().over(W.partitionBy("query_id").orderBy(F.desc("score"), "vec_id"))
    return found.withColumn("rank", rank).where(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")
