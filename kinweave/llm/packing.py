"""Packing documents into sequences of equal length by Karmarkar-Karp multiway differencing.

1. Each text is encoded once and an end token put behind it. Its ids are cut at every `length`, and what is
   left over into pieces of at most `grain`; a piece's digest is taken there, so ids needn't move.
2. Pieces are dealt by a hash of their place to batches of about `windows` sequences, whatever document they
   are of, so that a batch's size doesn't depend on any document or key.
3. In a batch, whole sequences stand by themselves. The other pieces begin as partial partitions with one
   piece each; the two with the largest imbalances are merged, the fullest window of one with the emptiest of
   the other, until one partition into near-equal windows is left. If its fullest window is over `length`, the
   differencing is done again with one window more.

Each id is in just one piece, pieces of a window lie side by side in the order of their documents, and windows
are padded to `length` unless they hold a power of two. A null text counts as an empty one, of one id, its end.
Repeated rows are packed as rows of their own. An empty table gives an empty one. A very long text is held whole
with its ids while it is encoded; its pieces go to many batches. Null ids pass through. Other columns aren't
read. Reruns agree: a row's place is its file's and its own in it, or is written down first.
"""

from __future__ import annotations

import heapq
import zlib

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from kinweave.llm import bpe
from kinweave.llm.common import Columns, cut_table, stored

#: The id behind every document.
END = 1


def cuts(n: int, length: int, grain: int) -> np.ndarray:
    """Where n ids are cut, 0 and n included."""
    whole = n - n % length
    return np.unique(np.r_[np.arange(0, whole + 1, length), np.arange(whole, n, grain), n])


def differencing(sizes: np.ndarray, windows: int) -> tuple[np.ndarray, np.ndarray]:
    """A window for each size, and the windows' sums. A partial partition is its sums, largest first, with a tree of
    sizes for each: number i is size i, a larger number the union of a pair."""
    trees: list[np.ndarray] = []
    count = n = len(sizes)
    parts: dict[int, tuple[np.ndarray, np.ndarray]] = {}
    for i, x in enumerate(sizes.tolist()):
        sums, tree = np.zeros(windows, np.int64), np.full(windows, -1)
        sums[0], tree[0] = x, i
        parts[i] = sums, tree
    heap = [(-int(s[0] - s[-1]), i) for i, (s, _) in parts.items()]
    heapq.heapify(heap)
    name = n
    while len(heap) > 1:
        (a, x), (b, y) = (parts.pop(heapq.heappop(heap)[1]) for _ in range(2))
        sums, y = a + b[::-1], y[::-1]
        both = np.flatnonzero((x >= 0) & (y >= 0))
        tree = np.maximum(x, y)
        trees.append(np.stack([x[both], y[both]], axis=1))
        tree[both] = count + np.arange(len(both))
        count += len(both)
        order = np.argsort(-sums, kind="stable")
        parts[name] = sums[order], tree[order]
        heapq.heappush(heap, (-int(sums[order[0]] - sums[order[-1]]), name))
        name += 1
    window = np.zeros(count, np.int64)
    sums, tree = parts[heap[0][1]]
    window[tree[tree >= 0]] = np.flatnonzero(tree >= 0)
    at = count
    for pairs in reversed(trees):  # from the latest union down to sizes
        at -= len(pairs)
        window[pairs] = window[at : at + len(pairs), None]
    return window[:n], sums


def fill(sizes: np.ndarray, length: int) -> np.ndarray:
    """A window for each size, none of which holds over `length`; as few windows as differencing manages."""
    windows = max(1, -(-int(sizes.sum()) // length))
    while True:
        window, sums = differencing(sizes, windows)
        if sums[0] <= length:
            return window
        windows += 1


def _pieces(path: str, length: int, grain: int, with_ids: bool, names: list[str]):
    def run(batches):
        import pyarrow as pa

        e = bpe.Whole(bpe.codec(path))
        for batch in batches:
            for at in range(0, batch.num_rows, 256):
                part = batch.slice(at, 256)
                owner, start, size, crc, whole, kept = [], [], [], [], [], []
                for i, text in enumerate(part.column("text").to_pylist()):
                    ids = np.append(e.encode(text), END).astype("<u4")
                    edges = cuts(len(ids), length, grain)
                    for a, b in zip(edges[:-1].tolist(), edges[1:].tolist(), strict=True):
                        owner.append(i)
                        start.append(a)
                        size.append(b - a)
                        crc.append(zlib.crc32(ids[a:b].tobytes()))
                        whole.append(len(ids))
                        if with_ids:
                            kept.append(ids[a:b].astype(np.int32))
                given = part.select(["row", "doc_id"]).take(pa.array(owner, pa.int64()))
                new = [pa.array(x, pa.int64()) for x in (start, size, crc, whole)] + ([pa.array(kept, pa.list_(pa.int32()))] if with_ids else [])
                yield pa.RecordBatch.from_arrays([*given.columns, *new], names=names)

    return run


def _packed(length: int):
    """The rows of a batch with their sequences and offsets."""

    def run(table):
        import pyarrow as pa

        table = table.sort_by([("row", "ascending"), ("start", "ascending")])
        size, n = table.column("length").to_numpy(), table.num_rows
        window, some = np.zeros(n, np.int64), size < length
        if some.any():
            window[some] = fill(size[some], length)
        window[~some] = window.max() + 1 + np.arange((~some).sum())
        order = np.argsort(window, kind="stable")
        before = np.cumsum(size[order]) - size[order]
        begins = np.flatnonzero(np.r_[True, np.diff(window[order]) > 0])
        offset = np.empty(n, np.int64)
        offset[order] = before - np.repeat(before[begins], np.diff(np.r_[begins, n]))
        sequence = table.column("batch").to_numpy() << 32 | window
        return table.drop_columns(["batch", "row"]).append_column("sequence_id", pa.array(sequence)).append_column("offset", pa.array(offset))

    return run


def pack(docs: DataFrame, vocabulary: str | None = None, length: int = 2048, grain: int = 512, windows: int = 256, number=stored, with_ids: bool = False) -> DataFrame:
    """(doc_id, start, length, ids_crc32, doc_tokens, sequence_id, offset), with_ids also ids, for each piece of docs
    (doc_id, text). number: how rows are told apart, `common.stored` or, for files as they were read, `common.placed`."""
    if not 1 <= grain <= length:
        raise ValueError("a piece has from 1 id to as many as a sequence")
    given = Columns(docs)
    rows = number(given.rows.select(F.col(given["doc_id"]).alias("doc_id"), F.col(given["text"]).alias("text")))
    out = T.StructType([T.StructField("row", T.LongType()), T.StructField("doc_id", rows.schema["doc_id"].dataType)])
    for name in ("start", "length", "ids_crc32", "doc_tokens"):
        out.add(name, T.LongType())
    if with_ids:
        out.add("ids", T.ArrayType(T.IntegerType()))
    pieces = cut_table(rows.mapInArrow(_pieces(vocabulary or bpe.default_vocabulary(), length, grain, with_ids, out.names), out))
    total = pieces.agg(F.sum("length")).first()[0] or 0
    batches = max(1, -(-total // (windows * length)))
    dealt = pieces.withColumn("batch", F.pmod(F.xxhash64("row", "start"), F.lit(batches)))
    packed = T.StructType([f for f in out.fields if f.name != "row"]).add("sequence_id", T.LongType()).add("offset", T.LongType())
    return dealt.groupBy("batch").applyInArrow(_packed(length), packed)
