"""Exact similarity join of sets by prefix filtering, to complete links that are known already.

Sets are sorted by one order of all elements. Two sets whose Jaccard similarity is s or more share an element
within the first n - ceil(s n) + 1 elements of each, whatever the order. So rows meet by the elements of their
prefixes, and of the rows that share one, those pairs go on to be verified that have different labels (others are
linked already), sizes that are near enough, and as many elements in the same buckets of hashes.

The order is that of the hashes, but for hot elements, which come last. An element is hot if so many rows have it in
their prefixes that their pairs would grow with the square of them. Prefixes with a hot element are drawn anew: the
elements that come next are looked up among the hot ones too, and where too few others are left, all of the set that
may belong to its prefix is taken. An element that still has too many rows is worked block against block. No pair is
lost on the way: any order that is the same for all sets will do, and so will more elements than a prefix needs.

Sets are made from the texts again whenever they are needed, so that only prefixes and pairs move.
"""

from __future__ import annotations

import math

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from kinweave.llm.common import Beside, beside, cut_files, cut_table, delete, join_salted, lean, release

COLUMNS = ["k", "row", "label", "size"]
SCHEMA = "a bigint, b bigint, k bigint, label bigint, size bigint"


def prefix_length(size: int, similarity: float) -> int:
    return size - math.ceil(similarity * size - 1e-9) + 1 if size else 0


def _room(x: dict, y: dict, similarity: float) -> np.ndarray:
    """Which pairs may still be similar: their labels differ, their sizes hardly do."""
    alike = np.minimum(x["size"], y["size"]) >= similarity * np.maximum(x["size"], y["size"]) - 1e-9
    return (x["label"] != y["label"]) & alike


def _some(x: dict, at) -> dict:
    return {c: v[at] for c, v in x.items()}


def _between(x: dict, y: dict, similarity: float, rows: int = 1 << 20):
    """Pairs (a, b) of a row of x with one of y, a part at a time."""
    step = max(1, rows // max(1, len(y["row"])))
    for at in range(0, len(x["row"]), step):
        left = {c: v[at : at + step, None] for c, v in x.items()}
        i, j = np.nonzero(_room(left, {c: v[None] for c, v in y.items()}, similarity))
        yield left["row"][i, 0], y["row"][j]


def _meet(similarity: float, few: int, most: int, chunk: int = 1 << 17):
    """Pairs of rows that share an element, for rows that come sorted by it. Where an element's pairs are too many, its
    rows pass through instead, with b null."""

    def run(batches):
        import pyarrow as pa

        names = [f.split()[0] for f in SCHEMA.split(", ")]

        def pairs(a, b):
            none = pa.nulls(len(a), pa.int64())
            return pa.RecordBatch.from_arrays([pa.array(np.minimum(a, b)), pa.array(np.maximum(a, b)), none, none, none], names=names)

        def passed(x):
            return pa.RecordBatch.from_arrays([pa.array(x["row"]), pa.nulls(len(x["row"]), pa.int64()), *[pa.array(x[c]) for c in ("k", "label", "size")]], names=names)

        def one(x):
            """The pairs of one element with many rows, or its rows."""
            label, count = np.unique(x["label"], return_counts=True)
            n = len(x["row"])
            if len(label) == 1:
                return
            if (n * n - (count * count).sum()) // 2 > few * n:
                yield passed(x)
                return
            # Nearly all rows have one label, so the others are few: each meets all.
            rest = x["label"] != label[np.argmax(count)]
            for a, b in _between(_some(x, rest), x, similarity):
                yield pairs(a, b)

        def runs(x):
            k = x["k"]
            starts = np.flatnonzero(np.r_[True, k[1:] != k[:-1]]) if len(k) else np.empty(0, np.int64)
            sizes = np.diff(np.r_[starts, len(k)])
            for s, n in zip(starts[sizes > few].tolist(), sizes[sizes > few].tolist(), strict=True):
                yield from one(_some(x, slice(s, s + n)))
            after = np.repeat(np.where(sizes > few, 0, starts + sizes), sizes)  # the end of each row's run
            at, offset, a, b = np.arange(len(k)), 1, [], []
            while len(at := at[at + offset < after[at]]):
                near = at[_room(_some(x, at), _some(x, at + offset), similarity)]
                a.append(x["row"][near])
                b.append(x["row"][near + offset])
                offset += 1
            if a:
                found = np.unique(np.sort(np.stack([np.concatenate(a), np.concatenate(b)], axis=1), axis=1), axis=0)
                yield pairs(found[:, 0], found[:, 1])

        held: dict = {c: np.empty(0, np.int64) for c in COLUMNS}
        passing = None
        for batch in batches:
            x = {c: np.ascontiguousarray(batch.column(c), np.int64) for c in COLUMNS}
            if passing is not None:
                n = int(np.searchsorted(x["k"], passing, side="right"))
                if n:
                    yield passed(_some(x, slice(0, n)))
                x = _some(x, slice(n, None))
                if not len(x["k"]):
                    continue
                passing = None
            held = {c: np.concatenate([held[c], x[c]]) for c in COLUMNS}
            if len(held["k"]) < chunk:
                continue
            last = int(np.searchsorted(held["k"], held["k"][-1]))  # the last run may go on
            yield from runs(_some(held, slice(0, last)))
            held = _some(held, slice(last, None))
            if len(held["k"]) > most:
                yield passed(held)
                passing, held = held["k"][-1], {c: np.empty(0, np.int64) for c in COLUMNS}
        yield from runs(held)

    return run


def _sketched(column) -> np.ndarray:
    """Sketches as rows of counts. One that is empty, as a count left 16 bits, bounds nothing."""
    full = np.full(BUCKETS, (1 << 16) - 1, "<u2").tobytes()
    return np.frombuffer(b"".join(x or full for x in column.to_pylist()), "<u2").reshape(-1, BUCKETS)


#: Of a row's crowded elements so many, the smallest, go with it to tell which element a pair comes from.
FIRSTS = 16


def _firsts(k: np.ndarray) -> bytes:
    return np.r_[k[:FIRSTS], np.full(max(0, FIRSTS - len(k)), np.iinfo(np.int64).max)].astype("<i8").tobytes()


def _blockwise(over: DataFrame, sketches: DataFrame, similarity: float, block: int) -> DataFrame:
    """(a, b) of elements with too many rows: rows are dealt to blocks, and every two blocks meet in one task, which
    hands on only the pairs whose sketches leave room.

    A pair meets at each element that both have, but is handed on only where none smaller is known to be common. At the
    smallest one none is, whatever is known, so no pair is lost; similar rows nearly always know it of each other."""
    sizes = cut_table(over.groupBy("k").agg(F.ceil(F.count(F.lit(1)) / block).alias("n")))
    rows = over.withColumnRenamed("a", "row").join(sketches, "row").join(sizes, "k").withColumn("x", F.pmod(F.xxhash64("row"), F.col("n")))
    rows = rows.withColumn("y", F.explode(F.sequence(F.lit(0).cast("bigint"), F.col("n") - 1)))
    rows = rows.select("k", F.least("x", "y").alias("i"), F.greatest("x", "y").alias("j"), (F.col("x") <= F.col("y")).alias("left"), (F.col("x") >= F.col("y")).alias("right"), "row", "label", "size", "sketch", "firsts")

    def meet(table):
        import pyarrow as pa

        x, counts = {c: table.column(c).to_numpy() for c in COLUMNS}, _sketched(table.column("sketch"))
        k, firsts = x["k"][0], np.frombuffer(b"".join(table.column("firsts").to_pylist()), "<i8").reshape(-1, FIRSTS)
        firsts = np.where(firsts < k, firsts, np.iinfo(np.int64).max)
        left, right = (np.flatnonzero(np.array(table.column(c).to_pylist(), bool)) for c in ("left", "right"))
        found, step = [np.empty((0, 2), np.int64)], max(1, (1 << 20) // max(1, len(right)))
        for at in range(0, len(left), step):
            i, j = np.nonzero(_room({c: v[left[at : at + step], None] for c, v in x.items()}, {c: v[None, right] for c, v in x.items()}, similarity))
            i, j = left[i + at], right[j]
            for part in range(0, len(i), 1 << 14):
                a, b = i[part : part + (1 << 14)], j[part : part + (1 << 14)]
                enough = similarity / (1 + similarity) * (x["size"][a] + x["size"][b]) - 1e-9
                keep = np.minimum(counts[a], counts[b]).sum(axis=1, dtype=np.int64) >= enough
                a, b = a[keep], b[keep]
                earlier = ((firsts[a][:, :, None] == firsts[b][:, None]) & (firsts[a] < k)[:, :, None]).any(axis=(1, 2))
                found.append(np.stack([x["row"][a[~earlier]], x["row"][b[~earlier]]], axis=1))
        pairs = np.unique(np.sort(np.concatenate(found), axis=1), axis=0)
        return pa.table({"a": pairs[:, 0], "b": pairs[:, 1]})

    return rows.groupBy("k", "i", "j").applyInArrow(meet, "a bigint, b bigint")


def _over(texts: DataFrame, uri: str, rows, schema: str, whole: bool = False) -> DataFrame:
    """What rows(row, text, findings) gives for those rows of texts that have findings in the folder of `beside`: an array
    for each column, whose members are rows, or the values of one row if that is `whole`."""

    from pyspark.sql import types as T
    from pyspark.sql.pandas.types import to_arrow_schema

    out = to_arrow_schema(T.StructType.fromDDL(schema))

    def run(batches):
        import pyarrow as pa

        known = Beside(uri)
        for batch in batches:
            for at in range(0, batch.num_rows, 256):
                piece = batch.slice(at, 256)
                found = [rows(row, text.as_py(), facts) for row, text in zip(piece.column("row").to_pylist(), piece.column("text"), strict=True) if (facts := known.of(row))]
                if found:
                    columns = [pa.array(c if whole else np.concatenate(c), f.type) for c, f in zip(zip(*found, strict=True), out, strict=True)]
                    yield pa.RecordBatch.from_arrays(columns, schema=out)

    return texts.mapInArrow(lean(run), schema)


def _beside(rows: DataFrame) -> str:
    return beside(rows.withColumn("lo", F.lit(0).cast("bigint")) if "lo" not in rows.columns else rows)


def sets_of(texts: DataFrame, wanted: DataFrame, hashes) -> DataFrame:
    """(row, elements) of the rows of texts (row, text) that are wanted; hashes: gives a text's different ones."""
    return _over(texts, _beside(wanted.select("row").distinct()), lambda row, text, _: (row, hashes(text)), "row bigint, elements array<bigint>", True)


def _ends(pairs: DataFrame, facts: DataFrame, name: str) -> DataFrame:
    """pairs (a, b) with a fact (row, name) of each end. A row may have a great part of the pairs."""
    total, met = pairs.count(), pairs
    for end, other in (("a", "b"), ("b", "a")):
        counts = pairs.groupBy(end).agg(F.count(F.lit(1)).alias("n"))
        met = join_salted(met, facts.select(F.col("row").alias(end), F.col(name).alias(f"of_{end}")), end, counts, total, [other])
    return met


def _kept(rows: DataFrame, folder: str) -> DataFrame:
    """rows written down, and the folder that they came from deleted."""
    out = cut_table(rows)
    delete(out.sparkSession, folder)
    release(out.sparkSession)
    return out


#: Parts of the hashes in which elements are counted, to bound how many two sets have in common.
BUCKETS = 256


def sketch(e: np.ndarray) -> bytes:
    """How many elements fall into each bucket; empty where a count leaves 16 bits."""
    counts = np.bincount(e & (BUCKETS - 1), minlength=BUCKETS)
    return counts.astype("<u2").tobytes() if counts.max() < 1 << 16 else b""


def fine_sketch(e: np.ndarray, load: int = 8) -> np.ndarray:
    """The same of a large set, in so many buckets, a power of two, that no more than `load` elements fall into one on
    average. Of a set for which BUCKETS are enough: empty."""
    if len(e) <= load * BUCKETS:
        return np.empty(0, np.int32)
    buckets = 1 << math.ceil(math.log2(len(e) / load))
    return np.bincount(e & (buckets - 1), minlength=buckets).astype(np.int32)


def _halved(x: Column) -> Column:
    """A fine sketch in half as many buckets."""
    half = (F.size(x) / 2).cast("int")
    return F.zip_with(F.slice(x, 1, half), F.slice(x, half + 1, half), lambda a, b: a + b)


def finely_possible(texts: DataFrame, pairs: DataFrame, similarity: float, hashes) -> DataFrame:
    """`possible` for the pairs of large sets, whose buckets there all fill alike; other pairs stay. Sketches are a
    sixteenth of the sets or less, so few of these sets move that don't have to."""
    either = pairs.select(F.col("a").alias("row")).union(pairs.select(F.col("b").alias("row")))
    folder = cut_files(_over(texts, _beside(either.distinct()), lambda row, text, _: (row, fine_sketch(hashes(text))), "row bigint, fine array<int>", True))
    fine = pairs.sparkSession.read.schema("row bigint, fine array<int>").parquet(folder)
    a, b = F.col("of_a"), F.col("of_b")
    n, m = F.size(a), F.size(b)
    total = lambda x: F.aggregate(x, F.lit(0).cast("bigint"), lambda sum, c: sum + c)
    x, y = F.when(n > m, _halved(a)).otherwise(a), F.when(m > n, _halved(b)).otherwise(b)
    # Sizes of similar sets are so near that one has twice the other's buckets at most.
    comparable = (n > 0) & (m > 0) & (n <= 2 * m) & (m <= 2 * n)
    shared = total(F.zip_with(x, y, lambda c, d: F.least(c, d)))
    keep = F.when(comparable, shared >= similarity / (1 + similarity) * (total(a) + total(b)) - 1e-9).otherwise(True)
    return _kept(_ends(pairs, fine, "fine").where(keep).select("a", "b"), folder)


def possible(texts: DataFrame, pairs: DataFrame, similarity: float, hashes) -> DataFrame:
    """Those of the pairs (a, b) that may be similar: two sets have no more in common in a bucket than either has there."""

    def run(batches):
        import pyarrow as pa

        for batch in batches:
            of = [batch.column(c).to_pylist() for c in ("of_a", "of_b")]
            keep = np.array([not x or not y for x, y in zip(*of, strict=True)], bool)
            if some := np.flatnonzero(~keep).tolist():
                x, y = (np.frombuffer(b"".join(c[i] for i in some), "<u2").reshape(-1, BUCKETS).astype(np.int64) for c in of)
                keep[some] = np.minimum(x, y).sum(axis=1) >= similarity / (1 + similarity) * (x.sum(axis=1) + y.sum(axis=1)) - 1e-9
            yield batch.select(["a", "b"]).filter(pa.array(keep))

    either = pairs.select(F.col("a").alias("row")).union(pairs.select(F.col("b").alias("row")))
    folder = cut_files(_over(texts, _beside(either.distinct()), lambda row, text, _: (row, sketch(hashes(text))), "row bigint, sketch binary", True))
    sketches = pairs.sparkSession.read.schema("row bigint, sketch binary").parquet(folder)
    return _kept(_ends(pairs, sketches, "sketch").select("a", "b", "of_a", "of_b").mapInArrow(lean(run), "a bigint, b bigint"), folder)


def verified(texts: DataFrame, pairs: DataFrame, similarity: float, hashes) -> DataFrame:
    """Those of the pairs (a, b), each given once and written down, whose sets are similar."""
    either = pairs.select(F.col("a").alias("row")).union(pairs.select(F.col("b").alias("row")))
    folder = cut_files(sets_of(texts, either, hashes))
    sets = pairs.sparkSession.read.schema("row bigint, elements array<bigint>").parquet(folder)
    both = F.size(F.array_intersect("of_a", "of_b"))
    return _kept(_ends(pairs, sets, "elements").where(both >= similarity * (F.size("of_a") + F.size("of_b") - both)).select("a", "b"), folder)


def _drawn(e: np.ndarray, hot: np.ndarray, need: int, seen: int) -> np.ndarray:
    """What a prefix of `need` elements has at most, if `hot` are the hot ones of the first `seen` elements."""
    cold = e[:seen][~np.isin(e[:seen], hot)]
    return cold[:need] if len(cold) >= need or seen >= len(e) and not len(hot) else np.concatenate([cold, e[seen:], hot])


def _seen(need: int, hot: int, size: int) -> int:
    """How many elements are looked up among the hot ones, where so many of the first `need` are hot."""
    return size if 3 * hot > need else min(size, 2 * need + 8)


def _keys(texts: DataFrame, nodes: DataFrame, hot: DataFrame | None, similarity: float, hashes) -> DataFrame:
    """(k, row, label, size): the elements of each node's prefix, drawn without the hot ones (row, k) that are known of it."""
    facts = nodes.select("row", "label", F.lit(None).cast("bigint").alias("k"))
    if hot is not None:
        facts = facts.union(hot.select("row", F.lit(0).cast("bigint"), "k"))  # with nulls labels would be read as floats
    folder = _beside(facts.select("row", F.coalesce("k", F.lit(0)).alias("lo"), "label", F.col("k").isNotNull().alias("hot")))

    def rows(row, text, found):
        e, of = hashes(text), found["hot"].astype(bool)
        need = prefix_length(len(e), similarity)
        own = found["lo"][of]
        k = _drawn(e, own, need, _seen(need, int(np.isin(own, e[:need]).sum()), len(e))) if len(own) else e[:need]
        label = int(found["label"][~of][0])
        return k, np.full(len(k), row), np.full(len(k), label), np.full(len(k), len(e))

    return _over(texts, folder, rows, "k bigint, row bigint, label bigint, size bigint")


def _next(texts: DataFrame, crowded: DataFrame, similarity: float, hashes) -> DataFrame:
    """(row, k): of the rows with crowded elements (row, k), the elements that come next in order."""

    def rows(row, text, found):
        e = hashes(text)
        need = prefix_length(len(e), similarity)
        k = e[need : _seen(need, len(found["lo"]), len(e))]
        return np.full(len(k), row), k

    return _over(texts, _beside(crowded.select("row", F.col("k").alias("lo"))), rows, "row bigint, k bigint")


def missing_pairs(texts: DataFrame, nodes: DataFrame, similarity: float, hashes, few: int = 64, most: int = 1 << 16, block: int = 4096) -> DataFrame:
    """(a, b): every pair of nodes (row, label) with different labels that may be similar, each pair once. texts (row,
    text) has the rows' texts; hashes: gives the different elements of a text, sorted."""

    def met(keys: DataFrame) -> tuple[DataFrame, DataFrame]:
        found = cut_table(keys.repartition("k").sortWithinPartitions("k").mapInArrow(lean(_meet(similarity, few, most)), SCHEMA))
        release(found.sparkSession)
        return found.where("b is not null").select("a", "b"), found.where("b is null")

    pairs, crowded = met(_keys(texts, nodes, None, similarity, hashes))
    if not crowded.isEmpty():
        first = crowded.select(F.col("a").alias("row"), "k")
        hot = cut_table(first.select("k").distinct())
        more = _next(texts, first, similarity, hashes).join(hot, "k", "left_semi").select("row", "k")
        pairs, crowded = met(_keys(texts, nodes, cut_table(first.union(more)), similarity, hashes))
        if not crowded.isEmpty():
            own = _beside(crowded.select(F.col("a").alias("row"), F.col("k").alias("lo")))
            sketches = _over(texts, own, lambda row, text, found: (row, sketch(hashes(text)), _firsts(found["lo"])), "row bigint, sketch binary, firsts binary", True)
            pairs = pairs.union(_blockwise(crowded, sketches, similarity, block))
    pairs = cut_table(pairs.distinct())
    release(pairs.sparkSession)
    return finely_possible(texts, possible(texts, pairs, similarity, hashes), similarity, hashes)
