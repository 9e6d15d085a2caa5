"""Exact removal of repeated byte strings: every byte covered by a string of `length` bytes that also
starts anywhere else goes, judged on the texts as they came.

Distributed prefix doubling over the positions of all texts. A position's rank at a length is a name of
the string of that length there, equal for equal strings; the ranks at 2L are the pairs of ranks at L
of a position and of the one L further on. At each length, in growing order, Spark sorts the ranks of the
positions that are still open; a position whose rank is unique leaves, the others go on to the double
length, and at `length` they are the answer. `longest_repeat` is the last length at which a text still
had an open position.

Not all positions are sorted at the first length; three sieves, which lose nothing, come before:

1. Anchors. Each window of the first length has as its anchor its gram with the smallest hash, which equal
   windows share. The grams are counted; where one is unique, none of its anchor's positions stay open. An
   anchor stands for all positions that have it, so some two positions in a hundred take part.
2. Contexts. All bytes of an anchor's windows are its context, for each length. If a context occurs twice,
   all its positions repeat. Of the contexts whose gram has others, one of each kind goes on, to meet
   those of other kinds. Copies of whole texts end here.
3. Sides. A window has, beside the gram, half of its other bytes on the gram's right, or on its left. A
   context goes on with the side, or sides, that another kind shares.

What is found out about positions is written down by files of the input, and the tasks that read a file
again read that with it; so texts are never shuffled.

In all sorts, items that meet in one batch of a task are settled there and go on as one row, so what is
common to a third of all texts gives no more rows than there are batches; the rest meet by Spark's sort.
In the end a text's open positions become intervals, and what they cover is cut out.

Ranks are names made by hashing, 96 bits or more together, as a pair can then be formed where its text
is; they are not compared byte by byte. A null text counts as an empty one; texts under `length` bytes
lose nothing. An empty table gives an empty one. A very long text is one task's work, in memory of some
sixty times its size. Repeated rows are occurrences of their own, so both lose what they share. What is
kept of a text is bytes: a cut may go through a character. Columns other than doc_id and text are not
read. Rows are told apart by a number that is either written down with them or, for Parquet files, their
place in the files; it doesn't depend on how a job splits the input.
"""

from __future__ import annotations

import hashlib
from collections.abc import Sequence

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from kinweave.llm.common import Beside, Columns, beside, cut_table, join_salted, stored
from kinweave.llm.substrings import Hashed, anchors, mix

#: Positions that a task compares among themselves before it passes them on; a task takes some 250 bytes for each.
BATCH_WINDOWS = 1 << 18


def settle(first_key: np.ndarray, second_key: np.ndarray, n: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """For items with two hashes and a number of occurrences: which repeat for sure, the first item of
    each kind, in order, and the occurrences of each first's kind."""
    order = np.lexsort((second_key, first_key))
    if not len(order):
        return np.empty(0, bool), order, order
    a, b = first_key[order], second_key[order]
    new = np.r_[True, (a[1:] != a[:-1]) | (b[1:] != b[:-1])]
    kind = np.cumsum(new) - 1
    total = np.bincount(kind, weights=n[order]).astype(np.int64)
    repeats = np.empty(len(order), bool)
    repeats[order] = total[kind] > 1
    first = order[new]
    back = np.argsort(first)
    return repeats, first[back], total[back]


NAMES = ["row", "at", "lo", "hi", "key", "g", "n", "length"]
RANGE = ", ".join(f"{c} bigint" for c in NAMES)


def _settled(row, at, lo, hi, key, g, n, length: int):
    """Rows (row, at, lo, hi, key, g, n, length) for ranges of positions: one for each kind of this batch, n at
    most 2, and with n = 0, under a key of their own, the ranges that repeat for sure, adjoining ones as one."""
    import pyarrow as pa

    repeats, first, total = settle(key, g, n)
    done = np.flatnonzero(repeats & (n == 1))
    r, a, b = row[done], lo[done], hi[done]
    new = np.flatnonzero(np.r_[True, (r[1:] != r[:-1]) | (a[1:] != b[:-1] + 1)]) if len(done) else done
    last = np.r_[new[1:], len(done)] - 1 if len(done) else done
    own = mix((r[new].astype(np.uint64) << np.uint64(24)) + a[new].astype(np.uint64)).view(np.int64)
    none = np.zeros(len(new), np.int64)
    columns = zip((r[new], none, a[new], b[last], own, none, none), (row[first], at[first], lo[first], hi[first], key[first], g[first], np.minimum(total, 2)), strict=True)
    arrays = [np.concatenate(c) for c in columns]
    return pa.RecordBatch.from_arrays([pa.array(x) for x in [*arrays, np.full(len(arrays[0]), length)]], names=NAMES)


def _let_go(held: Sequence[list[tuple]], first: int = 0):
    """One batch of rows for each list of items, under lengths first, first + 1, …; a list is empty when its batch is passed on."""
    for length, items in enumerate(held, first):
        columns = [np.concatenate(x) for x in zip(*items, strict=True)]
        items.clear()
        batch = _settled(*columns, length)
        del columns
        yield batch


def _grams(length: int, gram: int):
    """The hashes of the anchors' grams, and how often each stands in a batch."""

    def run(batches):
        import pyarrow as pa

        for batch in batches:
            found = [np.empty(0, np.int64)]
            for text in batch.column("text"):
                data = (text.as_py() or "").encode()
                if len(data) >= length:
                    found.append(anchors(Hashed(data), length, gram)[3])
            g, n = np.unique(np.concatenate(found), return_counts=True)
            yield pa.RecordBatch.from_arrays([pa.array(g), pa.array(n)], names=["g", "n"])

    return run


def _anchors(lengths: list[int], gram: int):
    """Each text's anchors: where the gram is, which positions it stands for, and for each length the last
    of these that has so many bytes before it and the hash of all their bytes."""
    names = ["row", "g", "at", "lo", *[f"{c}_{n}" for n in lengths for c in ("hi", "key")]]

    def run(batches):
        import pyarrow as pa

        for batch in batches:
            out = []
            for row, text in zip(batch.column("row"), batch.column("text"), strict=True):
                data = (text.as_py() or "").encode()
                if len(data) >= lengths[0]:
                    h = Hashed(data)
                    at, lo, hi, g = anchors(h, lengths[0], gram)
                    columns = [np.full(len(at), row.as_py()), g, at, lo]
                    for length in lengths:
                        end = np.minimum(hi, len(data) - length)
                        some = end >= lo
                        extent = np.where(some, end + length - lo, 0)
                        key = mix(h.at(lo, extent) ^ mix((extent.astype(np.uint64) << np.uint64(24)) + (at - lo).astype(np.uint64))).view(np.int64)
                        columns += [np.where(some, end, -1), key ^ length]
                    out.append(columns)
            if out:
                yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(c)) for c in zip(*out, strict=True)], names=names)

    return run, ", ".join(f"{c} bigint" for c in names)


def _contexts(lengths: list[int]):
    """Anchors whose gram repeats, as ranges of positions for each length, keyed by context and gram."""

    def run(batches):
        for batch in batches:
            column = {c: np.ascontiguousarray(batch.column(c), np.int64) for c in batch.schema.names}
            for length in lengths:
                some = column[f"hi_{length}"] >= 0
                if some.any():
                    c = {k: v[some] for k, v in column.items()}
                    # Contexts of different lengths are different things, also where they hash alike.
                    g = mix(c["g"].view(np.uint64) ^ np.uint64(length)).view(np.int64)
                    yield _settled(c["row"], c["at"], c["lo"], c[f"hi_{length}"], c[f"key_{length}"], g, np.ones(len(g), np.int64), length)

    return run


def _texts(batches):
    for batch in batches:
        for row, text in zip(batch.column("row").to_pylist(), batch.column("text"), strict=True):
            yield row, text


def _sides(length: int, gram: int, contexts: str):
    """For open contexts, keyed by gram and name, the gram with what stands on its right and on its left, each
    for half of what a window has beside the gram. A window that repeats has one of the two repeat."""
    half = (length - gram) // 2

    def run(batches):
        known, held, count = Beside(contexts), ([], []), 0
        for row, text in _texts(batches):
            if c := known.of(row):
                h = Hashed(text.as_py().encode())
                for side, (begins, fits) in enumerate(((c["at"], c["at"] + gram + half <= h.n), (c["at"] - half, c["at"] >= half))):
                    b, lo, g = begins[fits], c["lo"][fits], c["g"][fits]
                    held[side].append((np.full(len(b), row), b, lo, lo, h.at(b, gram + half).view(np.int64), g ^ side, np.ones(len(b), np.int64)))
                count += len(c["lo"])
                if count >= BATCH_WINDOWS:
                    yield from _let_go(held)
                    count = 0
        if count:
            yield from _let_go(held)

    return run


def _ranks(h: Hashed, at: np.ndarray, length: int, base: int) -> np.ndarray:
    """The ranks of positions at a length: names at the base length, and above it pairs of ranks at half of it."""
    if length == base:
        return h.at(at, length)
    half = length // 2
    return mix(_ranks(h, at, half, base) ^ mix(_ranks(h, at + half, half, base)))


def _inside(at: np.ndarray, ranges: dict[str, np.ndarray]) -> np.ndarray:
    """Which positions lie in one of the ranges lo … hi, which come by lo."""
    if not ranges:
        return np.zeros(len(at), bool)
    k = np.searchsorted(ranges["lo"], at, side="right") - 1
    return (k >= 0) & (at <= np.maximum.accumulate(ranges["hi"])[np.maximum(k, 0)])


def _windows(length: int, base: int, gram: int, contexts: str, sides: str, lower: str | None):
    """The open positions in each text's open contexts, keyed by rank and gram. At the base length those that
    a side of the gram leaves open; above it a position is open if it and the one half the length further
    on still were at half the length."""
    half = (base - gram) // 2

    def run(batches):
        known, of_sides, of_lower = Beside(contexts), Beside(sides), Beside(lower) if lower else None
        held, count = [], 0
        for row, text in _texts(batches):
            if not (c := known.of(row)):
                continue
            size = c["hi"] - c["lo"] + 1
            of = np.repeat(np.arange(len(size)), size)
            s = np.arange(len(of)) - np.repeat(np.cumsum(size) - size, size) + c["lo"][of]
            if of_lower:
                ranges = of_lower.of(row)
                keep = _inside(s, ranges) & _inside(s + length // 2, ranges)
            else:
                found = of_sides.of(row)
                side = [_inside(c["lo"], {k: v[found["length"] == x] for k, v in found.items()} if found and (found["length"] == x).any() else {}) for x in (0, 1)]
                split = (c["at"] - half)[of]
                keep = side[0][of] & (s >= split) | side[1][of] & (s <= split)
            s, of = s[keep], of[keep]
            if len(s):
                h = Hashed(text.as_py().encode())
                held.append((np.full(len(s), row), s, s, s, _ranks(h, s, length, base).view(np.int64), c["g"][of] & 0xFFFFFFFF, c["n"][of]))
                count += len(s)
            if count >= BATCH_WINDOWS:
                yield from _let_go([held], length)
                count = 0
        if count:
            yield from _let_go([held], length)

    return run


def merged(starts: np.ndarray, ends: np.ndarray) -> list[tuple[int, int]]:
    """Maximal runs covered by intervals; touching ones are one run."""
    out: list[tuple[int, int]] = []
    for a, b in sorted(zip(starts.tolist(), ends.tolist(), strict=True)):
        if out and a <= out[-1][1]:
            out[-1] = (out[-1][0], max(b, out[-1][1]))
        else:
            out.append((a, b))
    return out


def _cut(lengths: list[int], found: list[str], with_kept: bool):
    """Each text's results, from where its open positions are written down for each length."""
    names = ["n_bytes", "n_removed", "n_spans", "kept_sha256", "longest_repeat", "kept", "spans"]

    def run(batches):
        import pyarrow as pa

        known = [Beside(uri) for uri in found]
        for batch in batches:
            for at in range(0, batch.num_rows, 64):
                piece, out = batch.slice(at, 64), []
                for row, text in _texts([piece]):
                    data = (text.as_py() or "").encode()
                    ranges = [k.of(row) for k in known]
                    spans = merged(ranges[-1]["lo"], ranges[-1]["hi"] + lengths[-1]) if ranges[-1] else []
                    edges = [0, *[x for span in spans for x in span], len(data)]
                    kept = b"".join(data[a:b] for a, b in zip(edges[::2], edges[1::2], strict=True))
                    longest = max((n for n, r in zip(lengths, ranges, strict=True) if r), default=0)
                    out.append((len(data), len(data) - len(kept), len(spans), hashlib.sha256(kept).hexdigest(), longest, kept if with_kept else None, [{"s": a, "e": b} for a, b in spans]))
                columns = [pa.array(x, run.schema.field(c).type) for c, x in zip(names, zip(*out, strict=True), strict=True)]
                yield pa.RecordBatch.from_arrays([piece.column("doc_id"), *columns], names=["doc_id", *names])

    return run


def open_ranges(texts: DataFrame, lengths: list[int], gram: int) -> list[str]:
    """For each length where it is written down (see Beside) which ranges lo … hi of each row's positions have
    a string of that length that also starts elsewhere, for texts (row, text)."""
    grams = texts.mapInArrow(_grams(lengths[0], gram), "g bigint, n bigint")
    repeated = cut_table(grams.groupBy("g").agg(F.sum("n").alias("n")).where("n > 1"))
    run, schema = _anchors(lengths, gram)
    total = repeated.agg(F.sum("n")).first()[0] or 0
    met = join_salted(texts.mapInArrow(run, schema), repeated.select("g"), "g", repeated, total, ["row", "lo"], "left_semi")

    kind = W.partitionBy("key", "g")
    done = (F.col("n") == 0) | ((F.col("n") == 1) & (F.col("total") > 1))
    ranked = met.mapInArrow(_contexts(lengths), RANGE).withColumns(
        {"total": F.sum("n").over(kind), "place": F.row_number().over(kind.orderBy(F.desc("n"), "row", "lo"))}
    )
    names = ["row", "at", "lo", "hi", "g", "length", F.least("total", F.lit(2)).alias("n"), done.alias("done"), ((F.col("n") > 0) & (F.col("place") == 1)).alias("leads")]
    found = cut_table(ranked.select(*names).where("done or leads"))
    leads = found.where("leads")
    several = leads.groupBy("g").agg(F.count(F.lit(1)).alias("kinds")).where("kinds > 1").select("g")
    contexts = cut_table(leads.join(several, "g", "left_semi").select("row", "at", "lo", "hi", "g", "n", "length"))

    def settled(laid: DataFrame, *names: str) -> DataFrame:
        return laid.withColumn("total", F.sum("n").over(kind)).where(done).select("row", "lo", "hi", *names)

    out: list[str] = []
    sides = ""
    for length in lengths:
        of_length = F.col("length") == length
        lists = beside(contexts.where(of_length).drop("length"))
        if not out:
            sides = beside(settled(texts.mapInArrow(_sides(length, gram, lists), RANGE), "length"))
        laid = texts.mapInArrow(_windows(length, lengths[0], gram, lists, sides, out[-1] if out else None), RANGE)
        out.append(beside(settled(laid).union(found.where("done").where(of_length).select("row", "lo", "hi"))))
    return out


def remove(docs: DataFrame, length: int = 400, gram: int = 80, rounds: int = 2, number=stored, with_kept: bool = True) -> DataFrame:
    """(doc_id, n_bytes, n_removed, n_spans, kept_sha256, longest_repeat, kept, spans) for each row of docs (doc_id, text).

    rounds: how many lengths there are, each the double of the one before, `length` the last; longest_repeat
    is one of these lengths, or 0 where no string of even the first one repeats. gram: the anchors' bytes.
    number: how rows are told apart, `common.stored` or, for files as they were read, `common.placed`. with_kept: whether to give what remains of the texts; else kept is null.
    """
    from pyspark.sql import types as T
    from pyspark.sql.pandas.types import to_arrow_schema

    lengths = [length >> k for k in range(rounds - 1, -1, -1)]
    if length % (1 << rounds - 1) or not 1 <= gram <= lengths[0]:
        raise ValueError("lengths double, and a gram is part of the first one's windows")
    given = Columns(docs)
    rows = number(given.rows.select(F.col(given["doc_id"]).alias("doc_id"), F.col(given["text"]).alias("text")))
    kind = dict(rows.dtypes)["doc_id"]
    out = T.StructType.fromDDL(f"doc_id {kind}, n_bytes bigint, n_removed bigint, n_spans bigint, kept_sha256 string, longest_repeat bigint, kept binary, spans array<struct<s:int,e:int>>")
    run = _cut(lengths, open_ranges(rows.select("row", "text"), lengths, gram), with_kept)
    run.schema = to_arrow_schema(out)
    return rows.mapInArrow(run, out)
