"""Near-duplicate documents by SimHash fingerprints and Golay-code fuzzy hashing.

1. Each text, A-Z in lower case, gives its 4-word shingles (fewer words: the whole sequence) and from
   their XXH64 values a 64-bit fingerprint: a bit is set if over half the shingles set it.
2. Distinct fingerprints are cut into segments of 22, 21 and 21 bits, each padded to 23. At most 4
   differing bits leave two segments that differ in at most 2 bits together, so on each of the three
   pairs of segments every fingerprint gets all pairs of its Golay indices as keys: two linked
   fingerprints share a key of some pair.
3. Rows are dealt by key and sorted. Within a key, distances are computed and links kept as a forest:
   a group of m near copies gives fewer than m rows for a key, not m². A key with over `most` members
   goes on to a second round in which its members meet block by block, still without loss.
4. Connected components over fingerprints; a component is named after its smallest doc_id.

A null or empty text has fingerprint zero and is linked like any other. Rows with equal texts share
their fingerprint. A null doc_id takes part but names nothing, unless a component has no other: then
its component_id is null. An empty table gives an empty one. A very long text needs some twenty times
its size in memory while its shingles are counted. `near_duplicates` reads no other columns; all pass
through `keep_first`, whatever their names.
"""

from __future__ import annotations

import numpy as np
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from kinweave.llm import golay, setjoin
from kinweave.llm.common import Beside, Columns, append, beside, cut_table, join_hot, lean, stored
from kinweave.llm.components import components

#: Segments as (shift, bits).
SEGMENTS = ((42, 22), (21, 21), (0, 21))
PAIRS = ((0, 1), (0, 2), (1, 2))


def fingerprint(text: str | None, width: int = 4) -> int:
    """The fingerprint of a text as a signed 64-bit number."""
    w = (text or "").encode().lower().split()
    if not w:
        return 0
    shingles = map(b" ".join, zip(*[w[i:] for i in range(width)], strict=False)) if len(w) >= width else [b" ".join(w)]
    h = np.array([xxhash.xxh64_intdigest(s, 42) for s in shingles], dtype="<u8")
    votes = np.add.reduce(np.unpackbits(h.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little"), axis=0, dtype=np.int64)
    return int(np.packbits(2 * votes > len(h), bitorder="little").view("<i8")[0])


def with_fingerprint(docs: DataFrame, into: str = "fingerprint_bits") -> DataFrame:
    return append(docs, f"`{into}` bigint", lambda: lambda texts: [[fingerprint(t) for t in texts]])


def keys_of(fingerprints: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """All (key, fingerprint) rows; a key is a pair of segments and one Golay index of each."""
    f = fingerprints.view(np.uint64)
    segments = [golay.indices((f >> np.uint64(shift) & np.uint64((1 << bits) - 1)).astype(np.uint32)) for shift, bits in SEGMENTS]
    keys, owners = [], []
    for p, (i, j) in enumerate(PAIRS):
        (a, n), (b, m) = segments[i], segments[j]
        for x in range(golay.MOST):
            for y in range(golay.MOST):
                at = np.flatnonzero((n > x) & (m > y))
                keys.append(p << 24 | a[at, x].astype(np.int64) << 12 | b[at, y].astype(np.int64))
                owners.append(fingerprints[at])
    return np.concatenate(keys), np.concatenate(owners)


def differing(f: np.ndarray, g: np.ndarray) -> np.ndarray:
    """How many bits differ between fingerprints, rows of 64-bit words."""
    return np.bitwise_count(f ^ g).sum(axis=-1)


def forest(f: np.ndarray, ids: np.ndarray, distance: int, descending: bool = False) -> tuple[np.ndarray, np.ndarray]:
    """Links that connect whatever links of at most `distance` bits connect in f, at most len(f) - 1 of them.
    Most are links to the smallest ids, or to the largest."""
    order = np.argsort(ids)[:: -1 if descending else 1]
    left, names, a, b = f[order], ids[order], [], []
    frontier: list = []
    while len(left):
        if frontier:
            node, name = frontier.pop()
        else:
            node, name, left, names = left[0], names[0], left[1:], names[1:]
        near = differing(left, node) <= distance
        if near.any():
            a.append(np.full(near.sum(), name))
            b.append(names[near])
            frontier.extend(zip(left[near], names[near], strict=True))
            left, names = left[~near], names[~near]
    if not a:
        return np.empty(0, np.int64), np.empty(0, np.int64)
    return np.concatenate(a), np.concatenate(b)


def links_in(keys: np.ndarray, f: np.ndarray, ids: np.ndarray, distance: int, small: int = 48, both_ways: bool = False) -> tuple[np.ndarray, np.ndarray]:
    """Links within the runs of equal keys. Short runs are compared all at once, at growing offsets; of the
    others a forest is given, or two."""
    starts = np.flatnonzero(np.r_[True, keys[1:] != keys[:-1]]) if len(keys) else np.empty(0, np.int64)
    sizes = np.diff(np.r_[starts, len(keys)])
    a, b = [], []
    for s, n in zip(starts[sizes > small].tolist(), sizes[sizes > small].tolist(), strict=True):
        for descending in (False, True) if both_ways else (False,):
            x, y = forest(f[s : s + n], ids[s : s + n], distance, descending)
            a.append(np.minimum(x, y))
            b.append(np.maximum(x, y))
    after = np.repeat(np.where(sizes > small, 0, starts + sizes), sizes)  # the end of each row's run
    at = np.arange(len(keys))
    offset = 1
    while len(at := at[at + offset < after[at]]):
        near = at[differing(f[at], f[at + offset]) <= distance]
        a.append(ids[near])
        b.append(ids[near + offset])
        offset += 1
    if not a:
        return np.empty(0, np.int64), np.empty(0, np.int64)
    pairs = np.unique(np.stack([np.concatenate(a), np.concatenate(b)], axis=1), axis=0)
    return pairs[:, 0], pairs[:, 1]


def _words(batch, words: list[str]) -> np.ndarray:
    """The fingerprints of a batch of rows, as rows of 64-bit words."""
    return np.stack([np.ascontiguousarray(batch.column(w), np.int64) for w in words], axis=1).view(np.uint64)


def _emit_keys(batches):
    import pyarrow as pa

    for batch in batches:
        f = np.ascontiguousarray(batch.column("f"), np.int64)
        for at in range(0, len(f), 8192):
            k, o = keys_of(f[at : at + 8192])
            yield pa.RecordBatch.from_arrays([pa.array(k), pa.array(o)], names=["k", "f"])


def _emit_links(words: list[str], name: str, distance: int, most: int, small: int, both_ways: bool, chunk: int = 1 << 17):
    """A task's rows come sorted by key. Whole runs are worked off in chunks; a run over `most` passes
    through with its key for the second round."""

    def run(batches):
        import pyarrow as pa

        def links(k, f, ids):
            a, b = links_in(k, f, ids, distance, small, both_ways)
            none = pa.nulls(len(a), pa.int64())
            return pa.RecordBatch.from_arrays([pa.array(a), pa.array(b), none, *[none for _ in words]], names=NAMES_LINK + [f"w{i}" for i in range(len(words))])

        def passed(k, f, ids):
            return pa.RecordBatch.from_arrays([pa.array(ids), pa.array(ids), pa.array(k), *[pa.array(x) for x in f.view(np.int64).T.copy()]], names=NAMES_LINK + [f"w{i}" for i in range(len(words))])

        held: list[tuple] = []
        passing = None
        for batch in batches:
            rows = (np.ascontiguousarray(batch.column("k"), np.int64), _words(batch, words), np.ascontiguousarray(batch.column(name), np.int64))
            if passing is not None:
                n = int(np.searchsorted(rows[0], passing, side="right"))
                if n:
                    yield passed(*(x[:n] for x in rows))
                if n == len(rows[0]):
                    continue
                passing, rows = None, tuple(x[n:] for x in rows)
            held.append(rows)
            if sum(len(x[0]) for x in held) < chunk:
                continue
            rows = tuple(np.concatenate(x) for x in zip(*held, strict=True))
            last = int(np.searchsorted(rows[0], rows[0][-1]))  # the last run may go on
            yield links(*(x[:last] for x in rows))
            held = [tuple(x[last:] for x in rows)]
            if len(rows[0]) - last > most:
                yield passed(*held[0])
                held, passing = [], rows[0][-1]
        if held:
            yield links(*(np.concatenate(x) for x in zip(*held, strict=True)))

    return run


NAMES_LINK = ["a", "b", "k"]


def _blockwise(over: DataFrame, words: int, distance: int, block: int) -> DataFrame:
    """Links within keys of too many members: members are dealt to blocks, and every two blocks meet in one task."""
    sizes = over.groupBy("k").agg(F.ceil(F.count(F.lit(1)) / block).alias("n"))
    rows = over.join(F.broadcast(sizes), "k").withColumn("x", F.pmod(F.xxhash64("a"), F.col("n")))
    rows = rows.withColumn("y", F.explode(F.sequence(F.lit(0).cast("bigint"), F.col("n") - 1)))
    names = [f"w{i}" for i in range(words)]
    rows = rows.select("k", F.least("x", "y").alias("i"), F.greatest("x", "y").alias("j"), "a", *names)

    def meet(pdf):
        import pandas as pd

        pdf = pdf.drop_duplicates("a")
        a, b = forest(np.stack([pdf[w].to_numpy() for w in names], axis=1).view(np.uint64), pdf["a"].to_numpy(), distance)
        return pd.DataFrame({"a": a, "b": b})

    return rows.groupBy("k", "i", "j").applyInPandas(meet, "a bigint, b bigint")


def links_by_key(keys: DataFrame, words: list[str], name: str, distance: int, most: int, small: int = 48, both_ways: bool = False) -> DataFrame:
    """(a, b): links among rows of equal k, named by a column, whose fingerprints in `words` differ in at most
    `distance` bits; enough of them to connect what all such links connect within a k (see links_in)."""
    schema = ", ".join(f"{c} bigint" for c in [*NAMES_LINK, *[f"w{i}" for i in range(len(words))]])
    found = cut_table(keys.repartition("k").sortWithinPartitions("k").mapInArrow(lean(_emit_links(words, name, distance, most, small, both_ways)), schema))
    links, over = found.where("k is null").select("a", "b"), found.where("k is not null")
    return links if over.isEmpty() else links.union(_blockwise(over, len(words), distance, most))


def link(fingerprints: DataFrame, distance: int = 4, most: int = 1 << 16) -> DataFrame:
    """(a, b): links that connect the distinct fingerprints f just as all pairs within `distance` (at most 4) bits do."""
    if not 0 <= distance <= 4:
        raise ValueError("the keys find all links of up to 4 bits")
    return links_by_key(fingerprints.mapInArrow(_emit_keys, "k bigint, f bigint"), ["f"], "f", distance, most)


def groups(nodes: DataFrame, distance: int = 4) -> DataFrame:
    """nodes with a column label, equal for linked fingerprints; nodes have one row for each fingerprint f."""
    labels = cut_table(components(link(nodes.select("f"), distance)).select(F.col("node").alias("f"), "label"))
    return nodes.join(labels, "f", "left").withColumn("label", F.coalesce("label", "f"))


def near_duplicates(docs: DataFrame, distance: int = 4) -> DataFrame:
    """(doc_id, fingerprint, component_id) for each row of docs (doc_id, text)."""
    given = Columns(docs)
    rows = given.rows.select(F.col(given["doc_id"]).alias("doc_id"), F.col(given["text"]).alias("text"))
    prints = cut_table(with_fingerprint(rows, "f").select("doc_id", "f"))
    nodes = prints.groupBy("f").agg(F.min("doc_id").alias("first"), F.count(F.lit(1)).alias("n"))
    grouped = cut_table(groups(cut_table(nodes), distance))
    named = grouped.groupBy("label").agg(F.min("first").alias("component_id"), F.count(F.lit(1)).alias("members"))
    of_print = join_hot(grouped, named, "label", "members", grouped.count()).select("f", "n", "component_id")
    whole = join_hot(prints, cut_table(of_print), "f", "n", prints.count())
    return whole.select("doc_id", F.lower(F.lpad(F.hex("f"), 16, "0")).alias("fingerprint"), "component_id")


# Near copies by similarity: wider fingerprints, several codewords a segment by soft decoding, and exact
# similarities of the pairs that they bring together.

#: Segments of 23 bits in a fingerprint of 128, codewords of each, and how many bits of similar texts may
#: differ: texts with a similarity of 0.8 differ in 19.4 on average, unlike ones in 64.
PARTS, CODES, REACH = 5, 3, 32


def shingles(text: str | None, width: int) -> list[bytes]:
    """Runs of `width` words of a text, A-Z in lower case, repeats included; of fewer words the whole sequence."""
    w = (text or "").encode().lower().split()
    if len(w) < width:
        return [b" ".join(w)] if w else []
    return [b" ".join(w[i : i + width]) for i in range(len(w) - width + 1)]


def _digests(text: str | None, width: int) -> np.ndarray:
    """128-bit hashes of the different shingles of a text, 16 bytes a row."""
    s = set(shingles(text, width))
    return np.frombuffer(b"".join(map(xxhash.xxh3_128_digest, s)), np.uint8).reshape(len(s), 16)


def _elements(width: int):
    """The different shingles of a text as sorted numbers, a half of their hashes."""
    return lambda text: np.unique(_digests(text, width)[:, :8].copy().view("<i8").ravel())


def _wide(width: int):
    """For texts: what their set of shingles is known by, their 128-bit fingerprints and, two bytes each, the codewords of
    the segments."""

    def run(texts):
        votes, known = np.zeros((len(texts), 128), np.int64), np.zeros((len(texts), 2), "<i8")
        for i, t in enumerate(texts):
            h = _digests(t, width)
            if len(h):
                votes[i] = 2 * np.add.reduce(np.unpackbits(h, axis=1, bitorder="little"), axis=0, dtype=np.int64) - len(h)
            e = np.unique(h[:, :8].copy().view("<i8").ravel())
            known[i] = np.frombuffer(xxhash.xxh3_128_digest(e.tobytes()), "<i8")
        f = np.packbits(votes > 0, axis=1, bitorder="little").view("<i8")
        # How sure a bit is grows with its margin, up to twice the text's mean.
        margins = np.clip(votes / np.maximum(np.abs(votes).mean(axis=1, keepdims=True), 1e-9), -2, 2)
        codes = [golay.nearest(margins[:, 23 * p : 23 * p + 23], CODES) for p in range(PARTS)]
        return [known[:, 0].tolist(), known[:, 1].tolist(), f[:, 0].tolist(), f[:, 1].tolist(), [x.tobytes() for x in np.concatenate(codes, axis=1).astype("<u2")]]

    return run


def _wide_keys(batches):
    """Rows (k, f0, f1, row): for each pair of segments all pairs of their codewords."""
    import pyarrow as pa

    for batch in batches:
        for at in range(0, batch.num_rows, 4096):
            piece = batch.slice(at, 4096)
            codes = np.frombuffer(b"".join(piece.column("codes").to_pylist()), "<u2").reshape(-1, PARTS, CODES).astype(np.int64)
            keys = [(PARTS * i + j) << 24 | codes[:, i, x] << 12 | codes[:, j, y] for i in range(PARTS) for j in range(i) for x in range(CODES) for y in range(CODES)]
            columns = [np.tile(np.ascontiguousarray(piece.column(c), np.int64), len(keys)) for c in ("f0", "f1", "row")]
            yield pa.RecordBatch.from_arrays([pa.array(x) for x in (np.concatenate(keys), *columns)], names=["k", "f0", "f1", "row"])


def _chosen(uri: str):
    def run(batches):
        import pyarrow as pa

        known = Beside(uri)
        for batch in batches:
            yield batch.filter(pa.array([bool(known.of(r)) for r in batch.column("row").to_pylist()], pa.bool_()))

    return run


def similar(texts: DataFrame, nodes: DataFrame, similarity: float, width: int, most: int = 1 << 16) -> DataFrame:
    """(a, b): links between nodes (row, f0, f1, codes), by rows of texts (row, text), that are similar: the
    different shingles that both have are at least this share of those that either has."""
    candidates = links_by_key(nodes.mapInArrow(lean(_wide_keys), "k bigint, f0 bigint, f1 bigint, row bigint"), ["f0", "f1"], "row", REACH, most, small=8, both_ways=True)
    pairs = cut_table(candidates.select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).where("a <> b").distinct())
    return setjoin.verified(texts, pairs, similarity, _elements(width))


def similar_groups(texts: DataFrame, nodes: DataFrame, similarity: float, width: int, few: int = 64) -> DataFrame:
    """(row, label) of every node (row, f0, f1, codes): those with the same label are linked by similar ones.
    Fingerprints find nearly all links; a prefix-filtered join of what they leave apart finds the rest."""
    labels = cut_table(components(similar(texts, nodes, similarity, width)).select(F.col("node").alias("row"), "label"))
    labelled = cut_table(nodes.select("row").join(labels, "row", "left").withColumn("label", F.coalesce("label", "row")))
    rest = setjoin.missing_pairs(texts, labelled, similarity, _elements(width), few)
    found = setjoin.verified(texts, rest, similarity, _elements(width))
    if found.isEmpty():
        return labelled
    joined = components(found.union(labels.select("row", "label"))).select(F.col("node").alias("row"), F.col("label").alias("joined"))
    return labelled.join(joined, "row", "left").select("row", F.coalesce("joined", "label").alias("label"))


def keep_first(docs: DataFrame, similarity: float = 0.8, width: int = 5, number=stored, few: int = 64) -> DataFrame:
    """The rows of docs (with columns doc_id and text) that come first in their group of near copies, one row
    for each group, with all columns. Near copies share at least `similarity` of their different shingles of `width`
    words, or are linked by others that do. No link is lost.

    Fingerprints of 128 bits are cut into segments, and each segment is decoded to the codewords nearest
    to its votes, sure bits counting for more: texts that are similar share a codeword in two segments at
    least, with few exceptions. Pairs that share both and differ in at most REACH bits are compared by all of
    their shingles; where more than eight texts share a pair of codewords, two forests of such pairs, so that
    the work grows with the texts. What similar texts that leaves apart, an exact join of the different groups'
    prefixes brings together (see setjoin); few: how many texts may share a shingle before that goes another way.

    Rows come in the order of their doc_id (null last), a hash of their text, and their place. Null and empty
    texts are copies of each other. number: how rows are told apart, `common.stored` or, for files as they
    were read, `common.placed`. All is decided on narrow rows, and texts don't move.
    """
    given = Columns(docs)
    rows = number(given.rows)
    doc_id, text = F.col(given["doc_id"]), F.col(given["text"])
    place = F.struct(doc_id.isNull().alias("none"), doc_id.alias("doc_id"), F.xxhash64(text).alias("hash"), F.col("row").alias("row"))
    schema = "k0 bigint, k1 bigint, f0 bigint, f1 bigint, codes binary"
    prints = append(rows.select(place.alias("place"), text.alias("text")), schema, lambda: _wide(width), rows=256).drop("text")
    first = prints.groupBy("k0", "k1").agg(F.min(F.struct("place", "f0", "f1", "codes")).alias("first"))
    nodes = cut_table(first.select("first.*", F.col("first.place.row").alias("row")))
    labels = similar_groups(rows.select("row", text.alias("text")), nodes, similarity, width, few)
    grouped = nodes.select("row", "place").join(labels, "row")
    kept = grouped.groupBy("label").agg(F.min("place").alias("place")).select("place.row", F.lit(0).cast("bigint").alias("lo"))
    return given.back(rows.mapInArrow(lean(_chosen(beside(kept))), rows.schema))
