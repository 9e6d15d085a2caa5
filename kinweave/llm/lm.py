"""Language-model scoring with an n-gram trie of `order` levels in Elias-Fano codes.

Level 1 holds the words, by their 64-bit hashes; a word's number is its rank by hash. An n-gram of a higher
level is a child of its first n - 1 words, which the level before holds, and stands there under a number
relative to its context: the place of its last n - 1 words among the children of its middle n - 2 (at level
2, the word's number). So numbers stay small, whatever the vocabulary.

Training, over all training texts, one level after the other:
0. A pass estimates how many words differ, so that words are cut into ranges of hashes of even size.
1. Each batch looks up what the levels so far say, and counts its n-grams. The counts go out as sorted,
   Elias-Fano coded blocks, one for each range of contexts; a range's blocks are merged by one task.
2. Ranges of contexts are laid by their counts at the level before, and a context with very many is cut into
   several ranges, so no task gets much more than `range_tokens` tokens however common a context is.
3. Each range is written as one file in the shared folder: the contexts' pointers and the children as
   monotone Elias-Fano sequences, and in 8 bits each the logarithms of the children's discounted
   probabilities and of the contexts' weights of the level before.

Scoring maps the files into memory, so pages that are used are read, and shared by all tasks of a machine;
only the ranges that a batch touches are opened. An n-gram is found by a successor search among its
context's children. The probability is (c(h w) - D) / c(h) + D * children(h) / c(h) * P(w after one word
less), and that of the shorter context where h was not seen; with no context it is the base's add-one
estimate. The text begins after an end token, and contexts don't reach back further than that.

A null text counts as an empty one: a single token, end. A null doc_id is not held out. Repeated rows
count and are scored as rows of their own. An empty table gives an empty one; without training texts every
token is unseen. A very long text is looked up as a whole, in memory of some hundred bytes a word. Columns
other than doc_id and text are not read. The shared folder must be one that pyarrow can open. What the
driver and each task hold of the model are a few numbers for each range.
"""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Iterable
from functools import lru_cache

import numpy as np
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from kinweave.llm import eliasfano
from kinweave.llm.common import Columns, append, by_range, own_dir

#: The end token's stand-in: no word holds a space.
END = xxhash.xxh64_intdigest(b" ")
#: Tokens that a task counts at once.
BATCH = 1 << 21
#: Steps of an 8-bit logarithm to a doubling.
STEPS = 6


class Files:
    """Files under a URI, written whole or not at all, read as memory maps."""

    def __init__(self, uri: str):
        from pyarrow import fs

        self.fs, self.path = fs.FileSystem.from_uri(uri)
        self.local = isinstance(self.fs, fs.LocalFileSystem)

    def write(self, name: str, words: np.ndarray) -> None:
        self.fs.create_dir(self.path, recursive=True)
        own = f"{self.path}/{name}.{uuid.uuid4().hex}"
        with self.fs.open_output_stream(own) as out:
            out.write(np.ascontiguousarray(words).tobytes())
        self.fs.move(own, f"{self.path}/{name}")  # a task that runs twice writes the same

    def read(self, name: str) -> np.ndarray:
        path = f"{self.path}/{name}"
        if not self.local:
            # A copy without a name: its space is free again when the map is given up or the task's process ends.
            with tempfile.TemporaryFile() as copy, self.fs.open_input_stream(path) as source:
                while piece := source.read(1 << 22):
                    copy.write(piece)
                copy.flush()
                return np.memmap(copy, np.uint64, "r").view(np.ndarray)
        return np.memmap(path, np.uint64, "r").view(np.ndarray)


def hashes(text: str | None) -> np.ndarray:
    """The hashes of a text's tokens: its words, A-Z in lower case, then end."""
    words = (text or "").encode().lower().split()
    words.append(b" ")
    return np.fromiter(map(xxhash.xxh64_intdigest, words), np.uint64, len(words))


def held_out(doc_id: Column, parts: int = 7, part: int = 2) -> Column:
    return F.coalesce(F.crc32(doc_id.cast("string")) % parts == part, F.lit(False))


def block(keys: np.ndarray, counts: np.ndarray) -> bytes:
    """Sorted keys with counts: Elias-Fano for the keys above the first, counts in one byte, large ones beside them."""
    first = int(keys[0])
    codes = eliasfano.encode(keys - keys[0], int(keys[-1]) - first + 1)
    large = np.flatnonzero(counts >= 255)
    head = np.array([first, len(keys), len(large)], np.uint64)
    return head.tobytes() + codes.tobytes() + counts[large].astype(np.uint64).tobytes() + np.minimum(counts, 255).astype(np.uint8).tobytes()


def unblock(data: bytes) -> tuple[np.ndarray, np.ndarray]:
    first, n, large = (int(x) for x in np.frombuffer(data, np.uint64, 3))
    codes = eliasfano.Codes(np.frombuffer(data, np.uint64, (len(data) - n) // 8, 0)[3:])
    counts = np.frombuffer(data, np.uint8, n, len(data) - n).astype(np.int64)
    counts[counts == 255] = np.frombuffer(data, np.uint64, large, 8 * (3 + codes.words)).astype(np.int64)
    return codes.all() + np.uint64(first), counts


def _summed(parts: list[tuple[np.ndarray, np.ndarray]]) -> tuple[np.ndarray, np.ndarray]:
    keys, counts = (np.concatenate(x) for x in zip(*parts, strict=True))
    order = np.argsort(keys, kind="stable")
    keys, counts = keys[order], counts[order]
    start = np.flatnonzero(np.r_[True, keys[1:] != keys[:-1]])
    return keys[start], np.add.reduceat(counts, start)


def merge(blocks: Iterable[bytes], most: int = 1 << 22) -> tuple[np.ndarray, np.ndarray]:
    """The keys of all blocks with their counts; folds blocks as they come, so that never more is held than
    `most` keys, or twice the different ones."""
    parts: list[tuple[np.ndarray, np.ndarray]] = []
    held, limit = 0, most
    for data in blocks:
        parts.append(unblock(data))
        held += len(parts[-1][0])
        if held >= limit:
            parts = [_summed(parts)]
            held = len(parts[0][0])
            limit = max(most, 2 * held)
    return _summed(parts)


#: Registers of the estimate of how many words differ, as a power of two.
REGISTERS = 11


def _registers(batches):
    """(register, rank): what a task's words set in a HyperLogLog estimate."""
    import pyarrow as pa

    most, low = np.zeros(1 << REGISTERS, np.int64), np.uint64((1 << 52) - 1)
    for found, _ in _batches(batches):
        ranks = 53 - np.frexp((found & low).astype(np.float64))[1].astype(np.int64)
        np.maximum.at(most, (found >> np.uint64(64 - REGISTERS)).astype(np.int64), ranks)
    full = np.flatnonzero(most)
    yield pa.RecordBatch.from_arrays([pa.array(full), pa.array(most[full])], names=["register", "rank"])


def different_words(texts: DataFrame) -> int:
    """About how many words differ, within a few hundredths; it lays out the ranges and enters no result."""
    rows = texts.mapInArrow(_registers, "register bigint, rank bigint").groupBy("register").agg(F.max("rank").alias("rank")).collect()
    m = 1 << REGISTERS
    ranks = np.zeros(m)
    for r in rows:  # 2,048 at most
        ranks[r["register"]] = r["rank"]
    empty = m - len(rows)
    found = 0.7213 / (1 + 1.079 / m) * m * m / np.exp2(-ranks).sum()
    return int(m * np.log(m / empty) if empty and found < 2.5 * m else found)


def _batches(batches, most: int = BATCH):
    """Token hashes of many texts at once, with the texts' lengths."""
    held, size = [], 0
    for batch in batches:
        for text in batch.column("text"):
            held.append(hashes(text.as_py()))
            size += len(held[-1])
            if size >= most:
                yield np.concatenate(held), np.array([len(x) for x in held])
                held, size = [], 0
    if held:
        yield np.concatenate(held), np.array([len(x) for x in held])


def _blocks_by_range(keys: np.ndarray, of: np.ndarray, ranges: int):
    """(range, block) rows for keys in the ranges `of`."""
    import pyarrow as pa

    full, data = [], []
    for r, where in _grouped(of, ranges):
        full.append(r)
        data.append(block(*np.unique(keys[where], return_counts=True)))
    return pa.RecordBatch.from_arrays([pa.array(full, pa.int64()), pa.array(data, pa.binary())], names=["range", "block"])


def _lay_ranges(counts: np.ndarray, most: int) -> tuple[np.ndarray, np.ndarray]:
    """Where ranges of contexts with these counts begin: (context, parts). A range has about `most` tokens; a
    context with more has as many ranges of its own as it needs, parts, and stands there as often."""
    parts = np.maximum(1, -(-counts // most))
    whole = np.cumsum(np.where(parts > 1, 0, counts))
    begins = (parts > 1) | np.r_[True, (whole[1:] // most != whole[:-1] // most) | (parts[:-1] > 1)]
    return np.repeat(np.flatnonzero(begins), parts[begins]), np.repeat(parts[begins], parts[begins])


def _padded(x: np.ndarray) -> np.ndarray:
    return np.pad(x, (0, -len(x) % 8)).view(np.uint64)


def _logs(x: np.ndarray) -> np.ndarray:
    """Numbers from 0 to 1 as logarithms in 8 bits."""
    return np.clip(np.rint(-STEPS * np.log2(x)), 0, 255).astype(np.uint8)


#: What an 8-bit logarithm stands for.
_VALUES = np.exp2(-np.arange(256) / STEPS)


class Words:
    """Level 1: words by hash, their numbers and counts, in ranges of hashes."""

    def __init__(self, uri: str, sizes: np.ndarray):
        self.files, self.offsets = Files(uri), np.r_[0, np.cumsum(sizes)]
        self.bounds = _hash_bounds(len(sizes))

    @lru_cache(64)  # noqa: B019  one object for each task
    def _range(self, r: int):
        data = self.files.read(f"words-{r}")
        first, n, large = (int(x) for x in data[:3])
        codes = eliasfano.Codes(data[3:])
        end = 3 + codes.words + 2 * large
        return first, codes, data[3 + codes.words : 3 + codes.words + large], data[3 + codes.words + large : end], data[end:].view(np.uint8)[:n]

    def look_up(self, hashes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Numbers (-1: unseen) and counts of sorted hashes."""
        number, count = np.full(len(hashes), -1), np.zeros(len(hashes), np.int64)
        of = np.searchsorted(self.bounds, hashes, side="right") - 1
        touched, starts = np.unique(of, return_index=True)
        for r, a, b in zip(touched.tolist(), starts, np.r_[starts[1:], len(of)], strict=True):
            if self.offsets[r + 1] > self.offsets[r]:
                first, codes, places, large, small = self._range(r)
                x = hashes[a:b] - np.uint64(first)
                inside = np.flatnonzero((hashes[a:b] >= np.uint64(first)) & (x < np.uint64(codes.universe)))
                at = codes.find(x[inside])
                inside, at = inside[at >= 0] + a, at[at >= 0]
                number[inside], count[inside] = self.offsets[r] + at, small[at]
                many = np.flatnonzero(count[inside] == 255)
                count[inside[many]] = large[np.searchsorted(places, at[many].astype(np.uint64))].astype(np.int64)
        return number, count

    @staticmethod
    def write(files: Files, r: int, keys: np.ndarray, counts: np.ndarray) -> None:
        large = np.flatnonzero(counts >= 255)
        codes = eliasfano.encode(keys - keys[0], int(keys[-1]) - int(keys[0]) + 1)
        head = np.array([keys[0], len(keys), len(large)], np.uint64)
        small = _padded(np.minimum(counts, 255).astype(np.uint8))
        files.write(f"words-{r}", np.concatenate([head, codes, large.astype(np.uint64), counts[large].astype(np.uint64), small]))


def _hash_bounds(ranges: int) -> np.ndarray:
    return np.array([(r << 64) // ranges for r in range(ranges)], np.uint64)


class Level:
    """A level from the second on. firsts, parts: each range's first context, and how many ranges that has, if
    it has some of its own; sizes: the n-grams of each range. An n-gram's number is its place in the level."""

    def __init__(self, uri: str, order: int, span: int, firsts: np.ndarray, parts: np.ndarray):
        self.files, self.order, self.span, self.firsts, self.parts = Files(uri), order, span, firsts, parts
        self.cut: dict[int, float] = {}

    def made(self, sizes: np.ndarray, totals: dict[int, int], discount: float) -> None:
        """sizes as they came out, and the counts of the contexts that were cut."""
        self.sizes, self.offsets = sizes, np.r_[0, np.cumsum(sizes)]
        for context, total in totals.items():
            a, b = np.searchsorted(self.firsts, [context, context + 1])
            self.cut[context] = discount * int(sizes[a:b].sum()) / total

    def keys(self, context: np.ndarray, child: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The range that an n-gram belongs to, and its key there."""
        r = np.searchsorted(self.firsts, context, side="right") - 1
        n = self.parts[r]
        r = r - (n - 1) + child % n
        return r, (context - self.firsts[r]) * self.span + child

    @lru_cache(64)  # noqa: B019  one object for each task
    def _range(self, r: int):
        data = self.files.read(f"level{self.order}-{r}")
        n, contexts = int(data[0]), int(data[1])
        pointers = eliasfano.Codes(data[2:])
        at = 2 + pointers.words
        children = eliasfano.Codes(data[at:])
        at += children.words
        weights = data[at:].view(np.uint8)[:contexts]
        return pointers, children, weights, data[at + -(-contexts // 8) :].view(np.uint8)[:n]

    def write(self, r: int, keys: np.ndarray, counts: np.ndarray, total: int | None, discount: float) -> None:
        """The file of a range. total: the count of its only context, where that is cut."""
        context, child = keys // self.span, keys % self.span
        contexts = int(context[-1]) + 1
        pointers = np.searchsorted(context, np.arange(contexts + 1))
        sums = np.r_[0, np.cumsum(counts)]
        totals = sums[pointers[1:]] - sums[pointers[:-1]] if total is None else np.array([total])
        n = np.diff(pointers)
        weights = np.where(n > 0, _logs(np.where(n > 0, discount * n / np.maximum(totals, 1), 1)), 0).astype(np.uint8)
        # Each context's children go on from the last one of the context before.
        last = np.where(n > 0, child[np.maximum(pointers[1:] - 1, 0)] + 1, 0)
        values = np.repeat(np.cumsum(last) - last, n) + child + 1
        codes = [eliasfano.encode(pointers, len(keys) + 1), eliasfano.encode(values, int(values[-1]) + 1)]
        self.files.write(f"level{self.order}-{r}", np.concatenate([np.array([len(keys), contexts], np.uint64), *codes, _padded(weights), _padded(_logs((counts - discount) / np.repeat(totals, n)))]))

    def look_up(self, context: np.ndarray, child: np.ndarray) -> tuple[np.ndarray, ...]:
        """Numbers (-1: unseen) and discounted probabilities (0: unseen) of n-grams with known contexts; where
        the contexts' children begin, and the weights that they give the level before, 1 without children."""
        number, p = np.full(len(context), -1), np.zeros(len(context))
        start, weight = np.zeros(len(context), np.int64), np.ones(len(context))
        ranges, keys = self.keys(context, np.maximum(child, 0))
        for r, where in _grouped(ranges, len(self.firsts)):
            cut = self.parts[r] > 1
            start[where] = self.offsets[np.searchsorted(self.firsts, self.firsts[r])]
            if cut:
                weight[where] = self.cut[int(self.firsts[r])]
            if not self.sizes[r]:
                continue
            pointers, children, weights, logs = self._range(r)
            distinct, back = inverse(keys[where])
            of = distinct // self.span
            new = np.r_[True, of[1:] != of[:-1]]
            c, of = of[new], np.cumsum(new) - 1
            known = c + 1 < pointers.n
            begin, end = np.zeros((2, len(c)), np.int64)
            begin[known], end[known] = pointers.get(c[known]).astype(np.int64), pointers.get(c[known] + 1).astype(np.int64)
            before = np.zeros(len(c), np.int64)
            some = np.flatnonzero(known & (begin > 0))
            before[some] = children.get(begin[some] - 1).astype(np.int64)
            x = before[of] + distinct % self.span + 1
            inside = np.flatnonzero((end[of] > begin[of]) & (x < children.universe))
            at = children.find(x[inside])
            found = (at >= begin[of[inside]]) & (at < end[of[inside]])
            place, chance = np.full(len(distinct), -1), np.zeros(len(distinct))
            place[inside[found]], chance[inside[found]] = self.offsets[r] + at[found], _VALUES[logs[at[found]]]
            number[where], p[where] = place[back], chance[back]
            if not cut:
                own = np.ones(len(c))
                own[known] = _VALUES[weights[c[known]]]
                start[where] += begin[of][back]
                weight[where] = own[of][back]
        unknown = child < 0
        number[unknown], p[unknown] = -1, 0
        return number, p, start, weight


def inverse(x: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """As np.unique(x, return_inverse=True), for numbers from 0 on: they are sorted with their places in their low bits,
    which is several times faster than sorting places. Where that doesn't fit, places take the numbers' lowest bits,
    and the few arrays that this leaves out of order are done by np.unique."""
    if not len(x):
        return x, np.empty(0, np.int64)
    bits = np.uint64((len(x) - 1).bit_length())
    dropped = np.uint64(max(0, int(x.max()).bit_length() + int(bits) - 64))
    packed = x.astype(np.uint64) >> dropped << bits | np.arange(len(x), dtype=np.uint64)
    packed.sort()
    order = (packed & (np.uint64(1) << bits) - np.uint64(1)).astype(np.int64)
    ordered = x[order]
    if dropped and (ordered[1:] < ordered[:-1]).any():
        return np.unique(x, return_inverse=True)
    new = np.r_[True, ordered[1:] != ordered[:-1]]
    back = np.empty(len(x), np.int64)
    back[order] = np.cumsum(new) - 1
    return ordered[new], back


def _grouped(of: np.ndarray, groups: int):
    """Each group that has members, with where they are, for numbers of groups."""
    if not len(of):
        return
    # Short integers are sorted by radix.
    order = np.argsort(of.astype(np.int16) if groups < 1 << 15 else of, kind="stable")
    touched, starts = np.unique(of[order], return_index=True)
    for x, a, b in zip(touched.tolist(), starts, np.r_[starts[1:], len(of)], strict=True):
        yield x, order[a:b]


class Model:
    """What scoring needs: sizes, and where files are and which ranges they hold."""

    def __init__(self, tokens: int, words: Words, levels: list[Level]):
        self.tokens, self.words, self.levels = tokens, words, levels
        self.size = int(words.offsets[-1])
        self.end, self.ends = -1, 0
        if self.size:
            number, count = words.look_up(np.array([END], np.uint64))
            self.end, self.ends = int(number[0]), int(count[0])

    def grams(self, number: np.ndarray, lengths: np.ndarray, order: int):
        """For texts given as word numbers, level by level up to `order`: which tokens have a context and an n-gram
        that may be there, the contexts and the children. An n-gram's number at the last level isn't looked up."""
        first = np.zeros(len(number), bool)
        first[np.cumsum(lengths) - lengths] = True
        context = np.r_[self.end, number[:-1]]
        context[first] = self.end
        child = number
        for level in self.levels[: order - 1]:
            yield level, context, child
            if level.order == order:
                return
            both = np.flatnonzero((context >= 0) & (child >= 0))
            own = np.full(len(number), -1)
            start = np.zeros(len(number), np.int64)
            own[both], _, start[both], _ = level.look_up(context[both], child[both])
            child = np.where(own >= 0, own - start, -1)
            context = np.r_[-1, own[:-1]]
            context[first] = -1

    def score(self, tokens: np.ndarray, lengths: np.ndarray):
        """For texts given as token hashes: known tokens, base log10 probabilities and the model's, for each text."""
        distinct, back = inverse(tokens)
        number, count = self.words.look_up(distinct)
        base = ((count + 1) / (self.tokens + self.size + 1))[back]
        known, now = (count > 0)[back], number[back]
        p = base.copy()
        if self.size:
            first = np.zeros(len(now), bool)
            first[np.cumsum(lengths) - lengths] = True
            context = np.r_[self.end, now[:-1]]
            context[first] = self.end
            child = now
            for level in self.levels:
                some = np.flatnonzero(context >= 0)
                own, start = np.full(len(now), -1), np.zeros(len(now), np.int64)
                own[some], chance, start[some], weight = level.look_up(context[some], child[some])
                p[some] = p[some] * weight + chance
                child = np.where(own >= 0, own - start, -1)
                context = np.r_[-1, own[:-1]]
                context[first] = -1
        starts = np.cumsum(lengths) - lengths
        add = np.add.reduceat  # each text has a token, end
        return add(known.astype(np.int64), starts), add(np.log10(base), starts), add(np.log10(p), starts)


def train(texts: DataFrame, order: int = 3, discount: float = 0.75, range_tokens: int = 1 << 22, range_words: int = 1 << 18) -> Model:
    """A model of all texts (a column text). Ranges of words hold about `range_words` different words each, so a
    batch sends as many blocks as its own different words need, however many texts there are."""
    uri = f"{own_dir(texts.sparkSession)}/lm/{uuid.uuid4().hex}"
    ranges = max(2, -(-different_words(texts) // range_words))
    bounds = _hash_bounds(ranges)

    def count_words(batches):
        for found, _ in _batches(batches):
            yield _blocks_by_range(found, np.searchsorted(bounds, found, side="right") - 1, ranges)

    def laid(r, counts):
        context, parts = _lay_ranges(counts, range_tokens)
        return {"range": r, "n": len(counts), "tokens": int(counts.sum()), "context": context.tolist(), "parts": parts.tolist(), "total": np.where(parts > 1, counts[context], 0).tolist()}

    def finish_words(r, blocks):
        keys, counts = merge(blocks)
        Words.write(Files(uri), r, keys, counts)
        return laid(r, counts)

    schema = "range bigint, n bigint, tokens bigint, context array<bigint>, parts array<bigint>, total array<bigint>"

    def sizes(made, n):
        out = np.zeros(n, np.int64)
        for r in made:
            out[r["range"]] = r["n"]
        return out

    made = sorted(by_range(texts.mapInArrow(count_words, "range bigint, block binary"), finish_words, schema).collect(), key=lambda r: r["range"])
    model = Model(sum(r["tokens"] for r in made), Words(uri, sizes(made, ranges)), [])
    offsets = model.words.offsets
    for n in range(2, order + 1 if model.size else 2):
        if not made:  # no n-gram of the level before, as of empty texts only
            break
        layout = [(int(offsets[r["range"]]) + c, k, t) for r in made for c, k, t in zip(r["context"], r["parts"], r["total"], strict=True)]
        level = Level(uri, n, model.size, np.array([x[0] for x in layout]), np.array([x[1] for x in layout]))
        totals = {c: t for c, k, t in layout if k > 1}
        grown = Model(model.tokens, model.words, [*model.levels, level])
        made = sorted(by_range(texts.mapInArrow(_count(grown, n), "range bigint, block binary"), _finish(level, totals, discount, laid), schema).collect(), key=lambda r: r["range"])
        level.made(sizes(made, len(layout)), totals, discount)
        model, offsets = grown, level.offsets
    return model


def _count(model: Model, n: int):
    """Blocks of the counts of the n-grams of a level that isn't made yet."""

    def run(batches):
        for tokens, lengths in _batches(batches):
            distinct, back = inverse(tokens)
            number = model.words.look_up(distinct)[0][back]
            for level, context, child in model.grams(number, lengths, n):
                if level.order == n:
                    there = np.flatnonzero((context >= 0) & (child >= 0))
                    of, keys = level.keys(context[there], child[there])
                    yield _blocks_by_range(keys.astype(np.uint64), of, len(level.firsts))

    return run


def _finish(level: Level, totals: dict[int, int], discount: float, laid):
    def finish(r, blocks):
        keys, counts = merge(blocks)
        level.write(r, keys.astype(np.int64), counts, totals[int(level.firsts[r])] if level.parts[r] > 1 else None, discount)
        return laid(r, counts)

    return finish


def score(docs: DataFrame, model: Model, rows: int = 2048) -> DataFrame:
    """docs (with a column text) with n_tokens, n_known, train_tokens, base_score and score, and token_score,
    the score for each token."""

    def make():
        def run(texts):
            tokens = [hashes(t) for t in texts]
            lengths = np.array([len(h) for h in tokens])
            known, base, own = model.score(np.concatenate(tokens), lengths)
            return [lengths.tolist(), known.tolist(), [model.tokens] * len(lengths), base.tolist(), own.tolist(), (own / lengths).tolist()]

        return run

    return append(docs, "n_tokens bigint, n_known bigint, train_tokens bigint, base_score double, score double, token_score double", make, rows=rows)


def learn_and_score(docs: DataFrame, **options) -> DataFrame:
    """(doc_id, held_out, n_tokens, n_known, train_tokens, base_score, score, token_score): a model of the rows
    that aren't held out scores all rows."""
    given = Columns(docs)
    doc_id = F.col(given["doc_id"])
    marked = given.rows.select(doc_id.alias("doc_id"), held_out(doc_id).alias("held_out"), F.col(given["text"]).alias("text"))
    model = train(marked.where("not held_out").select("text"), **options)
    return score(marked, model).drop("text")
