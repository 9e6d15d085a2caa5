"""Byte-level BPE encoding and decoding with reuse of content-defined chunks.

A text is cut where a rolling hash over the last 32 bytes has its low bits zero, at the next place
where a space stands between two ASCII letters; so a passage that stands in many documents falls into
the same chunks in each.

1. Each task lists the hashes of its distinct chunks. A hash that several tasks list is a shared chunk,
   and one of them, picked by a hash so that the work spreads, owns it.
2. The owner encodes the chunk. Its ids are dealt to the tasks that list it, in a folder for every 64 tasks in
   the shared folder. Only hashes and shared chunks' ids move, never texts.
3. Each task encodes its texts with the ids it was dealt, and keeps the chunks it used last, up to a
   fixed amount of memory. Dealt ids must decode to the chunk's very bytes; else it is encoded here.
4. Where two chunks join, the last word of the left one and the first of the right one are encoded
   again as one piece; if that doesn't give the ids that the chunks have there, the two chunks are
   encoded as one, until all joins agree. Encoding a text so is encoding it whole.

A task is known by its number. Should an input be split in another way when it is read again, chunks
are missed and encoded on the spot; results stay the same. A task holds the ids of its own shared
chunks, which are no more than its part of the input. The shared folder must be one that pyarrow can open.

The special token's string in a text becomes its id, as the tokenizers library does by default. A null
text counts as an empty one: no ids, empty decoded text. Repeated rows give the same result. An empty
table gives an empty one. A very long text is held whole, with its ids; white space
of any length is encoded, runs of over 65,536 characters apart from the rest. Columns named like an output are
replaced; all others pass through, whatever their names.
"""

from __future__ import annotations

import json
import re
import uuid
from collections import OrderedDict
from functools import lru_cache

import numpy as np
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from kinweave.llm.common import append, cut_table, give_back, lean, own_dir

# Fixed value: the pattern that splits a text before byte-pair merges, as the vocabulary's pre-tokenizer has it.
PATTERN = r"""'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"""

# Fixed value: the characters that \s stands for in it.
WHITE = "\t-\r\x20\x85\xa0\u1680\u2000-\u200a\u2028\u2029\u202f\u205f\u3000"
#: White space of this many characters is cut out by hand: the engine's pattern matcher breaks down at a million.
LONG = 1 << 16
_LONG_WHITE = re.compile(f"[{WHITE}]{{{LONG},}}")


def default_vocabulary() -> str:
    import public_tokenizers

    return public_tokenizers.path("byte_bpe_50k.json")


def byte_alphabet() -> dict[str, int]:
    """The characters that stand for bytes in a byte-level vocabulary: printable bytes for themselves,
    the others, in order, from U+0100 on."""
    plain = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    rest = [b for b in range(256) if b not in set(plain)]
    return {chr(b): b for b in plain} | {chr(0x100 + i): b for i, b in enumerate(rest)}


class Codec:
    """Encodes and decodes with the vocabulary of a tokenizers JSON file."""

    def __init__(self, path: str):
        import tiktoken

        self.path = path
        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        letters = byte_alphabet()
        self.special = {t["content"]: t["id"] for t in spec["added_tokens"]}
        vocabulary = {w: i for w, i in spec["model"]["vocab"].items() if w not in self.special}
        ranks = {bytes(letters[c] for c in w): i for w, i in vocabulary.items()}
        # The merges, in order, must rank as the ids do; else this engine would merge in another order.
        merged = [vocabulary[a + b] for a, b in (m.split(" ") if isinstance(m, str) else m for m in spec["model"]["merges"])]
        if merged != sorted(merged):
            raise ValueError("the vocabulary's ids are not in the order of its merges")
        self.engine = tiktoken.Encoding("file", pat_str=PATTERN, mergeable_ranks=ranks, special_tokens={})
        self.bytes = {i: b for b, i in ranks.items()} | {i: s.encode() for s, i in self.special.items()}

    def encode(self, data: bytes) -> list[int]:
        text = data.decode()
        if len(data) < LONG:
            return self.engine.encode_ordinary(text)
        ids, at = [], 0
        for run in _LONG_WHITE.finditer(text):
            # The pattern takes all of a run, but the last of it goes with what follows.
            end = run.end() - (run.end() < len(text))
            ids += self.engine.encode_ordinary(text[at : run.start()])
            ids += _plain_engine(self.path).encode(text[run.start() : end], add_special_tokens=False).ids
            at = end
        return ids + self.engine.encode_ordinary(text[at:])

    def numbers(self, data: bytes) -> np.ndarray:
        return self.engine.encode_to_numpy(data.decode()) if len(data) < LONG else np.array(self.encode(data), np.uint32)

    def decode(self, ids: list[int]) -> bytes:
        return b"".join(map(self.bytes.__getitem__, ids))


@lru_cache(2)
def _plain_engine(path: str):
    from tokenizers import Tokenizer

    return Tokenizer.from_file(path)


@lru_cache(2)
def codec(path: str) -> Codec:
    made = Codec(path)
    give_back()  # what reading the file took
    return made


@lru_cache(1)
def _gears() -> np.ndarray:
    return np.random.Generator(np.random.PCG64(7)).integers(0, 1 << 32, 256, dtype=np.uint32)


def _letters(b: np.ndarray) -> np.ndarray:
    return ((b | 32) - 97).view(np.uint8) < 26


def cuts(data: bytes, bits: int = 11) -> list[int]:
    """Where data is cut: a space between two ASCII letters, the first at or after a place whose
    rolling hash over 32 bytes has its `bits` high bits zero."""
    if len(data) < 3:
        return []
    b = np.frombuffer(data, np.uint8)
    h = _gears()[b]
    for k in range(5):
        h[1 << k :] = h[1 << k :] + (h[: -(1 << k)] << np.uint32(1 << k))
    places = np.flatnonzero(h >> np.uint32(32 - bits) == 0)
    if not len(places):
        return []
    letter = _letters(b)
    safe = np.flatnonzero((b[1:-1] == 32) & letter[:-2] & letter[2:]) + 1
    at = np.searchsorted(safe, places)
    return np.unique(safe[at[at < len(safe)]]).tolist()


class Chunk:
    """A chunk's ids, and the words at its ends with theirs."""

    __slots__ = ("data", "ids", "head", "tail", "head_ids", "tail_ids")

    def __init__(self, data: bytes, c: Codec, ids: list[int] | None = None):
        self.data, ids = data, c.encode(data) if ids is None else ids
        self.ids = np.array(ids, np.int32)  # an eighth of a list's size
        self.head = data[: data.find(b" ", 1)] if data.find(b" ", 1) > 0 else data
        self.tail = data[data.rfind(b" ") :] if data.rfind(b" ") >= 0 else data
        self.head_ids, self.tail_ids = self._covering(c, ids, len(self.head)), self._covering(c, ids[::-1], len(self.tail))[::-1]

    @staticmethod
    def _covering(c: Codec, ids: list[int], length: int) -> list[int]:
        """The first ids that make up just `length` bytes; none if an id spans that place."""
        n = 0
        for k, i in enumerate(ids):
            n += len(c.bytes[i])
            if n >= length:
                return ids[: k + 1] if n == length else []
        return []


def chunk_hash(data: bytes) -> int:
    """A chunk's hash as a signed 64-bit number."""
    h = xxhash.xxh3_64_intdigest(data)
    return h - (1 << 64) if h >> 63 else h


class Encoder:
    """Encodes texts by chunks; keeps the chunks used last, up to `most_bytes` of their text. given: ids
    of chunks that were encoded elsewhere, by the chunks' hashes."""

    def __init__(self, c: Codec, bits: int = 11, most_bytes: int = 4 << 20, given: dict[int, np.ndarray] | None = None):
        self.codec, self.bits, self.most, self.held, self.given = c, bits, most_bytes, 0, given or {}
        self.chunks: OrderedDict[bytes, Chunk] = OrderedDict()
        self.joins: dict[tuple[bytes, bytes], bool] = {}
        self.reused = self.taken = self.made = self.repaired = 0

    def chunk(self, data: bytes) -> Chunk:
        if found := self.chunks.get(data):
            self.chunks.move_to_end(data)
            self.reused += 1
            return found
        ids = self.given.get(chunk_hash(data)) if self.given else None
        if ids is not None and self.codec.decode(known := ids.tolist()) == data:
            self.taken += 1
            new = self.chunks[data] = Chunk(data, self.codec, known)
        else:
            self.made += 1
            new = self.chunks[data] = Chunk(data, self.codec)
        self.held += len(data)
        while self.held > self.most and len(self.chunks) > 1:
            old, _ = self.chunks.popitem(last=False)
            self.held -= len(old)
        return new

    def agrees(self, left: Chunk, right: Chunk) -> bool:
        key = (left.tail, right.head)
        if (known := self.joins.get(key)) is None:
            whole = self.codec.encode(left.tail + right.head)
            known = bool(left.tail_ids) and bool(right.head_ids) and whole == left.tail_ids + right.head_ids
            if len(self.joins) > 1 << 14:
                self.joins.clear()
            self.joins[key] = known
        return known

    def pieces(self, data: bytes) -> list[bytes]:
        edges = [0, *cuts(data, self.bits), len(data)] if data else []
        return [data[a:b] for a, b in zip(edges, edges[1:], strict=False)]

    def plain(self, data: bytes) -> np.ndarray:
        done: list[Chunk] = []
        for piece in self.pieces(data):
            new = self.chunk(piece)
            while done and not self.agrees(done[-1], new):
                self.repaired += 1
                new = Chunk(done.pop().data + new.data, self.codec)
            done.append(new)
        return np.concatenate([_NONE, *[c.ids for c in done]])

    def encode(self, text: str | None) -> np.ndarray:
        for token, i in self.codec.special.items():
            if text and token in text:
                first, *rest = text.split(token)
                return np.concatenate([self.plain(first.encode()), *[x for r in rest for x in (np.array([i], np.int32), self.encode(r))]])
        return self.plain((text or "").encode())


_NONE = np.empty(0, np.int32)


class Whole(Encoder):
    """Encodes texts whole, without chunks."""

    def plain(self, data: bytes) -> np.ndarray:
        return self.codec.numbers(data)


class Lister(Encoder):
    """Goes over texts as an Encoder does, but only gathers the chunks not seen before, by hash."""

    def __init__(self, c: Codec, bits: int):
        super().__init__(c, bits)
        self.seen: set[int] = set()
        self.new: dict[int, bytes] = {}

    def plain(self, data: bytes) -> np.ndarray:
        for piece in self.pieces(data):
            if (h := chunk_hash(piece)) not in self.seen:
                self.seen.add(h)
                self.new[h] = piece
        return _NONE

    def take(self, texts: list) -> dict[int, bytes]:
        for t in texts:
            self.encode(t)
        new, self.new = self.new, {}
        return new


def _few(batches, rows: int = 64):
    """The texts of batches, a few at a time."""
    for batch in batches:
        for at in range(0, batch.num_rows, rows):
            yield batch.column("text").slice(at, rows).to_pylist()


def _task() -> int:
    from pyspark import TaskContext

    return TaskContext.get().partitionId()


def _deal(rows: DataFrame) -> str:
    """The URI of a folder with a part for every 64 tasks, for rows with a column t, the task's number."""
    uri = f"{own_dir(rows.sparkSession)}/chunks/{uuid.uuid4().hex}"
    rows.withColumn("part", F.shiftright("t", 6)).repartition("t").sortWithinPartitions("part", "t").write.partitionBy("part").parquet(uri)
    return uri


def _dealt(uri: str, columns: list[str]):
    """What this task was dealt, as an Arrow table; None if nothing."""
    from pyarrow import fs, parquet

    system, path = fs.FileSystem.from_uri(f"{uri}/part={_task() >> 6}")
    if system.get_file_info(path).type == fs.FileType.NotFound:
        return None
    return parquet.read_table(path, filesystem=system, columns=columns, partitioning=None, filters=[("t", "=", _task())]).combine_chunks()


def _hashes(path: str, bits: int):
    def run(batches):
        import pyarrow as pa

        lister, t = Lister(codec(path), bits), _task()
        for texts in _few(batches):
            new = list(lister.take(texts))
            yield pa.RecordBatch.from_arrays([pa.array([t] * len(new), pa.int32()), pa.array(new, pa.int64())], names=["t", "h"])

    return run


def _own_ids(path: str, bits: int, uri: str):
    def run(batches):
        import pyarrow as pa

        table = _dealt(uri, ["h"])
        if table is None:
            return
        own, lister = set(table.column("h").to_pylist()), Lister(codec(path), bits)
        for texts in _few(batches):
            new = {h: lister.codec.encode(c) for h, c in lister.take(texts).items() if h in own}
            yield pa.RecordBatch.from_arrays([pa.array(list(new), pa.int64()), pa.array(list(new.values()), pa.list_(pa.int32()))], names=["h", "ids"])

    return run


def share_chunks(texts: DataFrame, path: str, bits: int) -> str:
    """Encodes each chunk that several tasks over texts (a column text) have once; the URI of what each is dealt."""
    of_chunk = W.partitionBy("h")
    listed = texts.mapInArrow(lean(_hashes(path, bits)), "t int, h bigint")
    listed = listed.withColumns({"n": F.count(F.lit(1)).over(of_chunk), "owner": F.min(F.struct(F.xxhash64("h", "t"), "t")).over(of_chunk)["t"]})
    shared = cut_table(listed.where("n > 1").select("t", "h", "owner"))
    own = _deal(shared.where("t = owner").select("t", "h"))
    made = texts.mapInArrow(lean(_own_ids(path, bits, own)), "h bigint, ids array<int>")
    return _deal(shared.select("t", "h").join(made, "h").select("t", "h", "ids"))


def given_ids(uri: str) -> dict[int, np.ndarray]:
    """The ids of this task's shared chunks, by hash."""
    table = _dealt(uri, ["h", "ids"])
    if table is None or not table.num_rows:
        return {}
    ids = table.column("ids").chunk(0)
    values, at = ids.values.to_numpy(), ids.offsets.to_numpy()
    return {h: values[a:b] for h, a, b in zip(table.column("h").to_pylist(), at, at[1:], strict=False)}


def encode_decode(docs: DataFrame, vocabulary: str | None = None, bits: int = 11) -> DataFrame:
    """docs (with a column text) with tokens, the ids of the whole text, and decoded, the text from those ids."""
    path = vocabulary or default_vocabulary()
    uri = share_chunks(docs.select("text"), path, bits)

    def make():
        import pyarrow as pa

        e = Encoder(codec(path), bits, given=given_ids(uri))

        def run(texts):
            ids = [e.encode(t) for t in texts]
            offsets = np.zeros(len(ids) + 1, np.int32)
            np.cumsum([len(x) for x in ids], out=offsets[1:])
            tokens = pa.ListArray.from_arrays(pa.array(offsets), pa.array(np.concatenate([_NONE, *ids])))
            return [tokens, pa.array([e.codec.decode(x.tolist()).decode("utf-8", "replace") for x in ids], pa.string())]

        return run

    return append(docs, "tokens array<int>, decoded string", make, rows=64)


def digests(encoded: DataFrame) -> DataFrame:
    """(doc_id, n_tokens, ids_sha256, decoded_sha256) of encode_decode's rows."""
    return encoded.select(
        "doc_id",
        F.size("tokens").cast("bigint").alias("n_tokens"),
        F.sha2(F.array_join(F.col("tokens").cast("array<string>"), ","), 256).alias("ids_sha256"),
        F.sha2(F.col("decoded"), 256).alias("decoded_sha256"),
    )
