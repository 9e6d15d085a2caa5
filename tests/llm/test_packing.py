import random
import zlib
from collections import defaultdict

import numpy as np
import pytest
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from kinweave.llm import packing, query_packing
from kinweave.llm.bpe import default_vocabulary
from kinweave.llm.common import placed
from tests.llm import cases

TOKENIZER = Tokenizer.from_file(default_vocabulary())


def ids_of(text):
    return [*TOKENIZER.encode(text or "", add_special_tokens=False).ids, 1]


def check(rows, got, length):
    """All pieces against the tokenizers library: each id once, in sequences without gaps. Gives the share of padding."""
    want, pieces, sequences = defaultdict(list), defaultdict(list), defaultdict(list)
    for doc_id, text in rows:
        want[doc_id].append(ids_of(text))
    for r in got:
        pieces[r.doc_id].append(r)
        sequences[r.sequence_id].append((r.offset, r.length))
        assert r.length >= 1
    assert set(pieces) == set(want)
    for doc_id, docs in want.items():
        # Rows with equal ids are told apart by what they hold, as far as it differs.
        expected, seen = defaultdict(int), defaultdict(int)
        starts = defaultdict(set)
        for r in pieces[doc_id]:
            starts[r.doc_tokens].add((r.start, r.length))
        for ids in docs:
            edges = sorted(starts[len(ids)])
            assert sum(n for _, n in edges) == len(ids) and all(a + n == b for (a, n), (b, _) in zip(edges, edges[1:], strict=False)) and edges[0][0] == 0
            for a, n in edges:
                expected[(a, n, zlib.crc32(np.array(ids[a : a + n], "<u4").tobytes()), len(ids))] += 1
        for r in pieces[doc_id]:
            seen[(r.start, r.length, r.ids_crc32, r.doc_tokens)] += 1
        assert seen == expected
    for parts in sequences.values():
        at = 0
        for offset, n in sorted(parts):
            assert offset == at
            at += n
        assert at <= length
    sums = [sum(n for _, n in p) for p in sequences.values()]
    padded = sum(length - s for s in sums if s & (s - 1))
    return padded / (padded + sum(sums))


def test_documents(spark, sf_dir):
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text").collect()
    got = query_packing.op12(spark, sf_dir).collect()
    assert check(docs, got, 2048) < 0.015  # a window more than the ids need is a hundredth here
    assert max(r.sequence_id >> 32 for r in got) == -(-sum(r.length for r in got) // (256 * 2048)) - 1
    assert sorted(got) == sorted(query_packing.op12(spark, sf_dir).collect())


@pytest.mark.parametrize("options", [{}, {"length": 64, "grain": 16, "windows": 8}, {"length": 7, "grain": 7, "windows": 1}, {"length": 1, "grain": 1, "windows": 3}])
def test_edges(spark, options):
    rows = [(r[0], r[1]) for r in cases.rows() if options.get("length", 99) > 1 or len(r[1] or "") < 500]
    df = spark.createDataFrame(rows, "doc_id bigint, text string")
    one = packing.pack(df.coalesce(1), **options).collect()
    check(rows, one, options.get("length", 2048))
    apart = spark.createDataFrame(spark.sparkContext.parallelize(rows, len(rows)), df.schema)
    check(rows, packing.pack(apart, **options).collect(), options.get("length", 2048))
    assert packing.pack(cases.empty(spark), **options).count() == 0


def test_ids_and_columns(spark, tmp_path):
    docs = cases.docs(spark).select("*", *[F.lit(2).alias(c) for c in ("start", "length", "ids", "batch", "given1", "Row_")])
    docs.repartition(3).write.parquet(str(tmp_path / "d"))
    docs = spark.read.parquet(str(tmp_path / "d"))
    got = packing.pack(docs, with_ids=True, number=placed).collect()
    assert all(len(r.ids) == r.length and zlib.crc32(np.array(r.ids, "<u4").tobytes()) == r.ids_crc32 for r in got)
    assert sum(r.length for r in got) == sum(len(ids_of(r.text)) for r in docs.collect())
    big = spark.createDataFrame([((1 << 62) + 1, "a"), (None, "b")], "doc_id bigint, text string")
    assert {r.doc_id for r in packing.pack(big).collect()} == {(1 << 62) + 1, None}
    none = spark.createDataFrame(spark.sparkContext.parallelize([(i, None) for i in range(9)], 9), "doc_id bigint, text string")
    assert sorted((r.doc_id, r.start, r.length, r.doc_tokens) for r in packing.pack(none).collect()) == [(i, 0, 1, 1) for i in range(9)]


def plain_differencing(sizes, windows):
    """Sums by the textbook: the two partitions with the largest spreads are merged, largest with smallest."""
    parts = [(sorted([x, *[0] * (windows - 1)], reverse=True), i) for i, x in enumerate(sizes)]
    name = len(parts)
    while len(parts) > 1:
        parts.sort(key=lambda p: (-(p[0][0] - p[0][-1]), p[1]))
        (a, _), (b, _), *parts = parts
        parts.append((sorted((x + y for x, y in zip(a, reversed(b), strict=True)), reverse=True), name))
        name += 1
    return parts[0][0]


def test_differencing():
    assert packing.differencing(np.array([8, 7, 6, 5, 4]), 2)[1].tolist() == [16, 14]
    assert packing.differencing(np.array([4, 5, 6, 7, 8]), 3)[1].tolist() == plain_differencing([4, 5, 6, 7, 8], 3)
    rnd = random.Random(3)
    for _ in range(200):
        sizes = [rnd.randrange(1, rnd.choice([5, 60, 600])) for _ in range(rnd.randrange(1, 40))]
        windows = rnd.randrange(1, 9)
        window, sums = packing.differencing(np.array(sizes), windows)
        assert sums.tolist() == plain_differencing(sizes, windows)
        assert np.bincount(window, sizes, windows).astype(int).tolist() == sums.tolist()


def test_windows_rise_with_the_capacity():
    assert len(set(packing.fill(np.array([6, 6, 6]), 9).tolist())) == 3  # 18 would fit two of 9
    rnd = np.random.default_rng(4)
    for n in (1, 2, 50, 700):
        sizes = rnd.integers(1, 513, n)
        sums = np.bincount(packing.fill(sizes, 2048), sizes)
        assert sums.max() <= 2048 and len(sums) <= -(-sizes.sum() // 2048) + 2 + n // 200
        if n > 500:
            assert sums[sums > 0].min() > 0.95 * sums.max()
