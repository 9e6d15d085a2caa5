import hashlib
import random
import re
import zlib
from collections import defaultdict
from functools import lru_cache

import pytest
from pyspark.sql import functions as F

from kinweave.llm import conversations, query_conversations
from tests.oracle import compare, connect

SCHEMA = "conv_id bigint, turn bigint, role string, text string"
SPACE = " \t\n\x0b\f\r"


def cheapest(rows):
    """(cost, audit) of (initial, must go, charge) rows, with edits anywhere, by trying all."""

    @lru_cache(None)
    def best(i, state, inserted):
        ways = [(0, "")] if i == len(rows) and state in (0, 3) else []

        def add(cost, edit, *to):
            if (rest := best(*to)) is not None:
                ways.append((cost + rest[0], edit + rest[1]))

        if i < len(rows):
            initial, must, charge = rows[i]
            add(4, "D", i + 1, state, 0)
            if not must:
                for role, to in {0: [("s", 1), ("u", 2)], 1: [("u", 2)], 2: [("a", 3)], 3: [("u", 2)]}[state]:
                    if initial == role:
                        add(charge, "K", i + 1, to, 0)
                    if role != "s":
                        add(3 + charge, "R", i + 1, to, 0)
        if inserted < 3:
            add(3, "I", i, {0: 2, 1: 2, 2: 3, 3: 2}[state], inserted + 1)
        return min(ways, default=None)

    return best(0, 0, 0)


def brute(given):
    by = defaultdict(list)
    for conv, turn, role, text in given:
        role, text = " " if role is None else role, " " if text is None else text
        kind = zlib.crc32(f"{' ' if conv is None else conv}:{' ' if turn is None else turn}".encode()) % 20
        text = {1: "", 2: re.sub("[.!?]", "", text)}.get(kind, text)
        role = "user" if kind == 4 else role
        by[conv] += [(turn is not None, turn or 0, role, hashlib.sha256(text.encode()).hexdigest(), text)] * {0: 0, 3: 2}.get(kind, 1)
    out = []
    for conv, rows in by.items():
        rows.sort()
        seen, lattice, counts = set(), [], dict.fromkeys(("blank", "duplicate", "truncated"), 0)
        for _, _, role, _, text in rows:
            fault = "blank" if not text.strip(SPACE) else "duplicate" if (role, text) in seen else "truncated" if text.rstrip(SPACE)[-1] not in ".!?" else None
            seen.add((role, text))
            if fault:
                counts[fault] += 1
            lattice.append((role[:1], fault in ("blank", "duplicate"), 3 if fault == "truncated" else 0))
        turns = [t for known, t, *_ in rows if known]
        gaps = max(turns) - min(turns) + 1 - len(set(turns)) if turns else 0
        illegal = sum(a[2][:1] + b[2][:1] not in ("su", "ua", "au") for a, b in zip(rows, rows[1:], strict=False))
        cost, audit = cheapest(tuple(lattice))
        said, i = [], 0
        for edit in audit:
            role = "assistant" if said and said[-1].startswith("u") else "user"
            if edit == "I":
                said.append(f"{role}:")
                continue
            if edit != "D":
                said.append(f"{role if edit == 'R' else rows[i][2]}:{rows[i][4]}")
            i += 1
        assert re.fullmatch("(s?(ua)+)?", "".join(x[:1] for x in said))
        out.append((conv, gaps, *counts.values(), illegal, cost, audit, hashlib.sha256("\n".join(said).encode()).hexdigest()))
    return sorted(out, key=repr)


def listed(df):
    return sorted((tuple(r) for r in df.collect()), key=repr)


def test_conversations(spark, sf_dir):
    assert compare(query_conversations.op13(spark, sf_dir), query_conversations.SQL["op13_conversation_repair"], connect(sf_dir)) > 5
    given = spark.read.parquet(f"{sf_dir}/conversations.parquet")
    assert listed(conversations.repair(given)) == brute([tuple(r) for r in given.select("conv_id", "turn", "role", "text").collect()])


@pytest.mark.parametrize("block", [1, 2, 3, 256])
def test_lattice(block):
    """Costs and audits of random conversations, whole and in blocks."""
    rnd = random.Random(block)
    for _ in range(300):
        lattice, plain = conversations.Lattice(), []
        for _ in range(rnd.randrange(0, 12)):
            initial, must, cut_off, n = rnd.choice(["s", "u", "u", "a", "a", "x", ""]), rnd.random() < 0.2, rnd.random() < 0.3, rnd.choice([1, 1, 1, 2, 3])
            lattice.add(initial, must, cut_off, n)
            plain += [(initial, must, 3 if cut_off and not must else 0), *[(initial, True, 0)] * (n - 1)]
        assert lattice.repair(block) == cheapest(tuple(plain)), plain


def made(rnd, convs, most, nulls=0.1):
    rows = []
    for conv in range(convs):
        for turn in range(rnd.randrange(0, most)):
            role = rnd.choice(["user", "assistant", "user", "assistant", "system", "tool", "", "unknown"])
            text = rnd.choice(["Fine. ", "Yes?", "No", "so\n", "", " \t", f"text {rnd.randrange(4)}.", "　", "é!"])
            row = [conv, turn if rnd.random() < 0.9 else rnd.randrange(-3, 12), role, text]
            rows.append(tuple(None if rnd.random() < nulls else x for x in row))
    return rows + rows[: len(rows) // 10]


def test_nulls_ties_and_repeated_rows(spark):
    rows = made(random.Random(2), 60, 9)
    df = spark.createDataFrame(rows, SCHEMA)
    want = brute(rows)
    assert any(r[0] is None for r in want)
    assert listed(conversations.repair(df.repartition(7))) == want
    apart = spark.createDataFrame(spark.sparkContext.parallelize(rows[:40], 40), SCHEMA)
    assert listed(conversations.repair(apart, block=2)) == brute(rows[:40])
    clash = df.select("*", *[F.lit("x").alias(c) for c in ("kind", "copies", "n", "digest", "said", "first", "audit", "place", "id", "given0")])
    assert listed(conversations.repair(clash)) == want


def test_long_conversations(spark):
    rnd = random.Random(3)
    rows = [(7, t, rnd.choice(["user", "assistant"]), f"said {rnd.randrange(500)}" + rnd.choice([".", ".", ""])) for t in range(700)]
    rows += [(8, t, rnd.choice(["user", "assistant"]), "x" * 50_000 + ".") for t in range(20)] + [(9, 1, "user", "again.")] * 3000
    rows = [r for r in rows if r[0] != 9] + [r for r in rows if r[0] == 9]
    import sys

    sys.setrecursionlimit(20_000)
    want = brute([r for r in rows if r[0] != 9])
    got = listed(conversations.repair(spark.createDataFrame(rows, SCHEMA)))
    assert [r for r in got if r[0] != 9] == want
    of = next(r for r in got if r[0] == 9)
    assert of[3] in (0, 2999, 5999) and len(of[7]) >= of[3]


def test_empty(spark):
    assert conversations.repair(spark.createDataFrame([], SCHEMA)).count() == 0
    dropped = next(t for t in range(99) if zlib.crc32(f"1:{t}".encode()) % 20 == 0)
    rows = [(1, dropped, "user", "gone."), (None, None, None, None)]
    got = listed(conversations.repair(spark.createDataFrame(rows, SCHEMA)))
    assert got == brute(rows) and got[0][7:] == ("", hashlib.sha256(b"").hexdigest())
    nothing = spark.createDataFrame([(i, None, None, None) for i in range(5)], SCHEMA)
    assert listed(conversations.repair(nothing)) == brute([(i, None, None, None) for i in range(5)])
