"""Structure repair of conversations by A* on the edit lattice.

1. Rows with equal columns are counted, and the first turn of each (conversation, role, text) is found, so that
   blank, duplicate and truncated rows are known before any conversation comes together.
2. Narrow rows, without texts, pass a task in the order of their conversation. A conversation's lattice has a node
   for each row and state of the grammar (s?(ua)+)?. A* goes through it by (cost plus heuristic, audit): the
   heuristic sums what the rows ahead cost in any case, 4 for each mandatory deletion and 3 for each truncated row.
   It never falls short of what an edit costs, so the first path to reach the goal is the cheapest, and of those the
   one whose audit is least in ASCII.
3. A long conversation is cut into blocks of `block` rows. A* gives the best path of each block from every state
   to every state, and the best chain of them is found from the last block on. Two paths of a block never have one
   audit begin with the other, as no block but the last ends in an insertion, so the least chain is the least audit.
4. Texts pass a task in the same order, after their conversation's audit, and go into its digest one by one.

Edits: K keep, R rerole, D delete, I insert. Before a mandatory deletion nothing is inserted: behind it that costs
the same and its audit is less.

Order: turn (null first), role, then the SHA-256 of the text. A null role or text is one space, as in the key that
damage goes by. A null conv_id is a conversation of its own. Equal rows are duplicates of the first of them. A
conversation without rows has zeros, an empty audit and an empty text's digest. An empty table gives an empty one.
A role that begins with neither s, u nor a can't be kept. Other columns aren't read. A task holds some twenty bytes
for each row of one conversation, whose audit and digest are single values, and never its texts, however long.
"""

from __future__ import annotations

import hashlib
import heapq
import itertools

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from kinweave.llm.common import Columns, cut_table

#: White space, and the marks that end a text.
SPACE, MARKS = " \t\n\x0b\f\r", ".!?"
#: Costs of a change of role, a deletion, an insertion, and of a truncated row that stays.
REROLE, DELETE, INSERT, TRUNCATED = 3, 4, 3, 3
#: States of the grammar: nothing yet, after s, after u, after a. A state's next role, and the state after that.
NEXT = ("u", "u", "a", "u")
AFTER = (2, 2, 3, 2)
ACCEPTING = (0, 3)
ROLES = {"u": "user", "a": "assistant"}


def damaged(rows: DataFrame, parts: int = 20) -> DataFrame:
    """rows (conv_id, turn, role, text) with every twentieth row dropped, emptied, without marks, twice, or by a user."""
    text, role, space = F.coalesce("text", F.lit(" ")), F.coalesce("role", F.lit(" ")), F.lit(" ")
    key = F.concat_ws(":", F.coalesce(F.col("conv_id").cast("string"), space), F.coalesce(F.col("turn").cast("string"), space))
    kind = F.crc32(key) % parts
    changed = F.when(kind == 1, F.lit("")).when(kind == 2, F.regexp_replace(text, "[.!?]", "")).otherwise(text)
    rows = rows.select("conv_id", "turn", F.when(kind == 4, F.lit("user")).otherwise(role).alias("role"), changed.alias("text"), kind.alias("kind"))
    return rows.where("kind <> 0").withColumn("copies", F.when(F.col("kind") == 3, 2).otherwise(1).cast("bigint")).drop("kind")


def _faults(rows: DataFrame) -> DataFrame:
    """Different rows with n, how often each is there, and what can be told of a row by itself."""
    trimmed = F.rtrim("text", F.lit(SPACE))
    counted = rows.groupBy("conv_id", "turn", "role", "text").agg(F.sum("copies").alias("n"))
    return counted.withColumns({"digest": F.sha2("text", 256), "blank": trimmed == "", "cut_off": ~F.substring(trimmed, -1, 1).isin(*MARKS)})


class Lattice:
    """The rows of a conversation, as they come: for each an initial (a blank for others), whether it must go, whether
    it is truncated, and how often it is there."""

    def __init__(self):
        self.initials, self.faults, self.copies = bytearray(), bytearray(), []

    def add(self, initial: str, must: bool, truncated: bool, n: int) -> None:
        self.initials.append(ord(initial) if initial in ("s", "u", "a") else 32)
        self.faults.append(1 if must else 2 if truncated else 0)
        self.copies.append(n)

    def __len__(self) -> int:
        return len(self.copies)

    def least(self, i: int) -> int:
        """What row i costs whatever is done."""
        must = self.faults[i] == 1
        return DELETE * (self.copies[i] - (not must)) + (TRUNCATED if self.faults[i] == 2 else 0)

    def search(self, begin: int, end: int, start: int, last: bool) -> dict[int, tuple[int, str]]:
        """The cheapest way from `start` through rows begin to end, for each state that it can end in: (cost, audit), with
        a letter for each row, whatever its copies. For the last rows only the cheapest of all that the grammar accepts."""
        ahead = [0]
        for i in range(end - 1, begin - 1, -1):
            ahead.append(ahead[-1] + self.least(i))
        found, done = {}, set()
        heap = [(ahead[-1], "", begin, start)]
        while heap:
            key, audit, i, state = heapq.heappop(heap)
            if (i, state) in done:
                continue
            done.add((i, state))
            cost = key - ahead[end - i]
            if i == end:
                if not last or state in ACCEPTING:
                    found[state] = cost, audit
                    if last:
                        return found
                    continue
            else:
                # What the row costs in any case is in the key already: all of a mandatory deletion, those of
                # further copies, and a truncated row's charge.
                if self.faults[i] == 1:
                    heapq.heappush(heap, (key, audit + "D", i + 1, state))
                    continue
                spared = TRUNCATED if self.faults[i] == 2 else 0
                heapq.heappush(heap, (key + DELETE - spared, audit + "D", i + 1, state))
                initial = chr(self.initials[i])
                if initial == NEXT[state] or (initial == "s" and state == 0):
                    heapq.heappush(heap, (key, audit + "K", i + 1, 1 if initial == "s" else AFTER[state]))
                heapq.heappush(heap, (key + REROLE, audit + "R", i + 1, AFTER[state]))
            if last or i < end:
                heapq.heappush(heap, (key + INSERT, audit + "I", i, AFTER[state]))
        return found

    def repair(self, block: int) -> tuple[int, str]:
        """(cost, audit) of the whole, with a letter for each edit."""
        n = len(self)
        edges = [*range(0, n, block), n] if n else [0, 0]
        best: dict[int, tuple[int, str, int]] = {}
        chain: list[dict[int, tuple[int, str, int]]] = []
        for k in range(len(edges) - 2, -1, -1):
            last, now = k == len(edges) - 2, {}
            for start in range(4) if k else (0,):
                ways = self.search(edges[k], edges[k + 1], start, last)
                now[start] = min((cost + (0 if last else best[state][0]), audit, state) for state, (cost, audit) in ways.items() if last or state in best)
            chain.append(now)
            best = now
        cost, state, parts = chain[-1][0][0], 0, []
        for now in reversed(chain):
            _, audit, state = now[state]
            parts.append(audit)
        return cost, "".join(self._spelled("".join(parts)))

    def _spelled(self, audit: str):
        i = 0
        for edit in audit:
            if edit == "I":
                yield edit
                continue
            yield edit + "D" * (self.copies[i] - 1)
            i += 1


def _by_conversation(batches, names: list[str]):
    """(conv_id, its rows as they come) of sorted batches."""
    rows = itertools.chain.from_iterable(zip(*(batch.column(n).to_pylist() for n in names), strict=True) for batch in batches)
    return itertools.groupby(rows, key=lambda r: r[0])


def _together(rows, schema, most: int = 512):
    """Batches of dicts."""
    import pyarrow as pa

    while some := list(itertools.islice(rows, most)):
        yield pa.RecordBatch.from_pylist(some, schema)


COUNTS = ("gaps", "blank", "duplicate", "truncated", "illegal", "cost")


def _solve(block: int, schema):
    def solved(batches):
        for conv, rows in _by_conversation(batches, ["conv_id", "turn", "initial", "blank", "cut_off", "n", "is_first"]):
            lattice = Lattice()
            turns = blank = duplicate = truncated = illegal = 0
            low = high = before = None
            for _, turn, initial, is_blank, cut_off, n, first in rows:
                if turn is not None:
                    low = turn if low is None else low
                    turns += turn != high
                    high = turn
                fresh = first and not is_blank
                blank += n if is_blank else 0
                duplicate += 0 if is_blank else n - fresh
                truncated += fresh and cut_off
                illegal += before is not None and before + initial not in ("su", "ua", "au")
                illegal += (n - 1) * (initial + initial not in ("su", "ua", "au"))
                before = initial
                lattice.add(initial, not fresh, cut_off, n)
            cost, audit = lattice.repair(block)
            gaps = 0 if low is None else high - low + 1 - turns
            yield {"conv_id": conv, "audit": audit} | dict(zip(COUNTS, (gaps, blank, duplicate, truncated, illegal, cost), strict=True))

    return lambda batches: _together(solved(batches), schema)


def _digests(schema):
    """Each conversation's first row is its audit; those of its rows come behind."""

    def digested(batches):
        names = ["conv_id", *COUNTS, "audit", "role", "text", "n"]
        for conv, rows in _by_conversation(batches, names):
            _, *counts, audit, _, _, _ = next(rows)
            state, at, said, digest = 0, 0, 0, hashlib.sha256()

            def put(role, text):
                nonlocal said
                digest.update(f"{chr(10) if said else ''}{role}:{text}".encode())  # noqa: B023
                said += 1

            def inserted():
                nonlocal state, at
                while audit[at : at + 1] == "I":  # noqa: B023
                    put(ROLES[NEXT[state]], "")  # noqa: B023
                    state, at = AFTER[state], at + 1

            for *_, role, text, n in rows:
                inserted()
                edit = audit[at]
                at += n
                if edit == "R":
                    role = ROLES[NEXT[state]]
                if edit != "D":
                    put(role, text)
                    state = 1 if role[:1] == "s" else AFTER[state]
            inserted()
            yield {"conv_id": conv, "audit": audit, "repaired_sha256": digest.hexdigest()} | dict(zip(COUNTS, counts, strict=True))

    return lambda batches: _together(digested(batches), schema)


def _first_of(columns: list[str]) -> Column:
    """Turns in order, null first."""
    return F.struct(F.col("turn").isNotNull(), *columns)


def repair(given: DataFrame, damage=damaged, block: int = 256) -> DataFrame:
    """(conv_id, gaps, blank, duplicate, truncated, illegal, cost, audit, repaired_sha256) for each conv_id of given (conv_id,
    turn, role, text). damage: what is done to the rows first; it gives them with a column copies."""
    from pyspark.sql import types as T
    from pyspark.sql.pandas.types import to_arrow_schema

    c = Columns(given)
    named = c.rows.select(*[F.col(c[n]).alias(n) for n in ("conv_id", "turn", "role", "text")])
    rows = cut_table(_faults(damage(named)))
    whose = ["conv_id", "role", "digest"]
    narrow = rows.select(*whose, "turn", F.substring("role", 1, 1).alias("initial"), "blank", "cut_off", "n")
    # A row is known by all it says, in one value that is never null: conversations may be.
    said = F.sha2(F.concat_ws("|", F.coalesce(F.col("conv_id").cast("string"), F.lit("")), F.length("role").cast("string"), "role", "digest"), 256)
    narrow = narrow.withColumn("said", said)
    first = narrow.groupBy("said").agg(F.min(_first_of(["turn"])).alias("first"))
    known = narrow.join(first, "said").withColumn("is_first", _first_of(["turn"]).eqNullSafe(F.col("first"))).drop("said", "first")
    order = [F.col("conv_id").asc_nulls_first(), F.col("turn").asc_nulls_first(), F.col("role"), F.col("digest")]
    schema = T.StructType([T.StructField("conv_id", named.schema["conv_id"].dataType), *[T.StructField(n, T.LongType()) for n in COUNTS], T.StructField("audit", T.StringType())])
    solved = known.repartition("conv_id").sortWithinPartitions(*order).mapInArrow(_solve(block, to_arrow_schema(schema)), schema)
    ids = named.select("conv_id").distinct().withColumnRenamed("conv_id", "id")
    whole = ids.join(solved, F.col("id").eqNullSafe(F.col("conv_id")), "left").select(F.col("id").alias("conv_id"), *COUNTS, "audit")
    whole = whole.na.fill(0, list(COUNTS)).na.fill("", ["audit"])
    heads = whole.withColumn("place", F.lit(0)).select("conv_id", "place", *COUNTS, "audit", *[F.lit(None).cast(t).alias(n) for n, t in (("turn", dict(named.dtypes)["turn"]), ("role", "string"), ("digest", "string"), ("text", "string"), ("n", "bigint"))])
    tails = rows.select("conv_id", F.lit(1).alias("place"), *[F.lit(None).cast("bigint").alias(n) for n in COUNTS], F.lit(None).cast("string").alias("audit"), "turn", "role", "digest", "text", "n")
    order.insert(1, F.col("place"))
    out = T.StructType([*schema.fields, T.StructField("repaired_sha256", T.StringType())])
    done = heads.union(tails).repartition("conv_id").sortWithinPartitions(*order).mapInArrow(_digests(to_arrow_schema(out)), out)
    return done.select("conv_id", *COUNTS, "audit", "repaired_sha256")
