from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from kinweave.llm import conversations
from kinweave.llm.common import table


def op13(spark: SparkSession, sf_dir: str) -> DataFrame:
    return conversations.repair(table(spark, sf_dir, "conversations"))


def _least(*ways: str) -> str:
    return f"list_sort([{', '.join(ways)}])[1]"


def _step(state: str, cost: str, edit: str, said: str | None = None) -> str:
    """A way on from a state, as (cost, audit, repaired text)."""
    added = "" if said is None else f" || chr(10) || {said}"
    return f"struct_pack(c := {state}.c + {cost}, a := {state}.a || '{edit}', r := {state}.r{added})"


def _kept(states: list[str], state: str) -> str:
    """What a state is after the row: where it may be reached from by keeping, changing or deleting the row."""
    ways = [f"CASE WHEN must THEN {_step(state, '4', 'D')} ELSE {_step(state, '4', 'D')} END"]
    for old, initial, new in (("t0", "s", "s1"), ("t0", "u", "s2"), ("t1", "u", "s2"), ("t3", "u", "s2"), ("t2", "a", "s3")):
        if new == "s" + state[1]:
            ways.append(f"CASE WHEN NOT must AND initial = '{initial}' THEN {_step(old, 'charge', 'K', chr(39) + chr(39) + ' || role || chr(58) || text')} ELSE {_NEVER} END")
            if initial != "s":
                ways.append(f"CASE WHEN NOT must THEN {_step(old, '3 + charge', 'R', repr(dict(u='user:', a='assistant:')[initial]) + ' || text')} ELSE {_NEVER} END")
    return _least(*ways)


_NEVER = "struct_pack(c := 1000000000000, a := '', r := '')"
_U, _A = "'user:'", "'assistant:'"
_CLOSED = f"""s0 AS t0, s1 AS t1, {_least("s2", *(_step(x, '3', 'I', _U) for x in ("s0", "s1", "s3")))} AS t2,
  {_least("s3", _step("s2", "3", "I", _A), *(f"struct_pack(c := {x}.c + 6, a := {x}.a || 'II', r := {x}.r || chr(10) || {_U} || chr(10) || {_A})" for x in ("s0", "s1")))} AS t3"""

QUERIES = {"op13_conversation_repair": op13}
SQL = {
    "op13_conversation_repair": rf"""WITH RECURSIVE crc AS (SELECT list_transform(range(256), lambda x: list_reduce(list_prepend(x, range(8)), lambda c, i: xor(c >> 1, 3988292384 * (c & 1)))) AS t),
k AS (SELECT conv_id, turn, coalesce(role, ' ') AS role, coalesce(text, ' ') AS text, coalesce(CAST(conv_id AS VARCHAR), ' ') || ':' || coalesce(CAST(turn AS VARCHAR), ' ') AS k FROM conversations),
h AS (SELECT k.*, xor(list_reduce(list_prepend(4294967295, list_transform(string_split(k, ''), lambda x: CAST(ascii(x) AS BIGINT))), lambda c, b: xor(c >> 8, crc.t[1 + (xor(c, b) & 255)])), 4294967295) % 20 AS kind FROM k, crc),
m AS (SELECT conv_id, turn, CASE WHEN kind = 4 THEN 'user' ELSE role END AS role, CASE kind WHEN 1 THEN '' WHEN 2 THEN regexp_replace(text, '[.!?]', '', 'g') ELSE text END AS text,
  unnest(range(0, CASE kind WHEN 0 THEN 0 WHEN 3 THEN 2 ELSE 1 END)) AS copy FROM h),
o AS (SELECT *, row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST, role, sha256(text), copy) AS i FROM m),
f AS (SELECT *, substr(role, 1, 1) AS initial, rtrim(text, ' ' || chr(9) || chr(10) || chr(11) || chr(12) || chr(13)) AS trimmed, row_number() OVER (PARTITION BY conv_id, role, text ORDER BY i) > 1 AS again,
  lag(substr(role, 1, 1)) OVER (PARTITION BY conv_id ORDER BY i) AS before FROM o),
x AS (SELECT *, trimmed = '' AS blank, trimmed <> '' AND again AS duplicate, trimmed <> '' AND NOT again AND right(trimmed, 1) NOT IN ('.', '!', '?') AS truncated FROM f),
r AS (SELECT conv_id, i, role, text, initial, blank OR duplicate AS must, CASE WHEN truncated THEN 3 ELSE 0 END AS charge FROM x),
ids AS (SELECT row_number() OVER () AS id, conv_id FROM (SELECT DISTINCT conv_id FROM conversations)),
w AS (SELECT ids.id, r.* FROM ids JOIN r ON r.conv_id IS NOT DISTINCT FROM ids.conv_id),
p AS (SELECT id, CAST(0 AS BIGINT) AS i, struct_pack(c := CAST(0 AS BIGINT), a := '', r := '') AS s0, struct_pack(c := CAST(1000000000000 AS BIGINT), a := '', r := '') AS s1,
  struct_pack(c := CAST(1000000000000 AS BIGINT), a := '', r := '') AS s2, struct_pack(c := CAST(1000000000000 AS BIGINT), a := '', r := '') AS s3 FROM ids
UNION ALL SELECT id, i, {", ".join(f"{_kept([], f't{n}')} AS s{n}" for n in range(4))}
  FROM (SELECT c.id, w.i, role, text, initial, must, charge, {_CLOSED} FROM p c JOIN w ON w.id = c.id AND w.i = c.i + 1)),
e AS (SELECT id, {_least("t0", "t3")} AS best FROM (SELECT id, {_CLOSED} FROM (SELECT *, row_number() OVER (PARTITION BY id ORDER BY i DESC) AS z FROM p) WHERE z = 1)),
n AS (SELECT conv_id, CAST(coalesce(max(turn) - min(turn) + 1 - count(DISTINCT turn), 0) AS BIGINT) AS gaps, count(*) FILTER (WHERE blank) AS blank, count(*) FILTER (WHERE duplicate) AS duplicate,
  count(*) FILTER (WHERE truncated) AS truncated, count(*) FILTER (WHERE i > 1 AND before || initial NOT IN ('su', 'ua', 'au')) AS illegal FROM x GROUP BY conv_id)
SELECT ids.conv_id, coalesce(gaps, 0) AS gaps, coalesce(blank, 0) AS blank, coalesce(duplicate, 0) AS duplicate, coalesce(truncated, 0) AS truncated, coalesce(illegal, 0) AS illegal,
  best.c AS cost, best.a AS audit, sha256(substr(best.r, 2)) AS repaired_sha256 FROM ids JOIN e ON e.id = ids.id LEFT JOIN n ON n.conv_id IS NOT DISTINCT FROM ids.conv_id"""
}
