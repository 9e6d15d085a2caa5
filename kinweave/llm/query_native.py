"""Queries of the operators that are DataFrame expressions throughout, with their SQL."""

from __future__ import annotations

import math

from pyspark.sql import DataFrame, SparkSession

from kinweave.llm import mixing, quality
from kinweave.llm.common import table


def op1(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    return quality.assess(docs).select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept")


def op9(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text", "source")
    return mixing.mix(docs).select("doc_id", "size", "source_size", "target", "taken")


def _js(counts: list[str], total: str, shares: list[float]) -> str:
    def term(c: str, q: float) -> str:
        p, m = f"({c} / {total})", f"(({c} / {total} + {q!r}) / 2)"
        return f"(CASE WHEN {c} > 0 THEN {p} * log2({p} / {m}) ELSE 0 END" + (f" + {q!r} * log2({q!r} / {m}))" if q > 0 else ")")

    return f"sqrt(greatest(({' + '.join(term(c, q) for c, q in zip(counts, shares, strict=True))}) / 2, 0))"


def _nearest(counts: list[str], total: str, references: list[list[float]]) -> str:
    return f"CASE WHEN {total} > 0 THEN least({', '.join(_js(counts, total, r) for r in references)}) END"


def _op1_sql() -> str:
    space = r"[\x20\x09-\x0D]"
    steps = ["[a-z]+", space + "+", "[A-Z]+", "[0-9]+", r"[#*$%&|<>]+", r"[^\x00-\x7F]+"]
    r = "t"
    lengths = ["length(t)"]
    for x in steps:
        r = f"regexp_replace({r}, '{x}', '', 'g')"
        lengths.append(f"length({r})")
    lengths.append("0")
    classes = ", ".join(f"{lengths[i]} - {lengths[i + 1]} AS k{i}" for i in range(7))
    common = ", ".join(f"CAST(len(list_filter(w, lambda x: x IN ('{v}', '{v.capitalize()}'))) AS DOUBLE) AS c{i}" for i, v in enumerate(quality.VOCABULARY))
    total = "CAST(k0 + k1 + k2 + k3 + k4 + k5 + k6 AS DOUBLE)"
    chars = _nearest([f"k{i}" for i in range(7)], total, [list(x) for x in quality.CHARACTERS.values()])
    hits = " + ".join(f"c{i}" for i in range(len(quality.VOCABULARY)))
    references = [[*(q := [quality.COMMON[x].get(w, 0.0) / 100 for w in quality.VOCABULARY]), 1 - math.fsum(q)] for x in quality.COMMON]
    of_words = _nearest([*[f"c{i}" for i in range(len(quality.VOCABULARY))], f"(n_words - ({hits}))"], "CAST(n_words AS DOUBLE)", references)
    return rf"""WITH d AS (SELECT row_number() OVER () AS r, doc_id, coalesce(text, '') AS t FROM documents),
w AS (SELECT r, doc_id, t, regexp_extract_all(t, '[^\x20\x09-\x0D]+') AS w, list_filter(string_split(t, chr(10)), lambda x: regexp_matches(x, '[^\x20\x09-\x0D]')) AS l FROM d),
f AS (SELECT *, CAST(len(w) AS BIGINT) AS n_words, {classes}, {common} FROM w),
g AS (SELECT r, i, array_to_string(w[i:i + 4], ' ') AS g FROM (SELECT r, w, unnest(range(1, len(w) - 3)) AS i FROM w WHERE len(w) >= 5)),
p AS (SELECT r, i FROM (SELECT r, i, count(*) OVER (PARTITION BY r, g) AS c FROM g) WHERE c > 1),
x AS (SELECT r, count(DISTINCT i + j) AS n FROM p, (SELECT unnest(range(0, 5)) AS j) GROUP BY r),
m AS (SELECT doc_id, n_words, CAST(k0 + k2 + k3 + k4 + k5 + k6 AS BIGINT) AS word_chars, CAST(k4 AS BIGINT) AS n_symbols,
  CAST(len(l) - len(list_distinct(l)) AS BIGINT) AS n_dup_lines, CAST(coalesce(x.n, 0) AS BIGINT) AS n_repeat_words, length(t) AS chars,
  {chars} AS char_distance, {of_words} AS word_distance FROM f LEFT JOIN x ON x.r = f.r),
b AS (SELECT *, n_words < 10 OR 100 * n_repeat_words > 20 * n_words AS base_failed FROM m)
SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed,
  NOT base_failed AND NOT coalesce((chars >= 150 AND char_distance > 0.30) OR (n_words >= 30 AND word_distance > 0.70)
    OR (chars >= 150 AND n_words >= 30 AND char_distance > 0.17 AND word_distance > 0.25), FALSE) AS kept FROM b"""


_OP9_SQL = r"""WITH RECURSIVE d AS (SELECT doc_id, source, CAST(len(regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+')) AS BIGINT) AS size,
  md5('1:' || coalesce(CAST(doc_id AS VARCHAR), '')) AS h FROM documents),
s AS (SELECT source, CAST(sum(size) AS BIGINT) AS source_size, count(*) AS n, row_number() OVER (ORDER BY source IS NULL, source) AS o FROM d GROUP BY source),
v AS (SELECT *, CASE (o - 1) % 3 WHEN 0 THEN 3 WHEN 1 THEN 1 ELSE 2 END AS weight, 2 * source_size AS cap, CAST(least(4096, greatest(1, ceil(n / 4096.0))) AS BIGINT) AS shards FROM s),
l AS (SELECT *, (sum(source_size) OVER () * 1.5::DOUBLE - coalesce(sum(cap) OVER (ORDER BY cap / weight, o ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0))
  / sum(weight) OVER (ORDER BY cap / weight, o ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS level FROM v),
y AS (SELECT level FROM l WHERE level * weight <= cap ORDER BY cap / weight, level LIMIT 1),
t AS (SELECT l.*, CASE WHEN (SELECT level FROM y) IS NULL OR (SELECT level FROM y) * weight > cap THEN CAST(cap AS DOUBLE) ELSE (SELECT level FROM y) * weight END AS target FROM l),
z AS (SELECT *, round(sum(target) OVER () / 16) AS seats, sum(target) OVER () AS whole, count(*) OVER () AS many FROM t),
q AS (SELECT o, row_number() OVER (ORDER BY target / (2 * k + 1) DESC, o, k) AS place, seats
  FROM (SELECT o, target, seats, unnest(range(0, CAST(ceil(target / whole * seats) AS BIGINT) + many + 1)) AS k FROM z WHERE target > 0)),
b AS (SELECT o, count(*) AS blocks FROM q WHERE place <= seats GROUP BY o),
e AS (SELECT d.*, z.o, z.source_size, z.target, coalesce(blocks, 0) AS blocks, (CAST('0x' || substr(h, 1, 8) AS BIGINT) % 4096) % shards AS shard
  FROM d JOIN z ON d.source IS NOT DISTINCT FROM z.source LEFT JOIN b ON b.o = z.o),
a AS (SELECT o, shard, sum(size) AS words, max(blocks) AS blocks, sum(sum(size)) OVER (PARTITION BY o) AS whole, count(*) OVER (PARTITION BY o) AS many FROM e GROUP BY o, shard),
c AS (SELECT o, shard, row_number() OVER (PARTITION BY o ORDER BY words / (2 * k + 1) DESC, shard, k) AS place, blocks
  FROM (SELECT o, shard, words, blocks, unnest(range(0, CAST(ceil(words / whole * blocks) AS BIGINT) + many + 1)) AS k FROM a WHERE words > 0)),
u AS (SELECT o, shard, count(*) AS quota FROM c WHERE place <= blocks GROUP BY o, shard),
g AS (SELECT e.*, a.words, least(coalesce(u.quota, 0) * 16, a.words * 2) AS quota,
  sum(e.size) OVER (PARTITION BY e.o, e.shard ORDER BY h, doc_id, e.size ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) - e.size AS before
  FROM e JOIN a ON a.o = e.o AND a.shard = e.shard LEFT JOIN u ON u.o = e.o AND u.shard = e.shard),
f AS (SELECT *, CASE WHEN words > 0 THEN floor(quota / words) ELSE 0 END AS times FROM g)
SELECT doc_id, size, source_size, target, CAST(size * times + greatest(0, least(size, quota - times * words - before)) AS BIGINT) AS taken FROM f"""

QUERIES = {"op1_quality_rules": op1, "op9_source_mixing": op9}
SQL = {"op1_quality_rules": _op1_sql(), "op9_source_mixing": _OP9_SQL}
