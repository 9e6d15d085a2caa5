from __future__ import annotations

import string

from pyspark.sql import DataFrame, SparkSession

from kinweave.llm import divergence
from kinweave.llm.common import table


def op11(spark: SparkSession, sf_dir: str) -> DataFrame:
    return divergence.audit(table(spark, sf_dir, "documents"))


_P = "1 + CAST(1000000000 * (CAST({n} AS HUGEINT) + 1) // ({total} + v) AS BIGINT)"
_F = "CAST((CAST(p AS HUGEINT) - q) * (p - q) // q AS HUGEINT)"

QUERIES = {"op11_source_divergence": op11}
SQL = {
    "op11_source_divergence": rf"""WITH d AS (SELECT row_number() OVER () AS r, coalesce(lang, '') AS lang, coalesce(source, '') AS source,
  regexp_extract_all(translate(coalesce(text, ''), '{string.ascii_uppercase}', '{string.ascii_lowercase}'), '[^\x00-\x40\x5B-\x60\x7B-\x7F]+') AS w FROM documents),
t AS (SELECT r, lang, source, unnest(w) AS term FROM d),
g AS (SELECT DISTINCT lang, source FROM d),
k AS (SELECT lang, term, count(*) AS lang_n FROM t GROUP BY lang, term HAVING count(DISTINCT r) >= 3),
x AS (SELECT lang, count(*) AS v, sum(lang_n) AS lang_total FROM k GROUP BY lang),
c AS (SELECT lang, source, term, count(*) AS n FROM t GROUP BY lang, source, term),
z AS (SELECT g.lang, g.source, k.term, k.lang_n, coalesce(c.n, 0) AS n FROM g JOIN k ON k.lang = g.lang LEFT JOIN c ON c.lang = g.lang AND c.source = g.source AND c.term = k.term),
s AS (SELECT lang, source, sum(n) AS total FROM z GROUP BY lang, source),
p AS (SELECT z.lang, z.source, z.term, z.n, {_P.format(n="z.n", total="total")} AS p, {_P.format(n="lang_n", total="lang_total")} AS q
  FROM z JOIN s ON s.lang = z.lang AND s.source = z.source JOIN x ON x.lang = z.lang),
j AS (SELECT a.lang, a.source, b.source AS item, CAST(sum({_F.replace("q", "b.p").replace("(p", "(a.p").replace("AS HUGEINT) - b.p", "AS HUGEINT) - b.p")}) AS BIGINT) AS value
  FROM p a JOIN p b ON b.lang = a.lang AND b.term = a.term AND b.source <> a.source GROUP BY 1, 2, 3),
y AS (SELECT a.lang, a.source, 'pair' AS part, b.source AS item, coalesce(j.value, 0) AS value
  FROM g a JOIN g b ON b.lang = a.lang AND b.source <> a.source LEFT JOIN j ON j.lang = a.lang AND j.source = a.source AND j.item = b.source
  UNION ALL SELECT lang, source, 'term', term, CAST({_F} AS BIGINT) FROM p WHERE n > 0 AND p > q),
o AS (SELECT *, CAST(row_number() OVER (PARTITION BY lang, source, part ORDER BY value DESC, item) AS INTEGER) AS rank FROM y)
SELECT lang, source, part, item, value, rank FROM o WHERE part = 'pair' OR rank <= 200"""
}
