from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from kinweave.llm import topk
from kinweave.llm.common import table


def op7(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "embeddings").selectExpr("vec_id as id", "embedding as v")
    return topk.search(rows.where("id % 100 = 0"), rows)


QUERIES = {"op7_exact_topk": op7}
SQL = {
    "op7_exact_topk": """WITH e AS (SELECT row_number() OVER () AS r, vec_id, embedding AS v FROM embeddings),
x AS (SELECT r, vec_id, unnest(range(1, len(v) + 1)) AS i, unnest(v) AS x FROM e),
ok AS (SELECT r, vec_id FROM x GROUP BY r, vec_id HAVING count(*) = count(x) AND bool_and(isfinite(x))),
w AS (SELECT x.r, x.vec_id, i, CAST(floor(1024 * CAST(x AS DOUBLE)) AS BIGINT) AS w FROM x JOIN ok ON ok.r = x.r),
s AS (SELECT q.vec_id AS query_id, c.vec_id, CAST(sum(q.w * c.w) AS BIGINT) AS score FROM w q JOIN w c ON c.i = q.i AND c.vec_id <> q.vec_id WHERE q.vec_id % 100 = 0 GROUP BY q.vec_id, c.vec_id, c.r)
SELECT query_id, CAST(rank AS INTEGER) AS rank, vec_id, score FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS rank FROM s) WHERE rank <= 10"""
}
