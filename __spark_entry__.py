"""The registered queries, and for those that SQL can express the same result as DuckDB SQL.

`entry(spark)` runs the flagship query; `queries()` maps a name to a function of (spark, sf_dir);
`oracle_sql()` maps a name to SQL over the same parquet tables.
"""

from __future__ import annotations

import importlib.util
import os
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from kinweave import operators, plans, session, sinks, sources
from kinweave.operators.graph import region_edges
from kinweave.sources import StandIn

Query = Callable[[SparkSession, str], DataFrame]


def _edges(kind: str) -> Query:
    return lambda s, d: operators.same_region_edges(StandIn(s, d).pages(), getattr(StandIn(s, d), f"follows_{kind}")())


def _ids(kind: str, plan: str) -> Query:
    return lambda s, d: operators.one_way_followers(region_edges(StandIn(s, d).pages(), getattr(StandIn(s, d), f"follows_{kind}")()), plan)


def _written(lines: DataFrame) -> str:
    """A folder of text files with these lines."""
    path = session.scratch(lines.sparkSession)
    lines.write.text(path)
    return path


def _file_queries() -> dict[str, Query]:
    """The text readers and the text sink with real files: lines are written, then read back."""

    def question(letter: str, visits: str, lines: str, result: Query) -> Query:
        def run(s: SparkSession, d: str) -> DataFrame:
            t = StandIn(s, d)
            people = sources.read_pages(s, _written(t.page_lines()))
            out = session.scratch(s)
            sinks.write_text(result(people, getattr(sources, f"read_{visits}")(s, _written(getattr(t, lines)()))), letter, out)
            return s.read.text(out)

        return run

    return {
        "files_pages": lambda s, d: sources.read_pages(s, _written(StandIn(s, d).page_lines())),
        "files_page_count": lambda s, d: sources.count_lines(s, _written(StandIn(s, d).page_lines())),
        "files_follows": lambda s, d: sources.read_follows(s, _written(StandIn(s, d).follow_lines())),
        "files_activity": lambda s, d: sources.read_activity(s, _written(StandIn(s, d).activity_lines())),
        "files_d": question("d", "follows", "follow_lines", plans.follower_totals),
        "files_e": question("e", "activity", "activity_lines", plans.activity_totals),
        "files_h": question("h", "follows", "follow_lines", plans.one_way_in_region),
    }


def _graph_queries() -> dict[str, Query]:
    q: dict[str, Query] = {
        "a_hobby_frequency": lambda s, d: plans.hobby_frequency(StandIn(s, d).pages()),
        "c_users_by_hobby": lambda s, d: plans.users_by_hobby(StandIn(s, d).pages(), "building"),
        "b_access_counts": lambda s, d: operators.count_by(StandIn(s, d).activity_orders(), "what_page"),
        "b_counts_full_pages": lambda s, d: plans.questions.access_counts_with_people(StandIn(s, d).pages(), StandIn(s, d).activity_orders()),
        "d_follower_counts": lambda s, d: operators.count_by(StandIn(s, d).follows_part(), "id2"),
        "f_avg_followers": lambda s, d: operators.global_average(plans.follower_totals(StandIn(s, d).pages(), StandIn(s, d).follows_part())),
        "f_above_average_part_allrows": lambda s, d: plans.above_average(StandIn(s, d).pages(), StandIn(s, d).follows_part(), "rows"),
        "g_global_max": lambda s, d: operators.global_max(StandIn(s, d).activity_orders()),
        "g_user_max": lambda s, d: operators.max_by_user(StandIn(s, d).activity_orders()),
        "g_outdated_orders": lambda s, d: plans.outdated(StandIn(s, d).pages(), StandIn(s, d).activity_orders()),
        "g_outdated_events_24h": lambda s, d: plans.outdated(StandIn(s, d).pages(), StandIn(s, d).activity_events(), 24),
    }
    q |= {
        "a_hobby_frequency_strict": lambda s, d: plans.hobby_frequency(sources.page_rows(StandIn(s, d).page_lines(), True), True),
        "a_hobby_frequency_lines": lambda s, d: plans.hobby_frequency(sources.page_rows(StandIn(s, d).page_lines())),
        "c_users_by_hobby_padded": lambda s, d: plans.users_by_hobby(sources.page_rows(StandIn(s, d).page_lines()), " Machinery\t"),
        "text_pages": lambda s, d: sources.pages(StandIn(s, d).page_lines()),
        "text_follows": lambda s, d: sources.follows(StandIn(s, d).follow_lines()),
        "text_activity": lambda s, d: sources.activity(StandIn(s, d).activity_lines()),
    }
    q |= _file_queries()
    for letter, result in (
        ("a", lambda t: plans.hobby_frequency(t.pages())),
        ("b", lambda t: plans.top_pages(t.pages(), t.activity_orders())),
        ("c", lambda t: plans.users_by_hobby(t.pages(), "building")),
        ("d", lambda t: plans.follower_totals(t.pages(), t.follows_supp())),
        ("e", lambda t: plans.activity_totals(t.pages(), t.activity_orders())),
        ("f", lambda t: plans.above_average(t.pages(), t.follows_supp())),
        ("g", lambda t: plans.outdated(t.pages(), t.activity_orders())),
        ("h", lambda t: plans.one_way_in_region(t.pages(), t.follows_supp())),
    ):
        q[f"sink_lines_{letter}"] = lambda s, d, letter=letter, result=result: sinks.lines(result(StandIn(s, d)), letter)
    for kind in ("events", "orders"):
        visits = lambda s, d, kind=kind: getattr(StandIn(s, d), f"activity_{kind}")()
        q[f"b_top_pages_{kind}"] = lambda s, d, v=visits: plans.top_pages(StandIn(s, d).pages(), v(s, d))
        q[f"e_activity_{kind}"] = lambda s, d, v=visits: plans.activity_totals(StandIn(s, d).pages(), v(s, d))
    for kind in ("part", "supp"):
        edges = lambda s, d, kind=kind: getattr(StandIn(s, d), f"follows_{kind}")()
        q[f"d_followers_{kind}"] = lambda s, d, e=edges: plans.follower_totals(StandIn(s, d).pages(), e(s, d))
        q[f"f_above_average_{kind}"] = lambda s, d, e=edges: plans.above_average(StandIn(s, d).pages(), e(s, d))
        q[f"h_one_way_{kind}"] = lambda s, d, e=edges: plans.one_way_in_region(StandIn(s, d).pages(), e(s, d))
        q[f"h_same_region_edges_{kind}"] = _edges(kind)
        q[f"h_one_way_ids_anti_{kind}"] = _ids(kind, "anti")
        q[f"h_one_way_ids_pair_{kind}"] = _ids(kind, "pair")
    return q


_WITH = """WITH people AS (SELECT CAST(c_custkey AS BIGINT) AS id, c_name AS nick, c_name AS job, c_nationkey AS region, c_mktsegment AS hobby FROM customer),
ordered AS (SELECT CAST(o_custkey AS BIGINT) AS cust, CAST(l_partkey AS BIGINT) AS part, CAST(l_suppkey AS BIGINT) AS supp, CAST(floor(epoch(o_orderdate) / 3600) AS INTEGER) AS t FROM lineitem JOIN orders ON l_orderkey = o_orderkey),
follows_part AS (SELECT cust AS id1, part AS id2 FROM ordered WHERE cust <> part),
follows_supp AS (SELECT cust AS id1, supp AS id2 FROM ordered WHERE cust <> supp),
activity_orders AS (SELECT cust AS by_who, part AS what_page, t AS action_time FROM ordered),
activity_events AS (SELECT CAST(user_id AS BIGINT) AS by_who, TRY_CAST(json_extract_string(props, '$.k') AS BIGINT) AS what_page, CAST(floor(epoch(ts) / 3600) AS INTEGER) AS action_time FROM events)"""


_LINES = r"""WITH lines AS (SELECT CASE WHEN c_custkey % 8 = 7 THEN c_custkey || ',short' ELSE CASE WHEN c_custkey % 8 = 6 THEN 'id' ELSE CAST(c_custkey AS VARCHAR) END
  || ', ' || c_name || ',Job ' || c_custkey || ',' || CASE c_custkey % 8 WHEN 4 THEN 'x' WHEN 5 THEN ' +' || c_nationkey ELSE CAST(c_nationkey AS VARCHAR) END || ','
  || CASE c_custkey % 8 WHEN 1 THEN ' ' || c_mktsegment || chr(9) WHEN 2 THEN c_mktsegment || ',more' WHEN 3 THEN ',,' ELSE c_mktsegment END END AS value FROM customer),
parts AS (SELECT value, string_split(value, ',') AS p FROM lines),
rows_ AS (SELECT CASE WHEN regexp_matches(trim(p[1], ' ' || chr(9)), '^[+-]?[0-9]+$') THEN TRY_CAST(trim(p[1], ' ' || chr(9)) AS BIGINT) END AS id, trim(p[2], ' ' || chr(9)) AS nick_name, trim(p[3], ' ' || chr(9)) AS job_title,
  CASE WHEN len(p) >= 4 THEN coalesce(CASE WHEN regexp_matches(trim(p[4], ' ' || chr(9)), '^[+-]?[0-9]+$') THEN TRY_CAST(ltrim(trim(p[4], ' ' || chr(9)), '+') AS INTEGER) END, -1) END AS region_code,
  trim(p[5], ' ' || chr(9)) AS favorite_hobby FROM parts)"""
_ORDERED = """SELECT o_orderkey AS k, o_custkey AS cust, l_partkey AS part, l_suppkey AS supp, CAST(floor(epoch(o_orderdate) / 3600) AS INTEGER) AS t FROM lineitem JOIN orders ON l_orderkey = o_orderkey"""


def _text_sql() -> dict[str, str]:
    return {
        "a_hobby_frequency_strict": rf"{_LINES}, s AS (SELECT string_split(regexp_replace(value, ',+$', ''), ',') AS p FROM lines) SELECT p[5] AS hobby, count(*) AS n FROM s WHERE len(p) = 5 GROUP BY 1",
        "a_hobby_frequency_lines": f"{_LINES} SELECT favorite_hobby AS hobby, count(*) AS n FROM rows_ WHERE favorite_hobby <> '' GROUP BY 1",
        "c_users_by_hobby_padded": f"{_LINES} SELECT nick_name AS nick, job_title AS job FROM rows_ WHERE lower(favorite_hobby) = 'machinery'",
        "text_pages": f"{_LINES} SELECT id, nick_name, job_title, region_code, favorite_hobby FROM rows_ WHERE id IS NOT NULL",
        "text_follows": f"""WITH o AS ({_ORDERED}) SELECT CAST(k AS BIGINT) AS col_rel, CAST(cust AS BIGINT) AS id1, CASE WHEN k % 5 <> 1 THEN CAST(supp AS BIGINT) END AS id2,
  CAST(CASE WHEN k % 5 IN (3, 4) THEN NULL ELSE 7 END AS INTEGER) AS date_of_relation, CASE k % 5 WHEN 3 THEN NULL WHEN 4 THEN 'late' ELSE 'a friend' END AS description FROM o""",
        "text_activity": f"""WITH o AS ({_ORDERED}) SELECT CAST(k AS BIGINT) AS action_id, CASE WHEN k % 4 <> 1 THEN CAST(cust AS BIGINT) END AS by_who, CAST(part AS BIGINT) AS what_page,
  'viewed' AS action_type, CASE WHEN k % 4 <> 2 THEN t END AS action_time FROM o""",
    }


def _file_sql(text: dict[str, str]) -> dict[str, str]:
    people, edges, visits = (f"({text[x]})" for x in ("text_pages", "text_follows", "text_activity"))
    return {
        "files_pages": text["text_pages"],
        "files_page_count": "SELECT count(*) AS n FROM customer",
        "files_follows": text["text_follows"],
        "files_activity": text["text_activity"],
        "files_d": f"""SELECT p.id || ',' || nick_name || ',' || coalesce(n, 0) AS value FROM {people} p LEFT JOIN (SELECT id2, count(*) AS n FROM {edges} GROUP BY 1) c ON c.id2 = p.id WHERE nick_name IS NOT NULL""",
        "files_e": f"""SELECT p.id || chr(9) || coalesce(a, 0) || ',' || coalesce(b, 0) AS value FROM {people} p LEFT JOIN (SELECT by_who, count(*) AS a, count(DISTINCT what_page) AS b FROM {visits} WHERE by_who > 0 AND what_page > 0 GROUP BY 1) c ON c.by_who = p.id WHERE p.id > 0""",
        "files_h": f"""WITH q AS (SELECT * FROM {people}), e AS (SELECT DISTINCT id1, id2 FROM {edges} f JOIN q a ON a.id = f.id1 JOIN q b ON b.id = f.id2 WHERE a.region_code = b.region_code AND id1 <> id2)
SELECT q.id || ',' || nick_name AS value FROM q WHERE nick_name IS NOT NULL AND q.id IN (SELECT e.id1 FROM e LEFT JOIN e r ON r.id1 = e.id2 AND r.id2 = e.id1 WHERE r.id1 IS NULL)""",
    }


def _sink_sql(sql: dict[str, str]) -> dict[str, str]:
    sides = {"a": ("hobby", "n"), "b": ("id, nick, job, n", ""), "c": ("nick", "job"), "d": ("id, nick, n", ""), "e": ("id", "total_actions, distinct_pages"), "f": ("id, nick, n", ""), "g": ("id, nick", ""), "h": ("id, nick", "")}
    of = {"a": "a_hobby_frequency", "b": "b_top_pages_orders", "c": "c_users_by_hobby", "d": "d_followers_supp", "e": "e_activity_orders", "f": "f_above_average_supp", "g": "g_outdated_orders", "h": "h_one_way_supp"}
    join = lambda names: " || ',' || ".join(f"coalesce(CAST({n} AS VARCHAR), '')" for n in names.split(", "))
    return {f"sink_lines_{x}": f"SELECT {join(a)}{f' || chr(9) || {join(b)}' if b else ''} AS value FROM ({sql[of[x]]})" for x, (a, b) in sides.items()}


def _graph_sql() -> dict[str, str]:
    sql = {
        "a_hobby_frequency": f"{_WITH} SELECT trim(hobby) AS hobby, count(*) AS n FROM people WHERE trim(hobby) <> '' GROUP BY 1",
        "c_users_by_hobby": f"{_WITH} SELECT nick, job FROM people WHERE lower(trim(hobby)) = 'building'",
        "b_access_counts": f"{_WITH} SELECT what_page AS id, count(*) AS n FROM activity_orders WHERE what_page IS NOT NULL GROUP BY 1",
        "b_counts_full_pages": f"{_WITH}, c AS (SELECT what_page AS id, count(*) AS n FROM activity_orders WHERE what_page IS NOT NULL GROUP BY 1) SELECT coalesce(c.id, p.id) AS id, coalesce(nick, '') AS nick, coalesce(job, '') AS job, coalesce(n, 0) AS n FROM c FULL JOIN people p ON c.id = p.id",
        "d_follower_counts": f"{_WITH} SELECT id2 AS id, count(*) AS n FROM follows_part WHERE id2 IS NOT NULL GROUP BY 1",
        "g_global_max": f"{_WITH} SELECT coalesce(max(action_time), 0) AS t FROM activity_orders WHERE action_time >= 0",
        "g_user_max": f"{_WITH} SELECT by_who AS id, max(action_time) AS t FROM activity_orders WHERE by_who > 0 AND action_time >= 0 GROUP BY 1",
    }
    for kind in ("events", "orders"):
        log = f"activity_{kind}"
        sql[f"b_top_pages_{kind}"] = f"{_WITH}, top AS (SELECT what_page AS id, count(*) AS n FROM {log} WHERE what_page IS NOT NULL GROUP BY 1 ORDER BY n DESC, id LIMIT 10) SELECT top.id, coalesce(nick, '') AS nick, coalesce(job, '') AS job, n FROM top LEFT JOIN people p ON p.id = top.id"
        sql[f"e_activity_{kind}"] = f"{_WITH}, c AS (SELECT by_who AS id, count(*) AS a, count(DISTINCT what_page) AS b FROM {log} WHERE by_who > 0 AND what_page > 0 GROUP BY 1) SELECT p.id, coalesce(a, 0) AS total_actions, coalesce(b, 0) AS distinct_pages FROM (SELECT DISTINCT id FROM people WHERE id > 0) p LEFT JOIN c ON c.id = p.id"
    for name, log, hours in (("g_outdated_orders", "activity_orders", 2160), ("g_outdated_events_24h", "activity_events", 24)):
        sql[name] = f"{_WITH}, m AS (SELECT by_who AS id, max(action_time) AS t FROM {log} WHERE by_who > 0 AND action_time >= 0 GROUP BY 1) SELECT p.id, nick FROM people p LEFT JOIN m ON m.id = p.id WHERE t IS NULL OR t < (SELECT coalesce(max(action_time), 0) - {hours} FROM {log} WHERE action_time >= 0)"
    for kind in ("part", "supp"):
        totals = f"{_WITH}, c AS (SELECT id2 AS id, count(*) AS n FROM follows_{kind} GROUP BY 1), d AS (SELECT p.id, nick, coalesce(n, 0) AS n FROM people p LEFT JOIN c ON c.id = p.id)"
        edges = f"{_WITH}, e AS (SELECT DISTINCT id1, id2 FROM follows_{kind} JOIN people a ON a.id = id1 JOIN people b ON b.id = id2 WHERE a.region = b.region AND id1 <> id2)"
        one_way = f"{edges}, w AS (SELECT DISTINCT e.id1 AS id FROM e LEFT JOIN e r ON r.id1 = e.id2 AND r.id2 = e.id1 WHERE r.id1 IS NULL)"
        sql[f"d_followers_{kind}"] = f"{totals} SELECT id, nick, n FROM d"
        sql[f"f_above_average_{kind}"] = f"{totals} SELECT id, nick, n FROM d WHERE n > (SELECT avg(n) FROM d)"
        if kind == "part":
            sql["f_avg_followers"] = f"{totals} SELECT coalesce(avg(n), 0.0) AS average FROM d"
            sql["f_above_average_part_allrows"] = f"{totals} SELECT id, nick, n FROM d WHERE n > (SELECT (SELECT count(*) FROM follows_part) * 1.0 / (SELECT count(*) FROM people))"
        sql[f"h_same_region_edges_{kind}"] = f"{edges} SELECT id1, id2 FROM e"
        sql[f"h_one_way_ids_anti_{kind}"] = sql[f"h_one_way_ids_pair_{kind}"] = f"{one_way} SELECT id FROM w"
        sql[f"h_one_way_{kind}"] = f"{one_way} SELECT p.id, nick FROM people p JOIN w ON w.id = p.id"
    text = _text_sql()
    return sql | text | _file_sql(text) | _sink_sql(sql)


def _llm():
    """The registry of the training-data operators, or None when that subpackage or the pipeline is not there."""
    if importlib.util.find_spec("kinweave.llm") is None or importlib.util.find_spec("kinweave.llm.registry") is None:
        return None
    from kinweave.llm import registry

    return registry


def _pipeline():
    if importlib.util.find_spec("corpus_pipeline") is None:
        return None
    import corpus_pipeline

    return corpus_pipeline


def entry(spark: SparkSession) -> DataFrame:
    """The people who follow someone of their region without being followed back, at the smallest scale."""
    tables = StandIn(spark, os.environ.get("ENTRY_SF_DIR", "/root/testdata/sf0.001"))
    return plans.one_way_in_region(tables.pages(), tables.follows_part())


def queries() -> dict[str, Query]:
    q = _graph_queries()
    if (llm := _llm()) is not None:
        q |= llm.queries()
        if (pipeline := _pipeline()) is not None:
            q["pipeline"] = pipeline.run
    return q


def oracle_sql() -> dict[str, str]:
    sql = _graph_sql()
    if (llm := _llm()) is not None:
        sql |= llm.oracle_sql()
        if (pipeline := _pipeline()) is not None and pipeline.ORACLE_SQL is not None:
            sql["pipeline"] = pipeline.ORACLE_SQL
    return sql
