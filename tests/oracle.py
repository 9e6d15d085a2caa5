"""Compare a query's rows with its SQL in DuckDB, as bags, columns by name."""

import math
from pathlib import Path

import duckdb

TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


def connect(sf_dir):
    con = duckdb.connect()
    for name in TABLES:
        con.execute(f"CREATE VIEW {name} AS SELECT * FROM read_parquet('{Path(sf_dir) / name}.parquet')")
    return con


def same(a, b):
    if isinstance(a, float) and isinstance(b, float):
        return math.isclose(a, b, rel_tol=1e-9, abs_tol=1e-12)
    return a == b


def compare(df, sql, con):
    result = con.execute(sql)
    names = [c[0] for c in result.description]
    order = sorted(names)
    assert sorted(df.columns) == order
    mine = sorted((tuple(r[c] for c in order) for r in df.collect()), key=repr)
    theirs = sorted((tuple(r[names.index(c)] for c in order) for r in result.fetchall()), key=repr)
    assert len(mine) == len(theirs)
    for x, y in zip(mine, theirs, strict=True):
        assert all(same(p, q) for p, q in zip(x, y, strict=True)), (x, y)
    return len(mine)
