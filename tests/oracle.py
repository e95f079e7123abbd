"""Run a registered query and its SQL side by side; used by tests and by hand."""

from __future__ import annotations

import duckdb

TABLES = (
    "region nation customer supplier part orders lineitem events documents embeddings "
    "pages benchmark labels conversations"
).split()


def connect(sf_dir: str):
    con = duckdb.connect()
    con.execute("SET TimeZone = 'UTC'")
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{sf_dir}/{t}.parquet'")
    return con


def _cell(value):
    if isinstance(value, float):
        return ("f", repr(value))
    return (type(value).__name__, repr(value))


def compare(spark, con, query, sql, sf_dir):
    """'' when equal, else what differs."""
    return compare_rows(query(spark, sf_dir), con, sql)


def compare_rows(df, con, sql):
    names = sorted(df.columns)
    mine = [tuple(r[n] for n in names) for r in df.select(*[f"`{n}`" for n in names]).collect()]
    cursor = con.execute(sql)
    theirs_names = [d[0] for d in cursor.description]
    if sorted(theirs_names) != names:
        return f"columns {names} != {sorted(theirs_names)}"
    at = [theirs_names.index(n) for n in names]
    theirs = [tuple(r[i] for i in at) for r in cursor.fetchall()]
    if len(mine) != len(theirs):
        return f"rows {len(mine)} != {len(theirs)}"
    a = sorted(tuple(map(_cell, r)) for r in mine)
    b = sorted(tuple(map(_cell, r)) for r in theirs)
    wrong = [(x, y) for x, y in zip(a, b) if x != y]
    if wrong:
        x, y = wrong[0]
        diff = [(n, p, q) for n, p, q in zip(names, x, y) if p != q]
        return f"{len(wrong)} of {len(a)} rows differ, first: {diff}"
    return ""
