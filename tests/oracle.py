"""Run a registered query beside its SQL and compare rows, ignoring order."""

import math

import duckdb

TABLES = (
    "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations"
).split()


def connect(sf_dir):
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{sf_dir}/{t}.parquet'")
    return con


def plain(v):
    if v is None:
        return "NULL"
    if isinstance(v, bool):
        return str(v)
    if isinstance(v, float):
        return "NaN" if math.isnan(v) else f"{v:.9g}"
    if type(v).__name__ == "Decimal":
        return f"{float(v):.9g}"
    if isinstance(v, int):
        return str(v)
    return str(v)


def compare(spark, sf_dir, name, fn, sql, con):
    """None when equal, else a short description."""
    df = fn(spark, sf_dir)
    got_cols = sorted(df.columns)
    got = sorted(tuple(plain(r[c]) for c in got_cols) for r in df.collect())
    rel = con.execute(sql)
    cols = [d[0] for d in rel.description]
    want_cols = sorted(cols)
    if got_cols != want_cols:
        return f"columns {got_cols} != {want_cols}"
    place = [cols.index(c) for c in want_cols]
    want = sorted(tuple(plain(r[i]) for i in place) for r in rel.fetchall())
    if got != want:
        a, b = set(got), set(want)
        return f"rows {len(got)} vs {len(want)}; only spark {sorted(a - b)[:2]}; only sql {sorted(b - a)[:2]}"
    return None
