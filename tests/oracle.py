"""Side-by-side run of a query and its SQL, as the driver does it."""

from __future__ import annotations

from pathlib import Path

import duckdb


def connect(sf_dir: str):
    c = duckdb.connect()
    for p in sorted(Path(sf_dir).glob("*.parquet")):
        c.execute(f"create view {p.stem} as select * from read_parquet('{p}')")
    return c


def normal(v):
    if isinstance(v, float):
        return "nan" if v != v else repr(v + 0.0)
    return str(v)


def rows_of(columns, rows):
    order = sorted(range(len(columns)), key=lambda i: columns[i])
    return sorted(tuple(normal(r[i]) for i in order) for r in rows)


def differences(spark, con, query, sql: str, sf_dir: str) -> str:
    """Empty if both give the same columns and rows."""
    df = query(spark, sf_dir)
    mine = rows_of(df.columns, [tuple(r) for r in df.collect()])
    rel = con.execute(sql)
    names = [d[0] for d in rel.description]
    theirs = rows_of(names, rel.fetchall())
    if sorted(df.columns) != sorted(names):
        return f"columns {sorted(df.columns)} and {sorted(names)}"
    if len(mine) != len(theirs):
        return f"{len(mine)} rows and {len(theirs)}"
    bad = [(a, b) for a, b in zip(mine, theirs) if a != b]
    return f"{len(bad)} rows differ: {bad[:2]}" if bad else ""
