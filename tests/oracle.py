"""Holding a query against its DuckDB SQL."""

import datetime
import decimal
import math
from pathlib import Path


def connect(folder):
    import duckdb

    con = duckdb.connect()
    for p in sorted(Path(folder).glob("*.parquet")):
        con.execute(f"CREATE VIEW {p.stem} AS SELECT * FROM '{p}'")
    return con


def _plain(x):
    if isinstance(x, decimal.Decimal):
        return ("num", round(float(x), 6))
    if isinstance(x, bool) or x is None:
        return ("b", str(x))
    if isinstance(x, (int, float)):
        return ("num", "nan" if isinstance(x, float) and math.isnan(x) else round(float(x), 6))
    if isinstance(x, datetime.datetime):
        return ("t", x.isoformat())
    return ("s", str(x))


def normal(names, rows):
    order = sorted(range(len(names)), key=lambda i: names[i])
    return [names[i] for i in order], sorted(tuple(_plain(r[i]) for i in order) for r in rows)


def differ(con, df, sql):
    """None, or how the two results differ."""
    cur = con.execute(sql)
    want = normal([d[0] for d in cur.description], cur.fetchall())
    got = normal(df.columns, [tuple(r) for r in df.collect()])
    if got[0] != want[0]:
        return f"columns {got[0]} and {want[0]}"
    if len(got[1]) != len(want[1]):
        return f"{len(got[1])} and {len(want[1])} rows"
    return next((f"{a} and {b}" for a, b in zip(got[1], want[1], strict=True) if a != b), None)
