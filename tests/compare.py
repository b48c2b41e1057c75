"""A query's rows against what DuckDB makes of its SQL on the same tables."""

from __future__ import annotations

import math
from collections import Counter
from pathlib import Path

import duckdb

TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations"


def plain(v):
    """Values that both engines write alike: floats by nine digits, no trailing zone."""
    if v is None or isinstance(v, (bool, str, bytes)):
        return v
    if isinstance(v, (list, tuple)):
        return tuple(plain(x) for x in v)
    if hasattr(v, "isoformat"):
        return v.isoformat()[:26]
    try:
        f = float(v)
    except (TypeError, ValueError):
        return str(v)
    return "nan" if math.isnan(f) else 0.0 if f == 0 else float(f"{f:.9g}")


def bag(names, rows) -> Counter:
    order = sorted(range(len(names)), key=lambda i: names[i])
    return Counter(tuple(plain(r[i]) for i in order) for r in rows)


def by_spark(df) -> tuple[list[str], Counter]:
    return sorted(df.columns), bag(df.columns, df.collect())


def by_duckdb(sql: str, sf_dir: str) -> tuple[list[str], Counter]:
    con = duckdb.connect()
    con.execute("SET TimeZone = 'UTC'")
    for name in TABLES.split():
        if Path(sf_dir, f"{name}.parquet").exists():
            con.execute(f"CREATE VIEW {name} AS SELECT * FROM read_parquet('{sf_dir}/{name}.parquet')")
    found = con.execute(sql)
    names = [d[0] for d in found.description]
    return sorted(names), bag(names, found.fetchall())


def same(df, sql: str, sf_dir: str) -> None:
    names, rows = by_spark(df)
    names_2, rows_2 = by_duckdb(sql, sf_dir)
    assert names == names_2
    left, right = rows - rows_2, rows_2 - rows
    assert not left and not right, f"{sum(left.values())} and {sum(right.values())} of {sum(rows.values())} rows differ: {list(left)[:2]} {list(right)[:2]}"
