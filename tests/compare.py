"""Compare a query with its SQL on the same tables."""

from __future__ import annotations

import datetime
import math
from decimal import Decimal
from pathlib import Path

import duckdb


def plain(x):
    if isinstance(x, (float, Decimal)):
        return None if math.isnan(x) else round(float(x), 6)
    if isinstance(x, (list, tuple)):
        return tuple(map(plain, x))
    if isinstance(x, datetime.datetime):
        return x.replace(tzinfo=None).isoformat()
    return str(x) if isinstance(x, datetime.date) else x


def rows_of_sql(text: str, sf_dir: str):
    con = duckdb.connect()
    for p in Path(sf_dir).glob("*.parquet"):
        con.execute(f"CREATE VIEW {p.stem} AS SELECT * FROM read_parquet('{p}')")
    got = con.execute(text)
    names = [d[0] for d in got.description]
    order = sorted(range(len(names)), key=names.__getitem__)
    return [names[i] for i in order], sorted(([plain(r[i]) for i in order] for r in got.fetchall()), key=repr)


def rows_of_frame(df):
    names = sorted(df.columns)
    return names, sorted(([plain(r[n]) for n in names] for r in df.collect()), key=repr)


def difference(df, text: str, sf_dir: str) -> str:
    """What differs, or an empty string."""
    (a, left), (b, right) = rows_of_frame(df), rows_of_sql(text, sf_dir)
    if a != b:
        return f"columns {a} and {b}"
    if len(left) != len(right):
        return f"{len(left)} and {len(right)} rows"
    bad = [(x, y) for x, y in zip(left, right) if x != y]
    return f"{len(bad)} rows differ, first {bad[0]}" if bad else ""
