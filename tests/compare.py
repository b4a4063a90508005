"""Compare a Spark result with its SQL answer as bags of rows."""

from __future__ import annotations

import math
from collections import Counter

import duckdb

from vantry.sources.fixtures import DRIVER_TABLES


def open_duckdb(folder: str) -> duckdb.DuckDBPyConnection:
    con = duckdb.connect()
    for name in DRIVER_TABLES:
        con.execute(f"CREATE VIEW {name} AS SELECT * FROM '{folder}/{name}.parquet'")
    return con


def cell(value):
    if isinstance(value, float):
        return "nan" if math.isnan(value) else round(value, 6) + 0.0
    return value


KINDS = {"bigint": "BIGINT", "double": "DOUBLE", "string": "VARCHAR", "boolean": "BOOLEAN", "int": "INTEGER"}


def differences(df, con, sql: str) -> list[str]:
    cur = con.execute(sql)
    names = [d[0] for d in cur.description]
    kinds = dict(zip(names, [str(d[1]) for d in cur.description]))
    expected = cur.fetchall()
    out = []
    if sorted(df.columns) != sorted(names):
        return [f"columns {sorted(df.columns)} != {sorted(names)}"]
    for field in df.schema.fields:
        kind = KINDS.get(field.dataType.simpleString(), field.dataType.simpleString())
        if kind != kinds[field.name]:
            out.append(f"type of {field.name}: {kind} != {kinds[field.name]}")
    order = sorted(names)
    at = [names.index(n) for n in order]
    want = Counter(tuple(cell(r[i]) for i in at) for r in expected)
    got = Counter(tuple(cell(r[n]) for n in order) for r in df.collect())
    if want != got:
        extra, lost = list((got - want).items())[:3], list((want - got).items())[:3]
        out.append(f"rows {sum(got.values())} vs {sum(want.values())}; {order}; only spark {extra}; only sql {lost}")
    return out
