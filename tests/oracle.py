"""Comparison of a query with its SQL on the same tables: top-level floats to 9 digits, all else (lists too) exactly."""

import datetime
import math
from pathlib import Path

import duckdb
import pyarrow as pa


def connect(folder: str):
    con = duckdb.connect()
    con.execute("SET timezone = 'UTC'")
    for p in sorted(Path(folder).iterdir()):
        con.execute(f"CREATE VIEW {p.stem} AS SELECT * FROM read_parquet('{p if p.is_file() else p / '*.parquet'}')")
    return con


def plain(v):
    if isinstance(v, float):
        return "nan" if v != v else repr(v)
    if isinstance(v, datetime.datetime):
        return v.replace(tzinfo=None).isoformat()
    if isinstance(v, list | tuple):
        return "[" + ",".join(map(plain, v)) + "]"
    if isinstance(v, dict):
        return str(sorted((k, plain(x)) for k, x in v.items()))
    return str(v)


def same(a, b) -> bool:
    if a is None or b is None:
        return a is b
    return (a != a and b != b) or a == b or math.isclose(a, b, rel_tol=1e-9, abs_tol=1e-9)


def rows_of(table, floats):
    names = sorted(table.column_names)
    exact = [c for c in names if c not in floats]
    rows = [(tuple(plain(r[c]) for c in exact), tuple(r[c] for c in floats)) for r in table.to_pylist()]
    return sorted(rows, key=lambda r: (r[0], tuple(-1e300 if x is None or x != x else round(x, 6) for x in r[1])))


def compare(spark, folder, con, query, text):
    a, b = query(spark, folder).toArrow(), con.sql(text).to_arrow_table()
    assert sorted(a.column_names) == sorted(b.column_names)
    floats = sorted(c for c in a.column_names if pa.types.is_floating(a.schema.field(c).type) or pa.types.is_floating(b.schema.field(c).type))
    x, y = rows_of(a, floats), rows_of(b, floats)
    assert [r[0] for r in x] == [r[0] for r in y]
    assert all(same(u, v) for p, q in zip(x, y, strict=True) for u, v in zip(p[1], q[1], strict=True))
