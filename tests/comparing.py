"""Order-insensitive comparison of a Spark result with a DuckDB result."""

from __future__ import annotations

import datetime
import math

TABLES = ["region", "nation", "customer", "supplier", "part", "orders", "lineitem", "events"]


def _plain(value):
    if value is None:
        return None
    if isinstance(value, bool):
        return int(value)
    if isinstance(value, datetime.datetime):
        return value.isoformat()
    if isinstance(value, datetime.date):
        return value.isoformat()
    if isinstance(value, float):
        return None if math.isnan(value) else float(value) + 0.0
    if isinstance(value, str):
        return value
    return float(value)


def rows_of(columns: list[str], rows) -> list[tuple]:
    order = sorted(range(len(columns)), key=lambda k: columns[k])
    plain = [tuple(_plain(r[k]) for k in order) for r in rows]
    return sorted(plain, key=lambda r: tuple((v is not None, str(type(v)), v) for v in r))


def duck(sf_dir: str):
    import duckdb

    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"create view {t} as select * from '{sf_dir}/{t}.parquet'")
    return con


def differences(spark_df, con, sql: str, show: int = 3) -> list[str]:
    cur = con.execute(sql)
    names = [d[0] for d in cur.description]
    right_rows = cur.fetchall()
    problems = []
    if sorted(names) != sorted(spark_df.columns):
        extra = set(names) ^ set(spark_df.columns)
        return [f"columns differ: {sorted(extra)}"]
    left = rows_of(spark_df.columns, spark_df.collect())
    right = rows_of(names, right_rows)
    if len(left) != len(right):
        return [f"rows: spark {len(left)} sql {len(right)}"]
    ordered = sorted(names)
    for a, b in zip(left, right):
        if a != b:
            off = [(ordered[k], a[k], b[k]) for k in range(len(a)) if a[k] != b[k]]
            problems.append(str(off[:4]))
            if len(problems) >= show:
                break
    return problems


def same(left, right) -> bool:
    """Two Spark frames with equal columns and rows; doubles to 9 digits."""
    def rows(df):
        plain = rows_of(df.columns, df.collect())
        return sorted(
            (tuple(round(v, 9) if isinstance(v, float) else v for v in r) for r in plain),
            key=lambda r: tuple((v is not None, str(type(v)), v) for v in r))

    assert sorted(left.columns) == sorted(right.columns)
    a, b = rows(left), rows(right)
    assert len(a) == len(b)
    assert a == b
    return True
