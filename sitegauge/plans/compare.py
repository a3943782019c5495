"""Side-by-side check of a registered query against its DuckDB oracle."""

from __future__ import annotations

import math

from pyspark.sql import SparkSession

from sitegauge.plans.fixtures import BASE
from sitegauge.plans.registry import Query


def _plain(value: object) -> str:
    if value is None or (isinstance(value, float) and math.isnan(value)):
        return "NULL"
    if isinstance(value, bool):
        return str(value)
    if isinstance(value, (int, float)) or type(value).__name__ == "Decimal":
        return repr(float(value) + 0.0)
    return str(value)


def duck(sf_dir: str):
    import duckdb
    con = duckdb.connect()
    for table in BASE:
        con.execute(f"CREATE VIEW {table} AS SELECT * FROM '{sf_dir}/{table}.parquet'")
    return con


def _rows(names: list[str], rows) -> list[tuple]:
    order = sorted(range(len(names)), key=lambda i: names[i])
    return sorted(tuple(_plain(r[i]) for i in order) for r in rows)


def compare(spark: SparkSession, con, q: Query, sf_dir: str) -> str | None:
    """None when both agree, else a short description of the difference."""
    df = q.run(spark, sf_dir)
    got = _rows(df.columns, df.collect())
    if q.sql is None:
        return None
    res = con.execute(q.sql)
    names = [c[0] for c in res.description]
    want = _rows(names, res.fetchall())
    if sorted(df.columns) != sorted(names):
        return f"columns {sorted(df.columns)} != {sorted(names)}"
    if len(got) != len(want):
        return f"{len(got)} rows, expected {len(want)}: e.g. {list(set(got) ^ set(want))[:4]}"
    diff = [(a, b) for a, b in zip(got, want) if a != b]
    return f"{len(diff)} of {len(got)} rows differ, e.g. {diff[:3]}" if diff else None
