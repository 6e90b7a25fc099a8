"""Run a registered query and its SQL twin and compare the results."""

from __future__ import annotations

import math

import duckdb

TABLES = ["region", "nation", "customer", "supplier", "part", "orders", "lineitem", "events",
          "documents", "embeddings", "pages", "benchmark", "labels", "conversations"]

# Spark type -> accepted twin types.
TYPES = {
    "bigint": {"BIGINT"}, "int": {"INTEGER"}, "double": {"DOUBLE"}, "float": {"FLOAT"},
    "string": {"VARCHAR"}, "boolean": {"BOOLEAN"}, "date": {"DATE"},
}


def connect(folder: str) -> duckdb.DuckDBPyConnection:
    con = duckdb.connect()
    con.execute("SET TimeZone = 'UTC'")
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{folder}/{t}.parquet'")
    return con


def _plain(value):
    if value is None or (isinstance(value, float) and math.isnan(value)):
        return "NULL"
    if isinstance(value, float):
        return repr(0.0 if value == 0 else value)
    return str(value)


def compare(spark, con, run, sql: str, folder: str) -> list[str]:
    """Differences between a query and its twin; empty when they agree."""
    df = run(spark, folder)
    names = sorted(df.columns)
    got = sorted(tuple(_plain(r[n]) for n in names) for r in df.collect())
    rel = con.sql(sql)
    problems = []
    if sorted(rel.columns) != names:
        return [f"columns {names} != {sorted(rel.columns)}"]
    spark_types = dict(df.dtypes)
    twin_types = dict(zip(rel.columns, [str(x) for x in rel.types]))
    for n in names:
        if twin_types[n] not in TYPES.get(spark_types[n], set()):
            problems.append(f"type of {n}: {spark_types[n]} / {twin_types[n]}")
    at = [rel.columns.index(n) for n in names]
    want = sorted(tuple(_plain(r[i]) for i in at) for r in rel.fetchall())
    if len(got) != len(want):
        problems.append(f"{len(got)} rows, twin has {len(want)}")
    if got != want:
        have, wanted = set(got), set(want)
        extra = [r for r in got if r not in wanted]
        missing = [r for r in want if r not in have]
        key = next((names.index(k) for k in ("event_id", "id", "uid") if k in names), None)
        if key is not None and len(extra) == len(missing):
            other = {r[key]: r for r in missing}
            pairs = [(r, other.get(r[key])) for r in extra[:3]]
            cells = [(names[i], x, y[i]) for r, y in pairs if y for i, x in enumerate(r) if x != y[i]]
            problems.append(f"{len(extra)} rows differ: {cells[:12]}")
        else:
            problems.append(f"values differ: {names} spark {extra[:3]} twin {missing[:3]}")
    if not got:
        problems.append("no rows")
    return problems
