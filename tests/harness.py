"""Run a query on Spark and its oracle on DuckDB and compare names, types, rows and values."""

from __future__ import annotations

import datetime as dt
import decimal

import duckdb

TABLES = (
    "region nation customer supplier part orders lineitem events documents embeddings pages "
    "benchmark labels conversations"
).split()
TYPE_NAMES = {
    "BIGINT": "bigint", "INTEGER": "int", "DOUBLE": "double", "VARCHAR": "string",
    "DATE": "date", "TIMESTAMP": "timestamp_ntz", "BOOLEAN": "boolean",
}


def connect(root: str) -> duckdb.DuckDBPyConnection:
    con = duckdb.connect()
    for name in TABLES:
        con.execute(f"CREATE VIEW {name} AS SELECT * FROM '{root}/{name}.parquet'")
    return con


def _plain(value):
    if isinstance(value, float):
        return "nan" if value != value else repr(value)
    if isinstance(value, decimal.Decimal):
        return repr(float(value))
    if isinstance(value, (dt.date, dt.datetime)):
        return value.isoformat()
    return repr(value)


def canonical(rows, names: list[str]) -> list[tuple]:
    order = sorted(range(len(names)), key=lambda i: names[i])
    return sorted(tuple(_plain(r[i]) for i in order) for r in rows)


def compare(spark_df, con, sql: str) -> list[str]:
    """Differences as text; empty when both sides agree exactly."""
    problems = []
    rel = con.sql(sql)
    o_names, o_types = list(rel.columns), [str(t) for t in rel.types]
    s_types = {f.name: f.dataType.simpleString() for f in spark_df.schema}
    if sorted(o_names) != sorted(s_types):
        return [f"columns: spark-only {sorted(set(s_types) - set(o_names))}, "
                f"oracle-only {sorted(set(o_names) - set(s_types))}"]
    for name, kind in zip(o_names, o_types):
        if TYPE_NAMES.get(kind, kind) != s_types[name]:
            problems.append(f"type of {name}: spark {s_types[name]}, oracle {kind}")
    ours = canonical(spark_df.collect(), spark_df.columns)
    theirs = canonical(rel.fetchall(), o_names)
    if len(ours) != len(theirs):
        problems.append(f"rows: spark {len(ours)}, oracle {len(theirs)}")
    if not ours:
        problems.append("no rows")
    if ours != theirs:
        a, b = set(ours), set(theirs)
        diff = sorted(a - b)[:2], sorted(b - a)[:2]
        if diff[0] and diff[1]:
            cols = sorted(o_names)
            x, y = diff[0][0], diff[1][0]
            problems.append("values: " + "; ".join(
                f"{c}: {p} <> {q}" for c, p, q in zip(cols, x, y) if p != q))
        problems.append(f"only spark ({len(a - b)}): {diff[0]}"[:700])
        problems.append(f"only oracle ({len(b - a)}): {diff[1]}"[:700])
    return problems
