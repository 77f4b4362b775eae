"""Run a check on Spark and its SQL on DuckDB, and compare columns and rows regardless of order."""

from __future__ import annotations

import time

import duckdb

timings: dict[str, float] = {}

TABLES = ("region nation customer supplier part orders lineitem events documents embeddings pages "
          "benchmark labels conversations").split()


def duck(folder: str) -> duckdb.DuckDBPyConnection:
    connection = duckdb.connect()
    for name in TABLES:
        connection.execute(f"CREATE VIEW {name} AS SELECT * FROM '{folder}/{name}.parquet'")
    return connection


def _rows(columns, rows):
    order = sorted(range(len(columns)), key=lambda i: columns[i])
    return sorted((tuple(row[i] for i in order) for row in rows), key=repr)


def difference(spark, folder: str, check, connection) -> str | None:
    """None when both sides agree, else what differs."""
    started = time.time()
    result = check.run(spark, folder)
    got = _rows(result.columns, [tuple(row) for row in result.collect()])
    timings["spark"] = round(time.time() - started, 1)
    if check.sql is None:
        return None if got else "no rows"
    answer = connection.execute(check.sql)
    timings["both"] = round(time.time() - started, 1)
    names = [d[0] for d in answer.description]
    want = _rows(names, answer.fetchall())
    if sorted(names) != sorted(result.columns):
        return f"columns {sorted(result.columns)} and {sorted(names)}"
    if got == want:
        return None if got else "no rows on both sides"
    extra = [r for r in got if r not in set(want)][:2]
    missing = [r for r in want if r not in set(got)][:2]
    return f"{len(got)} rows and {len(want)} rows; only Spark {extra}; only SQL {missing}"
