"""Run registered queries next to their SQL and compare the rows."""

from __future__ import annotations

import math
import sys
import time

import duckdb

TABLES = (
    "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels "
    "conversations"
).split()


def connect(sf_dir: str) -> duckdb.DuckDBPyConnection:
    connection = duckdb.connect()
    for name in TABLES:
        connection.execute(f"CREATE VIEW {name} AS SELECT * FROM read_parquet('{sf_dir}/{name}.parquet')")
    return connection


def _plain(value):
    if value is None or (isinstance(value, float) and math.isnan(value)):
        return "null"
    if isinstance(value, bool):
        return str(value)
    if isinstance(value, float):
        return f"{value:.9g}" if value else "0"
    if isinstance(value, int):
        return str(value)
    return str(value)


def rows_of(columns, rows):
    order = sorted(range(len(columns)), key=lambda i: columns[i])
    return sorted(columns), sorted(tuple(_plain(r[i]) for i in order) for r in rows)


def compare(spark, connection, run, sql: str | None, sf_dir: str) -> tuple[str, int, float]:
    start = time.time()
    df = run(spark, sf_dir)
    actual = [tuple(r) for r in df.collect()]
    took = time.time() - start
    if sql is None:
        return "rows only", len(actual), took
    cursor = connection.execute(sql)
    names = [c[0] for c in cursor.description]
    wanted = cursor.fetchall()
    left, right = rows_of(df.columns, actual), rows_of(names, wanted)
    if left[0] != right[0]:
        return f"columns differ: {left[0]} / {right[0]}", len(actual), took
    if left[1] != right[1]:
        if len(left[1]) != len(right[1]):
            return f"row counts differ: {len(left[1])} / {len(right[1])}", len(actual), took
        bad = [(a, b) for a, b in zip(left[1], right[1]) if a != b]
        detail = [(c, x, y) for c, x, y in zip(left[0], *bad[0]) if x != y]
        return f"{len(bad)} rows differ, first: {detail}", len(actual), took
    return "ok", len(actual), took


if __name__ == "__main__":
    sys.path.insert(0, "/root/repo")
    from pyspark.sql import SparkSession

    import __spark_entry__ as entry

    sf_dir = sys.argv[1] if len(sys.argv) > 1 else "/root/testdata/sf0.01"
    wanted = sys.argv[2:]
    if "--pieces" in wanted:
        # Many small buckets and split hot keys, as large input has them.
        from tidemark.operators import sizing, skew

        wanted.remove("--pieces")
        sizing.ROWS_PER_BUCKET, sizing.ROWS_PER_PART, skew.ROWS_PER_TASK = 40, 160, 40
    spark = (
        SparkSession.builder.master("local[8]")
        .config("spark.sql.shuffle.partitions", "8")
        .config("spark.driver.memory", "12g")
        .config("spark.ui.enabled", "false")
        .getOrCreate()
    )
    spark.sparkContext.setLogLevel("ERROR")
    connection = connect(sf_dir)
    failed = 0
    oracles = entry.oracle_sql()
    for name, run in entry.queries().items():
        if wanted and name not in wanted:
            continue
        try:
            verdict, rows, took = compare(spark, connection, run, oracles.get(name), sf_dir)
        except Exception as error:  # noqa: BLE001
            verdict, rows, took = f"error: {str(error)[:1500]}", 0, 0.0
        if verdict not in ("ok", "rows only"):
            failed += 1
        print(f"{name:32s} rows={rows:<7d} {took:6.2f}s {verdict}", flush=True)
    print("failed:", failed)
