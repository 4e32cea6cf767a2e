"""Numbered text, strict numbers, published versions and the result ledger, over the given tables."""

from __future__ import annotations

import uuid

from pyspark.sql import functions as F

from catalog import bindings as b
from catalog.registry import query
from tidemark.operators.cashflow import strict_numbers
from tidemark.session import checkpoint_dir
from tidemark.sources import sinks, tables


def _folder(spark, name):
    return f"{checkpoint_dir(spark).rstrip('/')}/{name}-{uuid.uuid4().hex}"


# Orders as lines of text in the order of their keys, cut into seven files, numbered as one text.
@query(
    "numbered_lines",
    "SELECT o_orderkey, row_number() OVER (ORDER BY o_orderkey) AS line_number, o_orderpriority FROM orders",
)
def numbered_lines(spark, sf_dir):
    orders = b.table(spark, sf_dir, "orders").select("o_orderkey", "o_orderpriority")
    path = _folder(spark, "lines")
    ordered = orders.repartitionByRange(7, "o_orderkey").sortWithinPartitions("o_orderkey")
    ordered.select(F.to_json(F.struct("o_orderkey", "o_orderpriority"))).write.text(path)
    read = F.from_json("value", "o_orderkey long, o_orderpriority string").alias("r")
    return tables.number_lines(spark, path, across_files=True).select("line_number", read).select("r.*", "line_number")


@query(
    "strict_cast",
    """SELECT o_orderpriority, count(o_totalprice) AS readable_rows, round(sum(o_totalprice), 2) AS total,
      max(o_orderkey)::DOUBLE AS largest_key FROM orders GROUP BY 1""",
)
def strict_cast(spark, sf_dir):
    texts = b.table(spark, sf_dir, "orders").select(
        "o_orderpriority", F.col("o_totalprice").cast("string"), F.col("o_orderkey").cast("string")
    )
    numbers = strict_numbers(texts, ["o_totalprice", "o_orderkey"])
    return numbers.groupBy("o_orderpriority").agg(
        F.count("o_totalprice").alias("readable_rows"),
        F.round(F.sum(F.col("o_totalprice").cast("decimal(38,2)")).cast("double"), 2).alias("total"),
        F.max("o_orderkey").alias("largest_key"),
    )


# Two versions of one dataset, read through the pointer and by name, and a ledger whose second run was recorded twice.
@query(
    "published_versions",
    """WITH versions AS (SELECT 'first' AS version, * FROM orders WHERE o_orderstatus = 'F' UNION ALL SELECT 'current', * FROM orders)
    SELECT version, o_orderpriority, count(*) AS rows, min(o_orderkey) AS first_key, max(o_orderkey) AS last_key,
      2 - (version = 'first')::INT AS run, 1::BIGINT AS recorded FROM versions GROUP BY version, o_orderpriority""",
)
def published_versions(spark, sf_dir):
    path, ledger = _folder(spark, "published"), _folder(spark, "ledger")
    orders = b.table(spark, sf_dir, "orders").select("o_orderkey", "o_orderpriority", "o_orderstatus")

    def record(version, name, run):
        rows = sinks.read_published(spark, path, version).groupBy("o_orderpriority").agg(
            F.count(F.lit(1)).alias("rows"), F.min("o_orderkey").alias("first_key"), F.max("o_orderkey").alias("last_key")
        )
        sinks.append_ledger(rows.withColumn("version", F.lit(name)), ledger, run)

    sinks.publish(orders.where("o_orderstatus = 'F'"), path, sort_within=["o_orderkey"])
    first = sinks.current_version(spark, path)
    sinks.publish(orders, path, sort_within=["o_orderkey"])
    record(first, "first", "1")
    record(None, "current", "2")
    record(None, "current", "2")
    written = spark.read.schema(
        "version string, o_orderpriority string, rows long, first_key long, last_key long, recorded_at_utc timestamp, run_id int"
    ).json(ledger)
    kept = written.groupBy("version", "o_orderpriority", "rows", "first_key", "last_key", F.col("run_id").alias("run"))
    return kept.agg(F.count("recorded_at_utc").alias("recorded"))
