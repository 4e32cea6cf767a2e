"""Readers."""

from __future__ import annotations

from collections.abc import Iterable

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tidemark.functions.guards import require_columns, require_schema
from tidemark.sources.scratch import materialise


def read_table(
    spark: SparkSession,
    path: str,
    *,
    contract: T.StructType | None = None,
    required: Iterable[str] = (),
    view: str | None = None,
) -> DataFrame:
    """Parquet table, checked against a contract or a column list before any job starts."""
    df = spark.read.parquet(path)
    if contract is not None:
        require_schema(df, contract)
    require_columns(df, required)
    if view:
        df.createOrReplaceTempView(view)
    return df


def read_lines(spark: SparkSession, path: str, *, partitions: int | None = None) -> DataFrame:
    """One gzipped file of lines with its 1-based ``line_number``.

    A gzip file cannot be split, so one task reads it and the row counter of that task is the line number. Read
    several archives one by one and union them with their own keys. ``partitions`` spreads the parsing that follows.
    """
    if not path.endswith(".gz"):
        raise ValueError("line numbers need an unsplittable file")
    lines = spark.read.text(path).select((F.monotonically_increasing_id() + 1).alias("line_number"), "value")
    return lines.repartition(partitions, "line_number") if partitions else lines


def number_lines(spark: SparkSession, path: str, *, across_files: bool = False) -> DataFrame:
    """Lines of splittable text files with their 1-based ``line_number`` in their file, and ``file_path``.

    Every split of a file is read by its own task, as far as the file can be split. The rows are written once with their
    place in the split; the number of a line is that place plus the lines of the splits before it in the file, so only
    one row per split is put in order. With ``across_files`` the files count as one text cut up in the order of their names.
    """
    lines = spark.read.text(path).select(
        F.col("_metadata.file_path").alias("file_path"),
        F.col("_metadata.file_block_start").alias("_split"),
        F.monotonically_increasing_id().alias("_place"),
        "value",
    )
    stored = materialise(lines)
    split = ["file_path", "_split"]
    counted = stored.groupBy(*split).agg(F.min("_place").alias("_first"), F.count(F.lit(1)).alias("_lines"))
    order = Window.orderBy(*split) if across_files else Window.partitionBy("file_path").orderBy("_split")
    before = order.rowsBetween(Window.unboundedPreceding, -1)
    offsets = counted.select(*split, (F.coalesce(F.sum("_lines").over(before), F.lit(0)) - F.col("_first")).alias("_shift"))
    number = (F.col("_place") + F.col("_shift") + 1).alias("line_number")
    return stored.join(offsets, split).select("file_path", number, "value")


def footer_ranges(spark: SparkSession, path: str) -> DataFrame:
    """Minimum, maximum and non-null rows of the numeric columns of a Parquet table, from its file footers.

    The reader that answers aggregates from row-group statistics is switched on in a session of its own; no row is read.
    Columns of other types have no exact statistics there: see ``operators.quality.column_ranges``.
    """
    session = spark.newSession()
    for name, value in (("spark.sql.sources.useV1SourceList", ""), ("spark.sql.parquet.aggregatePushdown", "true")):
        session.conf.set(name, value)
    df = session.read.parquet(path)
    numbers = [f.name for f in df.schema.fields if isinstance(f.dataType, (T.IntegralType, T.FractionalType)) and not isinstance(f.dataType, T.DecimalType)]
    parts = [(F.min(c).alias(f"_lo_{c}"), F.max(c).alias(f"_hi_{c}"), F.count(c).alias(f"_n_{c}")) for c in numbers]
    wide = df.agg(*[p for part in parts for p in part])
    rows = F.array(
        *[
            F.struct(
                F.lit(c).alias("column_name"),
                F.col(f"_lo_{c}").cast("double").alias("minimum"),
                F.col(f"_hi_{c}").cast("double").alias("maximum"),
                F.col(f"_n_{c}").alias("non_null_rows"),
            )
            for c in numbers
        ]
    )
    return wide.select(F.explode(rows).alias("r")).select("r.*")


def spread(df: DataFrame, *columns: str) -> DataFrame:
    """Give every core work when the files offer fewer splits than there are cores.

    A table in a few large row groups would otherwise be parsed or joined by a few tasks. Input with enough splits,
    such as any large table, is returned as it is.
    """
    spark = df.sparkSession
    wanted = spark.sparkContext.defaultParallelism
    if df.rdd.getNumPartitions() >= wanted:
        return df
    return df.repartition(wanted, *columns)


def systematic_sample(df: DataFrame, stride: int, ordinal: str = "line_number") -> DataFrame:
    """Keep ordinals divisible by the stride; the same rows every time."""
    if stride < 1:
        raise ValueError("stride must be positive")
    return df.where(F.pmod(F.col(ordinal), F.lit(stride)) == 0)
