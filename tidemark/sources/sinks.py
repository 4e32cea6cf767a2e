"""Versioned publishing of what passed its checks, the result ledger, and the dataset manifest."""

from __future__ import annotations

import uuid
from collections.abc import Callable, Mapping, Sequence

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidemark.operators.quality import guarded


_POINTER = "CURRENT"  # a name that readers of text files don't skip


def publish(
    df: DataFrame,
    path: str,
    *,
    check: Callable[[DataFrame], None] | None = None,
    sort_within: Sequence[str] = (),
    partition_by: Sequence[str] = (),
) -> DataFrame:
    """Write a new version of a dataset, check what was written, then point to it.

    Versions are folders below ``path`` that are never changed; one small pointer file, replaced by an atomic rename,
    names the current one, so a reader sees the old or the new version and never none. Nothing is copied. A failed
    check leaves the pointer as it was and keeps the written version for inspection.
    """
    spark = df.sparkSession
    version = f"version-{uuid.uuid4().hex}"
    folder = f"{path.rstrip('/')}/{version}"
    rows = df.sortWithinPartitions(*sort_within) if sort_within else df
    writer = rows.write.option("compression", "zstd")
    if partition_by:
        writer = writer.partitionBy(*partition_by)
    writer.parquet(folder)
    if check is not None:
        check(spark.read.parquet(folder))
    _point_to(spark, path, version)
    return spark.read.parquet(folder)


def current_version(spark: SparkSession, path: str) -> str:
    """Name of the version that the pointer names."""
    return spark.read.text(f"{path.rstrip('/')}/{_POINTER}").first()[0]


def read_published(spark: SparkSession, path: str, version: str | None = None) -> DataFrame:
    """The current version of a published dataset, or a named one. The rows stay those of that version."""
    return spark.read.parquet(f"{path.rstrip('/')}/{version or current_version(spark, path)}")


def drop_versions(spark: SparkSession, path: str, keep: int = 1) -> None:
    """Delete versions other than the current one and the latest ``keep - 1`` others; readers pinned to them must be done."""
    jvm, conf = spark._jvm, spark._jsc.hadoopConfiguration()
    root = jvm.org.apache.hadoop.fs.Path(path)
    fs = root.getFileSystem(conf)
    current = current_version(spark, path)
    others = [s for s in fs.listStatus(root) if s.getPath().getName().startswith("version-") and s.getPath().getName() != current]
    for status in sorted(others, key=lambda s: -s.getModificationTime())[max(0, keep - 1) :]:
        fs.delete(status.getPath(), True)


def _point_to(spark: SparkSession, path: str, version: str) -> None:
    """Replace the pointer file in one rename of the file system."""
    jvm, conf = spark._jvm, spark._jsc.hadoopConfiguration()
    target = jvm.org.apache.hadoop.fs.Path(f"{path.rstrip('/')}/{_POINTER}")
    fresh = jvm.org.apache.hadoop.fs.Path(f"{path.rstrip('/')}/{_POINTER}-{version}")
    fs = target.getFileSystem(conf)
    out = fs.create(fresh, True)
    out.write(bytearray(version.encode()))
    out.close()
    context = jvm.org.apache.hadoop.fs.FileContext.getFileContext(fs.getUri(), conf)
    rename = jvm.org.apache.hadoop.fs.Options.Rename
    options = spark.sparkContext._gateway.new_array(rename, 1)
    options[0] = rename.OVERWRITE
    context.rename(context.makeQualified(fresh), context.makeQualified(target), options)


def append_ledger(rows: DataFrame, path: str, run_id: str) -> None:
    """Put the result rows of one run into a JSON ledger, with the time they were recorded.

    A run has a folder of its own, so recording the same run again replaces its rows and adds none.
    """
    stamped = rows.withColumn("recorded_at_utc", F.current_timestamp())
    stamped.write.mode("overwrite").json(f"{path.rstrip('/')}/run_id={run_id}")


def manifest(df: DataFrame, key: str, violations: Mapping[str, "F.Column"] | None = None) -> DataFrame:
    """One row that identifies a dataset: rows, distinct keys, order-free fingerprints and violation counts."""
    fingerprint = F.xxhash64(*[F.to_json(F.struct(c)) if _is_variable(df, c) else F.col(c) for c in df.columns])
    distinct = df.groupBy(key).agg(
        F.count(F.lit(1)).alias("_n"),
        F.bit_xor(fingerprint).alias("_x"),
        F.sum(fingerprint.cast("decimal(38,0)")).alias("_s"),
        *[F.count_if(F.coalesce(rule, F.lit(False))).alias(f"_v_{n}") for n, rule in (violations or {}).items()],
    )
    return distinct.agg(
        F.coalesce(F.sum("_n"), F.lit(0)).alias("rows"),
        F.count(key).alias("unique_keys"),
        F.bit_xor("_x").alias("fingerprint_xor"),
        F.sum("_s").cast("string").alias("fingerprint_sum"),
        *[F.coalesce(F.sum(f"_v_{n}"), F.lit(0)).alias(n) for n in (violations or {})],
    )


def range_fingerprints(df: DataFrame, key: str, digits: int = 1) -> DataFrame:
    """Rows, keys and an order-free fingerprint for each range of the hashed key.

    A row's fingerprint is the md5 of its columns' text, folded to 60 bits and added up exactly, so other engines can
    compute it as well. Null columns are left out of the text. The range is named by the first hex digits of the
    md5 of the key.
    """
    text = F.concat_ws("|", *[F.col(c).cast("string") for c in df.columns])
    part = F.conv(F.substring(F.md5(text.cast("binary")), 1, 15), 16, 10).cast("decimal(38,0)")
    name = F.substring(F.md5(F.col(key).cast("string").cast("binary")), 1, digits)
    per_key = df.groupBy(name.alias("key_range"), F.col(key).alias("_k")).agg(
        F.count(F.lit(1)).alias("_n"), F.sum(part).alias("_f")
    )
    return per_key.groupBy("key_range").agg(
        F.sum("_n").alias("rows"), F.count("_k").alias("unique_keys"), F.sum("_f").cast("string").alias("fingerprint")
    )


def compare_ranges(first: DataFrame, second: DataFrame, *, key: str, digits: int = 1) -> DataFrame:
    """The first run's key ranges, and whether the second run repeats each of them."""
    names = ["rows", "unique_keys", "fingerprint"]
    other = range_fingerprints(second, key, digits).withColumnsRenamed({n: f"_{n}" for n in names})
    same = F.lit(True)
    for n in names:
        same = same & F.col(n).eqNullSafe(F.col(f"_{n}"))
    joined = range_fingerprints(first, key, digits).join(other, "key_range", "full")
    return joined.select("key_range", *names, same.alias("repeated"))


def verified(df: DataFrame, expected: DataFrame, key: str) -> DataFrame:
    """The rows as they are; the plan that reads them stops when they are not those of the one-row manifest."""
    names = ["rows", "unique_keys", "fingerprint_xor", "fingerprint_sum"]
    wanted = expected.select(*[F.col(n).alias(f"_{n}") for n in names])
    differs = [(~F.col(n).eqNullSafe(F.col(f"_{n}"))).cast("int").alias(f"{n}_differs") for n in names]
    return guarded(df, manifest(df, key).crossJoin(wanted).select(*differs), "dataset manifest")


def same_content(left: DataFrame, right: DataFrame, key: str) -> bool:
    """Whether two results hold the same rows; used to compare repeated runs."""
    return manifest(left, key).first() == manifest(right, key).first()


def _is_variable(df: DataFrame, name: str) -> bool:
    return df.schema[name].dataType.typeName() in ("map", "variant")
