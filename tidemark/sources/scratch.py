"""Intermediate tables in the shared checkpoint folder."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame

from tidemark.session import checkpoint_dir


def materialise(df: DataFrame) -> DataFrame:
    """Write rows that several later steps read, and read them back.

    The table sits in the shared checkpoint folder, so a lost executor costs no recomputation of what came before.
    Unlike a row checkpoint it is columnar, so each reader scans only its columns, and its size is known exactly.
    """
    path = f"{checkpoint_dir(df.sparkSession).rstrip('/')}/table-{uuid.uuid4().hex}"
    df.write.option("compression", "zstd").parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)
