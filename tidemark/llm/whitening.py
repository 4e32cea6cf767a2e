"""Whitening of deployment feature vectors by an incremental eigendecomposition.

Each partition of the different vectors keeps one spectrum and adds its rows one by one (rank_one.Spectrum). Spectra are
merged in groups of a fixed number, eigenpair by eigenpair, until one is left. Its eigenvectors are then refined by a
distributed Rayleigh-Ritz step: every partition projects its centred rows on them and adds up the products, and the
small matrix of those sums is diagonalised. What travels is always width x width numbers, never rows.
"""

from __future__ import annotations

from collections.abc import Iterator
from decimal import Decimal

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tidemark.llm.rank_one import Spectrum
from tidemark.llm.settings import Batches, tidy
from tidemark.sources.scratch import materialise

_MERGED_AT_ONCE = 16
_STATE = "state_id long, n_rows long, spectrum binary"
_NULL_SHARE = 1e-13  # components with a smaller share of the variance have no direction of their own
_EXACT = "decimal(38,0)"


def whiten_deployments(deployments: DataFrame, *, components: int = 4, scale: float = 256.0) -> DataFrame:
    """Project deployment feature vectors on the leading components of their covariance, each scaled to variance 1.

    `deployments` needs token_address (any type) and features (array of numbers), such as the numeric columns of the
    extracted deployment features put in an array. Features become whole numbers floor(scale * x); components are those
    of the different whole vectors, each counted once, numbered from 1 by falling eigenvalue. The entry of a component
    with the largest absolute value is positive.

    Returns, for each row and component up to `components`: token_address, component, n (number of different vectors),
    deviation (exact sum over features of (n * x - sum)^2, null beyond 38 digits), whitened, explained (share of the
    variance) and identity_error (largest entry of the whitened vectors' covariance minus the identity).

    Rows whose vector is null or holds a null or non-finite number have no result. Shorter vectors are filled up with
    zeros. Repeated rows are all returned. A component without variance (equal vectors, fewer vectors than components)
    has null `whitened` and takes no part in identity_error, which is null if no component is left; `explained` is
    null if all vectors are equal. Null and repeated addresses are kept; extra columns are ignored; an empty table
    gives no rows. The driver holds width x width numbers.
    """
    spark = deployments.sparkSession
    usable = deployments.select("token_address", _whole(F.col("features"), scale).alias("x")).where(F.col("x").isNotNull())
    fit = materialise(usable.select("x").distinct())
    shape = fit.agg(F.count(F.lit(1)).alias("n"), F.max(F.size("x")).alias("width")).first()
    n, width = shape["n"], shape["width"] or 0
    out = T.StructType([usable.schema["token_address"], *_RESULT])
    if not width:
        return spark.createDataFrame([], out)
    sums = fit.agg(*[F.sum(F.coalesce(F.get("x", F.lit(i)), F.lit(0)).cast(_EXACT)).cast("string") for i in range(width)])
    total = [int(s) for s in sums.first()]
    mean = np.array([s / n for s in total])
    basis = _merged(fit, width).vectors
    values, vectors = _rayleigh_ritz(fit, mean, basis, n)
    count = min(components, width)
    shares = values / values.sum() if values.sum() > 0 else np.zeros(width)
    live = shares[:count] > _NULL_SHARE
    with np.errstate(all="ignore"):
        project = np.where(live, vectors[:, :count] / np.sqrt(np.where(live, values[:count], 1.0)), 0.0)
    error = _identity_error(fit, mean, project[:, live], n) if live.any() else None
    explained = shares[:count].tolist() if values.sum() > 0 else [None] * count

    def projected(batches: Batches) -> Batches:
        for batch in batches:
            x = _rows(batch.column(1), width)
            exact = pa.array(_deviations(x, total, n), pa.decimal128(38, 0))
            whitened = (x - mean) @ project
            for c in range(count):
                column = pa.array(whitened[:, c]) if live[c] else pa.nulls(len(x), pa.float64())
                rest = [_repeat(v, k, len(x)) for v, k in ((explained[c], pa.float64()), (error, pa.float64()))]
                yield pa.RecordBatch.from_arrays(
                    [batch.column(0), _repeat(c + 1, pa.int32(), len(x)), _repeat(n, pa.int64(), len(x)), exact, column, *rest],
                    names=out.names,
                )

    return usable.mapInArrow(tidy(projected), out)


_RESULT = [
    T.StructField("component", T.IntegerType()),
    T.StructField("n", T.LongType()),
    T.StructField("deviation", T.DecimalType(38, 0)),
    T.StructField("whitened", T.DoubleType()),
    T.StructField("explained", T.DoubleType()),
    T.StructField("identity_error", T.DoubleType()),
]


def _whole(features: Column, scale: float) -> Column:
    """Whole numbers of a vector; null if an entry is null or not finite."""
    value = F.transform(features, lambda x: x.cast("double"))
    bad = F.exists(value, lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == F.lit(float("inf"))))
    return F.when(~bad, F.transform(value, lambda x: F.floor(F.lit(scale) * x).cast("long")))


def _rows(column: pa.Array, width: int) -> np.ndarray:
    """Vectors as rows of a matrix, filled up with zeros."""
    lengths = np.diff(column.offsets.to_numpy())
    flat = column.flatten().to_numpy(zero_copy_only=False)
    if (lengths == width).all():
        return flat.reshape(len(column), width)
    out = np.zeros((len(column), width), np.int64)
    row = np.repeat(np.arange(len(column)), lengths)
    out[row, np.arange(len(flat)) - np.repeat(np.cumsum(lengths) - lengths, lengths)] = flat
    return out


def _repeat(value, kind: pa.DataType, times: int) -> pa.Array:
    return pa.nulls(times, kind) if value is None else pa.repeat(pa.scalar(value, kind), times)


def _deviations(x: np.ndarray, total: list[int], n: int) -> list[Decimal | None]:
    """Exact sums of (n * x - total)^2; in 64 bits where they are wide enough."""
    most = n * int(max(x.max(initial=0), -int(x.min(initial=0)))) + max(map(abs, total))
    if most * most * len(total) < 1 << 63:
        found = ((n * x - np.array(total)) ** 2).sum(axis=1).tolist()
    else:
        found = ((n * x.astype(object) - np.array(total, object)) ** 2).sum(axis=1).tolist()
    return [Decimal(v) if v < 10**38 else None for v in found]


def _merged(fit: DataFrame, width: int) -> Spectrum:
    """One spectrum of all vectors: one for each partition, then merged in groups."""

    def added(batches: Batches) -> Iterator[pa.RecordBatch]:
        found = Spectrum(width)
        for batch in batches:
            for row in _rows(batch.column(0), width).astype(np.float64):
                found.add_row(row)
        if found.count:
            yield _state(TaskContext.get().partitionId(), found)

    states = materialise(fit.mapInArrow(tidy(added), _STATE))
    span = _MERGED_AT_ONCE
    while states.count() > 1:
        group = F.floor(F.col("state_id") / span).alias("group_id")
        states = materialise(states.withColumn("group_id", group).groupBy("group_id").applyInArrow(_merge_group(width), _STATE))
        span *= _MERGED_AT_ONCE
    first = states.first()
    return Spectrum.load(first["n_rows"], bytes(first["spectrum"]), width)


def _state(number: int, spectrum: Spectrum) -> pa.RecordBatch:
    count, data = spectrum.dump()
    return pa.RecordBatch.from_arrays(
        [pa.array([number], pa.int64()), pa.array([count], pa.int64()), pa.array([data], pa.binary())],
        names=["state_id", "n_rows", "spectrum"],
    )


def _merge_group(width: int):
    def merged(group: pa.Table) -> pa.Table:
        found = None
        for row in sorted(group.to_pylist(), key=lambda r: r["state_id"]):
            other = Spectrum.load(row["n_rows"], row["spectrum"], width)
            if found is None:
                found = other
            else:
                found.merge(other)
        return pa.Table.from_batches([_state(group["state_id"][0].as_py(), found)])

    return merged


def _summed_products(fit: DataFrame, mean: np.ndarray, project: np.ndarray) -> np.ndarray:
    """Sum over the vectors of y y' and y, where y is the centred vector on the columns of `project`."""
    width, k = project.shape

    def products(batches: Batches) -> Iterator[pa.RecordBatch]:
        sums, line = np.zeros((k, k)), np.zeros(k)
        for batch in batches:
            y = (_rows(batch.column(0), width) - mean) @ project
            sums += y.T @ y
            line += y.sum(axis=0)
        cells = np.append(sums.ravel(), line)
        yield pa.RecordBatch.from_arrays(
            [pa.array(np.arange(len(cells))), pa.array(cells)], names=["cell", "amount"]
        )

    cells = fit.mapInArrow(tidy(products), "cell long, amount double").groupBy("cell").agg(F.sum("amount").alias("amount"))
    found = np.zeros(k * k + k)
    for row in cells.collect():  # one row for each cell of the small matrix
        found[row["cell"]] = row["amount"]
    return found


def _rayleigh_ritz(fit: DataFrame, mean: np.ndarray, basis: np.ndarray, n: int) -> tuple[np.ndarray, np.ndarray]:
    """Eigenpairs of the covariance on the span of `basis`, eigenvalues falling."""
    basis = np.linalg.qr(basis)[0]
    k = basis.shape[1]
    small = _summed_products(fit, mean, basis)[: k * k].reshape(k, k) / n
    values, turn = np.linalg.eigh((small + small.T) / 2)
    vectors = (basis @ turn)[:, ::-1]
    largest = vectors[np.abs(vectors).argmax(axis=0), np.arange(k)]
    return np.maximum(values[::-1], 0.0), vectors * np.where(largest < 0, -1.0, 1.0)


def _identity_error(fit: DataFrame, mean: np.ndarray, project: np.ndarray, n: int) -> float:
    k = project.shape[1]
    found = _summed_products(fit, mean, project) / n
    covariance = found[: k * k].reshape(k, k) - np.outer(found[k * k :], found[k * k :])
    return float(np.abs(covariance - np.eye(k)).max())
