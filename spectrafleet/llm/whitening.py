"""Embedding whitening by a randomised range finder.

A random basis of a few more columns than components are wanted is multiplied by the covariance in passes over all
centred rows. After each pass Rayleigh-Ritz in the basis gives components and their residuals. Where these don't fall to
rounding error within the passes, the basis is expanded to the full dimension, and one more pass settles it.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ._shared import materialize, spare

#: Components that are returned.
COMPONENTS = 4
#: Further columns of the random basis.
OVERSAMPLING = 12
#: Passes over the rows before the basis is expanded.
POWER_PASSES = 4
#: A component's residual over the largest eigenvalue, at most.
TOLERANCE = 1e-13
#: Entries are counted in this part of one.
STEPS = 256
#: Partial sums that one task adds up.
FAN_IN = 64
#: Components of less than this share of the trace have no direction.
LEAST_SHARE = 1e-12


@dataclass
class Whitening:
    """n distinct rows with sums S; components (one a row), their eigenvalues, and the trace of the covariance."""

    n: int
    sums: np.ndarray
    components: np.ndarray
    values: np.ndarray
    trace: float
    identity_error: float
    passes: int


def stepped(vectors: DataFrame, column: str = "embedding") -> DataFrame:
    """vectors without those that are null or hold a null or non-finite entry, and with x, their entries in whole steps.

    A vector shorter than the longest counts as having zeros at its end. Entries beyond the range of a long are its ends.
    """
    (x,) = spare(vectors, "x")
    c = F.col(column)
    finite = F.forall(c, lambda e: e.isNotNull() & ~F.isnan(e.cast("double")) & (F.abs(e.cast("double")) < float("inf")))
    rows = vectors.filter(c.isNotNull() & F.coalesce(finite, F.lit(False)))
    longest = rows.agg(F.max(F.size(c))).first()[0] or 0
    entries = F.transform(c, lambda e: F.floor(e.cast("double") * STEPS).cast("long"))
    padded = F.when(F.size(c) == longest, entries).otherwise(F.concat(entries, F.array_repeat(F.lit(0).cast("long"), F.lit(longest) - F.size(c))))
    return rows.withColumn(x, padded)


def _matrix(column: pa.ListArray) -> np.ndarray:
    flat = column.flatten().to_numpy(zero_copy_only=False)
    return flat.reshape(len(column), -1)


def _summed(spark: SparkSession, rows: DataFrame, part: Callable[[np.ndarray], np.ndarray], shape: tuple[int, ...], dtype=np.float64) -> np.ndarray:
    """The sum of part(x) over all rows (one column of arrays), a batch at a time.

    Each task adds up its own; groups of FAN_IN tasks add up theirs, so that the driver gets one array for each group.
    """

    def own(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(shape, dtype)
        for batch in batches:
            if batch.num_rows:
                total += part(_matrix(batch.column(0)))
        yield pa.RecordBatch.from_arrays([pa.array([total.tobytes()], pa.binary())], ["total"])

    def added(group: pd.DataFrame) -> pd.DataFrame:
        return pd.DataFrame({"total": [sum(np.frombuffer(t, dtype) for t in group["total"]).tobytes()]})

    parts = rows.mapInArrow(own, "total binary").withColumn("group", F.expr(f"cast(spark_partition_id() div {FAN_IN} as int)"))
    if rows.rdd.getNumPartitions() > FAN_IN:
        parts = parts.groupBy("group").applyInPandas(added, "total binary")
    out = np.zeros(shape, dtype)
    for row in parts.select("total").collect():
        out += np.frombuffer(row["total"], dtype).reshape(shape)
    return out


def _orthonormal(columns: np.ndarray) -> np.ndarray:
    return np.linalg.qr(columns)[0]


def fit(rows: DataFrame, components: int = COMPONENTS, seed: int = 0) -> Whitening | None:
    """Learn the whitening from each distinct x of rows (a column x of arrays of long, all of one length) once; None without rows.

    Components of no variance are left out. The covariance is never summed from uncentred products. Besides the basis
    (dimension x columns) and one such matrix for each FAN_IN tasks, nothing reaches the driver.
    """
    spark = rows.sparkSession
    distinct = materialize(rows.select("x").distinct(), "fit-list")
    counted = distinct.agg(F.count(F.lit(1)), F.max(F.size("x"))).first()
    n, d = counted[0], counted[1] or 0
    if not n or not d:
        return None
    sums = _summed(spark, distinct, lambda x: x.sum(0), (d,), np.int64)
    mean = sums / n

    def covariance_times(basis: np.ndarray) -> np.ndarray:
        def part(x: np.ndarray) -> np.ndarray:
            centred = x - mean
            return centred.T @ (centred @ basis)

        return _summed(spark, distinct, part, basis.shape) / n

    def variances(x: np.ndarray) -> np.ndarray:
        return ((x - mean) ** 2).sum(0)

    trace = float(_summed(spark, distinct, variances, (d,)).sum() / n)
    wanted, passes = min(components, d), 0
    basis = _orthonormal(np.random.default_rng(seed).standard_normal((d, min(d, wanted + OVERSAMPLING))))
    while True:
        product = covariance_times(basis)
        passes += 1
        small = basis.T @ product
        values, vectors = np.linalg.eigh((small + small.T) / 2)
        values, vectors = values[::-1][:wanted], vectors[:, ::-1][:, :wanted]
        residual = np.linalg.norm(product @ vectors - basis @ vectors * values, axis=0)
        if basis.shape[1] == d or (residual <= TOLERANCE * max(values[0], 0)).all():
            break
        if passes < POWER_PASSES:
            basis = _orthonormal(product)
        else:
            more = np.random.default_rng(seed + 1).standard_normal((d, d - basis.shape[1]))
            basis = _orthonormal(np.hstack([_orthonormal(product), more]))
    found = (basis @ vectors).T
    real = values > LEAST_SHARE * trace
    found, values = found[real], values[real]
    found /= np.linalg.norm(found, axis=1, keepdims=True)

    def whitened_squares(x: np.ndarray) -> np.ndarray:
        z = (x - mean) @ found.T / np.sqrt(values)
        return z.T @ z

    k = len(values)
    error = float(np.abs(_summed(spark, distinct, whitened_squares, (k, k)) / n - np.eye(k)).max(initial=0))
    return Whitening(n, sums, found, values, trace, error, passes)


def apply(rows: DataFrame, model: Whitening, keep: list[str]) -> DataFrame:
    """A row for each row (keep, x) and component: keep, component, n, deviation, whitened, explained, identity_error.

    deviation is exact; one beyond the range of a long stops the job.
    """
    n, sums, mean = model.n, model.sums, model.sums / model.n
    across = model.components.T / np.sqrt(model.values)
    k, explained = len(model.values), model.values / model.trace

    def apply_batch(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if not batch.num_rows or not k:
                continue
            x = _matrix(batch.column("x"))
            far = float(np.abs(x).max()) * n + float(np.abs(sums).max())
            if far * far * x.shape[1] < 2**63:
                deviation = ((n * x - sums) ** 2).sum(1).tolist()
            else:
                deviation = [sum((n * int(e) - int(s)) ** 2 for e, s in zip(r, sums, strict=True)) for r in x]
            rows, at = len(x), np.repeat(np.arange(len(x)), k)
            whole = [batch.column(c).take(pa.array(at)) for c in keep]
            own = [np.tile(np.arange(1, k + 1, dtype=np.int32), rows), np.full(rows * k, n, np.int64)]
            rest = [((x - mean) @ across).ravel(), np.tile(explained, rows), np.full(rows * k, model.identity_error)]
            columns = [*whole, *map(pa.array, own), pa.array(deviation, pa.int64()).take(pa.array(at)), *map(pa.array, rest)]
            yield pa.RecordBatch.from_arrays(columns, [*keep, "component", "n", "deviation", "whitened", "explained", "identity_error"])

    kept = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in rows.select(*keep).schema)
    schema = f"{kept}, component int, n long, deviation long, whitened double, explained double, identity_error double"
    return rows.select(*keep, "x").mapInArrow(apply_batch, schema)


def whiten(vectors: DataFrame, components: int = COMPONENTS) -> DataFrame:
    """vec_id, component, n, deviation, whitened, explained, identity_error of vectors (vec_id, embedding, others).

    A null vector, and one with a null or non-finite entry, goes; a shorter one counts as having zeros at its end.
    Repeated rows each have their results and count once in the fit; so do equal vectors of other ids. A null vec_id
    stays. No rows, or no variance, give no rows. Other columns are not read.
    """
    rows = stepped(vectors.select("vec_id", "embedding")).select("vec_id", "x")
    model = fit(rows, components)
    if model is None:
        schema = "vec_id long, component int, n long, deviation long, whitened double, explained double, identity_error double"
        return rows.sparkSession.createDataFrame([], schema)
    return apply(rows, model, ["vec_id"])
