"""Configuration statistics, trust checks, and calibration curves."""

from __future__ import annotations

import math
import tempfile
import uuid
from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, DoubleType, StructField, StructType

from ..functions.spectra import array_mean, calibrate_power, db_to_linear, linear_to_db, propagated_variance

RIDGE, LEVEL = 1e-6, 0.99
BROADCAST_BYTES = 32 << 20


def corpus_stats(rows: DataFrame, variance_min: float = 1e-18, ratio: float = 1e-3, exact: bool = False) -> DataFrame:
    """One row: variance and 5 % quantile of all powers, the variance floor, and the frequency range.

    The quantile is within a ten-thousandth of its rank, or exact by counting value ranges, at three more passes.
    """
    if exact:
        from .quantiles import exact_quantile

        low = exact_quantile(rows.select(F.lit(0).alias("one"), F.explode(db_to_linear(F.col("pxx_db"))).alias("value")), ["one"], 0.05, "q05").select("q05")
        rest = corpus_stats(rows, variance_min, ratio)
        return rest.drop("q05").join(F.broadcast(low)).select(*rest.columns)  # single rows
    values = rows.select("start_freq_hz", "end_freq_hz", F.explode(db_to_linear(F.col("pxx_db"))).alias("p"))
    low = F.percentile_approx("p", 0.05, 10_000)
    var = F.var_pop("p")
    return values.agg(var.alias("variance"), low.alias("q05"), F.greatest(F.lit(variance_min), ratio * var).alias("variance_floor"), F.min("start_freq_hz").alias("freq_min_hz"), F.max("end_freq_hz").alias("freq_max_hz"))


def config_stats(configs: DataFrame, features: tuple[str, ...]) -> DataFrame:
    """feature, mean, scale, least, greatest of each feature; a deviation of 1e-12 or less counts as 1."""
    aggs = []
    for f in features:
        std = F.stddev_pop(f)
        aggs.append(F.struct(F.lit(f).alias("feature"), F.avg(f).alias("mean"), F.when(std <= 1e-12, 1.0).otherwise(std).alias("scale"), F.min(f).alias("least"), F.max(f).alias("greatest")))
    return configs.agg(F.array(*aggs).alias("a")).select(F.inline("a"))


def chi2_tail(x: float, dof: int) -> float:
    """Upper tail of the chi-square distribution for whole degrees of freedom."""
    h = x / 2
    if dof % 2 == 0:
        term = total = math.exp(-h)
        for k in range(1, dof // 2):
            term *= h / k
            total += term
        return total
    total, term = math.erfc(math.sqrt(h)), math.exp(-h) * math.sqrt(h / math.pi) * 2
    for k in range(1, dof, 2):
        total += term
        term *= x / (k + 2)
    return total


def chi2_quantile(p: float, dof: int) -> float:
    lo, hi = 0.0, 1000.0
    for _ in range(200):
        mid = (lo + hi) / 2
        lo, hi = (mid, hi) if chi2_tail(mid, dof) > 1 - p else (lo, mid)
    return (lo + hi) / 2


@dataclass
class Geometry:
    """What a model knows of its training configurations: a handful of numbers for each feature."""

    features: tuple[str, ...]
    mean: np.ndarray
    scale: np.ndarray
    least: np.ndarray
    greatest: np.ndarray
    precision: np.ndarray
    rank: int
    threshold: float = field(default=0.0)


def config_geometry(configs: DataFrame, features: tuple[str, ...]) -> Geometry:
    """Standardisation, envelope and Mahalanobis geometry of training configurations (one aggregate row to the driver)."""
    stats = {r["feature"]: r for r in config_stats(configs, features).collect()}
    mean, scale, least, greatest = (np.array([stats[f][k] for f in features]) for k in ("mean", "scale", "least", "greatest"))
    d = len(features)
    z = [(F.col(f) - float(m)) / float(s) for f, m, s in zip(features, mean, scale, strict=True)]
    row = configs.agg(F.count(F.lit(1)).alias("n"), *[F.covar_samp(z[i], z[j]).alias(f"c{i}_{j}") for i in range(d) for j in range(i, d)]).first()
    cov = np.zeros((d, d))
    for i in range(d):
        for j in range(i, d):
            cov[i, j] = cov[j, i] = row[f"c{i}_{j}"] or 0.0
    if row["n"] < 2:
        precision, rank = np.eye(d), d
    else:
        rank = int(np.linalg.matrix_rank(cov))
        precision = np.linalg.pinv(cov + RIDGE * max(np.trace(cov) / d, 1.0) * np.eye(d))
    out = Geometry(features, mean, scale, least, greatest, precision, max(rank, 1))
    far = configs.agg(F.max(mahalanobis(out))).first()[0] or 0.0
    out.threshold = max(far, math.sqrt(chi2_quantile(LEVEL, out.rank)))
    return out


def standardized(g: Geometry) -> list[Column]:
    return [(F.col(f) - float(m)) / float(s) for f, m, s in zip(g.features, g.mean, g.scale, strict=True)]


def mahalanobis(g: Geometry) -> Column:
    z = standardized(g)
    total = F.lit(0.0)
    for i in range(len(z)):
        for j in range(len(z)):
            total = total + z[i] * z[j] * float(g.precision[i, j])
    return F.sqrt(F.greatest(total, F.lit(0.0)))


def envelope_checks(configs: DataFrame, g: Geometry) -> DataFrame:
    """configs with max_abs_z, out_of_range (names of features outside the training range) and outside_envelope."""
    z = standardized(g)
    names = [F.when((F.col(f) < float(lo)) | (F.col(f) > float(hi)), F.lit(f)) for f, lo, hi in zip(g.features, g.least, g.greatest, strict=True)]
    out = F.array_compact(F.array(*names))
    return configs.select("*", F.greatest(*[F.abs(x) for x in z]).alias("max_abs_z"), out.alias("out_of_range"), (F.size(out) > 0).alias("outside_envelope"))


def out_of_distribution(configs: DataFrame, g: Geometry) -> DataFrame:
    """envelope_checks() with distance and is_ood: outside the envelope, or farther than the Mahalanobis threshold."""
    out = envelope_checks(configs, g).withColumn("distance", mahalanobis(g))
    return out.withColumn("is_ood", F.col("outside_envelope") | (F.col("distance") > float(g.threshold)))


def _erfc_of_half(d2: Column, terms: int = 80) -> Column:
    """erfc(sqrt(d2 / 2)) to double precision: a series of positive terms below d2 = 18, a continued fraction from there on."""
    down, h = F.sequence(F.lit(terms), F.lit(1), F.lit(-1)), d2 / 2
    near = F.aggregate(down, F.lit(1.0), lambda acc, n: 1 + d2 / (2 * n + 1) * acc)
    large = F.greatest(d2, F.lit(18.0))
    far = F.aggregate(down, F.lit(1.0), lambda acc, n: 1 + n / large / acc)
    return F.when(d2 < 18, 1 - 2 / math.sqrt(math.pi) * F.exp(-h) * F.sqrt(h) * near).otherwise(F.exp(-h) / F.sqrt(large / 2 * math.pi) / far)


def trust_diagnostics(configs: DataFrame, g: Geometry, freq_min_hz: float, freq_max_hz: float) -> DataFrame:
    """Trust of each deployment row (features, start_freq_hz, end_freq_hz, n_bins): standardized vector, bins off the support, envelope, distance, verdict."""
    step = (F.col("end_freq_hz") - F.col("start_freq_hz")) / (F.col("n_bins") - 1)
    below = F.greatest(F.least(F.ceil((F.lit(freq_min_hz) - F.col("start_freq_hz")) / step), F.col("n_bins").cast("long")), F.lit(0))
    above = F.greatest(F.least(F.ceil((F.col("end_freq_hz") - F.lit(freq_max_hz)) / step), F.col("n_bins").cast("long")), F.lit(0))
    far = envelope_checks(configs, g).withColumn("standardized", F.array(*standardized(g))).withColumn("distance", mahalanobis(g)).withColumn("bins_below", below).withColumn("bins_above", above)
    d2, dof = F.col("distance") * F.col("distance"), g.rank
    h = d2 / 2
    if dof % 2 == 0:
        term = tail = F.exp(-h)
        for k in range(1, dof // 2):
            term = term * h / k
            tail = tail + term
        probability = tail
    else:
        probability, term = _erfc_of_half(d2), F.exp(-h) * F.sqrt(h / math.pi) * 2
        for k in range(1, dof, 2):
            probability, term = probability + term, term * d2 / (k + 2)
    out = far.withColumn("tail_probability", probability).withColumn("extrapolates", (F.col("bins_below") > 0) | (F.col("bins_above") > 0))
    return out.withColumn("is_ood", F.col("outside_envelope") | (F.col("distance") > float(g.threshold)) | F.col("extrapolates"))


def calibrate(rows: DataFrame, curves: DataFrame, by: tuple[str, ...] = ("sensor_id",), clip: bool = True) -> DataFrame:
    """rows with power, calibrated_power, from curves (by, gain, floor, var). A row whose sensor has no curve is an error.

    Curves are one row for each sensor and configuration: they are broadcast when small, which their bytes show.
    """
    small = curves.select(*by, "gain", "floor", "var")
    size = small.agg(F.sum(24 * F.size("gain") + 64).alias("b")).first()["b"] or 0
    if size <= BROADCAST_BYTES:
        small = F.broadcast(small)
    joined = rows.withColumn("power", db_to_linear(F.col("pxx_db"))).join(small, list(by), "left")
    known = F.when(F.col("gain").isNull(), F.raise_error(F.concat(F.lit("no curve for "), F.col("sensor_id"))).cast("array<double>")).otherwise(calibrate_power(F.col("power"), F.col("gain"), F.col("floor"), clip))
    return joined.withColumn("calibrated_power", known).drop("gain", "floor", "var")


def curve_variances(curves: DataFrame, by: tuple[str, ...] = ("sensor_id",)) -> DataFrame:
    """by, propagated_var, label: once for each curve."""
    return curves.select(*by, propagated_variance(F.col("var"), F.col("gain")).alias("propagated_var"), F.lit("observation_noise_only").alias("uncertainty"))


def curve_summary(curves: DataFrame) -> DataFrame:
    """sensor_id and the means of gain, floor and variance in dB."""
    db = lambda c: array_mean(linear_to_db(F.col(c)))
    return curves.select("sensor_id", db("gain").alias("mean_gain_db"), db("floor").alias("mean_floor_db"), db("var").alias("mean_var_db"))


def sensor_training_summary(curves: DataFrame, weights: DataFrame, norms: DataFrame | None = None) -> DataFrame:
    """sensor_id, campaigns, medians over all campaigns' bins of gain, floor and deviation in dB, weight, and embedding_norm of norms (sensor_id, embedding_norm)."""
    from .quantiles import exact_quantile

    db = lambda curve, root=False: F.transform(curve, lambda x: F.struct(F.lit(curve).alias("what"), (10 * F.log10(F.greatest(F.sqrt(x) if root else x, F.lit(1e-12)))).alias("value")))
    values = curves.select("sensor_id", F.inline(F.concat(db("gain"), db("floor"), db("var", True))))
    half = exact_quantile(values, ["sensor_id", "what"], 0.5, "median")
    of = lambda what, name: F.max(F.when(F.col("what") == what, F.col("median"))).alias(name)
    half = half.groupBy("sensor_id").agg(of("gain", "median_gain_db"), of("floor", "median_floor_db"), of("var", "median_std_db"))
    out = curves.groupBy("sensor_id").agg(F.count_distinct("campaign").alias("campaigns")).join(half, "sensor_id").join(weights, "sensor_id", "left")
    return out if norms is None else out.join(norms.select("sensor_id", "embedding_norm"), "sensor_id", "left")


def spline_basis(frequency: np.ndarray, n_basis: int, degree: int, lo: float, hi: float, clip: bool = False) -> np.ndarray:
    """Clamped B-spline basis with even inner knots over [lo, hi]; rows sum to 1."""
    if not clip and (frequency.min() < lo or frequency.max() > hi):
        raise ValueError("frequencies lie outside the support")
    x = np.clip((frequency - lo) / (hi - lo), 0.0, 1.0)
    knots = np.concatenate([np.zeros(degree), np.linspace(0, 1, n_basis - degree + 1), np.ones(degree)])
    b = ((knots[:-1] <= x[:, None]) & (x[:, None] < knots[1:])).astype(float)
    b[x == 1.0] = 0.0
    b[x == 1.0, n_basis - 1] = 1.0
    for d in range(1, degree + 1):
        left, right = knots[d:-1] - knots[: -d - 1], knots[d + 1 :] - knots[1:-d]
        up = np.divide(x[:, None] - knots[: -d - 1], left, out=np.zeros((len(x), len(left))), where=left > 0)
        down = np.divide(knots[d + 1 :] - x[:, None], right, out=np.zeros((len(x), len(right))), where=right > 0)
        b = up * b[:, :-1] + down * b[:, 1:]
    return b / b.sum(axis=1, keepdims=True)


def spline_weights(grids: DataFrame, n_basis: int, degree: int, lo: float, hi: float, clip: bool = False) -> DataFrame:
    """grids (start_freq_hz, end_freq_hz, n_bins, others) with basis, the spline weights of each bin, and without end and start.

    A grid off the support lo to hi is an error, unless clip clamps it.
    """
    kept = [f for f in grids.schema.fields if f.name not in ("start_freq_hz", "end_freq_hz", "n_bins")]

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            spans = zip(pdf["start_freq_hz"], pdf["end_freq_hz"], pdf["n_bins"], strict=True)
            made = [spline_basis(np.linspace(a, b, int(n)), n_basis, degree, lo, hi, clip).tolist() for a, b, n in spans]
            yield pdf[[f.name for f in kept]].assign(basis=made)

    return grids.mapInPandas(run, StructType([*kept, StructField("basis", ArrayType(ArrayType(DoubleType())))]))


def work_folder(spark: SparkSession) -> str:
    """A new folder that all executors share: under spark.checkpoint.dir, or a temporary one on a local master."""
    root = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getConf().get("spark.checkpoint.dir")
    if not root:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
        root = "file://" + tempfile.mkdtemp(prefix="spectrafleet-")
    return f"{root.rstrip('/')}/work-{uuid.uuid4().hex}"
