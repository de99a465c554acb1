"""Array expressions over spectra, and the one batch helper that needs NumPy."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

POWER_FLOOR = 1e-12
NOISE_BINS = 50


def db_to_linear(pxx: Column) -> Column:
    return F.transform(pxx, lambda x: F.pow(F.lit(10.0), x / 10))


def linear_to_db(power: Column) -> Column:
    """10 log10 of the power, not below -120 dB."""
    return F.transform(power, lambda x: 10 * F.log10(F.greatest(x, F.lit(POWER_FLOOR))))


def frequency_axis(start: Column, end: Column, n: Column) -> Column:
    """n evenly spaced frequencies; the last is end exactly."""
    step = (end - start) / (n - 1)
    return F.transform(F.sequence(F.lit(0), n - 1), lambda i: F.when(i == n - 1, end).otherwise(start + i * step))


def array_sum(a: Column) -> Column:
    return F.aggregate(a, F.lit(0.0), lambda s, x: s + x)


def array_mean(a: Column) -> Column:
    return array_sum(a) / F.size(a)


def calibrate_power(power: Column, gain: Column, floor: Column, clip: bool = True) -> Column:
    """(Y - N) / G for each bin, the difference not below 0 unless clip is off; lengths must agree and gains be positive."""
    y = F.zip_with(power, floor, lambda y, n: F.greatest(y - n, F.lit(0.0)) if clip else y - n)
    bad = (F.size(power) != F.size(gain)) | (F.size(power) != F.size(floor)) | F.exists(gain, lambda g: g <= 0)
    return F.when(bad, F.raise_error(F.lit("curves must have the spectrum's length and positive gains")).cast("array<double>")).otherwise(F.zip_with(y, gain, lambda y, g: y / g))


def propagated_variance(variance: Column, gain: Column) -> Column:
    """Observation variance divided by the squared gain; one array for each curve, not for each record."""
    return F.zip_with(variance, gain, lambda v, g: v / F.greatest(g * g, F.lit(POWER_FLOOR)))


def curve_roughness(curve: Column) -> Column:
    """Root mean square of a curve's second differences; 0 for fewer than three bins."""
    second = F.transform(F.sequence(F.lit(1), F.size(curve) - 2), lambda i: F.get(curve, i + 1) - 2 * F.get(curve, i) + F.get(curve, i - 1))
    return F.when(F.size(curve) < 3, F.lit(0.0)).otherwise(F.sqrt(F.aggregate(second, F.lit(0.0), lambda s, x: s + x * x) / (F.size(curve) - 2)))


def edge_jump_ratio(curve: Column) -> Column:
    """The larger of the first and last steps of a curve over its median inner step; 0 for fewer than two bins."""
    steps = F.transform(F.sequence(F.lit(0), F.size(curve) - 2), lambda i: F.abs(F.get(curve, i + 1) - F.get(curve, i)))
    inner = F.sort_array(F.when(F.size(steps) > 2, F.slice(steps, F.lit(2), F.size(steps) - 2)).otherwise(steps))
    middle = (F.get(inner, F.floor((F.size(inner) - 1) / 2).cast("int")) + F.get(inner, F.floor(F.size(inner) / 2).cast("int"))) / 2
    return F.when(F.size(curve) < 2, F.lit(0.0)).otherwise(F.greatest(F.get(steps, 0), F.element_at(steps, -1)) / F.greatest(middle, F.lit(POWER_FLOOR)))


def is_valid_spectrum(pxx: Column) -> Column:
    """At least two values, all finite."""
    return pxx.isNotNull() & (F.size(pxx) >= 2) & ~F.exists(pxx, lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == float("inf")))


def noise_floors(rows: np.ndarray) -> np.ndarray:
    """For each row, the left edge of the first fullest of NOISE_BINS equal bins over the row's own range."""
    lo, hi = rows.min(axis=1), rows.max(axis=1)
    flat = lo == hi
    lo, hi = np.where(flat, lo - 0.5, lo), np.where(flat, hi + 0.5, hi)
    step = (hi - lo) / NOISE_BINS
    edges = lo[:, None] + step[:, None] * np.arange(NOISE_BINS + 1)
    edges[:, -1] = hi
    at = np.clip(((rows - lo[:, None]) / step[:, None]).astype(np.int64), 0, NOISE_BINS - 1)
    row = np.arange(len(rows))[:, None]
    at -= rows < edges[row, at]  # decide by the edges themselves
    at += (rows >= edges[row, at + 1]) & (at < NOISE_BINS - 1)
    counts = np.bincount((row * NOISE_BINS + at).ravel(), minlength=len(rows) * NOISE_BINS).reshape(len(rows), NOISE_BINS)
    return edges[np.arange(len(rows)), counts.argmax(axis=1)]


@F.pandas_udf(T.DoubleType())
def noise_floor(pxx: pd.Series) -> pd.Series:
    """noise_floors() of a column of valid spectra, by groups of equal length."""
    out = np.full(len(pxx), np.nan)
    for n, at in pd.Series(range(len(pxx))).groupby(pxx.map(len).to_numpy()):
        if n:
            out[at.to_numpy()] = noise_floors(np.stack(pxx.iloc[at.to_numpy()].to_numpy()))
    return pd.Series(out)
