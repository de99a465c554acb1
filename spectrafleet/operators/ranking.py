"""Ranking sensors by agreement, and comparing their value distributions."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window

from ..functions.spectra import array_mean, noise_floor
from .quantiles import counted
from .records import STD_FLOOR, both_ways, pearson, record_matrix
from .sets import require_none


def _ranked(df: DataFrame, by: list[str], score: str, name: str = "rank") -> DataFrame:
    """Rank 1 is the highest score; of equal scores, the later sensor id comes first."""
    return df.withColumn(name, F.row_number().over(Window.partitionBy(*by).orderBy(F.col(score).desc(), F.col("sensor_id").desc())))


def record_scores(aligned: DataFrame) -> DataFrame:
    """campaign, record_idx, sensor_id, score (the row sum of the record's correlations, without itself), sensors."""
    pairs = both_ways(record_matrix(aligned, "pxx_db", pearson))
    return pairs.groupBy("campaign", "record_idx", "sensor_id").agg(F.sum("value").alias("score"), (F.count("value") + 1).alias("sensors"))


def mean_correlation_matrix(aligned: DataFrame) -> DataFrame:
    return record_matrix(aligned, "pxx_db", pearson).groupBy("campaign", "sensor_a", "sensor_b").agg(F.avg("value").alias("mean_correlation"))


def sensor_ranking(aligned: DataFrame) -> DataFrame:
    """Per sensor: rank, mean score and correlation, deviation of the score, mean noise floor, records."""
    scores = record_scores(aligned).groupBy("campaign", "sensor_id").agg(
        F.avg("score").alias("mean_score"), F.avg(F.col("score") / (F.col("sensors") - 1)).alias("mean_correlation"), F.stddev_pop("score").alias("score_std"), F.count(F.lit(1)).alias("n_records")
    )
    floors = aligned.groupBy("campaign", "sensor_id").agg(F.avg(noise_floor("pxx_db")).alias("mean_noise_floor_db"))
    return _ranked(scores.join(floors, ["campaign", "sensor_id"]), ["campaign"], "mean_score")


def rank_stability(scores: DataFrame) -> DataFrame:
    """From record_scores(): mean, best and worst rank, score range and deviation, how often a sensor came first."""
    return _ranked(scores, ["campaign", "record_idx"], "score").groupBy("campaign", "sensor_id").agg(
        F.avg("rank").alias("mean_rank"), F.min("rank").alias("best_rank"), F.max("rank").alias("worst_rank"), F.min("score").alias("min_score"), F.max("score").alias("max_score"),
        F.stddev_pop("score").alias("score_std"), F.count_if(F.col("rank") == 1).alias("top_1_count"), (F.count_if(F.col("rank") == 1) / F.count(F.lit(1))).alias("top_1_fraction"),
    )


def top_sensors(ranking: DataFrame, n: int = 3) -> DataFrame:
    return ranking.filter(F.col("rank") <= n)


def dataset_overview(ranking: DataFrame) -> DataFrame:
    """Best sensor per campaign; of equal scores, the first id."""
    best = F.min_by(F.struct("sensor_id", "mean_score", "mean_correlation"), F.struct((-F.col("mean_score")).alias("s"), F.col("sensor_id")))
    out = ranking.groupBy("campaign").agg(best.alias("b"), F.count(F.lit(1)).alias("n_sensors"), F.max("n_records").alias("n_records"))
    return out.select("campaign", F.col("b.sensor_id").alias("best_sensor"), F.col("b.mean_score").alias("best_score"), F.col("b.mean_correlation").alias("best_correlation"), "n_sensors", "n_records")


def _is_array(values: DataFrame) -> bool:
    return dict(values.dtypes)["value"].startswith("array")


def _ranges(values: DataFrame, value_range: tuple[float, float] | None) -> DataFrame:
    """campaign, lo, hi: the given range, or that of a campaign's values."""
    if value_range is None:
        low, high = (F.array_min("value"), F.array_max("value")) if _is_array(values) else (F.col("value"), F.col("value"))
        return values.groupBy("campaign").agg(F.min(low).alias("lo"), F.max(high).alias("hi"))
    if not value_range[0] < value_range[1]:
        raise ValueError("a range must begin below its end")
    return values.select("campaign").distinct().select("campaign", *[F.lit(float(x)).alias(n) for n, x in zip(("lo", "hi"), value_range)])


def bin_counts(value: np.ndarray, lo: float, hi: float, bins: int) -> np.ndarray:
    """How many values within lo and hi lie in each bin; bins are closed on the left, the last one on both sides, and decided by their edges."""
    value = value[(value >= lo) & (value <= hi)]
    width = (hi - lo) / bins
    guess = np.minimum(np.floor((value - lo) / width), bins - 1)
    at = guess - (value < lo + guess * width) + ((value >= lo + (guess + 1) * width) & (guess < bins - 1))
    return np.bincount(at.astype(np.int64), minlength=bins)


def psd_histogram(values: DataFrame, bins: int = 50, value_range: tuple[float, float] | None = None) -> DataFrame:
    """campaign, sensor_id, bin, n, density from values (campaign, sensor_id, value), over edges shared in a campaign.

    value is a number, or an array of them such as a spectrum. Values outside a given range don't count; a sensor that
    has no others is an error. A campaign of one value has no width and is an error. Each task counts into one array
    for each sensor, so that what is shuffled is a row for each task, sensor and bin, not for each value.
    """

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: dict[tuple, np.ndarray] = {}
        for batch in batches:
            column = batch.column("value")
            flat = column.flatten() if pa.types.is_list(column.type) else column
            value = flat.to_numpy(zero_copy_only=False)
            ends = np.cumsum(pc.list_value_length(column).fill_null(0).to_numpy(zero_copy_only=False)) if pa.types.is_list(column.type) else np.arange(1, len(value) + 1)
            rows = {}
            for k, key in enumerate(zip(*(batch.column(c).to_pylist() for c in ("campaign", "sensor_id", "lo", "hi")), strict=True)):
                rows.setdefault(key, []).append(value[ends[k - 1] if k else 0 : ends[k]])
            for key, parts in rows.items():
                found = bin_counts(np.concatenate(parts), key[2], key[3], bins)
                held[key] = held[key] + found if key in held else found
        out = [(*key[:2], int(i), int(n), (key[3] - key[2]) / bins) for key, found in held.items() for i, n in enumerate(found) if n]
        kinds = (pa.string(), pa.string(), pa.int32(), pa.int64(), pa.float64())
        yield pa.RecordBatch.from_arrays([pa.array([r[k] for r in out], t) for k, t in enumerate(kinds)], ["campaign", "sensor_id", "bin", "n", "width"])

    known = values.select("campaign", "sensor_id", F.col("value").cast("array<double>" if _is_array(values) else "double").alias("value"))
    placed = known.join(counted(_ranges(values, value_range)), "campaign")
    placed = placed.withColumn("lo", F.when(F.col("hi") > F.col("lo"), F.col("lo")).otherwise(F.raise_error(F.lit("a campaign's values are all equal")).cast("double")))
    parts = placed.mapInArrow(count, "campaign string, sensor_id string, bin int, n long, width double")
    counts = parts.groupBy("campaign", "sensor_id", "bin", "width").agg(F.sum("n").alias("n"))
    if value_range is not None:
        counts = counted(counts)
        require_none(values.select("campaign", "sensor_id").distinct().join(counts.select("campaign", "sensor_id").distinct(), ["campaign", "sensor_id"], "left_anti"), "no value within the range")
    total = F.sum("n").over(Window.partitionBy("campaign", "sensor_id"))
    return counts.select("campaign", "sensor_id", "bin", "n", (F.col("n") / (total * F.col("width"))).alias("density"))


def histogram_summary(values: DataFrame, bins: int = 50, value_range: tuple[float, float] | None = None) -> DataFrame:
    """campaign, bin, centre, n, density over all sensors of a campaign, every bin, and the share of values that the range clips."""
    found = psd_histogram(values, bins, value_range).groupBy("campaign", "bin").agg(F.sum("n").alias("n"))
    ends = _ranges(values, value_range)
    low, high = value_range or (None, None)
    if value_range is None:
        clipped = F.lit(0.0)
    elif _is_array(values):
        clipped = F.sum(F.size(F.filter("value", lambda v: ~v.between(low, high)))) / F.sum(F.size("value"))
    else:
        clipped = F.count_if(~F.col("value").between(low, high)) / F.count("value")
    whole = values.groupBy("campaign").agg(clipped.alias("clipped_fraction"))
    width = (F.col("hi") - F.col("lo")) / bins
    every = ends.join(whole, "campaign").select("campaign", "clipped_fraction", "lo", width.alias("width"), F.explode(F.sequence(F.lit(0), F.lit(bins - 1))).alias("bin"))
    out = every.join(found, ["campaign", "bin"], "left").fillna(0, ["n"])
    total = F.sum("n").over(Window.partitionBy("campaign"))
    return out.select("campaign", "bin", (F.col("lo") + (F.col("bin") + 0.5) * F.col("width")).alias("centre"), "n", (F.col("n") / (total * F.col("width"))).alias("density"), "clipped_fraction")


def spectra_values(rows: DataFrame) -> DataFrame:
    """campaign, sensor_id and value, a spectrum, for psd_histogram()."""
    return rows.select("campaign", "sensor_id", F.col("pxx_db").alias("value"))


def distribution_similarity(histogram: DataFrame, bins: int = 50) -> DataFrame:
    """Per sensor: score (sum of correlations with the other sensors' density curves), normalised score, rank, outlier flag."""
    # Missing bins are zero: sums over all bins follow from the bins that are there.
    stats = histogram.groupBy("campaign", "sensor_id").agg((F.sum("density") / bins).alias("mean"), (F.sum(F.col("density") * F.col("density")) / bins).alias("square"))
    stats = stats.select("campaign", "sensor_id", "mean", F.greatest(F.sqrt(F.greatest(F.col("square") - F.col("mean") * F.col("mean"), F.lit(0.0))), F.lit(STD_FLOOR)).alias("std"))
    a = histogram.select("campaign", "bin", F.col("sensor_id").alias("a"), F.col("density").alias("x"))
    b = histogram.select("campaign", "bin", F.col("sensor_id").alias("b"), F.col("density").alias("y"))
    products = a.join(b, ["campaign", "bin"]).filter("a <> b").groupBy("campaign", "a", "b").agg((F.sum(F.col("x") * F.col("y")) / bins).alias("xy"))
    sa = stats.select("campaign", F.col("sensor_id").alias("a"), F.col("mean").alias("ma"), F.col("std").alias("sa"))
    sb = stats.select("campaign", F.col("sensor_id").alias("b"), F.col("mean").alias("mb"), F.col("std").alias("sb"))
    pairs = sa.join(sb, "campaign").filter("a <> b").join(products, ["campaign", "a", "b"], "left").fillna(0.0, ["xy"])
    rho = F.greatest(F.least((F.col("xy") - F.col("ma") * F.col("mb")) / (F.col("sa") * F.col("sb")), F.lit(1.0)), F.lit(-1.0))
    scores = pairs.groupBy("campaign", F.col("a").alias("sensor_id")).agg(F.sum(rho).alias("score"), F.avg(rho).alias("normalised_score"))
    w = Window.partitionBy("campaign")
    out = scores.withColumn("is_outlier", F.col("score") < F.avg("score").over(w) - F.stddev_pop("score").over(w))
    return _ranked(out, ["campaign"], "score")


def reliable_sensor(ranking: DataFrame, distribution: DataFrame) -> DataFrame:
    """campaign, reliable_sensor: the best-ranked sensor that is no distribution outlier, else the best-ranked."""
    both = ranking.select("campaign", "sensor_id", "rank").join(distribution.select("campaign", "sensor_id", "is_outlier"), ["campaign", "sensor_id"])
    return both.groupBy("campaign").agg(F.min_by("sensor_id", F.struct("is_outlier", "rank")).alias("reliable_sensor"))


def sensor_integrity(aligned: DataFrame) -> DataFrame:
    """Per sensor: records, first and last time, span, and mean, deviation, least and greatest value of all its bins."""
    # sums of each row's own array: its mean, and the squared deviations from it
    row_mean, bins = array_mean(F.col("pxx_db")), F.size("pxx_db")
    rows = aligned.select("campaign", "sensor_id", "ts_ms", "pxx_db", row_mean.alias("m"), bins.alias("k"))
    rows = rows.withColumn("squares", F.aggregate("pxx_db", F.lit(0.0), lambda s, x: s + (x - F.col("m")) * (x - F.col("m"))))
    k, m = F.col("k"), F.col("m")
    n, mean = F.sum(k), F.sum(k * m) / F.sum(k)
    out = rows.groupBy("campaign", "sensor_id").agg(
        F.count(F.lit(1)).alias("n_records"), F.min("ts_ms").alias("first_ms"), F.max("ts_ms").alias("last_ms"), ((F.max("ts_ms") - F.min("ts_ms")) / 1000).alias("span_s"), mean.alias("mean_db"),
        F.sqrt(F.greatest((F.sum("squares") + F.sum(k * m * m)) / n - mean * mean, F.lit(0.0))).alias("std_db"), F.min(F.array_min("pxx_db")).alias("min_db"), F.max(F.array_max("pxx_db")).alias("max_db"),
    )
    return out


def campaign_inspection(rows: DataFrame) -> DataFrame:
    """Per sensor: records, times in UTC, span in minutes, median bins, means of each row's mean and 10th percentile."""
    row_mean = F.expr("aggregate(pxx_db, 0D, (s, x) -> s + x) / size(pxx_db)")
    # The quantile of one row's own array, between its neighbours in order.
    place = (F.size("pxx_db") - 1) * F.lit(0.1)
    at, ordered = F.floor(place).cast("int"), F.array_sort("pxx_db")
    low, high = F.get(ordered, at), F.get(ordered, F.least(at + 1, F.size("pxx_db") - 1))
    rows = rows.withColumn("_p10", low + (high - low) * (place - at))
    out = rows.groupBy("campaign", "sensor_id").agg(
        F.count(F.lit(1)).alias("n_records"), F.timestamp_millis(F.min("ts_ms")).cast("string").alias("start_utc"), F.timestamp_millis(F.max("ts_ms")).cast("string").alias("end_utc"),
        ((F.max("ts_ms") - F.min("ts_ms")) / 60000).alias("span_min"), F.percentile("n_bins", F.lit(0.5)).alias("median_bins"), F.avg(row_mean).alias("mean_db"), F.avg("_p10").alias("mean_p10_db"),
    )
    return out


def dataset_summary(aligned: DataFrame) -> DataFrame:
    """Per campaign: sensors, records, bins, frequency step and span, mean and greatest time spread of a record, sensor list."""
    spread = aligned.groupBy("campaign", "record_idx").agg(((F.max("ts_ms") - F.min("ts_ms")) / 1000).alias("s")).groupBy("campaign").agg(F.count(F.lit(1)).alias("n_records"), F.avg("s").alias("mean_spread_s"), F.max("s").alias("max_spread_s"))
    out = aligned.groupBy("campaign").agg(
        F.count_distinct("sensor_id").alias("n_sensors"), F.max("n_bins").alias("n_bins"), F.max((F.col("end_freq_hz") - F.col("start_freq_hz")) / (F.col("n_bins") - 1)).alias("step_hz"),
        F.max((F.col("end_freq_hz") - F.col("start_freq_hz")) / 1e6).alias("span_mhz"), F.array_join(F.sort_array(F.collect_set("sensor_id")), ",").alias("sensors"),
    )
    return out.join(spread, "campaign")


def mean_psd_curve(aligned: DataFrame, ranking: DataFrame, n: int = 3) -> DataFrame:
    """campaign, sensor_id, bin, mean_db of the n best sensors."""
    best = counted(top_sensors(ranking, n).select("campaign", "sensor_id"))
    return aligned.join(best, ["campaign", "sensor_id"]).select("campaign", "sensor_id", F.posexplode("pxx_db").alias("bin", "v")).groupBy("campaign", "sensor_id", "bin").agg(F.avg("v").alias("mean_db"))
