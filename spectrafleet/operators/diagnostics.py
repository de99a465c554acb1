"""Agreement of sensors before and after calibration."""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window

from ..functions.spectra import array_mean, array_sum, curve_roughness, linear_to_db
from .quantiles import counted, exact_quantile
from .records import LOG_FLOOR, by_record, log_pearson, mean_over, record_matrix, rmse_matrix, sensor_spread


def pairwise_rmse(rows: DataFrame, spectrum: str, name: str = "rmse_db") -> DataFrame:
    """campaign, record_idx, mean over sensor pairs of the root mean squared difference in dB."""
    return mean_over(record_matrix(rows, spectrum, rmse_matrix), ["campaign", "record_idx"], name)


def pairwise_log_correlation(rows: DataFrame, power: str) -> DataFrame:
    return mean_over(record_matrix(rows, power, log_pearson), ["campaign"], "log_correlation")


def overlay_limits(rows: DataFrame, padding: float = 0.5) -> DataFrame:
    """campaign, lower, upper: range of raw and calibrated dB, padded."""
    low = F.least(F.array_min("raw_db"), F.array_min("calibrated_db"))
    high = F.greatest(F.array_max("raw_db"), F.array_max("calibrated_db"))
    return rows.groupBy("campaign").agg((F.min(low) - padding).alias("lower"), (F.max(high) + padding).alias("upper"))


def with_db(calibrated: DataFrame) -> DataFrame:
    return calibrated.withColumn("raw_db", linear_to_db(F.col("power"))).withColumn("calibrated_db", linear_to_db(F.col("calibrated_power")))


def deployment_summary(calibrated: DataFrame, curves: DataFrame) -> DataFrame:
    """One row per campaign: mean gain, spread of gain and of calibrated power over sensors, mean floor and variance, mean and 99 % quantile of calibrated power, greatest roughness."""
    per_bin = lambda df, by, c: df.select(*by, F.posexplode(c).alias("bin", "v")).groupBy(*by, "bin").agg(F.stddev_pop("v").alias("s"))
    power = sensor_spread(calibrated, "calibrated_power", "calibrated_spread")
    means = calibrated.groupBy("campaign").agg((F.sum(array_sum(F.col("calibrated_power"))) / F.sum(F.size("calibrated_power"))).alias("mean_calibrated"))
    high = exact_quantile(calibrated.select("campaign", F.explode("calibrated_power").alias("value")), ["campaign"], 0.99, "q99_calibrated")
    values = means.join(high, "campaign")
    gain = per_bin(curves.select(F.lit(1).alias("one"), "gain"), ["one"], "gain").agg(F.avg("s").alias("gain_spread"))
    rest = curves.agg(
        F.avg(array_mean(F.col("gain"))).alias("mean_gain"), F.avg(array_mean(F.col("floor"))).alias("mean_floor"), F.avg(array_mean(F.col("var"))).alias("mean_var"), F.max(curve_roughness(F.col("gain"))).alias("max_gain_roughness")
    )
    return power.join(values, "campaign").join(F.broadcast(gain)).join(F.broadcast(rest))  # single rows


def record_measures(calibrated: DataFrame) -> DataFrame:
    """campaign, record_idx, raw and cal (mean RMSE of sensor pairs in dB), ss and n (squared log deviations), corr and pairs: in one pass over records."""

    def measures(_: np.ndarray, spectra: np.ndarray) -> list[tuple]:
        raw, db, power = np.split(spectra, 3, axis=1)
        a, b = np.triu_indices(len(spectra), 1)
        z = np.log(power + LOG_FLOOR)
        squares = (z - z.mean(axis=0)) ** 2
        mean = lambda m: float(m[a, b].mean()) if len(a) else None
        return [(mean(rmse_matrix(raw)), mean(rmse_matrix(db)), float(squares.sum()), squares.size, float(log_pearson(power)[a, b].sum()), len(a))]

    both = with_db(calibrated).withColumn("all", F.concat("raw_db", "calibrated_db", "calibrated_power"))
    return by_record(both, "all", measures, "raw double, cal double, ss double, n long, corr double, pairs long")


def campaign_diagnostics(calibrated: DataFrame, roles: DataFrame, trust: DataFrame) -> DataFrame:
    """One row per campaign: role, RMSE raw and calibrated (mean, median, greatest), improvement, dispersion, correlation, OOD flag.

    Spectra are shuffled once; the medians are taken of one row for each record, which is written.
    """
    each = counted(record_measures(calibrated))
    out = each.filter("raw is not null").groupBy("campaign").agg(
        F.count(F.lit(1)).alias("n_records"), F.avg("raw").alias("mean_raw_rmse_db"), F.max("raw").alias("max_raw_rmse_db"), F.avg("cal").alias("mean_cal_rmse_db"), F.max("cal").alias("max_cal_rmse_db"), (F.avg("raw") - F.avg("cal")).alias("improvement_db"),
        (F.sum("corr") / F.sum("pairs")).alias("log_correlation"),
    )
    for c in ("raw", "cal"):
        out = out.join(exact_quantile(each.select("campaign", F.col(c).alias("value")), ["campaign"], 0.5, f"median_{c}_rmse_db"), "campaign")
    dispersion = each.groupBy("campaign").agg((F.sum("ss") / F.sum("n")).alias("dispersion"))
    return out.join(dispersion, "campaign").join(roles, "campaign").join(trust, "campaign", "left")


def role_summary(diagnostics: DataFrame, weight_dispersion: float = 1.0, weight_correlation: float = 1.0) -> DataFrame:
    return diagnostics.groupBy("role").agg(
        F.count(F.lit(1)).alias("campaigns"), F.sum("n_records").alias("records"), F.avg("mean_raw_rmse_db").alias("mean_raw_rmse_db"), F.avg("mean_cal_rmse_db").alias("mean_cal_rmse_db"), F.max("max_cal_rmse_db").alias("max_cal_rmse_db"),
        F.sum(weight_dispersion * F.col("dispersion")).alias("dispersion_term"), F.sum(weight_correlation * (1 - F.col("log_correlation"))).alias("correlation_term"), F.count_if("is_ood").alias("ood_campaigns"),
    )


def objective_history(steps: DataFrame) -> DataFrame:
    """steps (run, step, objective) with the change, the relative change, and whether each is the best so far or the one selected."""
    w = Window.partitionBy("run").orderBy("step")
    before = F.lag("objective").over(w)
    best = F.min("objective").over(w.rowsBetween(Window.unboundedPreceding, 0))
    chosen = F.row_number().over(Window.partitionBy("run").orderBy("objective", "step")) == 1
    return steps.select("*", (F.col("objective") - before).alias("delta"), ((F.col("objective") - before) / F.greatest(F.abs(before), F.lit(1e-12))).alias("relative_delta"), (F.col("objective") <= best).alias("is_best_so_far"), chosen.alias("is_selected"))

