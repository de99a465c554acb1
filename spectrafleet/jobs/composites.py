"""Composite jobs: each runs for all campaigns at once."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..operators import alignment as A
from ..operators import calibration as C
from ..operators import diagnostics as D
from ..operators import ranking as R
from ..operators import sets as X
from ..operators.calibration import work_folder
from ..operators.fit import FitResult, evaluate_curves
from ..sources.measurements import require_valid

GRID = ("start_freq_hz", "end_freq_hz", "n_bins")


def aligned_spectra(rows: DataFrame, tolerance_ms: int | None = None, allow_pruning: bool = False) -> DataFrame:
    """Valid rows of complete records, with record_idx. Only timestamps take part in the alignment itself.

    Both the slim alignment and the joined spectra are written to the shared folder: several measures read them.
    """
    root = work_folder(rows.sparkSession)
    slim = written(A.align(rows, tolerance_ms, allow_pruning).select("campaign", "record_idx", "sensor_id", "src_row"), f"{root}/alignment")
    return written(require_valid(rows).drop("record_idx").join(slim, ["campaign", "sensor_id", "src_row"]), f"{root}/spectra")


def written(df: DataFrame, path: str) -> DataFrame:
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def rank_campaigns(rows: DataFrame, tolerance_ms: int | None = None, label: str | None = None, bins: int = 50) -> tuple[DataFrame, DataFrame]:
    """(sensor ranking, distribution similarity) of one campaign or of all."""
    if label is not None:
        rows = rows.filter(F.col("campaign") == label)
    aligned = aligned_spectra(rows, tolerance_ms)
    return R.sensor_ranking(aligned), R.distribution_similarity(R.psd_histogram(R.spectra_values(aligned), bins), bins)


@dataclass
class Corpus:
    aligned: DataFrame
    ranking: DataFrame
    distribution: DataFrame
    reliable: DataFrame
    registry: DataFrame
    overview: DataFrame


def prepare_corpus(rows: DataFrame, configs: DataFrame, exclusions: DataFrame, leading: int = 0, tolerance_ms: int | None = None, bins: int = 50) -> Corpus:
    """Exclusions, then leading rows, then alignment with pruning; ranking, outliers, the reliable sensor and an overview."""
    kept = A.drop_leading(X.exclude_sensors(rows, exclusions), leading) if leading else X.exclude_sensors(rows, exclusions)
    aligned = aligned_spectra(kept, tolerance_ms, allow_pruning=True)
    ranking = R.sensor_ranking(aligned)
    distribution = R.distribution_similarity(R.psd_histogram(R.spectra_values(aligned), bins), bins)
    reliable = R.reliable_sensor(ranking, distribution)
    return Corpus(aligned, ranking, distribution, reliable, X.sensor_registry(aligned), campaign_overview(rows, aligned, distribution, reliable, configs))


def campaign_overview(rows: DataFrame, aligned: DataFrame, distribution: DataFrame, reliable: DataFrame, configs: DataFrame) -> DataFrame:
    """One row per prepared campaign: sensors, those left out, records, reliable sensor, outliers, settings in display units."""
    names = lambda c: F.array_join(F.sort_array(F.collect_set(c)), ",")
    had = rows.groupBy("campaign").agg(F.collect_set("sensor_id").alias("had"))
    has = aligned.groupBy("campaign").agg(F.collect_set("sensor_id").alias("has"), F.count_distinct("record_idx").alias("n_records"))
    odd = distribution.groupBy("campaign").agg(names(F.when(F.col("is_outlier"), F.col("sensor_id"))).alias("outliers"))
    out = had.join(has, "campaign").join(reliable, "campaign").join(odd, "campaign").join(configs, "campaign", "left")
    return out.select(
        "campaign", F.array_join(F.sort_array("has"), ",").alias("sensors"), F.array_join(F.sort_array(F.array_except("had", "has")), ",").alias("left_out"), "n_records", "reliable_sensor", "outliers",
        (F.col("central_freq_hz") / 1e6).alias("central_freq_mhz"), (F.col("span_hz") / 1e6).alias("span_mhz"), (F.col("rbw_hz") / 1e3).alias("rbw_khz"), (F.col("acquisition_interval_s") / 60).alias("interval_min"),
    )


@dataclass
class Evaluation:
    """One row for each campaign, each role, and the run."""

    campaigns: DataFrame
    roles: DataFrame
    run: DataFrame


def _diagnosed(rows: DataFrame, settings: DataFrame, done: FitResult, features: tuple[str, ...]) -> DataFrame:
    """campaign_diagnostics() of rows calibrated with a fit's persistent curves."""
    grid = rows.select("campaign", "sensor_id", "start_freq_hz", "end_freq_hz", "n_bins").distinct()
    made = evaluate_curves(done.model, grid.join(settings.drop("config_id"), "campaign").withColumnRenamed("campaign", "config_id")).withColumnRenamed("config_id", "campaign")
    out = C.calibrate(rows, made, ("campaign", "sensor_id"))
    g = C.config_geometry(settings.filter("role = 'train'"), features)
    trust = C.out_of_distribution(settings, g).select("campaign", "is_ood")
    return D.campaign_diagnostics(out, settings.select("campaign", "role"), trust)


def evaluate_run(rows: DataFrame, settings: DataFrame, done: FitResult, features: tuple[str, ...]) -> Evaluation:
    """Agreement by campaign and role under a fit's persistent curves, and what the fit came to."""
    spark = rows.sparkSession
    campaigns = written(_diagnosed(rows, settings, done, features), work_folder(spark))
    told = [(done.reason, len(done.rounds), done.selected_round, float(done.selected), len(done.history), max(done.gradient_norms, default=None))]
    fitted = spark.createDataFrame(told, "reason string, rounds int, selected_round int, selected_objective double, steps int, max_gradient_norm double")
    count = lambda role: F.count_if(F.col("role") == role)
    whole = campaigns.agg(
        count("train").alias("train_campaigns"), count("test").alias("test_campaigns"), F.sum("n_records").alias("records"), F.avg("mean_raw_rmse_db").alias("mean_raw_rmse_db"), F.avg("mean_cal_rmse_db").alias("mean_cal_rmse_db"),
        F.count_if(F.col("improvement_db") > 0).alias("improved_campaigns"), F.count_if("is_ood").alias("ood_campaigns"),
    )
    return Evaluation(campaigns, D.role_summary(campaigns), fitted.join(F.broadcast(whole)))  # single rows


def evaluate_corpus(rows: DataFrame, settings: DataFrame, done: FitResult, features: tuple[str, ...]) -> DataFrame:
    """Role summary of rows calibrated with a fit's persistent curves, out-of-distribution campaigns counted."""
    return D.role_summary(_diagnosed(rows, settings, done, features))


def write_evaluation(told: Evaluation, path: str) -> None:
    """campaigns, roles and run as tables under path."""
    for name in ("campaigns", "roles", "run"):
        getattr(told, name).write.mode("overwrite").parquet(f"{path}/{name}")
