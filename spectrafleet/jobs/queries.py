"""One query for each operator, over the measurement tables that sources.fixtures derives."""

from __future__ import annotations

from collections.abc import Callable

import numpy as np
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import Window

from ..functions import spectra as S
from ..operators import alignment as A
from ..operators import calibration as C
from ..operators import diagnostics as D
from ..operators import fit
from ..operators import ranking as R
from ..operators import records as P
from ..operators import sets as X
from ..sources import artifacts
from ..sources import fixtures as T
from ..sources import measurements as M
from ..streaming import calibrate as stream
from . import composites as jobs

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
TOLERANCE_MS = 1_800_000


def query(f: Callable[[SparkSession, str], DataFrame]) -> Callable[[SparkSession, str], DataFrame]:
    QUERIES[f.__name__] = f
    return f


def rounded(df: DataFrame, digits: int = 6) -> DataFrame:
    return df.select(*[F.round(c, digits).alias(c) if t == "double" else F.col(c) for c, t in df.dtypes])


def curves(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Gain, floor and variance curves of each sensor of the spectra table."""
    number = F.expr("cast(substring(sensor_id, 5) as double)")
    bins = F.sequence(F.lit(0), F.col("n_bins") - 1)
    rows = T.psd(spark, sf_dir).select("sensor_id", "n_bins").distinct()
    return rows.select(
        "sensor_id",
        F.transform(bins, lambda i: 1.0 + 0.05 * number + 0.001 * i).alias("gain"),
        F.transform(bins, lambda i: 1e-7 * number * (1.0 + 0.01 * i)).alias("floor"),
        F.transform(bins, lambda i: 1e-12 * (number + i)).alias("var"),
    )


def calibrated(spark: SparkSession, sf_dir: str) -> DataFrame:
    return C.calibrate(T.psd(spark, sf_dir), curves(spark, sf_dir))


@query
def sensor_ranking(spark, sf_dir):
    return rounded(R.sensor_ranking(T.psd(spark, sf_dir)))


@query
def db_to_linear(spark, sf_dir):
    return rounded(T.psd(spark, sf_dir).select("campaign", "record_idx", "sensor_id", (S.array_sum(S.db_to_linear(F.col("pxx_db"))) * 1e6).alias("total_uw")))


@query
def linear_to_db(spark, sf_dir):
    power = F.transform(S.db_to_linear(F.col("pxx_db")), lambda x: x - 1e-6)
    return rounded(T.psd(spark, sf_dir).select("campaign", "record_idx", "sensor_id", S.array_mean(S.linear_to_db(power)).alias("mean_db")))


@query
def frequency_axis(spark, sf_dir):
    axis = T.psd(spark, sf_dir).select("campaign", "sensor_id", "n_bins", S.frequency_axis(F.col("start_freq_hz"), F.col("end_freq_hz"), F.col("n_bins")).alias("f")).distinct()
    return rounded(axis.select("campaign", "sensor_id", F.size("f").alias("n"), F.get("f", 1).alias("second_hz"), F.element_at("f", -1).alias("last_hz"), (S.array_sum(F.col("f")) / 1e6).alias("sum_mhz")), 3)


@query
def noise_floor(spark, sf_dir):
    return rounded(T.psd(spark, sf_dir).select("campaign", "record_idx", "sensor_id", S.noise_floor("pxx_db").alias("noise_floor_db")))


@query
def curve_roughness(spark, sf_dir):
    return rounded(T.psd(spark, sf_dir).select("campaign", "record_idx", "sensor_id", S.curve_roughness(F.col("pxx_db")).alias("roughness")))


@query
def gain_edge_jump_ratio(spark, sf_dir):
    return rounded(T.psd(spark, sf_dir).select("campaign", "record_idx", "sensor_id", S.edge_jump_ratio(F.col("pxx_db")).alias("ratio")))


@query
def validate_measurements(spark, sf_dir):
    rows = T.psd(spark, sf_dir).withColumn("pxx_db", F.when(F.col("src_row") % 7 == 0, F.slice("pxx_db", 1, 1)).when(F.col("src_row") % 11 == 0, F.lit(None)).otherwise(F.col("pxx_db")))
    rows = rows.withColumn("ts_ms", F.when(F.col("src_row") % 13 != 0, F.col("ts_ms"))).withColumn("end_freq_hz", F.when(F.col("src_row") % 17 != 0, F.col("end_freq_hz")))
    bad = M.invalid_measurements(rows).groupBy("campaign", "sensor_id", "problem").agg(F.count(F.lit(1)).alias("n"))
    good = rows.join(M.invalid_measurements(rows).select("src_row", "campaign", "sensor_id"), ["src_row", "campaign", "sensor_id"], "left_anti")
    return bad.unionByName(good.groupBy("campaign", "sensor_id").agg(F.lit("none").alias("problem"), F.count(F.lit(1)).alias("n")))


@query
def list_campaigns(spark, sf_dir):
    return T.events_series(spark, sf_dir).select("campaign").distinct()


@query
def drop_leading(spark, sf_dir):
    return A.drop_leading(T.events_series(spark, sf_dir), 3).groupBy("campaign", "sensor_id").agg(F.count(F.lit(1)).alias("n"), F.min("ts_ms").alias("first_ms"), F.sum("src_row").alias("rows_sum"))


@query
def select_record_sample(spark, sf_dir):
    rows = T.psd(spark, sf_dir)
    n = rows.groupBy("campaign", "sensor_id").agg(F.count(F.lit(1)).alias("n")).groupBy("campaign").agg(F.min("n").alias("n"))
    return rows.join(n, "campaign").filter("record_idx in (0, n div 2, n - 1)").select("campaign", "sensor_id", "record_idx", "src_row")


@query
def exclude_sensors(spark, sf_dir):
    gone = T.events_series(spark, sf_dir).filter("src_row % 50 = 0").select("campaign", "sensor_id").distinct().filter("campaign in ('c1', 'c2')")
    return X.exclude_sensors(T.events_series(spark, sf_dir), gone).groupBy("campaign", "sensor_id").agg(F.count(F.lit(1)).alias("n"))


@query
def resolve_global_exclusions(spark, sf_dir):
    ids = T.psd(spark, sf_dir).select(F.concat(F.lit(" "), F.when(F.col("src_row") % 2 == 0, F.col("sensor_id")).otherwise(F.lit("Node2"))).alias("sensor_id")).filter("trim(sensor_id) in ('Node2', 'Node4')")
    return X.resolve_global_exclusions(T.psd(spark, sf_dir), ids)[0]


@query
def unknown_sensor_check(spark, sf_dir):
    return X.unknown_sensors(T.cells(spark, sf_dir), X.sensor_registry(T.psd(spark, sf_dir)))


@query
def sensor_registry(spark, sf_dir):
    return X.sensor_registry(T.psd(spark, sf_dir))


@query
def sensor_pairs(spark, sf_dir):
    return P.sensor_pairs(T.psd(spark, sf_dir))


@query
def reference_weights(spark, sf_dir):
    rows = T.cells(spark, sf_dir)
    return rounded(X.reference_weights(X.sensor_registry(rows), rows.groupBy("sensor_id").agg(F.count(F.lit(1)).cast("double").alias("weight"))))


def _labels(rows):
    return rows.groupBy("campaign").agg(F.min("src_row").alias("pos")).select(F.col("campaign").alias("label"), "pos")


@query
def workflow_union(spark, sf_dir):
    return X.workflow_union(_labels(T.events_series(spark, sf_dir)), _labels(T.psd(spark, sf_dir)))


@query
def split_overlap(spark, sf_dir):
    return X.split_violations(_labels(T.events_series(spark, sf_dir)), _labels(T.psd(spark, sf_dir)))


@query
def missing_campaigns(spark, sf_dir):
    return X.missing_campaigns(T.events_series(spark, sf_dir), T.psd(spark, sf_dir))


@query
def infer_tolerance(spark, sf_dir):
    return A.infer_tolerance(T.events_series(spark, sf_dir).withColumn("ts_ms", F.expr("ts_ms div 3000")))


@query
def select_anchor(spark, sf_dir):
    return A.select_anchor(T.events_series(spark, sf_dir))


@query
def nearest_asof(spark, sf_dir):
    rows = T.events_series(spark, sf_dir)
    tol = rows.select("campaign").distinct().withColumn("tolerance_ms", F.lit(TOLERANCE_MS).cast("long"))
    return A.nearest_asof(rows, tol)


@query
def align_campaign(spark, sf_dir):
    return A.align(T.psd(spark, sf_dir), 1000)


@query
def align_greedy(spark, sf_dir):
    return A.align(T.events_series(spark, sf_dir), TOLERANCE_MS * 4)


@query
def align_with_pruning(spark, sf_dir):
    return A.align(T.events_series(spark, sf_dir), TOLERANCE_MS // 60, allow_pruning=True)


@query
def align_report(spark, sf_dir):
    rows = T.psd(spark, sf_dir)
    return rounded(A.align_report(rows, A.align(rows, 1000)))


@query
def pairwise_match_count(spark, sf_dir):
    return A.pairwise_match_count(T.events_series(spark, sf_dir), TOLERANCE_MS)


@query
def stack_row_aligned(spark, sf_dir):
    return X.stack_row_aligned(T.psd(spark, sf_dir).drop("record_idx"))[0].select("campaign", "sensor_id", "record_idx", "src_row")


@query
def dataset_summary(spark, sf_dir):
    return rounded(R.dataset_summary(T.psd(spark, sf_dir)))


@query
def sensor_integrity(spark, sf_dir):
    return rounded(R.sensor_integrity(T.psd(spark, sf_dir)))


@query
def campaign_inspection(spark, sf_dir):
    return rounded(R.campaign_inspection(T.psd(spark, sf_dir)))


@query
def psd_histogram(spark, sf_dir):
    return rounded(R.psd_histogram(T.cells(spark, sf_dir)))


@query
def histogram_summary(spark, sf_dir):
    return rounded(R.histogram_summary(T.cells(spark, sf_dir), value_range=(10.0, 50.0)))


@query
def distribution_similarity(spark, sf_dir):
    return rounded(R.distribution_similarity(R.psd_histogram(R.spectra_values(T.psd(spark, sf_dir)))))


@query
def record_correlation(spark, sf_dir):
    return rounded(P.record_matrix(T.psd(spark, sf_dir), "pxx_db", P.pearson))


@query
def mean_correlation_matrix(spark, sf_dir):
    return rounded(R.mean_correlation_matrix(T.psd(spark, sf_dir)))


@query
def rank_stability(spark, sf_dir):
    return rounded(R.rank_stability(R.record_scores(T.psd(spark, sf_dir))))


@query
def dataset_overview(spark, sf_dir):
    return rounded(R.dataset_overview(R.sensor_ranking(T.psd(spark, sf_dir))))


@query
def reliable_sensor(spark, sf_dir):
    rows = T.psd(spark, sf_dir)
    return R.reliable_sensor(R.sensor_ranking(rows), R.distribution_similarity(R.psd_histogram(R.spectra_values(rows))))


@query
def mean_psd_curve(spark, sf_dir):
    rows = T.psd(spark, sf_dir)
    return rounded(R.mean_psd_curve(rows, R.sensor_ranking(rows)))


@query
def corpus_stats(spark, sf_dir):
    out = C.corpus_stats(T.psd(spark, sf_dir), exact=True)
    return rounded(out.select(*[(F.col(c) * (1e12 if c.startswith("var") else 1e6 if c == "q05" else 1)).alias(c) for c in out.columns]))


@query
def config_stats(spark, sf_dir):
    return rounded(C.config_stats(T.configs(spark, sf_dir).filter("role = 'train'"), T.FEATURES), 4)


@query
def trust_envelope(spark, sf_dir):
    rows = T.configs(spark, sf_dir)
    g = C.config_geometry(rows.filter("role = 'train'"), T.FEATURES)
    out = C.envelope_checks(rows, g)
    return rounded(out.select("config_id", "max_abs_z", F.array_join("out_of_range", ",").alias("out_of_range"), "outside_envelope"), 4)


@query
def trust_diagnostics(spark, sf_dir):
    rows = T.configs(spark, sf_dir).withColumns({"start_freq_hz": F.col("central_freq_hz") - F.col("span_hz"), "end_freq_hz": F.col("central_freq_hz") + F.col("span_hz"), "n_bins": F.lit(64)})
    g = C.config_geometry(rows.filter("role = 'train'"), T.FEATURES)
    return rounded(C.trust_diagnostics(rows, g, 80e6, 100e6).select("config_id", "bins_below", "bins_above", "distance", "tail_probability", "outside_envelope", "is_ood"))


@query
def calibration_map(spark, sf_dir):
    return rounded(calibrated(spark, sf_dir).select("campaign", "record_idx", "sensor_id", (S.array_sum(F.col("calibrated_power")) * 1e6).alias("total_uw")))


@query
def propagated_variance(spark, sf_dir):
    return rounded(C.curve_variances(curves(spark, sf_dir)).select("sensor_id", (S.array_sum(F.col("propagated_var")) * 1e12).alias("sum_var"), "uncertainty"))


@query
def curve_summary(spark, sf_dir):
    return rounded(C.curve_summary(curves(spark, sf_dir)))


@query
def sensor_training_summary(spark, sf_dir):
    rows = T.psd(spark, sf_dir).select("campaign", "sensor_id").distinct().join(curves(spark, sf_dir), "sensor_id")
    return rounded(C.sensor_training_summary(rows, X.reference_weights(X.sensor_registry(rows))))


@query
def pairwise_rmse(spark, sf_dir):
    return rounded(D.pairwise_rmse(T.psd(spark, sf_dir), "pxx_db"))


@query
def log_dispersion(spark, sf_dir):
    return rounded(P.log_dispersion(calibrated(spark, sf_dir), "calibrated_power"))


@query
def pairwise_log_correlation(spark, sf_dir):
    return rounded(D.pairwise_log_correlation(calibrated(spark, sf_dir), "calibrated_power"))


@query
def overlay_limits(spark, sf_dir):
    return rounded(D.overlay_limits(D.with_db(calibrated(spark, sf_dir))))


@query
def deployment_summary(spark, sf_dir):
    out = D.deployment_summary(calibrated(spark, sf_dir), curves(spark, sf_dir))
    return rounded(out.select("campaign", *[(F.col(c) * (1 if "gain" in c else 1e12 if c == "mean_var" else 1e6)).alias(c) for c in out.columns if c != "campaign"]))


def _diagnostics(spark, sf_dir):
    rows = calibrated(spark, sf_dir)
    roles = rows.select("campaign").distinct().withColumn("role", F.when(F.expr("cast(substring(campaign, 2) as int) % 2 = 0"), "train").otherwise("test"))
    trust = roles.select("campaign", (F.col("campaign") == "c1").alias("is_ood"))
    return D.campaign_diagnostics(rows, roles, trust)


@query
def campaign_diagnostics(spark, sf_dir):
    return rounded(_diagnostics(spark, sf_dir))


@query
def role_summary(spark, sf_dir):
    return rounded(D.role_summary(_diagnostics(spark, sf_dir)))


@query
def objective_history(spark, sf_dir):
    steps = T.events_series(spark, sf_dir).select(F.concat_ws("/", "campaign", "sensor_id").alias("run"), F.col("src_row").alias("step"), F.col("value").alias("objective"))
    return rounded(D.objective_history(steps), 4)


def _landed(spark, sf_dir):
    """Landed JSON rows: a spectrum of three values from each event, some without mac or spectrum."""
    rows = spark.read.parquet(f"{sf_dir}/events.parquet")
    pxx = F.when(F.col("event_id") % 9 == 0, F.lit(None)).when(F.col("event_id") % 10 == 0, F.lit("")).otherwise(F.format_string("[%d, %d,%d]", F.col("event_id") % 7, F.col("event_id") % 5, F.col("user_id") % 3))
    return rows.select(
        F.col("event_id").cast("string").alias("id"), F.when(F.col("event_id") % 4 == 0, F.lit(" ")).otherwise(F.concat(F.lit("m"), F.col("user_id").cast("string"))).alias("mac"), F.when(F.col("event_id") % 3 == 0, F.col("user_id").cast("string")).alias("campaign_id"),
        pxx.alias("pxx"), F.lit("88e6").alias("start_freq_hz"), F.lit("108e6").alias("end_freq_hz"), F.expr("cast(unix_micros(cast(ts as timestamp)) div 1000 as string)").alias("timestamp"), F.concat(F.lit("c"), F.col("user_id") % 10).alias("campaign"), F.col("event_type").alias("label"),
    )


@query
def ingest_measurements(spark, sf_dir):
    return M.ingest_measurements(_landed(spark, sf_dir), F.lit("fallback"), F.lit(7).cast("bigint"))


@query
def ingest_report(spark, sf_dir):
    raw = _landed(spark, sf_dir).filter("not (campaign = 'c1' and label = 'click')")
    kept = raw.filter("pxx is not null and pxx <> '' and not (campaign = 'c2' and label = 'view')")
    return M.ingest_report(raw.select("label").distinct(), raw.select("campaign"), raw, kept)


@query
def read_measurements(spark, sf_dir):
    """Landed rows as sensor files, of two sensors with other columns than the rest, read back and checked."""
    root = C.work_folder(spark)
    raw = _landed(spark, sf_dir).withColumn("pxx", F.when(F.col("id").cast("bigint") % 13 == 0, F.lit("[1,\"x\"]")).otherwise(F.col("pxx"))).withColumn("sensor_id", F.concat("label", F.lit(".csv")))
    slim = F.col("label").isin("click", "view")
    for rows, cols in ((raw.filter(slim), ("pxx", "start_freq_hz", "end_freq_hz", "timestamp")), (raw.filter(~slim), ("id", "mac", "campaign_id", "pxx", "timestamp", "end_freq_hz", "start_freq_hz"))):
        rows.select(*cols, "campaign", "sensor_id").write.mode("append").partitionBy("campaign", "sensor_id").option("header", True).option("escape", '"').csv(root)
    out = M.read_measurements(spark, root)
    # one pass over the files; sensors with rows of both kinds
    told = out.select("campaign", "sensor_id", "pxx_db", S.is_valid_spectrum(F.col("pxx_db")).alias("good"), M.measurement_problem().isNotNull().alias("bad"))
    counts = told.groupBy("campaign", "sensor_id").agg(F.count_if("good").alias("n_good"), F.sum(F.when(F.col("good"), S.array_sum(F.col("pxx_db")))).alias("total"), F.count_if("bad").alias("n_bad"))
    return rounded(counts.filter("n_good > 0 and n_bad > 0"))


def _payloads(spark, sf_dir):
    part = spark.read.parquet(f"{sf_dir}/part.parquet")
    text = F.format_string(
        '{"name":"campaign %d","schedule":{"start_date":"2024-01-01","end_date":"2024-01-02","start_time":"00:00","end_time":"23:59","interval_seconds":%d},"config":{"rbw":%d,"span":%d,"lna_gain":%d,"vga_gain":%d,"antenna_amp":"%s","centerFrequency":%d}}',
        F.col("p_partkey"), 60 + F.col("p_size") * 15, 1000 * (1 + F.col("p_size") % 5), F.col("p_size"), F.col("p_size") % 40, F.col("p_size") % 20, F.when(F.col("p_size") % 3 == 0, "maybe").when(F.col("p_size") % 3 == 1, "Yes").otherwise("0"), 88000000 + 125000 * F.col("p_size"),
    )
    return M.parse_campaign_payload(part.select(F.col("p_partkey").alias("campaign_id"), F.concat(F.lit("c"), "p_partkey").alias("campaign_label"), text.alias("payload")))


@query
def parse_campaign_payload(spark, sf_dir):
    return _payloads(spark, sf_dir).select("campaign_id", "name", "acquisition_interval_s", "central_freq_hz", "span_hz", "rbw_hz", "antenna_amp", "problem")


@query
def build_metadata_row(spark, sf_dir):
    return M.build_metadata_row(_payloads(spark, sf_dir)).select("campaign_label", "campaign_id", "acquisition_freq_minutes", "central_freq_MHz", "span_MHz", "rbw_kHz", "antenna_amp")


@query
def load_campaign_config(spark, sf_dir):
    rows = M.build_metadata_row(_payloads(spark, sf_dir)).withColumns({"campaign": F.concat(F.lit("g"), F.expr("cast(campaign_id as bigint) % 50")), "row": F.col("campaign_id").cast("bigint")})
    return rounded(M.load_campaign_config(rows.drop("campaign_id")), 3)


@query
def load_registry(spark, sf_dir):
    rows = spark.read.parquet(f"{sf_dir}/part.parquet").select(F.concat(F.lit(" r"), (F.col("p_partkey") % 997).cast("string"), F.lit(" ")).alias("label"), F.when(F.col("p_partkey") % 5 == 0, "x").otherwise(F.col("p_partkey").cast("string")).alias("id"))
    return X.registry_problems(rows).groupBy("problem").agg(F.count(F.lit(1)).alias("n"))


@query
def resolve_sensors(spark, sf_dir):
    registry = X.sensor_registry(T.cells(spark, sf_dir)).select(F.col("sensor_id").alias("label"), F.when(F.col("sensor_id") == "Node3", " ").otherwise(F.concat(F.lit("mac-"), "sensor_id")).alias("mac"))
    chosen = spark.read.parquet(f"{sf_dir}/supplier.parquet").select(F.concat(F.lit("Node"), (F.col("s_suppkey") * 5 % 11).cast("string")).alias("label"), F.col("s_suppkey").alias("pos"))
    return X.resolve_sensors(registry, chosen)


@query
def content_fingerprint(spark, sf_dir):
    out = M.content_fingerprint(T.psd(spark, sf_dir), T.psd(spark, sf_dir).groupBy("campaign").agg(F.count(F.lit(1)).alias("n")))
    return out


@query
def write_calibrated(spark, sf_dir):
    path = C.work_folder(spark)
    artifacts.write_calibrated(calibrated(spark, sf_dir), path)
    return rounded(spark.read.parquet(path).groupBy("campaign", "sensor_id").agg(F.count(F.lit(1)).alias("n"), (F.sum(S.array_sum(F.col("calibrated_power"))) * 1e6).alias("total_uw")))


@query
def stream_calibrate(spark, sf_dir):
    """Streams the spectra table from files to calibrated files, and reads them."""
    root = C.work_folder(spark)
    T.psd(spark, sf_dir).repartition(4).write.parquet(f"{root}/in")
    rows = spark.read.parquet(f"{root}/in")
    done = stream.start(stream.stream_calibrate(stream.read_stream(spark, f"{root}/in", rows.schema), curves(spark, sf_dir)), f"{root}/out", f"{root}/log")
    done.awaitTermination()
    return rounded(spark.read.parquet(f"{root}/out").groupBy("campaign", "sensor_id").agg(F.count(F.lit(1)).alias("n"), (F.sum(S.array_sum(F.col("calibrated_power"))) * 1e6).alias("total_uw")))


@query
def stream_quarantine(spark, sf_dir):
    """Streams spectra, some of them broken, of an unknown sensor or of a refused configuration, into two sinks, and counts both."""
    root = C.work_folder(spark)
    rows = T.psd(spark, sf_dir).withColumn("config_id", F.expr("cast(substring(campaign, 2) as bigint)"))
    rows = rows.withColumn("pxx_db", F.when(F.col("src_row") % 7 == 0, F.slice("pxx_db", 1, 1)).otherwise(F.col("pxx_db"))).withColumn("sensor_id", F.when(F.col("src_row") % 11 == 0, "Node99").otherwise(F.col("sensor_id")))
    rows.repartition(4).write.parquet(f"{root}/in")
    trust = rows.select("config_id").distinct().withColumn("is_ood", F.col("config_id") == 2)
    stream_rows = stream.read_stream(spark, f"{root}/in", rows.schema)
    done = stream.start_judged(stream.judged(stream_rows, curves(spark, sf_dir), trust=trust, allow_ood=False), f"{root}/out", f"{root}/quarantine", f"{root}/log")
    done.awaitTermination()
    good = spark.read.parquet(f"{root}/out").groupBy("campaign", "sensor_id").agg(F.lit("none").alias("problem"), F.count(F.lit(1)).alias("n"), (F.sum(S.array_sum(F.col("calibrated_power"))) * 1e6).alias("total_uw"), (F.sum(S.array_sum(F.col("propagated_var"))) * 1e12).alias("total_var"))
    bad = spark.read.parquet(f"{root}/quarantine").groupBy("campaign", "sensor_id", "problem").agg(F.count(F.lit(1)).alias("n"), F.lit(None).cast("double").alias("total_uw"), F.lit(None).cast("double").alias("total_var"))
    return rounded(good.unionByName(bad))


def corpus(spark, sf_dir):
    """Spectra with one configuration for each campaign, and the campaign's reliable sensor."""
    rows = T.psd(spark, sf_dir)
    number = F.expr("cast(substring(campaign, 2) as bigint)")
    settings = rows.select("campaign", number.alias("config_id")).distinct().join(T.configs(spark, sf_dir), "config_id")
    reliable = rows.groupBy("campaign").agg(F.min("sensor_id").alias("reliable_sensor"))
    return rows, settings, reliable


@query
def fit_corpus(spark, sf_dir):
    rows, settings, reliable = corpus(spark, sf_dir)
    done = fit.fit(rows, settings, reliable, T.FEATURES)
    made = fit.campaign_curves(done.model, done.state)
    return made.select("campaign", "sensor_id", F.size("gain").alias("n"), S.array_mean(F.col("gain")).alias("mean_gain"), (S.array_mean(F.col("floor")) * done.model.power_scale).alias("mean_floor"))


@query
def evaluate_corpus(spark, sf_dir):
    rows, settings, reliable = corpus(spark, sf_dir)
    done = fit.fit(rows, settings, reliable, T.FEATURES)
    return jobs.evaluate_corpus(rows, settings, done, T.FEATURES)


@query
def rank_campaigns(spark, sf_dir):
    ranking, distribution = jobs.rank_campaigns(T.psd(spark, sf_dir), 1000)
    return rounded(ranking.join(distribution.select("campaign", "sensor_id", "is_outlier", F.col("score").alias("similarity")), ["campaign", "sensor_id"]))


@query
def prepare_corpus(spark, sf_dir):
    rows, settings, _ = corpus(spark, sf_dir)
    gone = rows.filter("campaign = 'c1' and sensor_id = 'Node5'").select("campaign", "sensor_id").distinct()
    return rounded(jobs.prepare_corpus(rows, settings, gone, 1, 1000).overview)


@query
def spline_basis(spark, sf_dir):
    """Cubic splines over the band of each configuration, on a support somewhat wider than all bands."""
    half = F.col("span_hz") / 2
    grids = T.configs(spark, sf_dir).select("config_id", (F.col("central_freq_hz") - half).alias("start_freq_hz"), (F.col("central_freq_hz") + half).alias("end_freq_hz"), F.lit(16).alias("n_bins"))
    # Odd margins: no weight lies half-way between two rounded values.
    support = grids.agg((F.min("start_freq_hz") - 123_457.0).alias("lo"), (F.max("end_freq_hz") + 234_571.0).alias("hi")).first()
    made = C.spline_weights(grids, 8, 3, support["lo"], support["hi"])
    each = made.select("config_id", F.posexplode("basis").alias("bin", "w")).select("config_id", "bin", F.posexplode("w").alias("spline", "weight"))
    return rounded(each.filter("weight > 1e-9"))


@query
def config_geometry(spark, sf_dir):
    """The covariance of standardised training settings, with its ridge, that the geometry's precision belongs to."""
    g = C.config_geometry(T.configs(spark, sf_dir).filter("role = 'train'"), T.FEATURES)
    cov = np.linalg.inv(g.precision)
    cells = [(a, b, round(float(cov[i, j]), 5) + 0.0) for i, a in enumerate(T.FEATURES) for j, b in enumerate(T.FEATURES)]
    return spark.createDataFrame(cells, "feature_a string, feature_b string, covariance double")


def level_model(spark: SparkSession, sf_dir: str) -> fit.Model:
    """A model whose curves have a closed form, in frequency x from 0 to 1, sensor number k and h = tanh of one setting.

    Log gain is 0.05 (1 + x) (k - mean k), the floor's parameter 0.02 k + 0.5 h + 0.3 x - 3, the variance's
    0.1 k + 0.5 h + 0.2 x - 2.
    """
    sensors = sorted(r["sensor_id"] for r in T.psd(spark, sf_dir).select("sensor_id").distinct().collect())
    x = np.linspace(0.0, 1.0, 4)  # cubic splines with these coefficients give x itself
    head = lambda sensor, setting: np.stack([sensor + 0 * x, setting + 0 * x], axis=1)
    theta = {"E": np.array([[float(s[4:])] for s in sensors]), "W": np.array([[0.3]]), "b": np.array([0.1])}
    theta |= {"A0": head(0.05 * (1 + x), 0.0), "A1": head(0.02, 0.5), "A2": head(0.1, 0.5), "B0": 0 * x, "B1": 0.3 * x - 3, "B2": 0.2 * x - 2}
    even = np.full(len(sensors), 1 / len(sensors))
    return fit.Model(sensors, even, ("vga_gain_db",), np.array([5.0]), np.array([3.0]), (88e6, 108e6), 1e-3, 1e-6, fit.FitConfig(bases=(4, 4, 4), embedding=1, hidden=1), theta)


def level_state(spark: SparkSession, sf_dir: str) -> DataFrame:
    """States without deviations of the campaigns of corpus(), for level_model()."""
    rows, settings, reliable = corpus(spark, sf_dir)
    known = rows.select("campaign", "sensor_id", "start_freq_hz", "end_freq_hz", "n_bins").distinct()
    known = known.join(settings.select("campaign", F.array((F.col("vga_gain_db") - 5) / 3).alias("c")), "campaign").join(reliable, "campaign")
    zero = F.array_repeat(F.lit(0.0), F.col("n_bins"))
    return known.withColumn("reliable", F.col("sensor_id") == F.col("reliable_sensor")).drop("reliable_sensor").withColumns({d: zero for d in fit.DEVIATIONS})


def level_records(spark: SparkSession, sf_dir: str, model: fit.Model, state: DataFrame) -> DataFrame:
    """Records of corpus() with the curves of level_model()."""
    size = 24 * (state.agg(F.sum("n_bins")).first()[0] or 0)
    return fit.with_curves(fit.record_rows(corpus(spark, sf_dir)[0], model.power_scale), fit.campaign_curves(model, state), size)


@query
def evaluate_curves(spark, sf_dir):
    rows, settings, _ = corpus(spark, sf_dir)
    wanted = rows.select("campaign", "sensor_id", "start_freq_hz", "end_freq_hz", "n_bins").distinct().join(settings, "campaign").withColumn("config_id", F.col("campaign"))
    made = fit.evaluate_curves(level_model(spark, sf_dir), wanted)
    each = made.select(F.col("config_id").alias("campaign"), "sensor_id", F.posexplode(F.arrays_zip("gain", "floor", "var")).alias("bin", "at"))
    return rounded(each.select("campaign", "sensor_id", "bin", "at.gain", (F.col("at.floor") * 1e6).alias("floor"), (F.col("at.var") * 1e12).alias("var")))


def level_latent(spark: SparkSession, sf_dir: str) -> DataFrame:
    model, state = level_model(spark, sf_dir), level_state(spark, sf_dir)
    return fit.latent_update(level_records(spark, sf_dir, model, state))


@query
def latent_update(spark, sf_dir):
    each = level_latent(spark, sf_dir).select("campaign", "record_idx", F.posexplode("s").alias("bin", "s"))
    return rounded(each)


@query
def write_latent(spark, sf_dir):
    path = C.work_folder(spark) + "/latent"
    artifacts.write_latent(level_latent(spark, sf_dir), path)
    return rounded(spark.read.parquet(path).select("campaign", "record_idx", F.size("s").alias("n"), S.array_sum(F.col("s")).alias("total")))


@query
def write_curves(spark, sf_dir):
    path = C.work_folder(spark) + "/curves"
    M.write_curves(fit.campaign_curves(level_model(spark, sf_dir), level_state(spark, sf_dir)), path)
    means = [S.array_mean(F.col(c)).alias(f"mean_{c}") for c in ("gain", "floor", "var")]
    return rounded(spark.read.parquet(path).select("campaign", "sensor_id", F.size("gain").alias("n"), *means))


@query
def initial_floors(spark, sf_dir):
    """Starting floors, a tenth of each bin's 5 % quantile, as the states of the fit have them."""
    rows, settings, reliable = corpus(spark, sf_dir)
    model = level_model(spark, sf_dir)
    floors = fit.initial_floors(model, fit.record_rows(rows, model.power_scale), settings, reliable)
    each = fit.campaign_curves(model, floors).select("campaign", "sensor_id", F.posexplode("floor").alias("bin", "floor"))
    return rounded(each)


@query
def objective_and_gradient(spark, sf_dir):
    """The loss of level_model() under its latent spectra, and its slope at the levels of all floors and variances."""
    model, state = level_model(spark, sf_dir), level_state(spark, sf_dir)
    loss, grad = fit.objective_and_gradient(model, fit.round_table(state, fit.record_sums(level_records(spark, sf_dir, model, state))))
    by = model.unflat(grad)
    return rounded(spark.createDataFrame([(float(loss), float(by["B1"].sum()), float(by["B2"].sum()))], "loss double, floor_slope double, variance_slope double"), 4)


def level_penalties(spark: SparkSession, sf_dir: str) -> tuple[float, float]:
    model, state = level_model(spark, sf_dir), level_state(spark, sf_dir)
    records = fit.record_rows(corpus(spark, sf_dir)[0], model.power_scale)
    return fit.penalties(model, fit.penalised_records(records, state))[:2]


@query
def consistency_penalty(spark, sf_dir):
    return spark.createDataFrame([(round(float(level_penalties(spark, sf_dir)[0]), 6),)], "penalty double")


@query
def correlation_penalty(spark, sf_dir):
    return spark.createDataFrame([(round(float(level_penalties(spark, sf_dir)[1]), 6),)], "penalty double")
