"""Reading, checking and normalising measurement files, campaign settings and registries."""

from __future__ import annotations

import re

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import Window

from ..functions.spectra import is_valid_spectrum
from ..operators.quantiles import counted
from .delimited import record_reader

# The columns of an acquisition file, those that are numbers, and of a campaign's metadata file.
ACQUISITION_COLUMNS = (
    "id", "mac", "campaign_id", "pxx", "start_freq_hz", "end_freq_hz", "timestamp", "lat", "lng", "excursion_peak_to_peak_hz", "excursion_peak_deviation_hz",
    "excursion_rms_deviation_hz", "depth_peak_to_peak", "depth_peak_deviation", "depth_rms_deviation", "created_at",
)
LONG_COLUMNS = ("id", "campaign_id", "timestamp", "created_at")
METADATA_COLUMNS = (
    "campaign_label", "campaign_id", "start_date", "stop_date", "start_time", "stop_time", "acquisition_freq_minutes", "central_freq_MHz", "span_MHz", "sample_rate_hz",
    "lna_gain_dB", "vga_gain_dB", "rbw_kHz", "antenna_amp",
)
# Accepted names of each setting (lower case, letters and digits only) and their factor to SI units, first name first.
ALIASES = {
    "central_freq_hz": (
        ("centralfreqmhz", 1e6), ("centralfrequencymhz", 1e6), ("centerfreqmhz", 1e6), ("centerfrequencymhz", 1e6), ("centralfreqhz", 1.0),
        ("centralfrequencyhz", 1.0), ("centerfreqhz", 1.0), ("centerfrequencyhz", 1.0), ("centerfrequency", 1.0),
    ),
    "span_hz": (("spanmhz", 1e6), ("bandwidthmhz", 1e6), ("span", 1e6), ("spanhz", 1.0), ("bandwidthhz", 1.0)),
    "rbw_hz": (("rbwkhz", 1e3), ("resolutionbandwidthkhz", 1e3), ("rbw", 1.0), ("rbwhz", 1.0), ("resolutionbandwidthhz", 1.0)),
    "lna_gain_db": (("lnagaindb", 1.0), ("lnagain", 1.0)),
    "vga_gain_db": (("vgagaindb", 1.0), ("vgagain", 1.0)),
    "acquisition_interval_s": (
        ("acquisitionfreqminutes", 60.0), ("acquisitionintervalminutes", 60.0), ("intervalseconds", 1.0), ("acquisitionfreqseconds", 1.0), ("acquisitionintervalseconds", 1.0),
    ),
}
AMPLIFIER_ALIASES = ("antennaamp", "antennaamplifierenabled")
TRUE_WORDS, FALSE_WORDS = ("true", "1", "yes", "y", "on"), ("false", "0", "no", "n", "off")


def _number(name: str) -> str:
    return f"try_cast(trim({name}) as {'bigint' if name in LONG_COLUMNS else 'double'})"


def parse_measurements(raw: DataFrame) -> DataFrame:
    """Typed rows from raw text columns plus campaign, sensor_id and src_row; values that don't parse become null."""
    have = [c for c in ACQUISITION_COLUMNS if c in raw.columns]
    typed = raw.select("campaign", "sensor_id", "src_row", *[F.col(c) if c in ("mac", "pxx") else F.expr(f"{_number(c)} as {c}") for c in have])
    return typed.withColumn("pxx_db", F.from_json("pxx", "array<double>")).drop("pxx").withColumnRenamed("timestamp", "ts_ms").withColumn("n_bins", F.size("pxx_db"))


#: Headers are one row for each file; beyond so many they are joined by shuffle.
BROADCAST_FILES = 10_000
_PLACE = r"(?:[^/=]+=)?([^/]+)/(?:[^/=]+=)?([^/]+)\.csv(?:/[^/]+)?$"


def read_measurements(spark: SparkSession, root: str, campaigns: list[str] | None = None) -> DataFrame:
    """All sensor files root/<campaign>/<sensor>.csv but metadata.csv; a <sensor>.csv may also be a folder of part files.

    Every file's columns are found by the names in its own header, so files with other columns, or with the same in
    another order, may lie together, whatever their number; a file without a pxx column is an error. src_row is the id
    column where there is one, else the record's place, which grows along its file. Large files are read by many tasks.
    """
    paths = [f"{root}/{c}/*.csv" for c in campaigns] if campaigns else [f"{root}/*/*.csv"]
    read = record_reader(spark, paths, but=r"metadata\.csv(?:/[^/]+)?$")
    is_header = F.exists("cells", lambda c: F.coalesce(F.trim(c) == "pxx", F.lit(False)))
    # what belongs to a file is looked up once for it; quotes may lie inside the word
    headers = read('p"*x"*x').filter(is_header).groupBy("file").agg(F.min_by(F.transform("cells", lambda c: F.regexp_replace(F.trim(c), "^\ufeff", "")), "place").alias("names"))
    at = F.struct(*[(F.array_position("names", F.lit(c)).cast("int") - 1).alias(c) for c in ACQUISITION_COLUMNS])
    headers = counted(headers.select("file", F.regexp_extract("file", _PLACE, 1).alias("campaign"), F.regexp_extract("file", _PLACE, 2).alias("sensor_id"), at.alias("at")), BROADCAST_FILES)
    rows = read(None).filter(~is_header).join(headers, "file", "left")
    known = F.when(F.col("at").isNull(), F.raise_error(F.concat(F.lit("no pxx column in "), F.col("file"))).cast(headers.schema["at"].dataType)).otherwise(F.col("at"))
    rows = rows.withColumn("at", known)
    value = {c: F.get("cells", F.col("at")[c]) for c in ACQUISITION_COLUMNS}
    keyed = rows.select("campaign", "sensor_id", F.coalesce(value["id"].try_cast("bigint"), F.col("place")).alias("src_row"), *[v.alias(c) for c, v in value.items()])
    return parse_measurements(keyed)


def list_campaigns(measurements: DataFrame) -> DataFrame:
    return measurements.select("campaign").distinct()


def measurement_problem() -> Column:
    """The first rule that a row breaks, or null."""
    return (
        F.when(F.col("pxx_db").isNull(), "spectrum is no array")
        .when(F.size("pxx_db") < 2, "fewer than two values")
        .when(~is_valid_spectrum(F.col("pxx_db")), "value missing or not finite")
        .when(F.col("start_freq_hz").isNull() | F.col("end_freq_hz").isNull(), "frequency missing")
        .when(F.col("ts_ms").isNull(), "timestamp missing")
    )


def invalid_measurements(rows: DataFrame) -> DataFrame:
    """Rows to quarantine, each with the first rule that it breaks."""
    return rows.withColumn("problem", measurement_problem()).filter("problem is not null")


def repeated_sensors(rows: DataFrame) -> DataFrame:
    """campaign, sensor_id, files: sensors that come from more than one file; rows have the column file."""
    return rows.groupBy("campaign", "sensor_id").agg(F.count_distinct("file").alias("files")).filter("files > 1")


def grid_problems(rows: DataFrame, by: tuple[str, ...] = ("campaign",)) -> DataFrame:
    """by, grids: campaigns (or, by campaign and sensor_id, sensors) whose rows lie on more than one frequency grid."""
    return rows.groupBy(*by).agg(F.count_distinct(F.struct("start_freq_hz", "end_freq_hz", F.size("pxx_db"))).alias("grids")).filter("grids > 1")


def require_valid(rows: DataFrame) -> DataFrame:
    """rows, failing at the first invalid one."""
    bad = ~is_valid_spectrum(F.col("pxx_db")) | F.col("start_freq_hz").isNull() | F.col("end_freq_hz").isNull() | F.col("ts_ms").isNull()
    return rows.withColumn("pxx_db", F.when(bad, F.raise_error(F.concat(F.lit("invalid measurement "), F.coalesce(F.col("src_row").cast("string"), F.lit("?")))).cast("array<double>")).otherwise(F.col("pxx_db")))


def ingest_measurements(raw: DataFrame, mac: Column, campaign_id: Column) -> DataFrame:
    """The acquisition columns from landed JSON rows: blank mac and campaign_id filled, rows without pxx dropped, pxx as compact JSON.

    Of the other columns, text that is no number becomes null.
    """
    pxx = F.col("pxx") if dict(raw.dtypes)["pxx"] == "string" else F.to_json("pxx")
    out = raw.withColumn("pxx", F.regexp_replace(pxx, r"\s+", "")).filter("pxx is not null and pxx not in ('', 'null')")
    out = out.withColumn("mac", F.coalesce(F.nullif(F.trim(F.col("mac")), F.lit("")), mac) if "mac" in raw.columns else mac)
    out = out.withColumn("campaign_id", F.coalesce(F.expr("try_cast(campaign_id as bigint)"), campaign_id) if "campaign_id" in raw.columns else campaign_id)
    kept = lambda c: F.col(c) if c in ("mac", "pxx", "campaign_id") else F.when(F.expr(_number(c)).isNotNull(), F.trim(c)).alias(c)
    return out.select(*[kept(c) if c in out.columns else F.lit(None).cast("string").alias(c) for c in ACQUISITION_COLUMNS])


def ingest_report(registry: DataFrame, campaigns: DataFrame, raw: DataFrame, kept: DataFrame) -> DataFrame:
    """campaign, label, rows, reason for every registered sensor of every campaign; raw and kept have campaign, label."""
    n = lambda df, c: df.groupBy("campaign", "label").agg(F.count(F.lit(1)).alias(c))
    all_pairs = campaigns.select("campaign").distinct().withColumn("j", F.lit(1)).join(F.broadcast(registry.select("label").withColumn("j", F.lit(1))), "j").drop("j")  # registries are lists of sensors
    out = all_pairs.join(n(raw, "raw"), ["campaign", "label"], "left").join(n(kept, "rows"), ["campaign", "label"], "left").fillna(0, ["raw", "rows"])
    return out.select("campaign", "label", "rows", F.when(F.col("raw") == 0, "no data").when(F.col("rows") == 0, "nothing left after filter").otherwise("saved").alias("reason"))


PAYLOAD = "name string, schedule struct<start_date: string, end_date: string, start_time: string, end_time: string, interval_seconds: double>, config struct<rbw: double, span: double, antenna: string, lna_gain: double, vga_gain: double, antenna_amp: string, center_freq_hz: double, sample_rate_hz: double, centerFrequency: double>"


def permissive_boolean(col: Column) -> Column:
    word = F.lower(F.trim(col.cast("string")))
    return F.when(word.isin(*TRUE_WORDS), True).when(word.isin(*FALSE_WORDS), False)


def parse_campaign_payload(raw: DataFrame) -> DataFrame:
    """Typed settings in SI units from payload (JSON text), with problem naming the first required field that is missing."""
    p = raw.withColumn("p", F.from_json("payload", PAYLOAD))
    out = p.select(
        "*", F.col("p.name").alias("name"), F.col("p.schedule.start_date").alias("start_date"), F.col("p.schedule.end_date").alias("stop_date"), F.col("p.schedule.start_time").alias("start_time"), F.col("p.schedule.end_time").alias("stop_time"),
        F.col("p.schedule.interval_seconds").alias("acquisition_interval_s"), F.coalesce("p.config.center_freq_hz", "p.config.centerFrequency").alias("central_freq_hz"), (F.col("p.config.span") * 1e6).alias("span_hz"),
        F.col("p.config.rbw").alias("rbw_hz"), F.col("p.config.lna_gain").alias("lna_gain_db"), F.col("p.config.vga_gain").alias("vga_gain_db"), permissive_boolean(F.col("p.config.antenna_amp")).alias("antenna_amp"), F.col("p.config.sample_rate_hz").alias("sample_rate_hz"),
    )
    needed = ("name", "acquisition_interval_s", "central_freq_hz", "span_hz", "rbw_hz", "lna_gain_db", "vga_gain_db", "antenna_amp")
    return out.drop("p", "payload").withColumn("problem", F.coalesce(*[F.when(F.col(c).isNull(), F.lit(f"{c} missing")) for c in needed]))


def plain_number(col: Column) -> Column:
    """A number as text without trailing zeros, to twelve significant digits."""
    scale = F.pow(F.lit(10.0), F.lit(11) - F.floor(F.log10(F.abs(col))))
    short = F.when(col == 0, F.lit(0.0)).otherwise(F.round(col * scale) / scale)
    return F.when((short == F.floor(short)) & (F.abs(short) < 1e12), short.cast("bigint").cast("string")).otherwise(F.regexp_replace(F.format_string("%.12f", short), r"\.?0+$", ""))


def build_metadata_row(settings: DataFrame) -> DataFrame:
    """The metadata columns in display units from parse_campaign_payload() rows with campaign_label and campaign_id."""
    return settings.select(
        "campaign_label", F.col("campaign_id").cast("string").alias("campaign_id"), "start_date", "stop_date", "start_time", "stop_time", plain_number(F.col("acquisition_interval_s") / 60).alias("acquisition_freq_minutes"),
        plain_number(F.col("central_freq_hz") / 1e6).alias("central_freq_MHz"), plain_number(F.col("span_hz") / 1e6).alias("span_MHz"), plain_number(F.col("sample_rate_hz")).alias("sample_rate_hz"), plain_number(F.col("lna_gain_db")).alias("lna_gain_dB"),
        plain_number(F.col("vga_gain_db")).alias("vga_gain_dB"), plain_number(F.col("rbw_hz") / 1e3).alias("rbw_kHz"), F.col("antenna_amp").cast("string").alias("antenna_amp"),
    )


def load_campaign_config(metadata: DataFrame, order: str = "row") -> DataFrame:
    """campaign and its seven settings in SI units from the first metadata row; problem names what is missing or not positive."""
    first = metadata.withColumn("_n", F.row_number().over(Window.partitionBy("campaign").orderBy(order))).filter("_n = 1").drop("_n")
    by_key = {re.sub("[^a-z0-9]", "", c.lower()): c for c in metadata.columns}  # of two columns with one key, the last
    # The first accepted name that holds anything decides, even if it is no number.
    cols = {}
    for name, options in ALIASES.items():
        found = [F.when(F.trim(by_key[a]) != "", F.struct(F.trim(by_key[a]).alias("text"), F.lit(k).alias("factor"))) for a, k in options if a in by_key]
        chosen = F.coalesce(*found) if found else F.lit(None).cast("struct<text:string,factor:double>")
        cols[name] = chosen["text"].try_cast("double") * chosen["factor"]
    amplifier = [F.col(by_key[a]) for a in AMPLIFIER_ALIASES if a in by_key]
    cols["antenna_amp"] = permissive_boolean(F.coalesce(*[F.when(F.trim(c) != "", c) for c in amplifier])) if amplifier else F.lit(None).cast("boolean")
    out = first.select("campaign", *[c.alias(n) for n, c in cols.items()])
    bad = [F.when(F.col(c).isNull(), F.lit(f"{c} missing")) for c in cols] + [F.when(F.col(c) <= 0, F.lit(f"{c} not positive")) for c in ("central_freq_hz", "span_hz", "rbw_hz", "acquisition_interval_s")]
    return out.withColumn("problem", F.coalesce(*bad))


def content_fingerprint(rows: DataFrame, configs: DataFrame) -> DataFrame:
    """campaign, sha256 of its label, sensors, grid and settings in one canonical JSON form."""
    support = rows.groupBy("campaign").agg(F.sort_array(F.collect_set("sensor_id")).alias("sensors"), F.min(F.struct("start_freq_hz", "end_freq_hz", "n_bins")).alias("grid"))
    both = support.join(configs, "campaign", "left")
    return both.select("campaign", F.sha2(F.to_json(F.struct(*sorted(both.columns))), 256).alias("sha256"))


def write_curves(curves: DataFrame, path: str) -> None:
    """Fitted curves by campaign; reading the path gives the same values."""
    curves.write.mode("overwrite").partitionBy("campaign").parquet(path)
