"""Online calibration of arriving measurement files."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from ..functions.spectra import calibrate_power, db_to_linear, is_valid_spectrum, propagated_variance
from ..sources.measurements import measurement_problem

#: Curves that are broadcast to every batch, in bytes.
BROADCAST_BYTES = 32 << 20


def read_stream(spark: SparkSession, path: str, schema: str, files_per_trigger: int = 100) -> DataFrame:
    return spark.readStream.schema(schema).option("maxFilesPerTrigger", files_per_trigger).parquet(path)


def with_calibration(rows: DataFrame, curves: DataFrame, by: tuple[str, ...] = ("sensor_id",)) -> DataFrame:
    """rows with calibrated_power, propagated_var and known_sensor, from curves (by, gain, floor, var), a static table.

    Where curves belong to configurations, by names these too. Two curves of one key are an error, since they would
    repeat rows. Rows without a curve stay, with null results: a stream must not stop at them.
    """
    twice = curves.groupBy(*by).count().filter("count > 1").limit(1).collect()
    if twice:
        raise ValueError(f"more than one curve for {', '.join(str(twice[0][c]) for c in by)}; name what tells them apart in by")
    small = curves.select(*by, "gain", "floor", "var")
    size = small.agg(F.sum(24 * F.size("gain") + 64).alias("b")).first()["b"] or 0
    joined = rows.join(F.broadcast(small) if size <= BROADCAST_BYTES else small, list(by), "left")
    known = F.col("gain").isNotNull()
    power = F.when(known & is_valid_spectrum(F.col("pxx_db")), calibrate_power(db_to_linear(F.col("pxx_db")), F.col("gain"), F.col("floor")))
    return joined.select(*rows.columns, power.alias("calibrated_power"), F.when(known, propagated_variance(F.col("var"), F.col("gain"))).alias("propagated_var"), known.alias("known_sensor"))


def stream_calibrate(stream: DataFrame, curves: DataFrame, by: tuple[str, ...] = ("sensor_id",)) -> DataFrame:
    """Valid rows of a stream with_calibration(); stateless, so a lost executor only repeats its own files."""
    return with_calibration(stream.filter(is_valid_spectrum(F.col("pxx_db"))), curves, by)


def start(calibrated: DataFrame, out: str, checkpoint: str) -> StreamingQuery:
    """Append to Parquet under a checkpoint; trigger once over what is there."""
    return calibrated.writeStream.format("parquet").option("path", out).option("checkpointLocation", checkpoint).outputMode("append").trigger(availableNow=True).start()


def judged(rows: DataFrame, curves: DataFrame, by: tuple[str, ...] = ("sensor_id",), trust: DataFrame | None = None, allow_ood: bool = True) -> DataFrame:
    """rows with_calibration(), is_ood and problem: why a row is refused, or null.

    trust has is_ood by config_id, of which rows must then have a column; a configuration that it lacks is none that is
    trusted. Unless allow_ood, rows of such configurations are refused, and so get no result.
    """
    out = with_calibration(rows, curves, by)
    out = out.join(F.broadcast(trust.select("config_id", "is_ood")), "config_id", "left") if trust is not None else out.withColumn("is_ood", F.lit(False))  # one row for each configuration
    out = out.withColumn("is_ood", F.coalesce("is_ood", F.lit(True)))
    problem: Column = measurement_problem().when(~F.col("known_sensor"), "no curve")
    if not allow_ood:
        problem = problem.when(F.col("is_ood"), "configuration out of distribution")
    out = out.withColumn("problem", problem)
    refused = F.col("problem").isNotNull()
    return out.withColumns({c: F.when(~refused, F.col(c)) for c in ("calibrated_power", "propagated_var")}).select(*rows.columns, "calibrated_power", "propagated_var", "is_ood", "problem")


def batch_writer(out: str, quarantine: str) -> Callable[[DataFrame, int], None]:
    """For foreachBatch: accepted rows of a judged batch to out, refused ones to quarantine, each to a folder of the batch's number.

    A batch that is repeated after a stop replaces what it had written, so no row is lost or written twice.
    """

    def write(batch: DataFrame, number: int) -> None:
        batch.persist()  # both writes read it
        batch.filter("problem is null").drop("problem").write.mode("overwrite").parquet(f"{out}/batch={number}")
        batch.filter("problem is not null").drop("calibrated_power", "propagated_var").write.mode("overwrite").parquet(f"{quarantine}/batch={number}")
        batch.unpersist()

    return write


def start_judged(rows: DataFrame, out: str, quarantine: str, checkpoint: str) -> StreamingQuery:
    """Write judged() rows of a stream with batch_writer(), over what is there."""
    return rows.writeStream.foreachBatch(batch_writer(out, quarantine)).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
