"""Saving fitted models and calibrated series, and reading them back with the same values.

A model's folder holds versions, each a folder of its own with all tables and, in its manifest, their digests. A version
is published by one small pointer file, written whole under another name and then renamed. Until that is there, the
version before is the model; a folder or a table of a version that was never published is never read.
"""

from __future__ import annotations

import dataclasses
import hashlib
import json
import uuid

import numpy as np
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators.fit import FitConfig, FitResult, Model

VERSION = 2
#: Versions that stay when a new one is published: readers of the one before may be at work.
KEPT_VERSIONS = 2
TABLES = ("parameters", "sensors", "features", "history", "state", "latent")


def write_calibrated(rows: DataFrame, path: str) -> None:
    """Calibrated series by campaign; reading the path gives the same values."""
    rows.write.mode("overwrite").partitionBy("campaign").parquet(path)


def write_latent(latent: DataFrame, path: str) -> None:
    """Latent spectra (campaign, record_idx, s) by campaign."""
    latent.write.mode("overwrite").partitionBy("campaign").parquet(path)


def corpus_fingerprint(state: DataFrame) -> str:
    """A digest of the campaigns, sensors, grids, settings and reliable sensors that a model was fitted on."""
    return table_digest(state.select("campaign", "sensor_id", "start_freq_hz", "end_freq_hz", "n_bins", "c", "reliable"))


def table_digest(table: DataFrame) -> str:
    """A digest of a table's rows, whatever their order and files."""
    # sums of row digests don't depend on the order of rows, and need no list of them
    each = F.sha2(F.to_json(F.struct(*sorted(table.columns)), {"ignoreNullFields": "false"}), 256)
    parts = [F.sum(F.conv(F.substring(each, 1 + 8 * i, 8), 16, 10).cast("decimal(38,0)")).cast("string") for i in range(8)]
    row = table.agg(F.count(F.lit(1)).alias("n"), *[p.alias(f"p{i}") for i, p in enumerate(parts)]).first()
    return hashlib.sha256(json.dumps([sorted(table.columns), *row]).encode()).hexdigest()


def _files(spark: SparkSession, path: str):
    """(Hadoop's path class, file system) of a path."""
    make = spark._jvm.org.apache.hadoop.fs.Path
    return make, make(path).getFileSystem(spark._jsparkSession.sessionState().newHadoopConf())


def _published(spark: SparkSession, path: str) -> list[tuple[int, str]]:
    """(number, folder) of the published versions, the present one first."""
    make, fs = _files(spark, path)
    found = fs.globStatus(make(f"{path}/current-*")) or []
    names = sorted((f.getPath().getName() for f in found), reverse=True)
    return [(int(n.split("-")[1]), n.split("-")[2]) for n in names]


def _publish(spark: SparkSession, path: str, version: str) -> None:
    make, fs = _files(spark, path)
    before = _published(spark, path)
    number = before[0][0] + 1 if before else 1
    fs.mkdirs(make(path))
    fs.create(make(f"{path}/_{version}"), True).close()
    # the name tells everything, so a pointer is never half written
    if not fs.rename(make(f"{path}/_{version}"), make(f"{path}/current-{number:012d}-{version}")):
        raise OSError(f"{path}: version {version} could not be published")
    for old, folder in before[KEPT_VERSIONS - 1 :]:
        fs.delete(make(f"{path}/current-{old:012d}-{folder}"), False)
        fs.delete(make(f"{path}/versions/{folder}"), True)


def save_fit(result: FitResult, path: str, extra: dict[str, int | float | str] | None = None) -> dict:
    """Write a fit as a new version under path, publish it, and return its manifest.

    Parameters are a handful of arrays; deviations and latent spectra stay tables. A stop at any time leaves the version
    before in place, and so may a fit loaded from path be saved there again. The last KEPT_VERSIONS stay.
    """
    spark, model, version = result.state.sparkSession, result.model, uuid.uuid4().hex
    own = f"{path}/versions/{version}"
    table = lambda rows, schema: spark.createDataFrame(rows, schema).coalesce(1).write
    table([(k, list(v.shape), v.ravel().tolist()) for k, v in sorted(model.theta.items())], "name string, shape array<int>, numbers array<double>").parquet(f"{own}/parameters")
    table([(i, s, float(w)) for i, (s, w) in enumerate(zip(model.sensors, model.weights, strict=True))], "position int, sensor_id string, weight double").parquet(f"{own}/sensors")
    table([(i, f, float(m), float(s)) for i, (f, m, s) in enumerate(zip(model.features, model.mean, model.scale, strict=True))], "position int, feature string, mean double, scale double").parquet(f"{own}/features")
    table([(i, float(x)) for i, x in enumerate(result.history)], "step int, loss double").parquet(f"{own}/history")
    result.state.write.parquet(f"{own}/state")
    write_latent(result.latent, f"{own}/latent")
    manifest = {
        "version": VERSION, "config": dataclasses.asdict(model.config), "freq": list(model.freq), "variance_floor": model.variance_floor, "power_scale": model.power_scale,
        "reason": result.reason, "selected": result.selected, "selected_round": result.selected_round, "rounds": result.rounds, "gradient_norms": result.gradient_norms,
        "corpus": corpus_fingerprint(result.state), "digests": {t: table_digest(_table(spark, own, t)) for t in TABLES}, "extra": extra or {},
    }
    table([(json.dumps(manifest, sort_keys=True),)], "value string").text(f"{own}/manifest")
    _publish(spark, path, version)
    return manifest


def _table(spark: SparkSession, own: str, name: str) -> DataFrame:
    read = spark.read.schema("record_idx long, s array<double>, campaign string") if name == "latent" else spark.read
    return read.parquet(f"{own}/{name}")


def load_fit(spark: SparkSession, path: str, verify: bool = True, corpus: str | None = None) -> FitResult:
    """The fit that save_fit() published last, equal to the last bit.

    Unless verify is off, each table is read once for its digest, and an altered one is refused. corpus, if given, is
    the fingerprint that the model's corpus must have.
    """
    published = _published(spark, path)
    if not published:
        raise FileNotFoundError(f"no model has been published in {path}")
    own = f"{path}/versions/{published[0][1]}"
    manifest = json.loads(spark.read.text(f"{own}/manifest").first()["value"])
    if manifest["version"] != VERSION:
        raise ValueError(f"a model of version {manifest['version']}, not {VERSION}")
    if corpus is not None and manifest["corpus"] != corpus:
        raise ValueError(f"{path}: the model was fitted on another corpus")
    if verify:
        for name in TABLES:
            if table_digest(_table(spark, own, name)) != manifest["digests"][name]:
                raise ValueError(f"{path}: {name} is not what was saved")
    rows = lambda name, key: sorted(_table(spark, own, name).collect(), key=lambda r: r[key])  # noqa: E731  one row for each sensor, feature, array or step
    sensors, features = rows("sensors", "position"), rows("features", "position")
    config = FitConfig(**manifest["config"] | {"bases": tuple(manifest["config"]["bases"])})
    column = lambda table, name: np.array([r[name] for r in table])
    model = Model([r["sensor_id"] for r in sensors], column(sensors, "weight"), tuple(r["feature"] for r in features), column(features, "mean"), column(features, "scale"), tuple(manifest["freq"]), manifest["variance_floor"], manifest["power_scale"], config)
    model.theta = {r["name"]: np.array(r["numbers"]).reshape(r["shape"]) for r in rows("parameters", "name")}
    latent = _table(spark, own, "latent").select("campaign", "record_idx", "s")
    return FitResult(model, _table(spark, own, "state"), latent, [r["loss"] for r in rows("history", "step")], manifest["reason"], manifest["selected"], manifest["rounds"], manifest["selected_round"], None, manifest["gradient_norms"])
