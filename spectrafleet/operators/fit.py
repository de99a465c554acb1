"""Fitting persistent calibration curves over a corpus of campaigns; model.py has the objective.

Layout. Aligned records are written once, one row each with the spectra of all its sensors. An outer round reads them
once, for sums over records by (campaign, sensor, bin) under fixed latent spectra. All gradient steps of the round then
run in one barrier stage over these sums (descent.py); corpora whose sums are too large for that take one job a step.
Powers are divided by the corpus deviation, so that the sums don't cancel.
"""

from __future__ import annotations

import secrets
from collections.abc import Callable, Iterator
from dataclasses import dataclass, field, replace

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.spectra import array_sum, edge_jump_ratio
from .calibration import Geometry, config_stats, corpus_stats, trust_diagnostics, work_folder
from .descent import ARRAYS, DEVIATIONS, MOMENTS, NAMES, ROUND, STATE, SUMS, Adam, held_campaigns, round_task, run_round, total_gradient, unpacked
from .model import (  # noqa: F401  what a fit's model is made of belongs to this module's names
    EPSILON, FitConfig, Model, batch_penalties, block_loss_and_gradient, inverse_softplus, loss_and_gradient, median_latent, record_penalties, residual_sums, sigmoid, softplus,
    variance_deviation, weighted_latent,
)

#: Bytes that one task of a barrier stage holds at most, and those from which on there is another task.
HELD_BYTES, TASK_BYTES = 1 << 30, 8 << 20
#: Tasks of a barrier stage, at most: in every step they add up their gradients.
BARRIER_TASKS = 64
#: Tasks whose partial sums meet in one.
FAN_IN = 64
#: Curves that are broadcast, in bytes.
BROADCAST_BYTES = 32 << 20

_STATE, _SUMS = STATE, f"campaign string, sensor_id string, {SUMS}"
_STATE_NAMES = [x.strip().split(" ")[0] for x in _STATE.split(", ")]
_SUM_NAMES = [x.strip().split(" ")[0] for x in _SUMS.split(", ")]


def record_rows(rows: DataFrame, scale: float) -> DataFrame:
    """campaign, record_idx, grid, sensors in order, flat: the record's powers over scale, sensor after sensor."""
    power = F.transform("pxx_db", lambda x: F.pow(F.lit(10.0), x / 10) / scale)
    each = F.array_sort(F.collect_list(F.struct("sensor_id", power.alias("y"))))
    grid = [F.first(c).alias(c) for c in ("start_freq_hz", "end_freq_hz", "n_bins")]
    out = rows.groupBy("campaign", F.col("record_idx").cast("long").alias("record_idx")).agg(*grid, each.alias("each"))
    return out.select("campaign", "record_idx", "start_freq_hz", "end_freq_hz", "n_bins", F.col("each.sensor_id").alias("sensors"), F.flatten("each.y").alias("flat"))


def _blocks(pdf: pd.DataFrame) -> Iterator[tuple[str, list[str], np.ndarray, pd.DataFrame]]:
    """Of a batch of records: (campaign, sensors, y as (record, sensor, bin), rows) for each set of sensors."""
    key = [(c, tuple(s), len(y)) for c, s, y in zip(pdf["campaign"], pdf["sensors"], pdf["flat"], strict=True)]
    for (campaign, sensors, _), part in pdf.groupby(pd.Series(key, index=pdf.index), sort=False):
        y = np.stack(part["flat"].to_numpy()).astype(np.float64)
        yield campaign, list(sensors), y.reshape(len(part), len(sensors), -1), part


def campaign_curves(model: Model, state: DataFrame) -> DataFrame:
    """campaign, sensor_id, gain, floor, var (in scaled power) under the present parameters and deviations."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            out = []
            for r in pdf.to_dict("records"):
                at, dev = model.sensors.index(r["sensor_id"]), [np.asarray(r[d], float) for d in DEVIATIONS]
                base = model.persistent(np.asarray(r["c"], float), model.bases(r["start_freq_hz"], r["end_freq_hz"], int(r["n_bins"])))
                p = [x[at] + d for x, d in zip(base, dev, strict=True)]
                out.append((r["campaign"], r["sensor_id"], np.exp(np.clip(p[0], -30, 30)), softplus(p[1]), model.variance_floor + softplus(p[2])))
            yield pd.DataFrame(out, columns=["campaign", "sensor_id", "gain", "floor", "var"])

    return state.mapInPandas(run, "campaign string, sensor_id string, gain array<double>, floor array<double>, var array<double>")


def with_curves(records: DataFrame, curves: DataFrame, size: int) -> DataFrame:
    """records with the curves of their campaign's sensors; size is the bytes of all curves."""
    by = curves.groupBy("campaign").agg(F.array_sort(F.collect_list(F.struct("sensor_id", "gain", "floor", "var"))).alias("c"))
    by = by.select("campaign", F.col("c.sensor_id").alias("known"), *[F.flatten(f"c.{k}").alias(k) for k in ("gain", "floor", "var")])
    return records.join(F.broadcast(by) if size <= BROADCAST_BYTES else by, "campaign")


def _latents(pdf: pd.DataFrame, latent: Callable) -> Iterator[tuple[str, list[str], np.ndarray, np.ndarray, pd.DataFrame]]:
    for campaign, sensors, y, part in _blocks(pdf):
        first = part.iloc[0]
        known = list(first["known"])
        at = [known.index(s) for s in sensors]
        gain, floor, var = (np.asarray(first[k], float).reshape(len(known), -1)[at] for k in ("gain", "floor", "var"))
        yield campaign, sensors, y, latent(y, gain, floor, var), part


def latent_update(records: DataFrame) -> DataFrame:
    """campaign, record_idx, s of records with curves: weighted least squares over a record's sensors, not below EPSILON."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            for _, _, _, s, part in _latents(pdf, weighted_latent):
                yield pd.DataFrame({"campaign": part["campaign"].to_numpy(), "record_idx": part["record_idx"].to_numpy(), "s": list(s)})

    return records.mapInPandas(run, "campaign string, record_idx long, s array<double>")


def _added(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """Rows of _SUMS added up by campaign and sensor."""
    sums: dict[tuple, list] = {}
    for pdf in batches:
        for c, i, *new in pdf[_SUM_NAMES].itertuples(index=False, name=None):
            old = sums.get((c, i))
            sums[c, i] = new if old is None else [a + b for a, b in zip(old, new, strict=True)]
    yield pd.DataFrame([(*k, *v) for k, v in sums.items()], columns=_SUM_NAMES)


def record_sums(records: DataFrame, latent: Callable = weighted_latent) -> DataFrame:
    """Sums over records with curves by (campaign, sensor), in scaled power, under their latent spectra.

    Each task adds up what it reads; groups of FAN_IN tasks add up theirs. There may be several rows for a sensor.
    """

    def partial(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        def rows() -> Iterator[pd.DataFrame]:
            for pdf in batches:
                for campaign, sensors, y, s, _ in _latents(pdf, latent):
                    one, two, three = y.sum(axis=0), (y * y).sum(axis=0), (y * s[:, None]).sum(axis=0)
                    four, five = s.sum(axis=0), (s * s).sum(axis=0)
                    yield pd.DataFrame([(campaign, i, float(len(y)), one[k], two[k], three[k], four, five) for k, i in enumerate(sensors)], columns=_SUM_NAMES)

        return _added(rows())

    out = records.mapInPandas(partial, _SUMS)
    tasks = records.rdd.getNumPartitions()
    while tasks > FAN_IN:
        tasks = -(-tasks // FAN_IN)
        out = out.repartition("campaign", "sensor_id", F.expr(f"pmod(spark_partition_id(), {tasks})")).mapInPandas(_added, _SUMS)
    return out


def objective_and_gradient(model: Model, table: DataFrame) -> tuple[float, np.ndarray]:
    """Loss and parameter gradient over states with sums, whole campaigns in a task; each task sends one vector."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        loss, grad, _ = total_gradient(model, *held_campaigns(model, batches))
        yield pd.DataFrame({"loss": [loss], "grad": [grad]})

    parts = table.mapInPandas(run, "loss double, grad array<double>").collect()  # one row for each task
    return sum(p["loss"] for p in parts), np.sum([p["grad"] for p in parts], axis=0)


def penalties(model: Model, records: DataFrame) -> tuple[float, float, np.ndarray]:
    """Sums of record_penalties() over penalised_records(): batches of records at a time, then of tasks FAN_IN at a time."""
    schema = "cons double, corr double, grad array<double>"

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        total = np.zeros(2 + model.flat(model.theta).size)
        for pdf in batches:
            for _, sensors, y, part in _blocks(pdf):
                f = part.iloc[0]
                cons, corr, grad = batch_penalties(model, np.asarray(f["c"], float), model.bases(f["start_freq_hz"], f["end_freq_hz"], int(f["n_bins"])), [model.sensors.index(s) for s in sensors], y, int(f["records"]))
                total += np.concatenate([[cons, corr], grad])
        yield pd.DataFrame({"cons": [total[0]], "corr": [total[1]], "grad": [total[2:]]})

    def added(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        held = [pdf for pdf in batches if len(pdf)]
        if held:
            both = pd.concat(held)
            yield pd.DataFrame({"cons": [both["cons"].sum()], "corr": [both["corr"].sum()], "grad": [np.stack(both["grad"].to_numpy()).sum(axis=0)]})

    parts = records.mapInPandas(run, schema)
    tasks = records.rdd.getNumPartitions()
    if tasks > FAN_IN:
        parts = parts.repartition(-(-tasks // FAN_IN)).mapInPandas(added, schema)
    got = parts.collect()
    return sum(p["cons"] for p in got), sum(p["corr"] for p in got), np.sum([p["grad"] for p in got], axis=0)


def penalised_records(records: DataFrame, state: DataFrame) -> DataFrame:
    """records with their campaign's configuration c and number of records."""
    counts = records.groupBy("campaign").agg(F.count_distinct("record_idx").alias("records"))
    known = state.groupBy("campaign").agg(F.first("c").alias("c")).join(counts, "campaign")  # c is the same for all sensors of a campaign
    return records.join(known, "campaign")


def initial_floors(model: Model, records: DataFrame, configs: DataFrame, reliable: DataFrame) -> DataFrame:
    """States whose floors are a tenth of each bin's 5 % quantile over records; other deviations are zero.

    Quantiles are sketches of each bin, made within tasks first: no task holds a sensor's spectra.
    """
    c = F.array(*[(F.col(f).cast("double") - float(m)) / float(s) for f, m, s in zip(model.features, model.mean, model.scale, strict=True)])
    key = ("campaign", "sensor_id", "start_freq_hz", "end_freq_hz", "n_bins")
    spectra = F.transform("sensors", lambda s, i: F.struct(s.alias("sensor_id"), F.slice("flat", i * F.col("n_bins") + 1, F.col("n_bins")).alias("y")))
    rows = records.select("campaign", "start_freq_hz", "end_freq_hz", "n_bins", F.inline(spectra))
    bins = rows.select(*key, F.posexplode("y").alias("bin", "v")).groupBy(*key, "bin").agg(F.percentile_approx("v", 0.05, 1000).alias("low"))
    one = bins.groupBy(*key).agg(F.sort_array(F.collect_list(F.struct("bin", "low"))).alias("b"))  # n_bins entries
    known = one.select(*key, F.col("b.low").alias("low")).join(configs.select("campaign", c.alias("c")), "campaign").join(reliable.select("campaign", "reliable_sensor"), "campaign")
    known = known.withColumn("reliable", F.col("sensor_id") == F.col("reliable_sensor")).drop("reliable_sensor")

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            out = []
            for r in pdf.to_dict("records"):
                grid = (r["start_freq_hz"], r["end_freq_hz"], int(r["n_bins"]))
                base = model.persistent(np.asarray(r["c"], float), model.bases(*grid))[1][model.sensors.index(r["sensor_id"])]
                out.append((r["campaign"], r["sensor_id"], *grid, r["c"], r["reliable"], np.zeros(grid[2]), inverse_softplus(0.1 * np.asarray(r["low"], float)) - base, np.zeros(grid[2])))
            yield pd.DataFrame(out, columns=_STATE_NAMES)

    return known.mapInPandas(run, _STATE)


def init_campaign_state(model: Model, records: DataFrame, floors: DataFrame, size: int) -> DataFrame:
    """States of initial_floors() with variances of the residuals from latent spectra that are medians over sensors.

    Gains start at the persistent ones. size is the bytes of all curves.
    """
    sums = record_sums(with_curves(records, campaign_curves(model, floors), size), median_latent)

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for campaign in held_campaigns(model, batches)[0]:
            campaign.renew_variance(model)
            yield pd.DataFrame([r[: len(_STATE_NAMES)] for r in campaign.rows_out()], columns=_STATE_NAMES)

    both = _round_rows(floors).unionByName(_round_rows(sums))
    return both.repartition("campaign").mapInPandas(run, _STATE)


def _round_rows(df: DataFrame) -> DataFrame:
    """df with all columns of a round's table."""
    kinds = dict(x.strip().split(" ", 1) for x in ROUND.split(", "))
    return df.select(*[F.col(n) if n in df.columns else F.lit(None).cast(kinds[n]).alias(n) for n in NAMES])


def round_table(state: DataFrame, sums: DataFrame) -> DataFrame:
    """States and their sums in a round's columns, campaign by campaign, as objective_and_gradient() reads them."""
    return _round_rows(state).unionByName(_round_rows(sums)).repartition("campaign")


def slots(spark: SparkSession) -> int:
    """Tasks that can run at a time."""
    context = spark.sparkContext._jsc.sc()
    return max(1, context.maxNumConcurrentTasks(context.resourceProfileManager().defaultResourceProfile()))


@dataclass
class FitResult:
    model: Model
    state: DataFrame
    latent: DataFrame
    #: The loss at each step, and after each round.
    history: list[float]
    reason: str
    selected: float
    rounds: list[float] = field(default_factory=list)
    selected_round: int = 0
    #: States with sums, as the selected loss was taken over them; not saved.
    table: DataFrame | None = None
    #: The greatest norm of a gradient in each round, before it was clipped.
    gradient_norms: list[float] = field(default_factory=list)


def fit(rows: DataFrame, configs: DataFrame, reliable: DataFrame, features: tuple[str, ...], config: FitConfig = FitConfig(), weights: dict[str, float] | None = None, held_bytes: int = HELD_BYTES) -> FitResult:
    """Fit aligned rows (campaign, record_idx, sensor_id, grid columns, pxx_db), one configuration row for each campaign.

    A round takes latent spectra under the present curves, renews variances from residuals, and takes gradient steps for
    parameters and deviations together; with config.joint off, for parameters alone, and deviations then take a damped
    Gauss-Newton step. Its loss is taken at its end. The result is one round's parameters, deviations and latent spectra
    together: those of the least loss. The fit ends early when no round was better for config.patience rounds, or when
    the loss is no number or more than config.divergence times the best.

    Steps of a round run in one barrier stage, if sums and states (and with penalties, records) come to held_bytes a
    task at most. A larger fit needs config.joint off; it takes a job for each step. Every round's table is written to
    the shared folder, so a lost executor costs one round at most; tables that no later round reads are deleted.
    """
    spark = rows.sparkSession
    root = work_folder(spark)

    def keep(df: DataFrame, name: str) -> DataFrame:
        df.write.mode("overwrite").parquet(f"{root}/{name}")
        return spark.read.schema(df.schema).parquet(f"{root}/{name}")

    def drop(name: str) -> None:
        path = spark._jvm.org.apache.hadoop.fs.Path(f"{root}/{name}")
        path.getFileSystem(spark._jsparkSession.sessionState().newHadoopConf()).delete(path, True)

    sensors = sorted(r["sensor_id"] for r in rows.select("sensor_id").distinct().collect())
    stats = corpus_stats(rows).first()
    scale = float(np.sqrt(stats["variance"])) or 1.0
    by = {r["feature"]: r for r in config_stats(configs, features).collect()}
    w = np.array([(weights or {}).get(s, 1.0) for s in sensors])
    model = Model(sensors, w / w.sum(), features, np.array([by[f]["mean"] for f in features]), np.array([by[f]["scale"] for f in features]), (stats["freq_min_hz"], stats["freq_max_hz"]), stats["variance_floor"] / scale**2, scale, config)
    rng, e, h = np.random.default_rng(config.seed), config.embedding, config.hidden
    model.theta = {"E": 0.1 * rng.standard_normal((len(sensors), e)), "W": 0.1 * rng.standard_normal((h, len(features))), "b": np.zeros(h)} | {f"A{i}": 0.1 * rng.standard_normal((k, e + h)) for i, k in enumerate(config.bases)}
    # Splines sum to 1, so equal coefficients are a level: a tenth of the 5 % quantile, and a hundredth of the variance.
    levels = (0.0, float(inverse_softplus(np.array(0.1 * stats["q05"] / scale))), float(inverse_softplus(np.array(0.01))))
    model.theta |= {f"B{i}": np.full(k, levels[i]) for i, k in enumerate(config.bases)}
    records = keep(record_rows(rows, scale), "records")
    floors = keep(initial_floors(model, records, configs, reliable), "floors")
    total = floors.agg(F.sum("n_bins").alias("bins"), F.count_distinct("campaign").alias("campaigns")).first()
    bins, campaigns = total["bins"] or 0, total["campaigns"]
    size = 24 * bins
    table = keep(_round_rows(init_campaign_state(model, records, floors, size)), "round-0")
    penalised = keep(penalised_records(records, floors), "penalised") if config.consistency or config.correlation else None
    held = 8 * len(NAMES) * bins + (8 * (penalised.agg(F.sum(F.size("flat"))).first()[0] or 0) if penalised is not None else 0)
    most = max(1, min(slots(spark), BARRIER_TASKS, campaigns))
    tasks, in_one_stage = max(1, min(most, -(-held // TASK_BYTES))), held <= held_bytes * most
    if not in_one_stage and config.joint:
        raise ValueError(f"a joint fit of {held} bytes needs more than {most} tasks of {held_bytes} bytes; set joint=False")
    key = secrets.token_bytes(32)
    adam = Adam(np.zeros(model.flat(model.theta).size), np.zeros(model.flat(model.theta).size))
    best, kept, history, rounds, norms, stale, reason = np.inf, None, [], [], [], 0, "all rounds done"
    for outer in range(config.outer):
        before, start = table, model
        state = before.filter("campaign is not null").select(*_STATE_NAMES, *MOMENTS)
        curved = with_curves(records, campaign_curves(model, state), size)
        if in_one_stage:
            given = _round_rows(state).unionByName(_round_rows(record_sums(curved)))
            # The tasks of a barrier stage run at the same time, so there must be this many whatever else is set.
            to = lambda *by: F.pmod(F.xxhash64(*by), F.lit(tasks)).cast("int")
            dealt = given.withColumn("dealt", to("campaign"))
            if penalised is not None:
                dealt = dealt.unionByName(penalised.withColumn("dealt", to("campaign", "record_idx")).drop("record_idx"), allowMissingColumns=True)
            run = dealt.repartitionById(tasks, "dealt").drop("dealt").mapInPandas(round_task(model, adam, key), ROUND, barrier=True)
            table = keep(run, f"round-{outer + 1}")
            model, adam, steps, loss, norm = unpacked(model, table.filter("told is not null").first()["told"])
        else:
            sums = keep(record_sums(curved), f"sums-{outer}")
            model, adam, steps, loss, norm, table = _round_of_jobs(model, adam, state, sums, penalised, lambda df: keep(df, f"round-{outer + 1}"))  # noqa: B023  called within this round
            drop(f"sums-{outer}")
        history += steps
        rounds.append(loss)
        norms.append(norm)
        if kept is None or loss < best - config.tolerance * max(abs(best), 1.0):
            if kept is not None:
                for k in {kept[4], kept[4] + 1} - {outer}:
                    drop(f"round-{k}")
            best, kept, stale = loss, (model, start, before, table, outer), 0
        else:
            if outer > kept[4] + 1:
                drop(f"round-{outer}")
            stale += 1
        if not np.isfinite(loss) or loss - best > (config.divergence - 1) * max(abs(best), 1.0):
            reason = "diverged"
            break
        if stale >= config.patience:
            reason = "no better round"
            break
    if kept is None:
        kept = (model, model, table, table, 0)
    model, start, before, table, chosen = kept
    table = table.filter("campaign is not null").drop("told")
    curves = campaign_curves(start, before.filter("campaign is not null").select(*_STATE_NAMES))
    latent = keep(latent_update(with_curves(records, curves, size)), "latent")
    state = table.select(*_STATE_NAMES)
    return FitResult(model, state, latent, history, reason, best, rounds, chosen, table if rounds else None, norms)


def _round_of_jobs(model: Model, adam: Adam, state: DataFrame, sums: DataFrame, penalised: DataFrame | None, keep: Callable[[DataFrame], DataFrame]):
    """run_round() with a job for each step, of fits whose sums no barrier stage can hold; deviations stay fixed meanwhile."""
    spark, cfg = state.sparkSession, model.config
    spread = _round_rows(state).unionByName(_round_rows(sums)).repartition("campaign")

    def objective(model: Model, table: DataFrame) -> tuple[float, np.ndarray]:
        loss, grad = objective_and_gradient(model, table)
        if penalised is not None:
            cons, corr, extra = penalties(model, penalised)
            loss, grad = loss + cfg.consistency * cons + cfg.correlation * corr, grad + extra
        return loss, grad

    def settle(model: Model) -> Callable[[Iterator[pd.DataFrame]], Iterator[pd.DataFrame]]:
        def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
            for campaign in held_campaigns(model, batches)[0]:
                campaign.settle(model)
                yield pd.DataFrame(campaign.rows_out(), columns=NAMES)

        return run

    history, greatest, adam = [], 0.0, replace(adam)
    spread.persist()  # every step reads it
    for _ in range(cfg.inner):
        loss, grad = objective(model, spread)
        history.append(loss)
        if not (np.isfinite(loss) and np.isfinite(grad).all()):
            break
        flat = model.flat(model.theta)
        grad = grad + cfg.decay * flat
        norm = float(np.linalg.norm(grad))
        greatest = max(greatest, norm)
        model = replace(model, theta=model.unflat(flat - adam.move(grad * min(1.0, cfg.clip / max(norm, EPSILON)), cfg.rate)))
    table = keep(spread.mapInPandas(settle(model), ROUND))
    spread.unpersist()
    # whole campaigns again: a large file may be cut anywhere
    loss = objective(model, table.repartition("campaign"))[0] if np.isfinite(history[-1:]).all() else np.nan
    return model, adam, history, loss, greatest, table


def evaluate_curves(model: Model, wanted: DataFrame, clip: bool = False) -> DataFrame:
    """wanted (config_id, sensor_id, start_freq_hz, end_freq_hz, n_bins, features) with persistent gain, floor, var in power units."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            out = []
            for r in pdf.to_dict("records"):
                c = (np.array([float(r[f]) for f in model.features]) - model.mean) / model.scale
                p = [x[model.sensors.index(r["sensor_id"])] for x in model.persistent(c, model.bases(r["start_freq_hz"], r["end_freq_hz"], int(r["n_bins"]), clip))]
                out.append((r["config_id"], r["sensor_id"], np.exp(p[0]), softplus(p[1]) * model.power_scale, (model.variance_floor + softplus(p[2])) * model.power_scale**2))
            yield pd.DataFrame(out, columns=["config_id", "sensor_id", "gain", "floor", "var"])

    return wanted.mapInPandas(run, "config_id string, sensor_id string, gain array<double>, floor array<double>, var array<double>")


def trusted_curves(model: Model, wanted: DataFrame, g: Geometry, allow_extrapolation: bool = False, allow_ood: bool = False) -> DataFrame:
    """evaluate_curves() of wanted, with trust_diagnostics() of each configuration.

    A grid off the training support, unless allow_extrapolation, and a configuration out of distribution, unless
    allow_ood, is an error of the row that asks for it, so that it never gives a curve; extrapolation clamps to the ends.
    """
    told = trust_diagnostics(wanted.withColumn("config_id", F.col("config_id").cast("string")), g, *model.freq)
    name = F.coalesce("config_id", F.lit("?"))
    features_out = F.array_join("out_of_range", ", ")
    refused = F.lit(None).cast("string")
    if not allow_ood:
        far = F.col("outside_envelope") | (F.col("distance") > float(g.threshold))
        refused = F.when(far, F.concat(F.lit("configuration "), name, F.lit(" is out of distribution: "), features_out, F.lit(" out of range, distance "), F.col("distance").cast("string"))).otherwise(refused)
    if not allow_extrapolation:
        refused = F.when(F.col("extrapolates"), F.concat(F.lit("the grid of configuration "), name, F.lit(" lies outside the training support"))).otherwise(refused)
    # the guard is the grid itself, which every curve needs
    guarded = told.withColumn("start_freq_hz", F.when(refused.isNotNull(), F.raise_error(refused).cast("double")).otherwise(F.col("start_freq_hz")))
    made = evaluate_curves(model, guarded.select("config_id", "sensor_id", "start_freq_hz", "end_freq_hz", "n_bins", *model.features), allow_extrapolation)
    trust = told.select("config_id", "sensor_id", "standardized", "bins_below", "bins_above", "distance", "tail_probability", "outside_envelope", "extrapolates", "is_ood")
    return made.join(trust, ["config_id", "sensor_id"])


def embedding_norms(spark: SparkSession, model: Model) -> DataFrame:
    """sensor_id, embedding_norm: one row for each sensor of a model."""
    norms = np.linalg.norm(model.theta["E"], axis=1).tolist()
    return spark.createDataFrame(list(zip(model.sensors, norms, strict=True)), "sensor_id string, embedding_norm double")


def fit_diagnostics(result: FitResult) -> dict[str, float | str | int | list[float]]:
    """Of the steps, of the rounds, and, where the fit's tables are at hand, how evenly and smoothly it fits."""
    h, rounds = np.array(result.history), np.array(result.rounds)
    rises = np.diff(rounds)
    out = {
        "start_objective": float(h[0]), "end_objective": float(h[-1]), "selected_objective": result.selected, "selected_round": result.selected_round, "steps": len(h), "increases": int((np.diff(h) > 0).sum()),
        "rounds": len(rounds), "round_increases": int((rises > 0).sum()), "max_round_increase": float(np.max(rises / np.maximum(np.abs(rounds[:-1]), 1.0), initial=0.0)), "reason": result.reason,
        "embedding_norm": float(np.linalg.norm(result.model.theta["E"])), "max_embedding_norm": float(np.linalg.norm(result.model.theta["E"], axis=1).max()),
        "max_gradient_norm": max(result.gradient_norms, default=float("nan")), "max_gradient_norm_by_round": list(result.gradient_norms),
    }
    return out if result.table is None else out | stability(result)


def stability(result: FitResult) -> dict[str, float]:
    """Counts, the mean loss of a campaign, the greatest campaign's share of the loss, residual variance over observed variance, and jump of a gain curve at its edges."""
    model, table = result.model, result.table

    def losses(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for campaign in held_campaigns(model, batches)[0]:
            yield pd.DataFrame({"campaign": [campaign.keys[0]["campaign"]], "loss": [campaign.gradient(model)[0]]})

    by_campaign = table.mapInPandas(losses, "campaign string, loss double").groupBy("campaign").agg(F.sum("loss").alias("loss"))
    told = by_campaign.agg(F.max("loss").alias("most"), F.avg("loss").alias("mean"), F.count(F.lit(1)).alias("campaigns")).first()
    counts = table.agg(F.count_distinct("sensor_id").alias("sensors"), F.sum(F.col("k") * F.size("y")).alias("values")).first()
    n = F.sum(F.col("k") * F.size("y"))
    seen = table.groupBy("campaign").agg((F.sum(array_sum(F.col("yy"))) / n - F.pow(F.sum(array_sum(F.col("y"))) / n, 2)).alias("seen"))
    curves = campaign_curves(model, result.state)
    left = curves.groupBy("campaign").agg(F.max(F.array_max("var")).alias("left"), F.max(edge_jump_ratio(F.col("gain"))).alias("jump"))
    row = left.join(seen, "campaign").agg(F.max(F.col("left") / F.greatest("seen", F.lit(EPSILON))).alias("ratio"), F.max("jump").alias("jump")).first()
    counted = {"mean_campaign_objective": told["mean"], "campaigns": told["campaigns"], "sensors": counts["sensors"], "values": int(counts["values"])}
    return counted | {"max_campaign_share": told["most"] / max(abs(result.selected), EPSILON), "max_variance_ratio": row["ratio"], "max_edge_jump_ratio": row["jump"]}
