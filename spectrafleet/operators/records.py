"""Work on the spectra of one aligned record: every pair of sensors of a record, in one grouped pass."""

from __future__ import annotations

import itertools
from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

STD_FLOOR, NORM_FLOOR, LOG_FLOOR = 1e-8, 1e-6, 1e-12


def pearson(x: np.ndarray) -> np.ndarray:
    """Correlation matrix of rows standardised with a floor on the deviation, clipped, 1 on the diagonal."""
    z = x - x.mean(axis=1, keepdims=True)
    z = z / np.maximum(z.std(axis=1, keepdims=True), STD_FLOOR)
    out = np.clip(z @ z.T / x.shape[1], -1.0, 1.0)
    np.fill_diagonal(out, 1.0)
    return out


def log_pearson(power: np.ndarray) -> np.ndarray:
    """Correlation matrix of log spectra with a floor on the norms; two flat spectra correlate fully."""
    z = np.log(power + LOG_FLOOR)
    z = z - z.mean(axis=1, keepdims=True)
    norm = np.sqrt((z**2).sum(axis=1))
    out = np.clip(z @ z.T / np.maximum(np.outer(norm, norm), NORM_FLOOR**2), -1.0, 1.0)
    flat = norm < NORM_FLOOR
    out[np.outer(flat, flat)] = 1.0
    np.fill_diagonal(out, 1.0)
    return out


def rmse_matrix(db: np.ndarray) -> np.ndarray:
    return np.sqrt(((db[:, None, :] - db[None, :, :]) ** 2).mean(axis=2))


def by_record(rows: DataFrame, spectrum: str, work: Callable[[np.ndarray, np.ndarray], list[tuple]], schema: str) -> DataFrame:
    """campaign, record_idx and schema's columns: work(sensor ids, spectra by sensor) of each record, whose rows come in sensor order.

    A record is some tens of spectra at most, so a large campaign spreads over many tasks, and a task works on many
    records at a time; one that two batches share waits for its end.
    """
    names = ["campaign", "record_idx", *[x.strip().split(" ")[0] for x in schema.split(",")]]

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        rest = None
        for pdf in itertools.chain(batches, [None]):
            both = rest if pdf is None else pdf if rest is None else pd.concat([rest, pdf], ignore_index=True)
            if both is None or not len(both):
                continue
            campaign, record = both["campaign"].to_numpy(), both["record_idx"].to_numpy()
            starts = np.concatenate([[0], np.flatnonzero((campaign[1:] != campaign[:-1]) | (record[1:] != record[:-1])) + 1, [len(both)]])
            done = len(starts) - (1 if pdf is None else 2)
            sensors, spectra = both["sensor_id"].to_numpy(), both["x"].to_numpy()
            out = [(campaign[a], record[a], *r) for a, b in zip(starts[:done], starts[1 : done + 1]) for r in work(sensors[a:b], np.stack(spectra[a:b]).astype(np.float64))]
            rest = None if pdf is None else both.iloc[starts[done] :]
            if out:
                yield pd.DataFrame(out, columns=names)

    slim = rows.select("campaign", F.col("record_idx").cast("long").alias("record_idx"), "sensor_id", F.col(spectrum).alias("x"))
    return slim.repartition("campaign", "record_idx").sortWithinPartitions("campaign", "record_idx", "sensor_id").mapInPandas(run, f"campaign string, record_idx long, {schema}")


def record_matrix(aligned: DataFrame, spectrum: str, matrix: Callable[[np.ndarray], np.ndarray]) -> DataFrame:
    """campaign, record_idx, sensor_a, sensor_b, value for a < b: matrix() of each record's spectra, rows in sensor order."""

    def pairs(names: np.ndarray, spectra: np.ndarray) -> list[tuple]:
        a, b = np.triu_indices(len(names), 1)
        return list(zip(names[a], names[b], matrix(spectra)[a, b].tolist(), strict=True))

    return by_record(aligned, spectrum, pairs, "sensor_a string, sensor_b string, value double")


def both_ways(pairs: DataFrame) -> DataFrame:
    """Each pair's value for both of its sensors: campaign, record_idx, sensor_id, other, value."""
    ends = [F.struct(F.col(x).alias("sensor_id"), F.col(y).alias("other")) for x, y in (("sensor_a", "sensor_b"), ("sensor_b", "sensor_a"))]
    return pairs.select("campaign", "record_idx", F.inline(F.array(*ends)), "value")  # one pass, where a union would make the pairs twice


def log_dispersion(aligned: DataFrame, power: str) -> DataFrame:
    """campaign, dispersion: mean squared deviation of log power from its mean over a record's sensors, bin by bin."""

    def squares(_: np.ndarray, spectra: np.ndarray) -> list[tuple]:
        z = np.log(spectra + LOG_FLOOR)
        return [(float(((z - z.mean(axis=0)) ** 2).sum()), z.size)]

    return by_record(aligned, power, squares, "ss double, n long").groupBy("campaign").agg((F.sum("ss") / F.sum("n")).alias("dispersion"))


def sensor_spread(aligned: DataFrame, power: str, name: str) -> DataFrame:
    """campaign, name: the deviation over a record's sensors, averaged over records and bins."""
    work = lambda _, spectra: [(float(spectra.std(axis=0).sum()), spectra.shape[1])]
    return by_record(aligned, power, work, "total double, n long").groupBy("campaign").agg((F.sum("total") / F.sum("n")).alias(name))


def sensor_pairs(aligned: DataFrame) -> DataFrame:
    """Every unordered pair of sensors on the same record."""
    a = aligned.select("campaign", "record_idx", F.col("sensor_id").alias("sensor_a"))
    return a.join(aligned.select("campaign", "record_idx", F.col("sensor_id").alias("sensor_b")), ["campaign", "record_idx"]).filter("sensor_a < sensor_b")


def mean_over(pairs: DataFrame, by: list[str], name: str) -> DataFrame:
    return pairs.groupBy(*by).agg(F.avg("value").alias(name))


