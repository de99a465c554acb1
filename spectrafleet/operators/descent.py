"""One round's gradient steps within one Spark stage.

The tasks of a barrier stage hold their campaigns' sums, deviations and moments, and go through all steps of a round
together: in each they add up their gradients of the parameters and make the same move. Deviations and their moments
never leave their task. Tasks find each other through the barrier, and then talk directly, since a gathering call of the
barrier takes a second. When an executor is lost, Spark repeats the stage, and so the round.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from dataclasses import dataclass, field, replace
from multiprocessing.connection import Client, Listener

import numpy as np
import pandas as pd
from pyspark import BarrierTaskContext

from .model import EPSILON, Model, batch_penalties, block_loss_and_gradient, sigmoid, softplus, variance_deviation

ARRAYS = ("y", "yy", "ys", "s", "ss")
DEVIATIONS, MOMENTS = ("d0", "d1", "d2"), ("m0", "m1", "m2", "v0", "v1", "v2")
STATE = "campaign string, sensor_id string, start_freq_hz double, end_freq_hz double, n_bins int, c array<double>, reliable boolean, d0 array<double>, d1 array<double>, d2 array<double>"
SUMS = "k double, " + ", ".join(f"{a} array<double>" for a in ARRAYS)
#: A round's rows: states with moments, sums, and one row (of no campaign) of what all tasks agree on.
ROUND = f"{STATE}, {', '.join(f'{m} array<double>' for m in MOMENTS)}, {SUMS}, told array<double>"
NAMES = [x.strip().split(" ")[0] for x in ROUND.split(", ")]


@dataclass
class Adam:
    """Moments of the parameters' gradient, and how many steps were taken."""

    first: np.ndarray
    second: np.ndarray
    steps: int = 0

    def move(self, grad: np.ndarray, rate: float) -> np.ndarray:
        self.steps += 1
        self.first, self.second = 0.9 * self.first + 0.1 * grad, 0.999 * self.second + 0.001 * grad**2
        return rate * (self.first / (1 - 0.9**self.steps)) / (np.sqrt(self.second / (1 - 0.999**self.steps)) + 1e-8)


@dataclass
class Campaign:
    """A campaign's sensors in a task: arrays are (sensor, bin), deviations and moments (3, sensor, bin)."""

    keys: list[dict] = field(default_factory=list)
    dev: list = field(default_factory=list)
    moments: list = field(default_factory=list)
    sums: dict[str, list] = field(default_factory=dict)

    def add_sums(self, r: dict) -> None:
        new = [float(r["k"]), *(np.asarray(r[a], float) for a in ARRAYS)]
        old = self.sums.get(r["sensor_id"])
        self.sums[r["sensor_id"]] = new if old is None else [a + b for a, b in zip(old, new, strict=True)]

    def close(self, model: Model) -> None:
        order = sorted((i for i, k in enumerate(self.keys) if k["sensor_id"] in self.sums), key=lambda i: self.keys[i]["sensor_id"])
        self.keys = [self.keys[i] for i in order]
        if not self.keys:
            return
        first = self.keys[0]
        self.c, self.bases = np.asarray(first["c"], float), model.bases(first["start_freq_hz"], first["end_freq_hz"], first["n_bins"])
        self.rows = np.array([model.sensors.index(k["sensor_id"]) for k in self.keys])
        self.reliable = np.array([bool(k["reliable"]) for k in self.keys])
        self.dev = np.stack([self.dev[i] for i in order], axis=1)
        zero = np.zeros((6, self.dev.shape[2]))
        self.moments = np.stack([zero if self.moments[i] is None else self.moments[i] for i in order], axis=1)
        held = [self.sums[k["sensor_id"]] for k in self.keys]
        self.sums = {"k": np.array([h[0] for h in held])[:, None]} | {a: np.stack([h[1 + i] for h in held]) for i, a in enumerate(ARRAYS)}

    def base(self, model: Model) -> list[np.ndarray]:
        return [x[self.rows] for x in model.persistent(self.c, self.bases)]

    def renew_variance(self, model: Model) -> None:
        self.dev[2] = variance_deviation(model, self.base(model), self.dev, self.sums, self.bases[2])

    def gradient(self, model: Model) -> tuple[float, np.ndarray, np.ndarray]:
        return block_loss_and_gradient(model, self.c, self.bases, self.rows, self.dev, self.sums, self.reliable)

    def step(self, grad: np.ndarray, rate: float, steps: int) -> None:
        """The same Adam step as the parameters', then log gains of mean zero over sensors."""
        first, second = self.moments[:3], self.moments[3:]
        first[:] = 0.9 * first + 0.1 * grad
        second[:] = 0.999 * second + 0.001 * grad**2
        self.dev = self.dev - rate * (first / (1 - 0.9**steps)) / (np.sqrt(second / (1 - 0.999**steps)) + 1e-8)
        self.dev[0] -= self.dev[0].mean(axis=0)

    def settle(self, model: Model) -> None:
        """One damped Gauss-Newton step of gain and floor deviations, then variances from residual energy."""
        cfg, base, s = model.config, self.base(model), self.sums
        _, _, (da, db, _) = self.gradient(model)
        g, v, slope = np.exp(np.clip(base[0] + self.dev[0], -30, 30)), model.variance_floor + softplus(base[2] + self.dev[2]), sigmoid(base[1] + self.dev[1])
        gain = self.dev[0] - np.clip(da / (g**2 * s["ss"] / v + 2 * cfg.shrink), -0.5, 0.5)
        floor = self.dev[1] - np.clip(db / (s["k"] * slope**2 / v + 2 * cfg.shrink), -0.5, 0.5)
        self.dev = np.stack([gain, floor, self.dev[2]])
        self.renew_variance(model)
        self.dev[0] -= self.dev[0].mean(axis=0)

    def rows_out(self) -> list[tuple]:
        return [
            (*(k[n] for n in ("campaign", "sensor_id", "start_freq_hz", "end_freq_hz", "n_bins", "c", "reliable")), *self.dev[:, i], *self.moments[:, i], float(self.sums["k"][i, 0]), *(self.sums[a][i] for a in ARRAYS), None)
            for i, k in enumerate(self.keys)
        ]


def _filled(x) -> bool:
    return x is not None and not (isinstance(x, float) and np.isnan(x))


def held_campaigns(model: Model, batches: Iterator[pd.DataFrame]) -> tuple[list[Campaign], list[tuple]]:
    """The campaigns of a task's rows, and the record batches for penalties: (c, bases, positions, records of the campaign, y)."""
    by: dict[str, Campaign] = {}
    records: dict[tuple, list] = {}
    for pdf in batches:
        for r in pdf.to_dict("records"):
            own = by.setdefault(r["campaign"], Campaign())
            if _filled(r.get("sensors")):
                key = (r["campaign"], tuple(r["sensors"]), tuple(r["c"]), r["start_freq_hz"], r["end_freq_hz"], int(r["n_bins"]), int(r["records"]))
                records.setdefault(key, []).append(np.asarray(r["flat"], float).reshape(len(r["sensors"]), -1))
            elif _filled(r["y"]):
                own.add_sums(r)
                if _filled(r["d0"]):
                    _add_state(own, r)
            else:
                _add_state(own, r)
    for c in by.values():
        c.close(model)
    batch = [(np.array(c), model.bases(a, b, n), [model.sensors.index(s) for s in sensors], k, np.stack(y)) for (_, sensors, c, a, b, n, k), y in sorted(records.items(), key=lambda x: x[0])]
    return [by[k] for k in sorted(by) if by[k].keys], batch


def _add_state(own: Campaign, r: dict) -> None:
    own.keys.append(r | {"n_bins": int(r["n_bins"])})
    own.dev.append(np.stack([np.asarray(r[d], float) for d in DEVIATIONS]))
    own.moments.append(np.stack([np.asarray(r[m], float) for m in MOMENTS]) if _filled(r["m0"]) else None)


def total_gradient(model: Model, campaigns: list[Campaign], records: list[tuple]) -> tuple[float, np.ndarray, list[np.ndarray]]:
    """(loss, gradient of the parameters, gradients of each campaign's deviations) of what a task holds."""
    cfg, loss, grad, devs = model.config, 0.0, np.zeros(model.flat(model.theta).size), []
    for c in campaigns:
        part, g, d = c.gradient(model)
        loss, grad = loss + part, grad + g
        devs.append(d)
    for c, bases, rows, k, y in records:
        cons, corr, g = batch_penalties(model, c, bases, rows, y, k)
        loss, grad = loss + cfg.consistency * cons + cfg.correlation * corr, grad + g
    return loss, grad, devs


def run_round(model: Model, adam: Adam, campaigns: list[Campaign], records: list[tuple], total_of: Callable[[np.ndarray], np.ndarray]) -> tuple[Model, Adam, list[float], float, float]:
    """All steps of a round: (model, moments, loss before each step, loss at the end, greatest gradient norm).

    total_of() adds up a vector over all tasks. It is called the same number of times in each: what decides that, the
    total loss, is the same everywhere.
    """
    cfg, history, greatest = model.config, [], 0.0
    if cfg.joint:
        for c in campaigns:
            c.renew_variance(model)
    for _ in range(cfg.inner):
        loss, grad, devs = total_gradient(model, campaigns, records)
        energy = sum(float((d**2).sum()) for d in devs) if cfg.joint else 0.0
        total = total_of(np.concatenate([[loss, energy], grad]))
        history.append(float(total[0]))
        if not np.isfinite(total).all():
            return model, adam, history, np.nan, greatest
        flat = model.flat(model.theta)
        grad = total[2:] + cfg.decay * flat
        norm = float(np.sqrt((grad**2).sum() + total[1]))
        greatest, factor = max(greatest, norm), min(1.0, cfg.clip / max(norm, EPSILON))
        moved = flat - adam.move(grad * factor, cfg.rate)
        if cfg.joint:
            for c, d in zip(campaigns, devs, strict=True):
                c.step(d * factor, cfg.rate, adam.steps)
        model = replace(model, theta=model.unflat(moved))
    if not cfg.joint:
        for c in campaigns:
            c.settle(model)
    end = total_of(np.array([total_gradient(model, campaigns, records)[0]]))[0]
    return model, adam, history, float(end), greatest


def packed(model: Model, adam: Adam, history: list[float], end: float, greatest: float) -> np.ndarray:
    return np.concatenate([[end, greatest, adam.steps, len(history)], history, model.flat(model.theta), adam.first, adam.second])


def unpacked(model: Model, told: list[float]) -> tuple[Model, Adam, list[float], float, float]:
    x, n = np.asarray(told, float), model.flat(model.theta).size
    k = int(x[3])
    theta, first, second = (x[4 + k + i * n : 4 + k + (i + 1) * n] for i in range(3))
    return replace(model, theta=model.unflat(theta)), Adam(first, second, int(x[2])), x[4 : 4 + k].tolist(), float(x[0]), float(x[1])


class Peers:
    """The tasks of a barrier stage, the first of which adds up what all send."""

    def __init__(self, context: BarrierTaskContext, key: bytes):
        tasks, self.links, self.hub = context.getTaskInfos(), [], context.partitionId() == 0
        if len(tasks) == 1:
            return
        if self.hub:
            with Listener(("0.0.0.0", 0), "AF_INET", len(tasks), authkey=key) as listener:
                context.allGather(str(listener.address[1]))
                links = [listener.accept() for _ in tasks[1:]]
            self.links = [link for _, link in sorted((link.recv(), link) for link in links)]  # in order of tasks, so that sums come out equal
        else:
            port = int(context.allGather("")[0])
            self.links = [Client((tasks[0].address.rsplit(":", 1)[0], port), "AF_INET", authkey=key)]
            self.links[0].send(context.partitionId())

    def total(self, vector: np.ndarray) -> np.ndarray:
        """The sum of all tasks' vectors, in each of them."""
        vector = np.ascontiguousarray(vector, np.float64)
        if self.hub:
            for link in self.links:
                vector = vector + np.frombuffer(link.recv_bytes())
            for link in self.links:
                link.send_bytes(vector.tobytes())
            return vector
        self.links[0].send_bytes(vector.tobytes())
        return np.frombuffer(self.links[0].recv_bytes())

    def close(self) -> None:
        for link in self.links:
            link.close()


def round_task(model: Model, adam: Adam, key: bytes) -> Callable[[Iterator[pd.DataFrame]], Iterator[pd.DataFrame]]:
    """For mapInPandas(..., barrier=True): a task's part of a round. The key is the tasks' common secret."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        context = BarrierTaskContext.get()
        campaigns, records = held_campaigns(model, batches)
        peers = Peers(context, key)
        done = run_round(model, replace(adam), campaigns, records, peers.total)
        peers.close()
        for c in campaigns:
            yield pd.DataFrame(c.rows_out(), columns=NAMES)
        if context.partitionId() == 0:
            yield pd.DataFrame([(*[None] * (len(NAMES) - 1), packed(*done))], columns=NAMES)

    return run
