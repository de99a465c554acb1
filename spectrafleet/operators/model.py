"""The two-level calibration model and the mathematics of its objective, in plain arrays.

Model. A sensor s under configuration c has features x = [e_s, tanh(W c + b)]; heads A x + B give the spline coefficients
of log gain, floor and variance parameters. Log gain is centred by the reference weights over all registered sensors;
G = exp, N = softplus, V = floor + softplus. Each campaign adds its own deviations, those of log gain with mean zero
over its sensors. An observation is Y = G S + N with variance V, S the record's latent spectrum.

With Y and S fixed, the likelihood needs sums over records alone: K, sum Y, sum Y^2, sum Y S, sum S, sum S^2 for each
(campaign, sensor, bin).
"""

from __future__ import annotations

from dataclasses import dataclass, field
from functools import lru_cache

import numpy as np

from .calibration import spline_basis

EPSILON = 1e-12


@dataclass(frozen=True)
class FitConfig:
    bases: tuple[int, int, int] = (8, 6, 6)
    degree: int = 3
    embedding: int = 3
    hidden: int = 6
    outer: int = 10
    inner: int = 30
    rate: float = 0.03
    decay: float = 1e-4
    clip: float = 10.0
    smooth: float = 1e-3
    shrink: float = 1.0
    anchor: float = 1e-2
    ridge: float = 1e-3
    consistency: float = 0.0
    correlation: float = 0.0
    patience: int = 5
    tolerance: float = 1e-4
    divergence: float = 10.0
    seed: int = 17
    #: Deviations take part in the gradient steps; else they take one damped Gauss-Newton step in each round.
    joint: bool = True


@lru_cache(maxsize=512)
def _bases(kinds: tuple[int, ...], degree: int, freq: tuple[float, float], start: float, end: float, n: int, clip: bool) -> tuple[np.ndarray, ...]:
    f = np.linspace(start, end, n)
    return tuple(spline_basis(f, k, degree, *freq, clip=clip) for k in kinds)


@dataclass
class Model:
    sensors: list[str]
    weights: np.ndarray
    features: tuple[str, ...]
    mean: np.ndarray
    scale: np.ndarray
    freq: tuple[float, float]
    variance_floor: float
    power_scale: float
    config: FitConfig
    theta: dict[str, np.ndarray] = field(default_factory=dict)

    def bases(self, start: float, end: float, n: int, clip: bool = False) -> tuple[np.ndarray, ...]:
        """The three spline bases of a grid; a process makes those of a grid once."""
        return _bases(tuple(self.config.bases), self.config.degree, tuple(self.freq), float(start), float(end), int(n), clip)

    def coefficients(self, c: np.ndarray) -> tuple[np.ndarray, np.ndarray, list[np.ndarray]]:
        """(hidden layer, features of all sensors, coefficients of the three heads by sensor)."""
        t = self.theta
        h = np.tanh(t["W"] @ c + t["b"])
        x = np.concatenate([t["E"], np.tile(h, (len(self.sensors), 1))], axis=1)
        return h, x, [x @ t[f"A{i}"].T + t[f"B{i}"] for i in range(3)]

    def persistent(self, c: np.ndarray, bases: tuple[np.ndarray, ...]) -> list[np.ndarray]:
        """Parameter curves (sensor, bin) of centred log gain, floor and variance."""
        _, _, coef = self.coefficients(c)
        u, n, v = (k @ b.T for k, b in zip(coef, bases, strict=True))
        return [u - self.weights @ u, n, v]

    def flat(self, grads: dict[str, np.ndarray]) -> np.ndarray:
        return np.concatenate([grads[k].ravel() for k in sorted(self.theta)])

    def unflat(self, x: np.ndarray) -> dict[str, np.ndarray]:
        out, at = {}, 0
        for k in sorted(self.theta):
            out[k] = x[at : at + self.theta[k].size].reshape(self.theta[k].shape)
            at += self.theta[k].size
        return out


def softplus(x: np.ndarray) -> np.ndarray:
    return np.logaddexp(0.0, x)


def inverse_softplus(y: np.ndarray) -> np.ndarray:
    y = np.maximum(y, EPSILON)
    return y + np.log(-np.expm1(-y))


def sigmoid(x: np.ndarray) -> np.ndarray:
    return 0.5 * (1 + np.tanh(x / 2))


def residual_sums(g: np.ndarray, n: np.ndarray, s: dict[str, np.ndarray]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Sums over records of r, r S and r^2 for r = Y - G S - N."""
    r = s["y"] - g * s["s"] - s["k"] * n
    rs = s["ys"] - g * s["ss"] - n * s["s"]
    rr = s["yy"] + g**2 * s["ss"] + s["k"] * n**2 - 2 * g * s["ys"] - 2 * n * s["y"] + 2 * g * n * s["s"]
    return r, rs, np.maximum(rr, 0.0)


def _from_coefficients(model: Model, c: np.ndarray, h: np.ndarray, x: np.ndarray, gc: list[np.ndarray]) -> np.ndarray:
    """Parameter gradient from the gradients of the three heads' coefficients by sensor."""
    t, e = model.theta, model.config.embedding
    dx = sum(k @ t[f"A{i}"] for i, k in enumerate(gc))
    dh = dx[:, e:].sum(axis=0) * (1 - h**2)
    return model.flat({"E": dx[:, :e], "W": np.outer(dh, c), "b": dh} | {f"A{i}": k.T @ x for i, k in enumerate(gc)} | {f"B{i}": k.sum(axis=0) for i, k in enumerate(gc)})


def second_difference_adjoint(second: np.ndarray, n: int) -> np.ndarray:
    out = np.zeros((len(second), n))
    if n > 2:
        out[:, :-2] += second
        out[:, 1:-1] -= 2 * second
        out[:, 2:] += second
    return out


def block_loss_and_gradient(model: Model, c: np.ndarray, bases: tuple[np.ndarray, ...], rows: np.ndarray, dev: np.ndarray, s: dict[str, np.ndarray], reliable: np.ndarray) -> tuple[float, np.ndarray, np.ndarray]:
    """(loss, gradient of the parameters, gradient of the deviations) of sensors (positions rows) of one campaign.

    dev is (3, sensor, bin); the sums in s are (sensor, bin), k is (sensor, 1); reliable tells the anchored sensors.
    """
    cfg = model.config
    h, x, coef = model.coefficients(c)
    u = coef[0] @ bases[0].T
    centred = u[rows] - model.weights @ u
    pg, pn, pv = centred + dev[0], coef[1][rows] @ bases[1].T + dev[1], coef[2][rows] @ bases[2].T + dev[2]
    g, n, v = np.exp(np.clip(pg, -30, 30)), softplus(pn), model.variance_floor + softplus(pv)
    r, rs, rr = residual_sums(g, n, s)
    loss = 0.5 * float((rr / v + s["k"] * np.log(v)).sum())
    a, b, d = -rs / v * g, -r / v * sigmoid(pn), 0.5 * (s["k"] / v - rr / v**2) * sigmoid(pv)
    second = np.diff(centred, 2, axis=1)
    anchor = cfg.anchor * reliable[:, None]
    loss += cfg.smooth * float((second**2).sum()) + cfg.shrink * float((dev[:2] ** 2).sum()) + float((anchor * centred**2).sum())
    to_coef = (a + 2 * cfg.smooth * second_difference_adjoint(second, a.shape[1]) + 2 * anchor * centred) @ bases[0]
    gc = [np.zeros_like(k) for k in coef]
    np.add.at(gc[0], rows, to_coef)
    gc[0] -= np.outer(model.weights, to_coef.sum(axis=0))
    np.add.at(gc[1], rows, b @ bases[1])
    np.add.at(gc[2], rows, d @ bases[2])
    return loss, _from_coefficients(model, c, h, x, gc), np.stack([a + 2 * cfg.shrink * dev[0], b + 2 * cfg.shrink * dev[1], d])


def loss_and_gradient(model: Model, c: np.ndarray, grid: tuple, row: int, dev: list[np.ndarray], s: dict[str, np.ndarray], reliable: bool) -> tuple[float, np.ndarray, list[np.ndarray]]:
    """block_loss_and_gradient() of one sensor."""
    sums = {k: np.atleast_1d(np.asarray(v, float))[None] for k, v in s.items()}
    loss, grad, (a, b, d) = block_loss_and_gradient(model, c, model.bases(*grid), np.array([row]), np.stack(dev)[:, None], sums, np.array([reliable]))
    return loss, grad, [a[0], b[0], d[0]]


def batch_penalties(model: Model, c: np.ndarray, bases: tuple[np.ndarray, ...], rows: list[int], y: np.ndarray, records: int) -> tuple[float, float, np.ndarray]:
    """(consistency, correlation, weighted parameter gradient): what records y (record, sensor, bin) have of their campaign's means.

    Both look at log spectra corrected by the persistent curves alone: how far sensors lie from their mean, and how
    far the mean correlation of their pairs is from 1.
    """
    cfg = model.config
    u, p, _ = (k[rows] for k in model.persistent(c, bases))
    g, n, eps = np.exp(np.clip(u, -30, 30)), softplus(p), EPSILON / model.power_scale
    x = np.maximum(y - n, 0.0) / g
    z = np.log(x + eps)
    away = z - z.mean(axis=1, keepdims=True)
    cons = float((away**2).mean(axis=(1, 2)).sum()) / records
    dz = cfg.consistency * 2 * away / z[0].size / records
    a = z - z.mean(axis=2, keepdims=True)
    norm = np.sqrt((a**2).sum(axis=2))
    flat = norm < 1e-6
    unit = np.where(flat[..., None], 0.0, a / np.maximum(norm, 1e-6)[..., None])
    rho = unit @ unit.transpose(0, 2, 1)
    rho[flat[:, :, None] & flat[:, None, :]] = 1.0
    m = len(rows)
    pairs = max(m * (m - 1) // 2, 1)
    i, j = np.triu_indices(m, 1)
    corr = float((1 - rho[:, i, j]).sum()) / pairs / records
    others = unit.sum(axis=1, keepdims=True) - unit
    da = -(others - (unit * others).sum(axis=2, keepdims=True) * unit) / np.maximum(norm, 1e-6)[..., None] / pairs / records
    da[flat] = 0.0
    dz = dz + cfg.correlation * (da - da.mean(axis=2, keepdims=True))
    gain, floor = np.zeros((len(model.sensors), z.shape[2])), np.zeros((len(model.sensors), z.shape[2]))
    np.add.at(gain, rows, (-dz * x / (x + eps)).sum(axis=0))
    np.add.at(floor, rows, np.where(y > n, -dz / (g * (x + eps)), 0.0).sum(axis=0) * sigmoid(p))
    h, features, coef = model.coefficients(c)
    raw = gain @ bases[0]
    return cons, corr, _from_coefficients(model, c, h, features, [raw - np.outer(model.weights, raw.sum(axis=0)), floor @ bases[1], np.zeros_like(coef[2])])


def record_penalties(model: Model, c: np.ndarray, grid: tuple, rows: list[int], y: np.ndarray, records: int) -> tuple[float, float, np.ndarray]:
    """batch_penalties() of one record (sensor, bin)."""
    return batch_penalties(model, c, model.bases(*grid), rows, y[None], records)


def weighted_latent(y: np.ndarray, gain: np.ndarray, floor: np.ndarray, var: np.ndarray) -> np.ndarray:
    """Weighted least squares over the sensors of records y (record, sensor, bin), not below EPSILON."""
    w = gain / np.maximum(var, EPSILON)
    return np.maximum((w * (y - floor)).sum(axis=1) / np.maximum((w * gain).sum(axis=0), EPSILON), EPSILON)


def median_latent(y: np.ndarray, gain: np.ndarray, floor: np.ndarray, var: np.ndarray) -> np.ndarray:
    """The median over sensors of what each says of the scene, not below EPSILON."""
    return np.maximum(np.median((y - floor) / np.maximum(gain, EPSILON), axis=1), EPSILON)


def variance_deviation(model: Model, base: list[np.ndarray], dev: np.ndarray, s: dict[str, np.ndarray], basis: np.ndarray) -> np.ndarray:
    """Deviations of variance parameters from the mean residual energy under the curves base + dev, projected on the basis."""
    g, n = np.exp(np.clip(base[0] + dev[0], -30, 30)), softplus(base[1] + dev[1])
    _, _, rr = residual_sums(g, n, s)
    parameter = inverse_softplus(np.maximum(rr / s["k"], model.variance_floor) - model.variance_floor)
    ridge = model.config.ridge * np.eye(basis.shape[1])
    return np.linalg.solve(basis.T @ basis + ridge, basis.T @ parameter.T).T @ basis.T - base[2]
