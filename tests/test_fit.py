import numpy as np
import pytest

from spectrafleet.operators import fit as G

FEATURES = ("u", "v")


def model(seed=0):
    cfg = G.FitConfig(bases=(6, 5, 4), embedding=2, hidden=3, smooth=0.3, shrink=0.7, anchor=0.5)
    rng = np.random.default_rng(seed)
    m = G.Model(["a", "b", "d"], np.array([0.2, 0.3, 0.5]), FEATURES, np.zeros(2), np.ones(2), (0.0, 1.0), 0.01, 1.0, cfg)
    m.theta = {"E": rng.normal(size=(3, 2)), "W": rng.normal(size=(3, 2)), "b": rng.normal(size=3)} | {f"A{i}": 0.3 * rng.normal(size=(k, 5)) for i, k in enumerate(cfg.bases)} | {f"B{i}": 0.3 * rng.normal(size=k) for i, k in enumerate(cfg.bases)}
    return m


def sums(rng, n=12, k=7):
    y, s = rng.gamma(2.0, 1.0, (k, n)), rng.gamma(2.0, 1.0, (k, n))
    return y, s, {"k": float(k), "y": y.sum(0), "yy": (y * y).sum(0), "ys": (y * s).sum(0), "s": s.sum(0), "ss": (s * s).sum(0)}


def test_sums_give_the_residuals():
    rng = np.random.default_rng(1)
    y, s, t = sums(rng)
    g, n = rng.gamma(2, 1, 12), rng.gamma(1, 1, 12)
    r = y - g * s - n
    for got, want in zip(G.residual_sums(g, n, t), (r.sum(0), (r * s).sum(0), (r * r).sum(0)), strict=True):
        assert np.allclose(got, want)


@pytest.mark.parametrize("row,reliable", [(0, True), (2, False)])
def test_gradients_match_finite_differences(row, reliable):
    rng = np.random.default_rng(4)
    m, c = model(), np.array([0.4, -0.8])
    _, _, t = sums(rng)
    dev = [0.1 * rng.normal(size=12) for _ in range(3)]
    call = lambda mm, d: G.loss_and_gradient(mm, c, (0.0, 1.0, 12), row, d, t, reliable)
    _, grad, gdev = call(m, dev)
    flat, eps = m.flat(m.theta), 1e-6
    for i in range(len(flat)):
        up, down = flat.copy(), flat.copy()
        up[i] += eps
        down[i] -= eps
        num = (call(G.replace(m, theta=m.unflat(up)), dev)[0] - call(G.replace(m, theta=m.unflat(down)), dev)[0]) / (2 * eps)
        assert grad[i] == pytest.approx(num, rel=1e-4, abs=1e-5)
    for j in range(3):
        for i in (0, 5, 11):
            up, down = [x.copy() for x in dev], [x.copy() for x in dev]
            up[j][i] += eps
            down[j][i] -= eps
            # Smoothing and the anchor act on the persistent curve alone.
            assert gdev[j][i] == pytest.approx((call(m, up)[0] - call(m, down)[0]) / (2 * eps), rel=1e-4, abs=1e-5)


@pytest.mark.parametrize("cons,corr", [(1.0, 0.0), (0.0, 1.0), (0.7, 2.0)])
def test_penalty_gradients_match_finite_differences(cons, corr):
    rng = np.random.default_rng(9)
    m, c = model(5), np.array([0.3, 0.9])
    m.config = G.replace(m.config, consistency=cons, correlation=corr)
    y = rng.gamma(3.0, 2.0, (2, 12))
    call = lambda mm: G.record_penalties(mm, c, (0.0, 1.0, 12), [0, 2], y, 4)
    grad, flat, eps = call(m)[2], m.flat(m.theta), 1e-6
    value = lambda t: cons * (r := call(G.replace(m, theta=m.unflat(t))))[0] + corr * r[1]
    for i in range(len(flat)):
        up, down = flat.copy(), flat.copy()
        up[i] += eps
        down[i] -= eps
        assert grad[i] == pytest.approx((value(up) - value(down)) / (2 * eps), rel=1e-3, abs=1e-6)


def test_penalties_vanish_on_identical_spectra():
    m = model(1)
    m.theta = {k: np.zeros_like(v) for k, v in m.theta.items()}
    m.config = G.replace(m.config, consistency=1.0, correlation=1.0)
    same = np.tile(np.linspace(2, 5, 12), (3, 1))
    one, two, grad = G.record_penalties(m, np.zeros(2), (0.0, 1.0, 12), [0, 1, 2], same, 1)
    assert one == pytest.approx(0) and two == pytest.approx(0) and np.allclose(grad, 0)


def test_persistent_gain_is_centred_and_parameters_round_trip():
    m = model(3)
    g = m.persistent(np.array([0.1, 0.2]), m.bases(0.0, 1.0, 9))[0]
    assert np.allclose(m.weights @ g, 0, atol=1e-12)
    assert all(np.array_equal(v, m.unflat(m.flat(m.theta))[k]) for k, v in m.theta.items())
    assert np.allclose(G.softplus(G.inverse_softplus(np.array([1e-6, 0.5, 30.0]))), [1e-6, 0.5, 30.0])


def test_fit_recovers_gains(spark):
    rng = np.random.default_rng(17)
    gain, rows, configs = {"a": 0.7, "b": 1.0, "d": 1.5}, [], []
    for c in range(3):
        configs.append((f"c{c}", float(c), float(c % 2)))
        for k in range(10):
            s = 1e-6 * rng.gamma(4.0, 1.0, 24)
            for i, (name, g) in enumerate(gain.items()):
                y = np.maximum(g * s + 1e-7 + 1e-8 * rng.normal(size=24), 1e-9)
                rows.append((f"c{c}", k, name, k * 10 + i, k * 1000, 88e6, 108e6, 24, (10 * np.log10(y)).tolist()))
    df = spark.createDataFrame(rows, "campaign string, record_idx long, sensor_id string, src_row long, ts_ms long, start_freq_hz double, end_freq_hz double, n_bins int, pxx_db array<double>")
    conf = spark.createDataFrame(configs, "campaign string, u double, v double")
    reliable = spark.createDataFrame([(f"c{c}", "b") for c in range(3)], "campaign string, reliable_sensor string")
    done = G.fit(df, conf, reliable, FEATURES, G.FitConfig(outer=4, inner=8))
    assert min(done.history) < done.history[0] and np.isfinite(done.history).all()
    means = {}
    for r in G.campaign_curves(done.model, done.state).collect():
        means.setdefault(r["sensor_id"], []).append(np.mean(r["gain"]))
    got = {k: np.mean(v) for k, v in means.items()}
    assert got["a"] < got["b"] < got["d"] and got["d"] / got["a"] == pytest.approx(1.5 / 0.7, rel=0.25)
    dev = np.array([r["d0"] for r in done.state.filter("campaign = 'c1'").collect()])
    assert np.allclose(dev.mean(axis=0), 0, atol=1e-9)
    assert G.fit_diagnostics(done)["steps"] == 32
    tied = G.fit(df, conf, reliable, FEATURES, G.FitConfig(outer=1, inner=3, consistency=1e3, correlation=1e3, joint=False))
    assert np.isfinite(tied.history).all() and tied.history[-1] < tied.history[0]


def small_corpus(spark, bins=16, records=5):
    rng, gain, rows = np.random.default_rng(8), {"a": 0.7, "b": 1.0, "d": 1.5}, []
    configs = [(f"c{c}", float(c), float(c % 2)) for c in range(4)]
    for name, *_ in configs:
        for k in range(records):
            s = 1e-6 * rng.gamma(4.0, 1.0, bins)
            for i, (sensor, g) in enumerate(list(gain.items())[: 2 if name == "c3" else 3]):
                rows.append((name, k, sensor, k * 10 + i, k * 1000, 88e6, 108e6, bins, (10 * np.log10(np.maximum(g * s + 1e-7 + 1e-8 * rng.normal(size=bins), 1e-9))).tolist()))
    df = spark.createDataFrame(rows, "campaign string, record_idx long, sensor_id string, src_row long, ts_ms long, start_freq_hz double, end_freq_hz double, n_bins int, pxx_db array<double>")
    return df, spark.createDataFrame(configs, "campaign string, u double, v double"), spark.createDataFrame([(c[0], "b") for c in configs], "campaign string, reliable_sensor string"), FEATURES


def same_fit(a, b):
    assert a.history == pytest.approx(b.history, rel=1e-9) and a.rounds == pytest.approx(b.rounds, rel=1e-9) and a.gradient_norms == pytest.approx(b.gradient_norms, rel=1e-9)
    # parameters that no curve depends on (a common level of log gains) move by rounding errors; curves don't
    for c in ([0.0, 0.0], [1.0, -0.5]):
        for x, y in zip(*(m.persistent(np.array(c), m.bases(88e6, 108e6, 16)) for m in (a.model, b.model)), strict=True):
            assert np.allclose(x, y, rtol=1e-9, atol=1e-9)
    key = lambda r: (r["campaign"], r["sensor_id"])
    for x, y in zip(sorted(a.state.collect(), key=key), sorted(b.state.collect(), key=key), strict=True):
        assert key(x) == key(y) and all(np.allclose(x[d], y[d], rtol=1e-9, atol=1e-9) for d in ("d0", "d1", "d2"))


def test_a_round_is_the_same_in_one_task_in_many_and_in_a_job_a_step(spark, monkeypatch):
    given = small_corpus(spark)
    config = G.FitConfig(outer=2, inner=4, consistency=3.0, correlation=5.0, joint=False)
    one = G.fit(*given, config)
    jobs = G.fit(*given, config, held_bytes=0)
    joint = G.fit(*given, G.replace(config, joint=True))
    monkeypatch.setattr(G, "TASK_BYTES", 1)
    same_fit(one, G.fit(*given, config))
    same_fit(one, jobs)
    same_fit(joint, G.fit(*given, G.replace(config, joint=True)))
    with pytest.raises(ValueError, match="joint=False"):
        G.fit(*given, G.FitConfig(outer=1), held_bytes=0)


def test_joint_steps_fit_no_worse_than_alternating_ones(spark):
    given = small_corpus(spark)
    joint, apart = (G.fit(*given, G.FitConfig(outer=4, inner=15, joint=j)) for j in (True, False))
    assert joint.selected <= apart.selected
    dev = np.array([r["d0"] for r in joint.state.filter("campaign = 'c1'").collect()])
    assert np.abs(dev).max() > 1e-3 and np.allclose(dev.mean(axis=0), 0, atol=1e-9)
    told = G.fit_diagnostics(joint)
    assert told["campaigns"] == 4 and told["sensors"] == 3 and told["values"] == 11 * 5 * 16 and len(told["max_gradient_norm_by_round"]) == 4
    assert told["mean_campaign_objective"] * 4 == pytest.approx(joint.selected)


def test_gradients_of_both_levels_match_finite_differences():
    rng = np.random.default_rng(9)
    m, c, rows = model(2), np.array([0.3, 0.9]), np.array([2, 0])
    parts = [sums(rng, k=9)[2] for _ in rows]
    s = {"k": np.array([[9.0], [9.0]])} | {a: np.stack([p[a] for p in parts]) for a in ("y", "yy", "ys", "s", "ss")}
    dev, reliable, bases = 0.1 * rng.normal(size=(3, 2, 12)), np.array([True, False]), m.bases(0.0, 1.0, 12)
    call = lambda mm, d: G.block_loss_and_gradient(mm, c, bases, rows, d, s, reliable)
    _, grad, gdev = call(m, dev)
    flat, eps = m.flat(m.theta), 1e-6
    for i in range(len(flat)):
        shift = eps * (np.arange(len(flat)) == i)
        num = (call(G.replace(m, theta=m.unflat(flat + shift)), dev)[0] - call(G.replace(m, theta=m.unflat(flat - shift)), dev)[0]) / (2 * eps)
        assert grad[i] == pytest.approx(num, rel=1e-4, abs=1e-5)
    for at in np.ndindex(*dev.shape):
        shift = np.zeros_like(dev)
        shift[at] = eps
        assert gdev[at] == pytest.approx((call(m, dev + shift)[0] - call(m, dev - shift)[0]) / (2 * eps), rel=1e-4, abs=1e-5)
    # one sensor at a time comes to the same
    alone = [G.loss_and_gradient(m, c, (0.0, 1.0, 12), r, list(dev[:, i]), {k: v[i] if k != "k" else 9.0 for k, v in s.items()}, bool(reliable[i])) for i, r in enumerate(rows)]
    assert sum(a[0] for a in alone) == pytest.approx(call(m, dev)[0]) and np.allclose(sum(a[1] for a in alone), grad)


def test_penalties_of_a_batch_are_those_of_its_records():
    rng, m = np.random.default_rng(3), model(5)
    m.config = G.replace(m.config, consistency=2.0, correlation=3.0)
    y, c = rng.gamma(3.0, 2.0, (4, 2, 12)), np.array([0.2, -0.1])
    both = G.batch_penalties(m, c, m.bases(0.0, 1.0, 12), [0, 2], y, 6)
    each = [G.record_penalties(m, c, (0.0, 1.0, 12), [0, 2], r, 6) for r in y]
    assert both[0] == pytest.approx(sum(e[0] for e in each)) and both[1] == pytest.approx(sum(e[1] for e in each)) and np.allclose(both[2], sum(e[2] for e in each))


def test_initial_variances_are_those_of_residuals(spark):
    rows, configs, reliable, features = small_corpus(spark, bins=12, records=6)
    done = G.fit(rows, configs, reliable, features, G.FitConfig(outer=1, inner=0))
    # the start: floors of a tenth of the 5 % quantile, latent spectra that are medians over sensors
    state = {(r["campaign"], r["sensor_id"]): r for r in done.state.collect()}
    assert len(state) == 11 and all(np.isfinite(r["d2"]).all() for r in state.values())


def test_registered_fits_run_the_whole_schedule(spark, monkeypatch):
    from spectrafleet.jobs import queries as Q

    class Seen(Exception):
        pass

    def stop(rows, configs, reliable, features, config=G.FitConfig(), weights=None):
        raise Seen(config.outer, config.inner, config.patience)

    monkeypatch.setattr(Q.fit, "fit", stop)
    for query in (Q.fit_corpus, Q.evaluate_corpus):
        with pytest.raises(Seen) as got:
            query(spark, "/root/testdata/sf0.001")
        assert got.value.args == (10, 30, 5)
