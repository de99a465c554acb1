import math

import numpy as np
import pytest

from spectrafleet.llm import whitening


def brute(vectors):
    x = [[math.floor(256 * float(e)) for e in v] for v in vectors]
    fit = np.array(sorted(set(map(tuple, x))), float)
    mean = fit.mean(0)
    values, vectors = np.linalg.eigh((fit - mean).T @ (fit - mean) / len(fit))
    return np.array(x), fit, mean, values[::-1], vectors.T[::-1]


def check(rows, vectors):
    x, fit, mean, values, comps = brute([v for _, v in vectors])
    by, ids = {(r["vec_id"], r["component"]): r for r in rows}, [i for i, _ in vectors]
    n, sums = len(fit), fit.sum(0).astype(int)
    assert len(rows) == 4 * len(vectors)
    for c in range(4):
        got = np.array([by[i, c + 1]["whitened"] for i in ids])
        want = (x - mean) @ comps[c] / math.sqrt(values[c])
        assert np.abs(got * np.sign(got @ want) - want).max() < 1e-8
        assert abs(by[ids[0], c + 1]["explained"] / (values[c] / values.sum()) - 1) < 1e-9
    for i, row in zip(ids, x, strict=True):
        r = by[i, 1]
        assert r["n"] == n and r["deviation"] == sum((n * int(e) - int(s)) ** 2 for e, s in zip(row, sums, strict=True))
        assert r["identity_error"] < 1e-9


def vectors(n, d, seed=1, spread=None):
    rng = np.random.default_rng(seed)
    x = rng.standard_normal((n, d)) * (spread if spread is not None else 1) + 0.3
    return [(i, [float(e) for e in np.float32(v)]) for i, v in enumerate(x)]


@pytest.mark.parametrize("spread", [None, "falling"])
def test_against_numpy(spark, spread):
    rows = vectors(300, 40, spread=None if spread is None else 4.0 ** -np.arange(40.0) + 1e-3)
    rows += [(1000, rows[5][1]), (1001, rows[5][1])]
    table = [(i, v, "clash", 1) for i, v in rows] + [(2000, None, "", 1), (2001, [float("nan")] * 40, "", 1), (2002, [None] + [1.0] * 39, "", 1), (2003, [float("-inf")] * 40, "", 1)]
    df = spark.createDataFrame(table, "vec_id long, embedding array<float>, x string, n int").repartition(3)
    check(whitening.whiten(df).collect(), rows)


def test_falling_spectrum_needs_no_expansion(spark):
    rows = vectors(400, 60, spread=8.0 ** -np.arange(60.0))
    df = whitening.stepped(spark.createDataFrame(rows, "vec_id long, embedding array<float>"))
    assert whitening.fit(df).passes <= whitening.POWER_PASSES
    flat = whitening.stepped(spark.createDataFrame(vectors(400, 60), "vec_id long, embedding array<float>"))
    assert whitening.fit(flat).passes == whitening.POWER_PASSES + 1


def test_sums_do_not_depend_on_partitions(spark, monkeypatch):
    rows = vectors(200, 12)
    df = spark.createDataFrame(rows, "vec_id long, embedding array<float>")
    monkeypatch.setattr(whitening, "FAN_IN", 2)
    x = whitening.stepped(df).select("x").repartition(9)
    total = whitening._summed(spark, x, lambda m: m.sum(0), (12,), np.int64)
    assert total.tolist() == brute([v for _, v in rows])[0].sum(0).tolist()


def test_exact_deviation_beyond_doubles(spark):
    rows = [(i, [float(1000 * i + k * k) for k in range(6)]) for i in range(50)]
    got = {r["vec_id"]: r["deviation"] for r in whitening.whiten(spark.createDataFrame(rows, "vec_id long, embedding array<double>")).filter("component = 1").collect()}
    x = [[256 * int(e) for e in v] for _, v in rows]
    sums = [sum(c) for c in zip(*x, strict=True)]
    assert got == {i: sum((50 * e - s) ** 2 for e, s in zip(x[i], sums, strict=True)) for i in range(50)}


def test_small_and_odd_tables(spark):
    schema = "vec_id long, embedding array<float>"
    assert whitening.whiten(spark.createDataFrame([], schema)).count() == 0
    assert whitening.whiten(spark.createDataFrame([(1, None), (2, [None])], schema)).count() == 0
    assert whitening.whiten(spark.createDataFrame([(1, [1.0, 2.0]), (2, [1.0, 2.0])], schema)).count() == 0
    line = whitening.whiten(spark.createDataFrame([(1, [1.0, 2.0]), (None, [2.0, 3.0]), (3, [2.0])], schema)).collect()
    assert {r["component"] for r in line} == {1, 2} and {r["vec_id"] for r in line} == {1, None, 3} and len(line) == 6
    assert whitening.whiten(spark.createDataFrame([(1, []), (2, [])], schema)).count() == 0


def test_query_against_numpy(spark):
    from spectrafleet.llm.queries import QUERIES

    rows = spark.read.parquet("/root/testdata/sf0.001/embeddings.parquet").collect()
    check(QUERIES["op12_range_finder"](spark, "/root/testdata/sf0.001").collect(), [(r["vec_id"], r["embedding"]) for r in rows])
