"""Alignment against a plain matcher that shares no code with the library."""

import itertools
import random
from statistics import median

import numpy as np
import pytest
from pyspark.sql import functions as F

from spectrafleet.operators import alignment as A


def plain_records(times, tol, anchor):
    """The rule as stated: anchor rows in order, each with every other sensor's nearest free row, or none at all."""
    last, out = {s: -1 for s in times}, []
    for i, t in enumerate(times[anchor]):
        record = {anchor: i}
        for s, ts in times.items():
            if s != anchor:
                free = [j for j in range(last[s] + 1, len(ts)) if -tol <= ts[j] - t <= tol]
                if free:
                    record[s] = min(free, key=lambda j: (abs(ts[j] - t), ts[j], -j if ts[j] < t else j))
        if len(record) == len(times):
            out.append(record)
            last.update({s: j for s, j in record.items() if s != anchor})
    return out


def plain_anchor(times):
    return sorted(times, key=lambda s: (len(times[s]), s))[0]


def plain_tolerance(times):
    gaps = [b - a for ts in times.values() for a, b in itertools.pairwise(ts) if b > a]
    return round(min(max(median(gaps) / 4, 250), 5000)) if gaps else 5000


def plain_best(times, tol):
    """(sensors, records, tolerance) by trying every subset, larger ones first."""
    for size in range(len(times), 1, -1):
        found = []
        for kept in itertools.combinations(sorted(times), size):
            part = {s: times[s] for s in kept}
            t = plain_tolerance(part) if tol is None else tol
            records = plain_records(part, t, plain_anchor(part))
            shares = [len(records) / len(ts) for ts in part.values()]
            if records:
                found.append(((-len(records), -sum(shares) / size, -min(shares), kept), records, t))
        if found:
            (*_, kept), records, t = min(found, key=lambda f: f[0])
            return kept, records, t
    return (), [], None


def most_matches(a, b, tol):
    best = np.zeros((len(a) + 1, len(b) + 1), int)
    for i, x in enumerate(a, 1):
        for j, y in enumerate(b, 1):
            best[i, j] = max(best[i - 1, j], best[i, j - 1], best[i - 1, j - 1] + (abs(x - y) <= tol))
    return int(best[-1, -1])


def random_times(rng, sensors, n, step):
    return {s: sorted(rng.randrange(0, n * step) if rng.random() < 0.5 else rng.randrange(n) * step for _ in range(rng.randrange(1, n))) for s in sensors}


def table(spark, campaigns):
    rows = [(c, s, 1000 * i + k, t) for c, times in campaigns.items() for i, (s, ts) in enumerate(times.items()) for k, t in enumerate(ts)]
    return spark.createDataFrame(rows, "campaign string, sensor_id string, src_row long, ts_ms long").repartition(5)


def found(rows, campaigns):
    return sorted((r["campaign"], r["record_idx"], r["sensor_id"], r["src_row"] % 1000) for r in rows.collect())


def test_the_rule_on_a_thousand_series():
    rng = random.Random(1)
    for _ in range(1000):
        times = random_times(rng, ["a", "b", "c"][: rng.randrange(2, 4)], rng.randrange(2, 30), rng.choice([3, 10, 40]))
        tol = rng.choice([0, 2, 9, 30])
        assert A.greedy_groups({s: np.array(t) for s, t in times.items()}, tol) == plain_records(times, tol, plain_anchor(times))


def test_blocks_match_like_whole_campaigns(spark, monkeypatch):
    rng = random.Random(2)
    campaigns = {f"k{k}": random_times(rng, ["a", "b", "c"], 40, rng.choice([4, 12])) for k in range(15)}
    # matches that stay late for the whole campaign: every start depends on the block before
    campaigns["late"] = {"a": list(range(0, 900, 3)), "b": list(range(6, 906, 3)) + [5000], "c": list(range(3, 903, 3)) + [5000]}
    rows, tol = table(spark, campaigns), 7
    chosen = A.select_anchor(rows).withColumn("sensors", F.lit(3)).withColumn("tolerance_ms", F.lit(tol).cast("long"))
    want = sorted((c, k, s, j) for c, times in campaigns.items() for k, r in enumerate(plain_records(times, tol, plain_anchor(times))) for s, j in r.items())
    for size in (8, 10_000):
        monkeypatch.setattr(A, "BLOCK_ROWS", size)
        assert found(A.match_blocks(rows.join(chosen, "campaign"), A.greedy_groups), campaigns) == want
    assert found(A.align(rows, tol), campaigns) == want


@pytest.mark.parametrize("tol", [6, None])
def test_the_best_subset_is_that_of_an_exhaustive_search(spark, monkeypatch, tol):
    rng = random.Random(3)
    monkeypatch.setattr(A, "WAVE", 5)
    monkeypatch.setattr(A, "BLOCK_ROWS", 20)
    campaigns = {}
    while len(campaigns) < 6:
        step = 10 if tol is not None else 900
        times = random_times(rng, "abcde"[: rng.randrange(3, 6)], 12, step)
        shift = rng.choice([0, 10_000_000])
        times[min(times)] = [t + shift for t in times[min(times)]]
        campaigns[f"k{len(campaigns)}"] = times
    campaigns["none"] = {"a": [0], "b": [1_000_000], "c": [2_000_000]}
    got = A.align_subsets(table(spark, campaigns), tol)
    want, tolerances = [], {}
    for c, times in campaigns.items():
        _, records, tolerances[c] = plain_best(times, tol)
        want += [(c, k, s, j) for k, r in enumerate(records) for s, j in r.items()]
    assert found(got, campaigns) == sorted(want)
    assert all(r["tolerance_ms"] == tolerances[r["campaign"]] for r in got.collect())


def test_few_subsets_are_matched():
    rng, sensors = random.Random(4), [f"s{i:02d}" for i in range(12)]
    times = {s: sorted(rng.sample(range(0, 4000, 10), 40)) for s in sensors}
    for s in sensors[:6]:
        times[s] = sorted({*times[s], *range(5000, 5300, 30)})
    counts, most = [len(times[s]) for s in sensors], {t: np.array([[most_matches(times[a], times[b], t) if a != b else 0 for b in sensors] for a in sensors]) for t in (3, 6)}
    tried = {}
    while True:
        todo, chosen = A.next_subsets(sensors, counts, most[3], most[6], tried, 8)
        if not todo:
            break
        for m in todo:
            part = {s: times[s] for i, s in enumerate(sensors) if m >> i & 1}
            tried[m] = len(plain_records(part, 3, plain_anchor(part)))
    assert [s for i, s in enumerate(sensors) if chosen >> i & 1] == list(plain_best({s: times[s] for s in sensors[:8]}, 3)[0]) or tried[chosen] > 0
    assert len(tried) < 4096


def test_pair_counts_are_the_most_matches(spark, monkeypatch):
    rng = random.Random(5)
    monkeypatch.setattr(A, "BLOCK_ROWS", 10)
    campaigns = {f"k{k}": random_times(rng, ["a", "b", "c"], 25, 8) for k in range(8)}
    campaigns["apart"] = {"a": [0], "b": [10**9]}
    got = {(r["campaign"], r["sensor_a"], r["sensor_b"]): r["matches"] for r in A.pairwise_match_count(table(spark, campaigns), 5).collect()}
    assert got == {(c, a, b): most_matches(times[a], times[b], 5) for c, times in campaigns.items() for a, b in itertools.combinations(sorted(times), 2)}


def plain_nearest(rows, tol):
    """The nearest rows as stated: least distance, then the earlier time, then the last of earlier rows or the first of the others."""
    out = set()
    for campaign in {r[0] for r in rows}:
        series = {}
        for c, s, k, t in rows:
            if c == campaign:
                series.setdefault(s, []).append((t, k))
        anchor = plain_anchor(series)
        for t, k in series[anchor]:
            for s, others in series.items():
                near = [(abs(u - t), u, -j if u < t else j, j) for u, j in others if s != anchor and abs(u - t) <= tol]
                if near:
                    out.add((campaign, k, t, s, min(near)[3], min(near)[1]))
    return out


@pytest.mark.parametrize(("block", "tol"), [(3, 20), (50_000, 20), (10, 0), (7, 100_000)])
def test_nearest_rows_over_blocks(spark, monkeypatch, block, tol):
    rng = random.Random(block + tol)
    rows = [(c, f"s{rng.choice((1, 1, 2, 2, 3))}", k, rng.randrange(0, wide)) for k, (c, wide) in enumerate([("a", 300), ("b", 4000), ("c", 1)] * 60)] + [("d", "s1", 1, 5), ("e", "s1", 2, -70), ("e", "s2", 3, -80)]
    rows += [("f", "s1", 1000 + k, 10 * k) for k in range(30)] + [("f", "s2", 2000 + k, 280 + k) for k in range(60)]  # sensors that hardly overlap
    rng.shuffle(rows)
    monkeypatch.setattr(A, "BLOCK_ROWS", block)
    df = spark.createDataFrame(rows, "campaign string, sensor_id string, src_row long, ts_ms long")
    tolerance = df.select("campaign").distinct().withColumn("tolerance_ms", F.lit(tol).cast("long"))
    got = [tuple(r) for r in A.nearest_asof(df, tolerance).select("campaign", "anchor_row", "anchor_ts", "sensor_id", "src_row", "ts_ms").collect()]
    assert len(got) == len(set(got)) and set(got) == plain_nearest(rows, tol)


def test_nearest_rows_of_dense_series(spark):
    """Twice 20,000 rows, each within the tolerance of each: 400 million pairs, too many to list within the time."""
    import threading

    n = 20_000
    df = spark.range(2 * n).selectExpr("'c' campaign", "if(id % 2 = 0, 'a', 'b') sensor_id", "id src_row", "id * 10 ts_ms")
    tolerance = spark.createDataFrame([("c", 100 * n)], "campaign string, tolerance_ms long")
    late = threading.Timer(60, spark.sparkContext.cancelAllJobs)
    late.start()
    try:
        got = A.nearest_asof(df, tolerance).agg(F.count(F.lit(1)).alias("n"), F.min(F.col("anchor_ts") - F.col("ts_ms")).alias("least"), F.max(F.col("anchor_ts") - F.col("ts_ms")).alias("most")).first()
    finally:
        late.cancel()
    assert (got["n"], got["least"], got["most"]) == (n, -10, 10)  # the first row has none before it
