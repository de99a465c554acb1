import json
import math
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from spectrafleet.functions import spectra as S
from spectrafleet.operators import alignment as A
from spectrafleet.operators import calibration as C
from spectrafleet.operators import diagnostics as D
from spectrafleet.operators import ranking as R
from spectrafleet.operators import records as P
from spectrafleet.operators import sets as X
from spectrafleet.sources import measurements as M
from spectrafleet.streaming import calibrate as stream


def spectra_rows(spark, table, campaign="c"):
    """table: {sensor: [[dB...], ...]}"""
    out = [(campaign, k, s, k * 1000 + i, k * 1000, 88e6, 108e6, len(x), [float(v) for v in x]) for i, (s, rows) in enumerate(table.items()) for k, x in enumerate(rows)]
    return spark.createDataFrame(out, "campaign string, record_idx long, sensor_id string, src_row long, ts_ms long, start_freq_hz double, end_freq_hz double, n_bins int, pxx_db array<double>")


def test_noise_floor_is_numpys_histogram():
    rng = np.random.default_rng(0)
    rows = np.concatenate([rng.normal(-60, 5, (200, 64)), np.round(rng.normal(0, 3, (200, 64))), np.full((2, 64), 3.0), np.arange(51.0)[None, :].repeat(2, 0).repeat(2, 1)[:, :64]])
    for x, got in zip(rows, S.noise_floors(rows), strict=True):
        counts, edges = np.histogram(x, bins=50)
        assert np.isclose(got, edges[counts.argmax()], atol=1e-9)


def test_ranking_puts_the_reversed_sensor_last(spark):
    base = [[-60, -58, -50, -41, -45, -52, -57, -61], [-61, -57, -49, -42, -46, -53, -58, -60], [-60, -59, -51, -40, -44, -51, -57, -62]]
    table = {"Node1": base, "Node3": [[v + 0.1 * (i % 3) for i, v in enumerate(x)] for x in base], "Node9": [x[::-1] for x in base]}
    rows = spectra_rows(spark, table)
    ranking = {r["sensor_id"]: r for r in R.sensor_ranking(rows).collect()}
    assert ranking["Node9"]["rank"] == 3
    stability = R.rank_stability(R.record_scores(rows)).collect()
    assert sum(r["top_1_count"] for r in stability) == 3
    m = P.pearson(np.array([table[s][0] for s in sorted(table)]))
    got = {(r["sensor_a"], r["sensor_b"]): r["value"] for r in P.record_matrix(rows, "pxx_db", P.pearson).filter("record_idx = 0").collect()}
    assert got["Node1", "Node3"] == pytest.approx(m[0, 1]) and np.allclose(np.diag(m), 1)


def test_distribution_flags_the_offset_sensor(spark):
    near = [[-58.7, -58.6, -58.8, -58.7], [-58.7, -58.65, -58.75, -58.7]]
    rows = spectra_rows(spark, {"Node1": near, "Node3": near, "Node9": [[v - 14 for v in x] for x in near]})
    got = {r["sensor_id"]: r for r in R.distribution_similarity(R.psd_histogram(R.spectra_values(rows), 10), 10).collect()}
    assert [r["sensor_id"] for r in sorted(got.values(), key=lambda r: r["rank"])] == ["Node3", "Node1", "Node9"]
    assert got["Node9"]["is_outlier"] and not got["Node1"]["is_outlier"]


def test_counts_are_those_of_the_edges(spark):
    rng = np.random.default_rng(6)
    spectra = {s: [(-60 + 0.1 * rng.integers(0, 50, 40)).tolist() for _ in range(7)] for s in ("x", "y")}
    rows = spectra_rows(spark, spectra).repartition(3)
    edges = lambda lo, hi, n: np.array([lo + i * ((hi - lo) / n) for i in range(n)] + [hi])
    for bins, limits in ((10, None), (7, (-59.0, -56.5))):
        lo, hi = limits or (min(v for xs in spectra.values() for x in xs for v in x), max(v for xs in spectra.values() for x in xs for v in x))
        want = {}
        for s, xs in spectra.items():
            v = np.concatenate(xs)
            v = v[(v >= lo) & (v <= hi)]
            n = np.bincount(np.minimum(np.searchsorted(edges(lo, hi, bins), v, "right") - 1, bins - 1), minlength=bins)
            want |= {(s, b): (int(k), k / (n.sum() * (hi - lo) / bins)) for b, k in enumerate(n) if k}
        for values in (R.spectra_values(rows), rows.select("campaign", "sensor_id", F.explode("pxx_db").alias("value"))):
            got = {(r["sensor_id"], r["bin"]): r for r in R.psd_histogram(values, bins, limits).collect()}
            assert set(got) == set(want) and all(got[k]["n"] == n and got[k]["density"] == pytest.approx(d) for k, (n, d) in want.items())
            whole = R.histogram_summary(values, bins, limits).collect()
            assert len(whole) == bins and sum(r["n"] for r in whole) == sum(n for n, _ in want.values())
            assert whole[0]["clipped_fraction"] == pytest.approx(1 - sum(n for n, _ in want.values()) / 560)
    with pytest.raises(ValueError, match="no value within the range"):
        R.psd_histogram(R.spectra_values(rows), 5, (5.0, 6.0)).count()
    told = {r["sensor_id"]: r for r in R.sensor_integrity(rows).collect()}
    for s, xs in spectra.items():
        assert (told[s]["mean_db"], told[s]["std_db"]) == pytest.approx((np.mean(xs), np.std(xs))) and (told[s]["min_db"], told[s]["max_db"]) == (np.min(xs), np.max(xs))


def series(spark, times, campaign="c"):
    out = [(campaign, s, i * 1000 + k, t) for i, (s, ts) in enumerate(times.items()) for k, t in enumerate(ts)]
    return spark.createDataFrame(out, "campaign string, sensor_id string, src_row long, ts_ms long")


def test_alignment_with_unequal_rows(spark):
    rows = series(spark, {"Alpha": [1000, 2000, 3000], "Beta": [1010, 3010], "Gamma": [995, 2005, 2995]})
    aligned = A.align(rows, 50)
    assert {(r["record_idx"], r["sensor_id"], r["ts_ms"]) for r in aligned.collect()} == {(0, "Alpha", 1000), (0, "Beta", 1010), (0, "Gamma", 995), (1, "Alpha", 3000), (1, "Beta", 3010), (1, "Gamma", 2995)}
    report = {r["sensor_id"]: r for r in A.align_report(rows, aligned).collect()}
    assert report["Beta"]["is_anchor"] and [report[s]["dropped_rows"] for s in ("Alpha", "Beta", "Gamma")] == [1, 0, 1]
    assert report["Beta"]["max_spread_ms"] == 15


def test_pruning_keeps_the_largest_subset(spark):
    base = [0, 1000, 2000, 3000]
    rows = series(spark, {"A": base, "B": [t + 10 for t in base], "C": [t - 10 for t in base], "D": [t + 50_000 for t in base], "E": [t + 700 for t in base]})
    assert A.align(rows, 50).count() == 0
    kept = A.align(rows, 50, allow_pruning=True).collect()
    assert {r["sensor_id"] for r in kept} == {"A", "B", "C"} and len(kept) == 12
    times = {f"S{i:02d}": [t + (i * 5 if i < 4 else 100_000 * i) for t in base] for i in range(14)}
    kept = A.align(series(spark, times), 50, allow_pruning=True).collect()
    assert {r["sensor_id"] for r in kept} == {"S00", "S01", "S02", "S03"} and len(kept) == 16


def test_the_fast_path_is_the_greedy_one(spark):
    rng = random.Random(1)
    parts, want = [], []
    for c in range(40):
        times = {}
        for s in ("a", "b", "d"):
            ts = sorted(rng.choice([k * 1000, k * 1000 + rng.randrange(-90, 90), k * 1000 + 50]) for k in range(12) if rng.random() < 0.9)
            times[s] = ts or [0]
        parts.append(series(spark, times, f"c{c}"))
        tol = 100
        for k, g in enumerate(A.greedy_groups({s: np.array(t) for s, t in times.items()}, tol)):
            want += [(f"c{c}", k, s, times[s][j]) for s, j in g.items()]
    rows = parts[0]
    for p in parts[1:]:
        rows = rows.unionByName(p)
    for n in (1, 3, 17):
        got = A.align(rows.repartition(n), 100).collect()
        assert sorted((r["campaign"], r["record_idx"], r["sensor_id"], r["ts_ms"]) for r in got) == sorted(want)


def test_rmse_and_limits(spark):
    raw = {"a": [[0, 2], [0, 2]], "b": [[3, 5], [3, 5]], "c": [[6, 8], [6, 8]]}
    got = [r["rmse_db"] for r in D.pairwise_rmse(spectra_rows(spark, raw), "pxx_db").collect()]
    assert got == pytest.approx([4.0, 4.0])
    rows = spectra_rows(spark, raw).withColumnsRenamed({"pxx_db": "raw_db"}).withColumn("calibrated_db", F.array(F.lit(1.0), F.lit(9.0)))
    limits = D.overlay_limits(rows).first()
    assert (limits["lower"], limits["upper"]) == (-0.5, 9.5)


def test_dropping_leading_rows_follows_time(spark):
    rows = series(spark, {"x": [3000, 1000, 2000], "y": [5]})
    assert [r["ts_ms"] for r in A.drop_leading(rows, 1).orderBy("ts_ms").collect()] == [2000, 3000]
    assert [r["sensor_id"] for r in A.short_series(rows, 1).collect()] == ["y"]


def test_exclusions_and_lists(spark):
    rows = series(spark, {"a": [1], "b": [1], "d": [1]})
    gone = spark.createDataFrame([("c", "a"), ("c", "zz")], "campaign string, sensor_id string")
    assert {r["sensor_id"] for r in X.exclude_sensors(rows, gone).collect()} == {"b", "d"}
    assert [r["problem"] for r in X.exclusion_problems(rows, gone).collect()] == ["unknown sensor zz"]
    _, unknown = X.resolve_global_exclusions(rows, spark.createDataFrame([(" a ",), ("q",)], "sensor_id string"))
    assert [r["sensor_id"] for r in unknown.collect()] == ["q"]
    lines = spark.createDataFrame([("one # first", 0), ("# none", 1), (" two", 2)], "line string, pos long")
    assert [r["label"] for r in X.parse_list(lines).orderBy("pos").collect()] == ["one", "two"]
    bad = spark.createDataFrame([("a", -1.0)], "sensor_id string, weight double")
    with pytest.raises(Exception, match="bad weight"):
        X.reference_weights(X.sensor_registry(rows), bad).collect()


def test_chi_square():
    known = (6.6349, 9.2103, 11.3449, 13.2767, 15.0863, 16.8119, 18.4753)
    for dof, q in enumerate(known, 1):
        assert C.chi2_quantile(0.99, dof) == pytest.approx(q, abs=1e-3)
        assert C.chi2_tail(q, dof) == pytest.approx(0.01, abs=1e-4)


def test_spline_basis():
    f = np.linspace(10, 20, 40)
    b = C.spline_basis(f, 8, 3, 10, 20)
    assert np.allclose(b.sum(axis=1), 1) and b[0, 0] == 1 and b[-1, -1] == 1 and (b >= 0).all()
    with pytest.raises(ValueError):
        C.spline_basis(f, 8, 3, 11, 20)


def test_trust(spark):
    rng = np.random.default_rng(2)
    train = spark.createDataFrame([(float(a), float(a * 2 + rng.normal())) for a in rng.normal(100, 5, 60)], "u double, v double")
    g = C.config_geometry(train, ("u", "v"))
    rows = spark.createDataFrame([(100.0, 200.0), (140.0, 280.0), (105.0, 195.0)], "u double, v double").withColumns({"start_freq_hz": F.lit(9.0), "end_freq_hz": F.lit(21.0), "n_bins": F.lit(13)})
    got = C.trust_diagnostics(rows, g, 10.0, 20.0).orderBy("u").collect()
    assert all((r["bins_below"], r["bins_above"], r["extrapolates"]) == (1, 1, True) for r in got)
    by = {r["u"]: r for r in got}
    assert by[140.0]["out_of_range"] == ["u", "v"] and not by[100.0]["outside_envelope"]
    assert by[105.0]["tail_probability"] < 0.05 and by[100.0]["tail_probability"] > 0.5
    for r in got:
        assert r["tail_probability"] == pytest.approx(C.chi2_tail(r["distance"] ** 2, g.rank), abs=1e-12)
    one = C.config_geometry(spark.createDataFrame([(1.0, 2.0)], "u double, v double"), ("u", "v"))
    assert np.array_equal(one.precision, np.eye(2))


def test_erfc(spark):
    values = [0.0, 1e-9, 0.3, 2.0, 17.9, 18.0, 18.1, 60.0, 900.0]
    got = spark.createDataFrame([(v,) for v in values], "v double").select("v", C._erfc_of_half(F.col("v")).alias("e")).collect()
    assert all(r["e"] == pytest.approx(math.erfc(math.sqrt(r["v"] / 2)), rel=1e-9, abs=1e-15) for r in got)


def test_calibration_rules(spark):
    rows = spectra_rows(spark, {"a": [[0.0, -10.0]]})
    curve = spark.createDataFrame([("a", [2.0, 2.0], [0.5, 0.5], [0.1, 0.1])], "sensor_id string, gain array<double>, floor array<double>, var array<double>")
    assert C.calibrate(rows, curve).first()["calibrated_power"] == pytest.approx([0.25, 0.0])
    assert C.calibrate(rows, curve, clip=False).first()["calibrated_power"] == pytest.approx([0.25, -0.2])
    for bad in (curve.filter("false"), curve.withColumn("gain", F.array(F.lit(0.0), F.lit(1.0))), curve.withColumn("gain", F.array(F.lit(1.0)))):
        with pytest.raises(Exception, match="curve"):
            C.calibrate(rows, bad).collect()


def test_files_are_read_and_checked(spark, tmp_path):
    folder = tmp_path / "camp"
    folder.mkdir()
    (folder / "Node1.csv").write_text('id,mac,campaign_id,pxx,start_freq_hz,end_freq_hz,timestamp\n2,m,1,"[-1,-2]",88e6,108e6,2000\n1,m,1,"[-3,-4]",88e6,108e6,1000\n3,m,1,"[1]",88e6,108e6,x\n4,m,1,"[1,null]",88e6,,5\n')
    (folder / "metadata.csv").write_text("campaign_label,central_freq_MHz\ncamp,98\n")
    rows = M.read_measurements(spark, str(tmp_path))
    assert [(r["campaign"], r["sensor_id"], r["src_row"], r["pxx_db"]) for r in rows.orderBy("ts_ms").filter("n_bins = 2 and ts_ms > 5").collect()] == [("camp", "Node1", 1, [-3.0, -4.0]), ("camp", "Node1", 2, [-1.0, -2.0])]
    assert {r["src_row"]: r["problem"] for r in M.invalid_measurements(rows).collect()} == {3: "fewer than two values", 4: "value missing or not finite"}
    with pytest.raises(Exception, match="invalid measurement"):
        M.require_valid(rows).collect()
    assert [r["campaign"] for r in M.list_campaigns(rows).collect()] == ["camp"]


def test_settings_in_display_units_and_aliases(spark):
    payload = json.dumps({"name": "n", "schedule": {"interval_seconds": 120}, "config": {"rbw": 10000, "span": 20, "lna_gain": 0, "vga_gain": 16, "antenna_amp": "TRUE", "center_freq_hz": 98e6, "sample_rate_hz": 20e6}})
    settings = M.parse_campaign_payload(spark.createDataFrame([("c", 176, payload)], "campaign_label string, campaign_id long, payload string"))
    row = M.build_metadata_row(settings).first()
    assert (row["acquisition_freq_minutes"], row["rbw_kHz"], row["central_freq_MHz"], row["span_MHz"], row["lna_gain_dB"]) == ("2", "10", "98", "20", "0")
    api = spark.createDataFrame([("c", 1, "98000000", "20", "10000", "120", "0", "1", "true")], "campaign string, row int, center_freq_hz string, span string, rbw string, interval_seconds string, lna_gain string, vga_gain string, antenna_amp string")
    got = M.load_campaign_config(api).first()
    assert tuple(got)[1:8] == (98e6, 20e6, 10e3, 0.0, 1.0, 120.0, True) and got["problem"] is None


def test_stream_equals_batch(spark, tmp_path):
    rows = spectra_rows(spark, {"a": [[0.0, -10.0]] * 6, "zz": [[0.0, -3.0]] * 2})
    curve = spark.createDataFrame([("a", [2.0, 2.0], [0.5, 0.5], [0.1, 0.1])], "sensor_id string, gain array<double>, floor array<double>, var array<double>")
    rows.repartition(3).write.parquet(str(tmp_path / "in"))
    q = stream.start(stream.stream_calibrate(stream.read_stream(spark, str(tmp_path / "in"), rows.schema, 1), curve), str(tmp_path / "out"), str(tmp_path / "log"))
    q.awaitTermination()
    got = spark.read.parquet(str(tmp_path / "out"))
    assert got.filter("known_sensor").count() == 6 and got.filter("calibrated_power is null").count() == 2
    want = {tuple(r["calibrated_power"]) for r in C.calibrate(rows.filter("sensor_id = 'a'"), curve).collect()}
    assert {tuple(r["calibrated_power"]) for r in got.filter("known_sensor").collect()} == want


def test_refused_rows_go_to_quarantine_and_a_restart_repeats_none(spark, tmp_path, monkeypatch):
    rows = spectra_rows(spark, {"a": [[0.0, -10.0]] * 9, "zz": [[0.0, -3.0]] * 2, "b": [[1.0, 2.0]] * 4}).withColumn("config_id", F.when(F.col("record_idx") == 3, 2).otherwise(1))
    rows = rows.withColumn("pxx_db", F.when((F.col("sensor_id") == "a") & (F.col("record_idx") == 0), F.array(F.lit(1.0))).otherwise(F.col("pxx_db")))
    schema = "sensor_id string, config_id int, gain array<double>, floor array<double>, var array<double>"
    curve = spark.createDataFrame([(s, c, [2.0 * c, 2.0], [0.5, 0.5], [0.1, 0.2]) for s in "ab" for c in (1, 2)], schema)
    with pytest.raises(ValueError, match="more than one curve for"):
        stream.with_calibration(rows, curve)
    trust = spark.createDataFrame([(1, False), (2, True)], "config_id int, is_ood boolean")
    rows.repartition(5).write.parquet(str(tmp_path / "in"))
    out, bad, log = (str(tmp_path / x) for x in ("out", "bad", "log"))

    def run():
        given = stream.judged(stream.read_stream(spark, str(tmp_path / "in"), rows.schema, 1), curve, ("sensor_id", "config_id"), trust, allow_ood=False)
        query = stream.start_judged(given, out, bad, log)
        query.awaitTermination()

    whole, calls = stream.batch_writer, []

    def failing(out, bad):
        def write(batch, number):
            calls.append(number)
            whole(out, bad if len(calls) != 2 else "/proc/nowhere")(batch, number)

        return write

    monkeypatch.setattr(stream, "batch_writer", failing)
    with pytest.raises(Exception):
        run()
    run()
    assert len(calls) > len(set(calls))  # a batch was begun, stopped after its first sink, and done again
    good, refused = spark.read.parquet(out), spark.read.parquet(bad)
    assert good.count() + refused.count() == rows.count() == 15
    assert good.select("sensor_id", "record_idx").distinct().count() == good.count() == 10
    assert {(r["problem"], r["n"]) for r in refused.groupBy("problem").agg(F.count(F.lit(1)).alias("n")).collect()} == {("fewer than two values", 1), ("no curve", 2), ("configuration out of distribution", 2)}
    r = good.filter("sensor_id = 'b'").first()
    assert r["calibrated_power"] == pytest.approx([(10**0.1 - 0.5) / 2, (10**0.2 - 0.5) / 2]) and r["propagated_var"] == pytest.approx([0.025, 0.05]) and not r["is_ood"]
    kept = stream.judged(rows, curve, ("sensor_id", "config_id"), trust).filter("is_ood and problem is null")
    assert kept.count() == 2 and kept.filter("calibrated_power is null").count() == 0


def test_registry_headers(spark):
    schema = "`capaign_label` string, ` campaign_id ` string, note string"
    rows = X.load_registry(spark.createDataFrame([(" one ", "7", ""), ("two", " 9 ", None)], schema))
    assert sorted(map(tuple, rows.collect())) == [("one", 7), ("two", 9)]
    for bad, match in (([("one", "x", "")], "bad id"), ([("one", "1", ""), ("one", "2", "")], "repeated label"), ([], "names no campaign")):
        with pytest.raises(ValueError, match=match):
            X.load_registry(spark.createDataFrame(bad, schema))
    with pytest.raises(ValueError, match="no column campaign_id"):
        X.load_registry(spark.createDataFrame([("one",)], "campaign_label string"))
    assert X.load_registry(spark.createDataFrame([("one", "x", "")], schema), strict=False).first()["campaign_id"] is None


def test_db_bounds():
    assert math.isclose(10 * math.log10(S.POWER_FLOOR), -120)
