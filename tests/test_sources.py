import json

import numpy as np
import pytest
from pyspark.sql import functions as F

from spectrafleet.operators.quantiles import exact_quantile
from spectrafleet.sources import artifacts as R
from spectrafleet.sources import measurements as M

FULL = ["id", "mac", "campaign_id", "pxx", "start_freq_hz", "end_freq_hz", "timestamp", "lat", "lng", "excursion_peak_to_peak_hz", "excursion_peak_deviation_hz", "excursion_rms_deviation_hz", "depth_peak_to_peak", "depth_peak_deviation", "depth_rms_deviation", "created_at"]


def sensor_file(path, names, rows):
    path.parent.mkdir(parents=True, exist_ok=True)
    cell = lambda v: '"' + v.replace('"', '""') + '"' if isinstance(v, str) else str(v)
    path.write_text("\n".join([",".join(names), *[",".join(cell(r.get(n, 0)) for n in names) for r in rows]]) + "\n")


def records(n, base, first_ms):
    return [{"id": 500 + k, "mac": "00:00:00:00:00:01", "campaign_id": 176, "pxx": json.dumps([base + k, base - k]), "start_freq_hz": 88e6, "end_freq_hz": 108e6, "timestamp": first_ms + 1000 * k, "created_at": 7} for k in range(n)]


def test_files_of_different_columns_lie_together(spark, tmp_path):
    sensor_file(tmp_path / "one" / "Node1.csv", FULL, records(3, -60, 10))
    sensor_file(tmp_path / "one" / "Node2.csv", ["id", "mac", "campaign_id", "pxx", "start_freq_hz", "end_freq_hz", "timestamp", "created_at"], records(2, -50, 20))
    sensor_file(tmp_path / "one" / "Node3.csv", ["pxx", "start_freq_hz", "end_freq_hz", "timestamp"], records(4, -40, 30))
    sensor_file(tmp_path / "two" / "Node1.csv", ["timestamp", "unheard_of", "end_freq_hz", "pxx", "start_freq_hz"], records(2, -30, 40))
    (tmp_path / "one" / "metadata.csv").write_text("campaign_label,span_MHz\none,20\n")
    got = M.read_measurements(spark, str(tmp_path))
    rows = {(r["campaign"], r["sensor_id"], r["ts_ms"]): r for r in got.collect()}
    want = {("one", "Node1"): (3, -60, 10), ("one", "Node2"): (2, -50, 20), ("one", "Node3"): (4, -40, 30), ("two", "Node1"): (2, -30, 40)}
    assert len(rows) == sum(n for n, _, _ in want.values())
    for (campaign, sensor), (n, base, first) in want.items():
        for k in range(n):
            r = rows[campaign, sensor, first + 1000 * k]
            assert r["pxx_db"] == [base + k, base - k] and (r["start_freq_hz"], r["end_freq_hz"], r["n_bins"]) == (88e6, 108e6, 2)
    assert [rows["one", "Node1", 10 + 1000 * k]["src_row"] for k in range(3)] == [500, 501, 502]
    places = [rows["one", "Node3", 30 + 1000 * k]["src_row"] for k in range(4)]
    assert places == sorted(places) and len(set(places)) == 4
    assert M.read_measurements(spark, str(tmp_path), ["two"]).count() == 2
    assert M.invalid_measurements(got).count() == 0 and M.grid_problems(got, ("campaign", "sensor_id")).count() == 0


def test_a_file_of_two_hundred_columns(spark, tmp_path):
    names = [f"extra{k}" for k in range(190)] + [c for c in FULL if c != "timestamp"] + ["timestamp"]
    sensor_file(tmp_path / "one" / "Node1.csv", names, records(3, -60, 10))
    got = {r["ts_ms"]: r for r in M.read_measurements(spark, str(tmp_path)).collect()}
    assert sorted(got) == [10, 1010, 2010] and got[1010]["pxx_db"] == [-59, -61] and got[10]["mac"] == "00:00:00:00:00:01" and got[2010]["src_row"] == 502


def test_records_with_line_ends_in_quotes_across_blocks(spark, tmp_path, monkeypatch):
    import csv
    import random

    from spectrafleet.sources import delimited

    rng = random.Random(3)
    cell = lambda: "".join(rng.choices(['"', ",", "\n", "\r\n", "é", "a", " ", "5\" x"], k=rng.randrange(0, 9)))
    want = {}
    for name in ("a.csv", "b.csv"):
        rows = [[cell() or "x" for _ in range(rng.randrange(1, 6))] for _ in range(120)] + [["y" * 50 + "\n" * 700 + "z"], ["end", "\n\n"]]
        with (tmp_path / name).open("w", newline="") as f:
            for r in rows:
                f.write(",".join(c if c and set(c) <= set("aé x5") else '"' + c.replace('"', '""') + '"' for c in r) + rng.choice(["\n", "\r\n"]))
        with (tmp_path / name).open(newline="") as f:
            want[name] = [r for r in csv.reader(f) if r and ",".join(r).strip(" ")]
    (tmp_path / "c.csv").write_text('a,5" pipe,b\n\n"x ""y""",,\n')
    want["c.csv"] = [["a", '5" pipe', "b"], ['x "y"', "", ""]]
    saved = spark.conf.get("spark.sql.files.maxPartitionBytes"), spark.conf.get("spark.sql.files.openCostInBytes")
    try:
        for block, few in (("134217728", 1000), ("97", 1000), ("300", 0)):
            spark.conf.set("spark.sql.files.maxPartitionBytes", block)
            spark.conf.set("spark.sql.files.openCostInBytes", "1")
            monkeypatch.setattr(delimited, "BROADCAST_BLOCKS", few)
            got = {}
            for r in delimited.read_records(spark, [str(tmp_path / "*.csv")]).collect():
                got.setdefault(r["file"].rsplit("/", 1)[1], []).append((r["place"], r["cells"]))
            for name, rows in want.items():
                assert [c for _, c in sorted(got[name])] == rows and len({p for p, _ in got[name]}) == len(rows), (name, block)
    finally:
        spark.conf.set("spark.sql.files.maxPartitionBytes", saved[0])
        spark.conf.set("spark.sql.files.openCostInBytes", saved[1])


def test_lines_that_leave_quotes_closed():
    import random

    import pyarrow as pa

    from spectrafleet.sources import delimited

    rng = random.Random(5)
    lines = ["".join(rng.choices(['"', ",", "a", "\r", " ", "é"], k=rng.randrange(0, 10))) for _ in range(20_000)]
    closed, open_ = delimited._unchanged(pa.array(lines))
    assert [bool(c) for c in closed] == [not delimited.open_after(t, False) for t in lines]
    assert all(delimited.open_after(t, True) for t, o in zip(lines, open_) if o)


def test_headers_with_quotes_and_line_ends(spark, tmp_path):
    (tmp_path / "one").mkdir()
    (tmp_path / "one" / "Node1.csv").write_text('"no\ntes",timestamp,"px"x,start_freq_hz,end_freq_hz\n"pxx, said\nthey",5,"[1,2]",1,2\n\n,6,"[3,4]",1,2\n')
    (tmp_path / "one" / "Node2.csv").write_text('\ufefftimestamp,p"xx," pxx ",end_freq_hz,start_freq_hz\n7,,"[5,6]",2,1\n')
    got = {r["ts_ms"]: (r["sensor_id"], r["pxx_db"], r["start_freq_hz"]) for r in M.read_measurements(spark, str(tmp_path)).collect()}
    assert got == {5: ("Node1", [1.0, 2.0], 1.0), 6: ("Node1", [3.0, 4.0], 1.0), 7: ("Node2", [5.0, 6.0], 1.0)}


def test_files_are_parsed_once(spark, tmp_path):
    """Besides the passes that settle quotes and headers: no record here lies in several blocks, so no second one looks for pieces."""
    from __spark_entry__ import queries

    parses = lambda df: df._jdf.queryExecution().optimizedPlan().toString().count("MapInArrow")
    sensor_file(tmp_path / "one" / "Node1.csv", FULL, records(3, -60, 10))
    assert parses(M.read_measurements(spark, str(tmp_path))) == 1
    assert parses(queries()["read_measurements"](spark, "/root/testdata/sf0.001")) == 1


def test_a_file_without_spectra_is_an_error(spark, tmp_path):
    sensor_file(tmp_path / "one" / "Node1.csv", FULL, records(2, -60, 10))
    sensor_file(tmp_path / "one" / "Node2.csv", ["start_freq_hz", "timestamp"], records(2, -60, 10))
    with pytest.raises(Exception, match="no pxx column"):
        M.read_measurements(spark, str(tmp_path)).collect()


@pytest.mark.parametrize(
    ("names", "values", "want"),
    [
        (["center_freq_hz", "span", "rbw", "lna_gain", "vga_gain", "interval_seconds", "antenna_amp"], ["98e6", "20", "10000", "16", "4", "120", "true"], (98e6, 20e6, 10e3, 16.0, 4.0, 120.0, True)),
        (["Center Frequency MHz", "bandwidth_hz", "resolution_bandwidth_kHz", "LNA gain dB", "vga_gain", "acquisition interval minutes", "antenna amplifier enabled"], ["98", "2e7", "10", "1", "2", "2", "no"], (98e6, 2e7, 1e4, 1.0, 2.0, 120.0, False)),
        (["span_hz", "span", "rbw_hz", "rbw", "center_frequency", "lna_gain", "vga_gain", "acquisition_freq_seconds", "antenna_amp"], ["1", "20", "2", "3", "9e7", "1", "2", "30", "1"], (9e7, 20e6, 3.0, 1.0, 2.0, 30.0, True)),
    ],
)
def test_names_of_settings(spark, names, values, want):
    rows = spark.createDataFrame([("g", 1, *values)], "campaign string, row int, " + ", ".join(f"`{n}` string" for n in names))
    r = M.load_campaign_config(rows).first()
    assert (r["central_freq_hz"], r["span_hz"], r["rbw_hz"], r["lna_gain_db"], r["vga_gain_db"], r["acquisition_interval_s"], r["antenna_amp"]) == want and r["problem"] is None


def test_the_first_name_that_holds_anything_decides(spark):
    rows = spark.createDataFrame([("g", 1, "often", "120", " "), ("h", 1, " ", "120", "7")], "campaign string, row int, acquisition_freq_minutes string, interval_seconds string, span_MHz string")
    got = {r["campaign"]: r for r in M.load_campaign_config(rows).collect()}
    assert got["g"]["acquisition_interval_s"] is None and got["h"]["acquisition_interval_s"] == 120.0
    assert got["g"]["span_hz"] is None and got["h"]["span_hz"] == 7e6


def test_selection_narrows_any_distribution(spark, monkeypatch):
    from spectrafleet.operators import quantiles

    rng, left = np.random.default_rng(4), []
    groups = {"log": 10.0 ** rng.uniform(-12, 0, 60_000), "same": np.full(20_000, 7.0), "two": np.repeat([1.0, 2.0], 10_000), "few": rng.normal(size=50), "heavy": np.concatenate([np.full(15_000, 3.0), rng.normal(size=9_000) + 3])}
    df = spark.createDataFrame([(g, float(x)) for g, xs in groups.items() for x in xs], "g string, value double").repartition(4)
    monkeypatch.setattr(quantiles, "BUCKETS", 500)
    whole = quantiles._inside

    def seen(values, state, by):
        if "s1" not in state.columns:
            left.append(max((r["left"] for r in state.collect()), default=0))
        return whole(values, state, by)

    monkeypatch.setattr(quantiles, "_inside", seen)
    for q in (0.05, 0.5, 0.987):
        left.clear()
        got = {r["g"]: r["v"] for r in exact_quantile(df, ["g"], q, "v").collect()}
        assert all(got[g] == pytest.approx(np.quantile(xs, q), rel=1e-13) for g, xs in groups.items())
        assert left[-1] <= 500 and len(left) <= 4


@pytest.mark.parametrize("q", [0.0, 0.05, 0.5, 0.99, 1.0])
def test_exact_quantiles(spark, monkeypatch, q):
    from spectrafleet.operators import quantiles

    monkeypatch.setattr(quantiles, "BUCKETS", 5)
    rng = np.random.default_rng(3)
    groups = {"a": rng.normal(size=1000), "b": np.repeat([1.0, 2.0, 2.0, 9.0], 50), "c": np.array([4.0]), "d": np.full(70, -3.0), "e": np.concatenate([rng.random(50) * 1e-9, [1e9]])}
    rows = [(g, float(x)) for g, xs in groups.items() for x in xs] + [("a", None), ("f", None)]
    df = spark.createDataFrame(rows, "g string, value double")
    got = {r["g"]: r["v"] for r in exact_quantile(df, ["g"], q, "v").collect()}
    assert set(got) == set(groups)
    for g, xs in groups.items():
        assert got[g] == pytest.approx(np.quantile(xs, q), rel=1e-12, abs=1e-18), g


def small_fit(spark, **more):
    from spectrafleet.operators import fit as G
    from tests.test_fit import FEATURES

    rng, rows, configs = np.random.default_rng(5), [], []
    for c in range(2):
        configs.append((f"c{c}", float(c), float(c % 2)))
        for k in range(6):
            s = 1e-6 * rng.gamma(4.0, 1.0, 16)
            for i, (name, g) in enumerate({"a": 0.8, "b": 1.0, "d": 1.3}.items()):
                rows.append((f"c{c}", k, name, k * 10 + i, k * 1000, 88e6, 108e6, 16, (10 * np.log10(np.maximum(g * s + 1e-7, 1e-9))).tolist()))
    df = spark.createDataFrame(rows, "campaign string, record_idx long, sensor_id string, src_row long, ts_ms long, start_freq_hz double, end_freq_hz double, n_bins int, pxx_db array<double>")
    conf = spark.createDataFrame(configs, "campaign string, u double, v double")
    reliable = spark.createDataFrame([(f"c{c}", "b") for c in range(2)], "campaign string, reliable_sensor string")
    return G.fit(df, conf, reliable, FEATURES, G.FitConfig(**{"outer": 3, "inner": 3} | more))


def test_the_fit_returned_is_the_best_round_whole(spark):
    from spectrafleet.operators import fit as G

    done = small_fit(spark, tolerance=0.0)
    assert done.selected == min(done.rounds) == done.rounds[done.selected_round] and len(done.rounds) == 3
    # Parameters, deviations and latent spectra of one round: its loss comes out again.
    assert G.objective_and_gradient(done.model, done.table)[0] == pytest.approx(done.selected, rel=1e-12)
    same = {(r["campaign"], r["sensor_id"]): r["d1"] for r in done.table.collect()}
    assert all(same[r["campaign"], r["sensor_id"]] == r["d1"] for r in done.state.collect())
    told = G.fit_diagnostics(done)
    assert told["steps"] == 9 and told["rounds"] == 3 and 0 < told["max_variance_ratio"] and told["max_edge_jump_ratio"] >= 0 and np.isfinite(told["max_campaign_share"])


def test_a_fit_stops_early(spark):
    worse = small_fit(spark, outer=6, inner=1, tolerance=1e9, patience=2)
    assert worse.reason == "no better round" and worse.selected_round == 0 and len(worse.rounds) == 3
    wild = small_fit(spark, outer=6, inner=2, rate=60.0, divergence=1.0001, tolerance=1e9, joint=False)
    assert wild.reason == "diverged" and len(wild.rounds) < 6 and np.isfinite(wild.selected)


def test_saved_fits_come_back_equal(spark, tmp_path):
    done = small_fit(spark, outer=1)
    manifest = R.save_fit(done, str(tmp_path / "m"), {"note": "x"})
    back = R.load_fit(spark, str(tmp_path / "m"))
    assert all(np.array_equal(v, back.model.theta[k]) for k, v in done.model.theta.items()) and set(back.model.theta) == set(done.model.theta)
    for name in ("sensors", "features", "freq", "variance_floor", "power_scale", "config"):
        assert getattr(back.model, name) == getattr(done.model, name)
    assert all(np.array_equal(getattr(back.model, n), getattr(done.model, n)) for n in ("weights", "mean", "scale"))
    assert (back.history, back.reason, back.selected, back.rounds, back.selected_round) == (done.history, done.reason, done.selected, done.rounds, done.selected_round)
    for a, b in ((done.state, back.state), (done.latent, back.latent)):
        assert sorted(map(str, a.collect())) == sorted(map(str, b.select(*a.columns).collect()))
    assert manifest["corpus"] == R.corpus_fingerprint(back.state) != R.corpus_fingerprint(back.state.withColumn("reliable", ~F.col("reliable")))
    assert manifest["extra"] == {"note": "x"}
    with pytest.raises(Exception):
        R.load_fit(spark, str(tmp_path / "none"))
    with pytest.raises(ValueError, match="another corpus"):
        R.load_fit(spark, str(tmp_path / "m"), corpus="other")
    # a loaded fit may be saved where it came from, and the last two versions stay
    for note in ("y", "z"):
        R.save_fit(R.load_fit(spark, str(tmp_path / "m")), str(tmp_path / "m"), {"note": note})
    assert len(list((tmp_path / "m/versions").iterdir())) == 2 and len(list((tmp_path / "m").glob("current-*"))) == 2
    assert R.load_fit(spark, str(tmp_path / "m"), corpus=manifest["corpus"]).history == done.history


def test_a_stop_between_any_two_writes_leaves_the_model_before(spark, tmp_path, monkeypatch):
    from pyspark.sql.readwriter import DataFrameWriter

    first, second, path = small_fit(spark, outer=1), small_fit(spark, outer=1, inner=4), str(tmp_path / "m")
    R.save_fit(first, path)

    class Stopped(Exception):
        pass

    left = None
    for method in ("parquet", "text"):

        def write(self, *args, whole=getattr(DataFrameWriter, method), **more):
            nonlocal left
            if left == 0:
                raise Stopped
            left -= 1
            return whole(self, *args, **more)

        monkeypatch.setattr(DataFrameWriter, method, write)
    monkeypatch.setattr(R, "_publish", lambda *args, whole=R._publish: whole(*args) if left else (_ for _ in ()).throw(Stopped))
    stops = 0
    for writes in range(20):
        left = writes
        try:
            R.save_fit(second, path)
            break
        except Stopped:
            stops += 1
            left = 100
            assert R.load_fit(spark, path).history == first.history
    left = 100
    assert stops == 8 and R.load_fit(spark, path).history == second.history


def test_an_altered_model_is_refused(spark, tmp_path):
    done, path = small_fit(spark, outer=1), str(tmp_path / "m")
    R.save_fit(done, path)
    (version,) = (tmp_path / "m/versions").iterdir()
    changed = done.state.withColumn("d1", F.transform("d1", lambda x: x + 1e-12))
    changed.write.mode("overwrite").parquet(str(version / "state"))
    with pytest.raises(ValueError, match="state is not what was saved"):
        R.load_fit(spark, path)
    assert R.load_fit(spark, path, verify=False).history == done.history


def test_evaluation_of_a_fit(spark):
    from spectrafleet.jobs import composites, queries
    from spectrafleet.operators import fit as G
    from spectrafleet.sources import fixtures as T

    sf = "/root/testdata/sf0.001"
    rows, settings, reliable = queries.corpus(spark, sf)
    done = G.fit(rows, settings, reliable, T.FEATURES, G.FitConfig(outer=1, inner=2))
    got = composites.evaluate_corpus(rows, settings, done, T.FEATURES).collect()
    spectra, curves = {}, {}
    wanted = rows.select("campaign", "sensor_id", "start_freq_hz", "end_freq_hz", "n_bins").distinct().join(settings.drop("config_id"), "campaign").withColumnRenamed("campaign", "config_id")
    for r in G.evaluate_curves(done.model, wanted).collect():
        curves[r["config_id"], r["sensor_id"]] = np.array(r["gain"]), np.array(r["floor"])
    for r in rows.collect():
        gain, floor = curves[r["campaign"], r["sensor_id"]]
        spectra.setdefault((r["campaign"], r["record_idx"]), []).append(np.maximum(10 ** (np.array(r["pxx_db"]) / 10) - floor, 0) / gain)
    role = {r["campaign"]: r["role"] for r in settings.collect()}
    for r in got:
        by_campaign, squares = {}, {}
        for (campaign, _), xs in spectra.items():
            if role[campaign] == r["role"]:
                db, logs = 10 * np.log10(np.maximum(xs, 1e-12)), np.log(np.array(xs) + 1e-12)
                pairs = [np.sqrt(((db[i] - db[j]) ** 2).mean()) for i in range(len(db)) for j in range(i)]
                by_campaign.setdefault(campaign, []).append(np.mean(pairs))
                squares.setdefault(campaign, []).append((((logs - logs.mean(axis=0)) ** 2).sum(), logs.size))
        assert r["campaigns"] == len(by_campaign) and r["records"] == sum(map(len, by_campaign.values()))
        assert r["mean_cal_rmse_db"] == pytest.approx(np.mean([np.mean(v) for v in by_campaign.values()]))
        assert r["dispersion_term"] == pytest.approx(sum(sum(a for a, _ in v) / sum(n for _, n in v) for v in squares.values()))


def test_pairwise_matches_against_plain_counting(spark):
    from spectrafleet.operators import alignment as A

    rng, rows = np.random.default_rng(2), []
    for campaign in ("p", "q"):
        for sensor in ("a", "b", "c"):
            rows += [(campaign, sensor, k, int(t)) for k, t in enumerate(rng.integers(0, 4000, rng.integers(1, 60)))]
    got = {(r["campaign"], r["sensor_a"], r["sensor_b"]): r["matches"] for r in A.pairwise_match_count(spark.createDataFrame(rows, "campaign string, sensor_id string, src_row long, ts_ms long"), 40).collect()}
    assert len(got) == 6
    for (campaign, a, b), n in got.items():
        left, right = (sorted(t for c, s, _, t in rows if c == campaign and s == x) for x in (a, b))
        count = 0
        while left and right:
            if abs(left[0] - right[0]) <= 40:
                count += 1
                left, right = left[1:], right[1:]
            elif left[0] < right[0]:
                left = left[1:]
            else:
                right = right[1:]
        assert n == count


def test_stretches_align_like_whole_campaigns(spark):
    from spectrafleet.operators import alignment as A
    from spectrafleet.operators import sets as X
    from tests.test_alignment import plain_best

    rng, rows = np.random.default_rng(8), []
    for campaign in ("p", "q", "r"):
        for sensor in ("a", "b", "c"):
            starts = np.repeat(np.arange(12) * 5000, 6)
            times = np.sort(starts + rng.integers(0, 900, len(starts)))[: rng.integers(40, 72)]
            rows += [(campaign, sensor, k, int(t)) for k, t in enumerate(times + (10**7 if (campaign, sensor) == ("r", "c") else 0))]
    df = spark.createDataFrame(rows, "campaign string, sensor_id string, src_row long, ts_ms long")
    aligned = A.align(df, 60, allow_pruning=True)
    got = {}
    for r in aligned.collect():
        got.setdefault(r["campaign"], {}).setdefault(r["record_idx"], {})[r["sensor_id"]] = r["src_row"]
    for campaign in ("p", "q", "r"):
        times = {s: np.array([t for c, x, _, t in rows if c == campaign and x == s]) for s in "abc"}
        groups = A.greedy_groups(times if campaign != "r" else {s: times[s] for s in plain_best(times, 60)[0]}, 60)
        assert groups and [got[campaign][k] for k in sorted(got[campaign])] == groups
    assert {tuple(r) for r in A.pruned_sensors(df, aligned).collect()} == {("r", "c")}
    strict = A.align(df, 60)
    assert [r["campaign"] for r in A.unaligned_campaigns(df, strict).collect()] == ["r"]
    with pytest.raises(ValueError, match="no common record: r"):
        X.require_none(A.unaligned_campaigns(df, strict), "no common record")
    X.require_none(A.unaligned_campaigns(df, aligned), "no common record")
