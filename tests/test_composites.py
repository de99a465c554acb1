from spectrafleet.jobs import composites as J
from spectrafleet.sources import fixtures as T
from spectrafleet.sources import measurements as M

SF = "/root/testdata/sf0.001"


def test_prepared_corpus(spark, tmp_path):
    rows = T.psd(spark, SF)
    settings = rows.selectExpr("campaign", "cast(substring(campaign, 2) as bigint) config_id").distinct().join(T.configs(spark, SF), "config_id")
    gone = rows.filter("campaign = 'c0' and sensor_id = 'Node2'").select("campaign", "sensor_id").distinct()
    corpus = J.prepare_corpus(rows, settings, gone, leading=1, tolerance_ms=1000)
    seen = {r["campaign"]: r for r in corpus.overview.collect()}
    assert seen["c0"]["left_out"] == "Node2" and seen["c1"]["left_out"] == "" and seen["c0"]["n_records"] == 24
    assert corpus.aligned.filter("campaign = 'c0'").count() == 24 * 4
    assert {r["sensor_id"] for r in corpus.registry.collect()} == {f"Node{i}" for i in range(1, 6)}
    one, _ = J.rank_campaigns(rows, 1000, label="c2")
    assert {r["campaign"] for r in one.collect()} == {"c2"} and one.count() == 5


def test_partitioning_changes_nothing(spark):
    rows = T.psd(spark, SF)
    first = None
    for n in (1, 3, 17):
        got = sorted((r["campaign"], r["sensor_id"], r["rank"], round(r["mean_score"], 9)) for r in J.rank_campaigns(rows.repartition(n), 1000)[0].collect())
        first = first or got
        assert got == first


def test_curves_round_trip_and_fingerprints(spark, tmp_path):
    rows = T.psd(spark, SF)
    curves = rows.selectExpr("campaign", "sensor_id", "pxx_db gain", "src_row")
    M.write_curves(curves, str(tmp_path / "curves"))
    back = spark.read.parquet(str(tmp_path / "curves")).select(*curves.columns)
    assert back.exceptAll(curves).count() == 0 and curves.exceptAll(back).count() == 0
    settings = rows.selectExpr("campaign", "1 as x").distinct()
    a = {r["campaign"]: r["sha256"] for r in M.content_fingerprint(rows, settings).collect()}
    b = {r["campaign"]: r["sha256"] for r in M.content_fingerprint(rows.repartition(5), settings).collect()}
    c = {r["campaign"]: r["sha256"] for r in M.content_fingerprint(rows.filter("not (campaign = 'c0' and sensor_id = 'Node1')"), settings).collect()}
    assert a == b and a["c0"] != c["c0"] and a["c1"] == c["c1"]


def test_evaluation_of_a_run(spark, tmp_path):
    from pyspark.sql import functions as F

    from spectrafleet.operators import fit as G

    rows = T.psd(spark, SF)
    settings = rows.selectExpr("campaign", "cast(substring(campaign, 2) as bigint) config_id").distinct().join(T.configs(spark, SF), "config_id").withColumn("role", F.expr("case when config_id = 1 then 'test' else 'train' end"))
    done = G.fit(rows, settings, rows.groupBy("campaign").agg(F.min("sensor_id").alias("reliable_sensor")), T.FEATURES, G.FitConfig(outer=1, inner=2))
    told = J.evaluate_run(rows, settings, done, T.FEATURES)
    run, campaigns = told.run.first(), told.campaigns.collect()
    n = settings.count()
    assert (run["train_campaigns"], run["test_campaigns"], run["rounds"], run["steps"]) == (n - 1, 1, 1, 2) and run["selected_objective"] == done.selected and run["max_gradient_norm"] == max(done.gradient_norms)
    assert len(campaigns) == n and run["records"] == sum(r["n_records"] for r in campaigns) and run["improved_campaigns"] == sum(r["improvement_db"] > 0 for r in campaigns)
    J.write_evaluation(told, str(tmp_path / "told"))
    assert spark.read.parquet(str(tmp_path / "told/roles")).count() == 2 and spark.read.parquet(str(tmp_path / "told/campaigns")).count() == n
    norms = {r["sensor_id"]: r["embedding_norm"] for r in G.embedding_norms(spark, done.model).collect()}
    assert set(norms) == set(done.model.sensors) and all(v > 0 for v in norms.values())


def test_records_that_lack_sensors_are_left_out(spark, tmp_path):
    """A last campaign of two whole records and one of three sensors: rankings are those of the SQL over whole records."""
    from pathlib import Path

    import duckdb

    from __spark_entry__ import oracle_sql, queries

    (tmp_path / "part.parquet").symlink_to(Path(SF) / "part.parquet")
    spark.read.parquet(f"{SF}/embeddings.parquet").filter("vec_id < 138").write.parquet(str(tmp_path / "embeddings.parquet"))
    con = duckdb.connect()
    con.sql(f"create view part as select * from '{SF}/part.parquet'")
    con.sql(f"create view embeddings as select * from '{tmp_path}/embeddings.parquet/*.parquet' where vec_id < 135")
    rows = lambda cols, found: sorted(tuple(round(r[c], 6) if isinstance(r[c], float) else r[c] for c in cols) for r in found)
    for name in ("rank_campaigns", "prepare_corpus"):
        want = con.sql(oracle_sql()[name])
        got = queries()[name](spark, str(tmp_path)).collect()
        assert rows(sorted(want.columns), got) == rows(sorted(want.columns), [dict(zip(want.columns, r)) for r in want.fetchall()]), name
    report = {r["sensor_id"]: r for r in queries()["align_report"](spark, str(tmp_path)).filter("campaign = 'c1'").collect()}
    assert {s: (r["is_anchor"], r["source_rows"], r["aligned_rows"], r["dropped_rows"], r["retained"]) for s, r in report.items()} == {
        **{f"Node{k}": (False, 3, 2, 1, 0.666667) for k in (1, 2, 3)}, "Node4": (True, 2, 2, 0, 1.0), "Node5": (False, 2, 2, 0, 1.0),
    }
