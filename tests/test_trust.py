import pytest
from pyspark.sql import functions as F

from spectrafleet.jobs import queries as Q
from spectrafleet.operators import calibration as C


def test_evaluate_corpus_counts_campaigns_inside_every_range_but_far_away(spark, monkeypatch):
    """Two settings that rise together in training; x1 pairs a low one with a high one, inside both ranges."""
    features = ("u", "v")
    rows = [(f"c{i}", "train", float(i), i + 0.1 * (i % 3)) for i in range(40)] + [("x1", "test", 5.0, 35.0), ("x2", "test", 20.0, 20.1), ("x3", "test", 90.0, 90.0)]
    settings = spark.createDataFrame(rows, "campaign string, role string, u double, v double")
    seen = {}

    def diagnostics(out, roles, trust):
        seen.update({r["campaign"]: r["is_ood"] for r in trust.collect()})
        return roles

    spectra = spark.createDataFrame([("x1", "a", 0.0, 1.0, 2)], "campaign string, sensor_id string, start_freq_hz double, end_freq_hz double, n_bins int")
    empty = spark.createDataFrame([], "config_id string, sensor_id string, gain array<double>, floor array<double>, var array<double>")
    monkeypatch.setattr(Q.T, "FEATURES", features)
    monkeypatch.setattr(Q, "corpus", lambda *_: (spectra, settings.withColumn("config_id", F.lit(0)), None))
    monkeypatch.setattr(Q.fit, "fit", lambda *_: type("Done", (), {"model": None}))
    monkeypatch.setattr(Q.fit, "evaluate_curves", lambda *_: empty)
    monkeypatch.setattr(Q.C, "calibrate", lambda rows, *_: rows)
    monkeypatch.setattr(Q.D, "campaign_diagnostics", diagnostics)
    monkeypatch.setattr(Q.D, "role_summary", lambda d: d)
    Q.evaluate_corpus(spark, "unused")
    assert {k for k, v in seen.items() if v} == {"x1", "x3"}
    g = C.config_geometry(settings.filter("role = 'train'"), features)
    assert not C.envelope_checks(settings.filter("campaign = 'x1'"), g).first()["outside_envelope"]
    assert C.out_of_distribution(settings.filter("campaign = 'x1'"), g).first()["distance"] > g.threshold == pytest.approx(3.035, abs=1e-2)


def test_curves_are_refused_off_the_support_and_out_of_distribution(spark):
    from spectrafleet.operators import fit as G
    from tests.test_fit import model

    train = spark.createDataFrame([(i, float(i), i + 0.1 * (i % 3)) for i in range(40)], "config_id int, u double, v double")
    g, m = C.config_geometry(train, ("u", "v")), model()
    wanted = spark.createDataFrame([(1, "a", 5.0, 5.1, 0.0, 1.0, 12), (2, "b", 5.0, 35.0, 0.1, 0.9, 12), (3, "a", 20.0, 20.1, 0.0, 1.5, 12)], "config_id int, sensor_id string, u double, v double, start_freq_hz double, end_freq_hz double, n_bins int")
    fine = G.trusted_curves(m, wanted.filter("config_id = 1"), g).first()
    assert len(fine["gain"]) == 12 and not fine["is_ood"] and fine["standardized"] == pytest.approx([(5.0 - g.mean[0]) / g.scale[0], (5.1 - g.mean[1]) / g.scale[1]])
    with pytest.raises(Exception, match="configuration 2 is out of distribution"):
        G.trusted_curves(m, wanted.filter("config_id < 3"), g).collect()
    with pytest.raises(Exception, match="grid of configuration 3 lies outside"):
        G.trusted_curves(m, wanted.filter("config_id <> 2"), g).collect()
    got = {r["config_id"]: r for r in G.trusted_curves(m, wanted, g, allow_extrapolation=True, allow_ood=True).collect()}
    assert sorted(got) == ["1", "2", "3"] and got["2"]["is_ood"] and got["3"]["extrapolates"] and got["3"]["bins_above"] == 4
    at_end, clamped = got["3"]["gain"][-4:], got["3"]["gain"][7]
    assert len(set(at_end)) == 1 and clamped != at_end[0]
