"""The fit's parts as queries, against their SQL: both have the closed form of the same model's curves."""

import os

import duckdb
import numpy as np
import pandas as pd
import pytest

from spectrafleet.jobs.oracle import ORACLE_SQL
from spectrafleet.jobs.queries import QUERIES
from spectrafleet.operators.calibration import spline_basis, spline_weights

SF = "/root/testdata/sf0.001"
NAMES = (
    "spline_basis", "config_geometry", "evaluate_curves", "latent_update", "write_latent", "write_curves", "initial_floors", "objective_and_gradient",
    "consistency_penalty", "correlation_penalty", "trust_diagnostics",
)


@pytest.fixture(scope="module")
def tables():
    con = duckdb.connect()
    for name in ("embeddings", "part"):
        path = f"{SF}/{name}.parquet"
        con.execute(f"create view {name} as select * from '{path + '/*.parquet' if os.path.isdir(path) else path}'")
    yield con
    con.close()


@pytest.mark.parametrize("name", NAMES)
def test_query_is_its_sql(spark, tables, name):
    got, want = QUERIES[name](spark, SF).toPandas(), tables.execute(ORACLE_SQL[name]).df()
    assert len(got) and sorted(got.columns) == sorted(want.columns)
    cols = sorted(got.columns)
    text = [c for c in cols if got[c].dtype.kind not in "f"]
    got, want = (x[cols].sort_values(text).reset_index(drop=True) if text else x[cols] for x in (got, want))
    pd.testing.assert_frame_equal(got, want, check_dtype=False, rtol=0, atol=2e-4 if name == "objective_and_gradient" else 2e-5 if name == "config_geometry" else 2e-6)


def test_spline_weights_keep_columns_and_refuse_other_bands(spark):
    grids = spark.createDataFrame([("a", 1.0, 2.0, 5, None), ("b", 1.5, 2.0, 3, "x")], "name string, start_freq_hz double, end_freq_hz double, n_bins int, note string")
    rows = {r["name"]: r for r in spline_weights(grids, 5, 3, 1.0, 2.0).collect()}
    assert rows["a"]["note"] is None and rows["b"]["note"] == "x"
    assert np.allclose(rows["a"]["basis"], spline_basis(np.linspace(1, 2, 5), 5, 3, 1.0, 2.0))
    assert np.allclose(np.sum(rows["b"]["basis"], axis=1), 1)
    assert spline_weights(grids.limit(0), 5, 3, 1.0, 2.0).count() == 0
    with pytest.raises(Exception, match="outside the support"):
        spline_weights(grids, 5, 3, 1.2, 2.0).collect()
    clamped = spline_weights(grids, 5, 3, 1.2, 2.0, clip=True).filter("name = 'a'").first()["basis"]
    assert np.allclose(clamped[0], [1, 0, 0, 0, 0])
