"""Queries over the whole of their operators' job."""
import math

from pyspark.sql import functions as F

from strata.operators import cluster as C
from strata.plans import catalog, q_cluster
from strata.sources.tables import read_table
from tests.conftest import SF_SMALL


def test_drop_constant_over_all_events(spark):
    out = catalog.queries()["drop_constant_all"](spark, SF_SMALL)
    assert out.columns == ["event_id", "user_id", "event_type", "value", "props"]
    assert out.count() == read_table(spark, SF_SMALL, "events").count()


def test_sweep_has_all_settings_and_equals_dbscan(spark):
    got = {(r["eps"], r["min_samples"]): (r["n_clusters"], r["n_noise"])
           for r in catalog.queries()["dbscan_sweep"](spark, SF_SMALL).collect()}
    assert len(got) == 24
    for eps, ms in ((0.1, 2), (0.3, 20)):
        lab = C.dbscan(q_cluster.sweep_points(spark, SF_SMALL), "x", "y", "id", eps=eps, min_samples=ms)
        row = lab.agg(F.countDistinct(F.when(F.col("cluster") >= 0, F.col("cluster"))), F.count_if(F.col("cluster") < 0)).first()
        assert got[eps, ms] == tuple(row)


def test_mann_whitney_p_value(spark):
    row = catalog.queries()["mann_whitney_p"](spark, SF_SMALL).first()
    assert abs(row["p_value"] - math.erfc(abs(row["z"]) / math.sqrt(2))) < 1e-6


def test_randomized_search_draws_ten(spark):
    assert catalog.queries()["randomized_search"](spark, SF_SMALL).count() == 10
