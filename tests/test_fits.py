"""Fitted models against closed forms: score equations, eigenvalues, distances and batch twins."""
import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from strata.operators import cluster as C
from strata.operators import features as FE
from strata.operators import models as M
from strata.operators import stats as ST
from strata.operators import windows as W
from strata.streaming import core as SS
from tests.test_models import _data

COLS = ["f0", "f1", "f2", "f3"]


@pytest.fixture(scope="module")
def data(spark):
    return _data(spark, 300).cache()


@pytest.fixture(scope="module")
def matrix(data):
    rows = data.orderBy("id").collect()
    return np.array([[r[c] for c in COLS] for r in rows]), np.array([r["label"] for r in rows])


@pytest.fixture(scope="module")
def blobs(spark):
    rng = np.random.default_rng(3)
    x = np.concatenate([rng.normal(m, 0.3, (40, 2)) for m in ((0, 0), (6, 0), (0, 6))])
    rows = [(i, float(a), float(b), i % 2) for i, (a, b) in enumerate(x)]
    return x, spark.createDataFrame(rows, "id long, a double, b double, label int").cache()


def test_svm_and_perceptron_separate(data):
    clean = data.withColumn("label", (F.col("f0") + 0.5 * F.col("f1") > 0).cast("int"))     # no noise: a line parts them
    train, test = clean.where(~F.col("is_test")), clean.where("is_test")
    for kind, params in (("linear_svm", {}), ("mlp", {"layers": [4, 16, 8, 2], "maxIter": 60})):
        pipe = M.build_pipeline(COLS, [], M.estimator(kind, **params))
        out = M.fit_predict(train, test, pipe, ["id", "label"])
        assert out.count() == test.count()
        assert out.where("label = prediction").count() / out.count() > 0.9


def test_grid_results_are_ranked_by_score(data):
    est = M.estimator("decision_tree")
    pipe = M.build_pipeline(COLS, [], est)
    rows = M.grid_search(data, pipe, est, {"maxDepth": [1, 4]}, "fold").orderBy("rank").collect()
    assert [r["rank"] for r in rows] == [1, 2] and rows[0]["mean_auc"] >= rows[1]["mean_auc"] > 0.5


def test_rank_by(spark):
    df = spark.createDataFrame([("a", 1.0), ("b", 3.0), ("c", 3.0), ("d", None)], "m string, s double")
    got = {r["m"]: r["rank"] for r in W.rank_by(df, "s", method="rank").collect()}
    assert got == {"b": 1, "c": 1, "a": 3, "d": 4}


def test_elbow_and_best_silhouette_of_three_blobs(blobs):
    x, df = blobs
    inertia = {r["k"]: r["inertia"] for r in C.elbow(df, ["a", "b"], range(1, 5)).collect()}
    assert abs(inertia[1] - ((x - x.mean(axis=0)) ** 2).sum()) < 1e-6
    assert inertia[1] > inertia[2] > inertia[3] >= inertia[4] and inertia[3] < inertia[2] / 5
    found = {r["k"]: r["best"] for r in C.silhouette_select(df, ["a", "b"], range(2, 5), key="id").collect()}
    assert found == {2: False, 3: True, 4: False}


def test_kmeans_assigns_to_the_nearest_centre_and_profile_counts(blobs):
    x, df = blobs
    model, assigned = C.kmeans(df, ["a", "b"], 3, keep=["id", "label"])
    centres = np.array(model.clusterCenters())
    got = {r["id"]: r["cluster"] for r in assigned.collect()}
    want = ((x[:, None] - centres[None]) ** 2).sum(axis=2).argmin(axis=1)
    assert got == dict(enumerate(want.tolist()))
    for r in C.cluster_profile(assigned, "cluster", "label", ["a"]).collect():
        mine = [i for i, c in got.items() if c == r["cluster"]]
        assert r["size"] == len(mine) and abs(r["label_rate"] - np.mean([i % 2 for i in mine])) < 1e-6
        assert abs(r["mean_a"] - x[mine, 0].mean()) < 1e-6


def test_logit_satisfies_its_score_equations(data, matrix):
    x, y = matrix
    terms = {r["term"]: r for r in M.logit_inference(data, COLS, "label").collect()}
    z = np.column_stack([x, np.ones(len(x))])
    beta = np.array([terms[c]["coef"] for c in [*COLS, "intercept"]])
    p = 1 / (1 + np.exp(-z @ beta))
    assert np.abs(z.T @ (y - p)).max() < 1e-3
    error = np.sqrt(np.diag(np.linalg.inv(z.T @ (z * (p * (1 - p))[:, None]))))
    for k, c in enumerate([*COLS, "intercept"]):
        assert abs(terms[c]["std_err"] - error[k]) < 1e-3 * error[k] + 1e-6
        assert abs(terms[c]["p_value"] - math.erfc(abs(terms[c]["z"]) / math.sqrt(2))) < 1e-6


def test_components_equal_the_eigenvalues(data, matrix):
    x, _ = matrix
    values, vectors = np.linalg.eigh(np.cov(x.T))
    ratio = values[::-1] / values.sum()
    got = FE.pca_explained(data, COLS).orderBy("component").collect()
    assert np.allclose([r["ratio"] for r in got], ratio, atol=1e-5)
    assert np.allclose([r["cumulative"] for r in got], np.cumsum(ratio), atol=1e-5)
    assert FE.pca_components_for(data, COLS, 0.6) == int((np.cumsum(ratio) < 0.6).sum()) + 1
    rows = FE.pca_project(data, COLS, 2, keep=["id"]).orderBy("id").collect()
    want = np.abs((x - x.mean(axis=0)) @ vectors[:, ::-1][:, :2])
    assert np.allclose(np.abs([[r["pc1"], r["pc2"]] for r in rows]), want, atol=1e-6)


def test_mean_contributions(data, matrix):
    x, _ = matrix
    coefs = [1.0, -2.0, 0.5, 0.0]
    contrib = M.linear_contributions(data, COLS, coefs, "id", top=4, digits=9)
    got = {r["feature"]: r["mean_abs"] for r in M.mean_abs_contribution(contrib).collect()}
    want = np.abs((x - x.mean(axis=0)) / x.std(axis=0, ddof=1) * coefs).mean(axis=0)
    assert np.allclose([got[c] for c in COLS], want, atol=1e-5)


def test_ks_statistic(data, matrix):
    v = np.sort(matrix[0][:, 0])
    cdf = np.array([0.5 * (1 + math.erf((a - v.mean()) / v.std(ddof=1) / math.sqrt(2))) for a in v])
    n = len(v)
    want = max((np.arange(1, n + 1) / n - cdf).max(), (cdf - np.arange(n) / n).max())
    assert abs(ST.ks_normality(data, "f0").first()["ks_statistic"] - want) < 1e-4


def test_stream_scores_equal_batch_scores(spark, data, tmp_path):
    model = M.build_pipeline(COLS, [], M.estimator("logistic_regression")).fit(data)
    data.select("id", *COLS).repartition(4).write.parquet(str(tmp_path / "rows.parquet"))
    stream = SS.read_stream(spark, str(tmp_path), "rows", max_files=1)
    scored = M.positive_probability(SS.score_stream(stream, model)).select("id", "score")
    got = {r["id"]: r["score"] for r in SS.run_to_table(scored, "fits").collect()}
    want = {r["id"]: r["score"] for r in M.positive_probability(model.transform(data)).collect()}
    assert got.keys() == want.keys() and all(abs(got[i] - want[i]) < 1e-12 for i in got)


def test_stream_dedup_keeps_the_earliest_for_any_batching(spark, tmp_path):
    rows = [(k, "ab"[k % 2], 60 * (k // 2) + (k % 7)) for k in range(200)]     # two keys, steps of a minute
    rows = [r for r in rows if not 80 <= r[0] < 120]                            # a break of twenty minutes
    df = spark.createDataFrame(rows, "id long, key string, s long").withColumn("ts", F.timestamp_seconds("s")).drop("s")
    for part in range(6):       # files in the order of their events
        df.where((F.col("id") >= 34 * part) & (F.col("id") < 34 * part + 34)).coalesce(1).write.mode("append").parquet(str(tmp_path / "many.parquet"))
    found = []
    for files in (None, 1):
        stream = SS.read_stream(spark, str(tmp_path), "many", max_files=files)
        out = SS.run_to_table(SS.dedup_within_watermark(stream, "ts", ["key"], "10 minutes", "id"), "dedup-test")
        found.append(sorted(r["id"] for r in out.collect()))
    assert found[0] == found[1] == [0, 1]          # the second session of each key is still open
