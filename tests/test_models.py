"""Model invariants (the reference tests assert shapes, ranges, determinism)."""
import os
import tempfile

import numpy as np
from pyspark.sql import functions as F

from strata.operators import models as M
from strata.operators import sampling as S


def _data(spark, n=200, seed=42):
    rng = np.random.default_rng(seed)
    X = rng.normal(size=(n, 4))
    y = (X[:, 0] + 0.5 * X[:, 1] + rng.normal(scale=.5, size=n) > 0).astype(int)
    rows = [(i, "A" if i % 3 else "B", *map(float, X[i]), int(y[i])) for i in range(n)]
    df = spark.createDataFrame(rows, "id long, cat string, f0 double, f1 double, f2 double, f3 double, label int")
    return S.stratified_kfold(S.stratified_split(df, "label", "id", 0.2, 42), "label", "id", 5, 42)


def test_pipeline_probabilities_and_determinism(spark):
    df = _data(spark)
    train, test = df.where(~F.col("is_test")), df.where("is_test")
    outs = []
    for _ in range(2):
        est = M.estimator("logistic_regression", n_rows=160)
        pipe = M.build_pipeline(["f0", "f1", "f2", "f3"], ["cat"], est, impute=True, kbest=3)
        outs.append(sorted((r.id, round(r.score, 9)) for r in M.fit_predict(train, test, pipe, ["id"]).collect()))
    assert outs[0] == outs[1]
    assert all(0.0 <= s <= 1.0 for _, s in outs[0]) and len(outs[0]) == 40


def test_cross_validate_scores_in_unit_interval(spark):
    df = _data(spark).where(~F.col("is_test"))
    est = M.estimator("decision_tree", maxDepth=3)
    pipe = M.build_pipeline(["f0", "f1", "f2", "f3"], [], est)
    summary = {r.metric: r for r in M.cv_summary(M.cross_validate(df, pipe, "fold", 5)).collect()}
    assert set(summary) == {"accuracy", "precision", "recall", "f1", "auc"}
    assert all(0.0 <= r.mean <= 1.0 for r in summary.values())
    assert summary["auc"].mean > 0.7


def test_save_and_load_model(spark):
    df = _data(spark)
    est = M.estimator("random_forest", numTrees=5, maxDepth=3)
    model = M.build_pipeline(["f0", "f1"], [], est).fit(df)
    path = os.path.join(tempfile.mkdtemp(prefix="strata-model-"), "m")
    meta = {"model_type": "RandomForest", "feature_names": ["f0", "f1"], "optimal_threshold": 0.4}
    M.save_model(model, path, meta, spark)
    loaded, meta2 = M.load_model(path, spark)
    assert meta2 == meta
    a = model.transform(df).select("id", "prediction").orderBy("id").collect()
    b = loaded.transform(df).select("id", "prediction").orderBy("id").collect()
    assert a == b


def test_linear_contributions_top_and_direction(spark):
    df = _data(spark)
    out = M.linear_contributions(df, ["f0", "f1", "f2", "f3"], [2.0, -1.0, 0.0, 0.5], "id", top=2)
    per = out.groupBy("id").count().agg(F.max("count")).first()[0]
    assert per == 2
    r = out.where("rank = 1").first()
    assert r.direction == ("increases_risk" if r.shap_value > 0 else "decreases_risk")


def test_contributions_use_the_fitted_scaler(spark):
    df = spark.createDataFrame([(1, 5.0), (2, 9.0)], "id long, x double")
    out = M.linear_contributions(df, ["x"], [3.0], "id", mean=[1.0], std=[2.0])
    assert {r["id"]: r["shap_value"] for r in out.collect()} == {1: 6.0, 2: 12.0}


def test_sampled_shapley_efficiency(spark):
    """Contributions of a row add up to f(x) - f(baseline)."""
    df = _data(spark, n=120)
    cols = ["f0", "f1", "f2", "f3"]
    model = M.build_pipeline(cols, [], M.estimator("gradient_boosting", maxIter=10), scale=False).fit(df)
    base = {c: 0.0 for c in cols}
    sh = M.sampled_shapley(model, df, cols, "id", n_perm=4, top=4, digits=12, baseline=base)
    total = {r["id"]: r["s"] for r in sh.groupBy("id").agg(F.sum("shap_value").alias("s")).collect()}
    fx = {r.id: r.score for r in M.positive_probability(model.transform(df)).select("id", "score").collect()}
    b = spark.createDataFrame([(0.0, 0.0, 0.0, 0.0)], cols)
    fb = M.positive_probability(model.transform(b)).first()["score"]
    for i in list(fx)[:30]:
        assert abs(total[i] - (fx[i] - fb)) < 1e-9


def _subset_value(leaf, row, known):
    """Mean of a leaf's value over a tree, with only the features ``known``."""
    out = leaf.value
    for f, low, high, allowed, share in leaf.path:
        inside = low < row[f] <= high and (allowed is None or row[f] in allowed)
        out *= float(inside) if f in known else share
    return out


def test_tree_contributions_equal_all_subsets_and_add_up(spark, tmp_path):
    from itertools import combinations
    from math import factorial

    from strata.operators import tree_shap as T
    df = _data(spark, 300)
    est = M.estimator("xgboost", maxIter=6, maxDepth=3)
    names = ["f0", "f1", "f2", "f3", "cat"]
    model = M.build_pipeline(names[:4], ["cat"], est, scale=True).fit(df)
    table = T.leaves(spark, model.stages[-1], str(tmp_path / "trees"))
    scored = model.transform(df)
    from pyspark.ml.functions import vector_to_array
    rows = scored.select(vector_to_array(model.stages[-1].getFeaturesCol()).alias("x"), vector_to_array("rawPrediction")[1].alias("m")).limit(20).collect()
    x, d = np.array([r["x"] for r in rows]), len(names)
    got = T.contributions(x, table)
    # rawPrediction is the margin of both classes, -m and m
    assert np.allclose(got.sum(axis=1) + T.base_value(table), [r["m"] for r in rows], atol=1e-9)
    for row, mine in zip(x[:5], got[:5]):
        for i in range(d):
            rest, want = [j for j in range(d) if j != i], 0.0
            for k in range(d):
                for s in combinations(rest, k):
                    gain = sum(_subset_value(leaf, row, {*s, i}) - _subset_value(leaf, row, set(s)) for leaf in table)
                    want += factorial(k) * factorial(d - 1 - k) / factorial(d) * gain
            assert abs(want - mine[i]) < 1e-9
    out = T.tree_contributions(model, df, names, "id", str(tmp_path / "again"), top=5, digits=9)
    assert out.count() == 300 * 5


def test_served_model_keeps_its_threshold_and_metrics(spark):
    from strata.operators import serving as SV
    data = _data(spark, 300)
    model, meta = SV.train_served(data, ["f0", "f1", "f2", "f3"], ["cat"], "logistic_regression", folds=5)
    assert 0 <= meta["optimal_threshold"] <= 1 and set(meta["cv_metrics"]) == {"accuracy", "precision", "recall", "f1", "auc"}
    assert meta["train_size"] + meta["test_size"] == 300 and set(meta["cost_detail"]) >= {"total_cost", "false_negatives", "false_positives"}
    served = SV.serve(model, meta, data, ["id"])
    assert served.select("threshold_used").distinct().first()[0] == round(meta["optimal_threshold"], 4)
    held = M.positive_probability(model.transform(data.where("is_test")))
    tp, said, pos = held.agg(F.count_if((F.col("score") >= meta["optimal_threshold"]) & (F.col("label") == 1)),
                             F.count_if(F.col("score") >= meta["optimal_threshold"]), F.count_if(F.col("label") == 1)).first()
    assert abs(meta["holdout_metrics"]["recall"] - tp / pos) < 1e-6 and abs(meta["holdout_metrics"]["precision"] - tp / said) < 1e-6
