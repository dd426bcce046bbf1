"""Closed-form checks on the reference's threshold fixture and AUC identities."""
import itertools

from strata.operators import evaluate as E

# the fixture vectors of the reference tests
Y_TRUE = [0, 0, 0, 1, 1, 1, 0, 1, 0, 1]
Y_PROB = [.1, .2, .3, .8, .7, .9, .4, .6, .15, .85]


def _df(spark, y=Y_TRUE, p=Y_PROB):
    return spark.createDataFrame(list(zip(range(len(y)), y, p)), "id long, label int, score double")


def test_cost_threshold_closed_form(spark):
    for cfn, cfp in [(500, 75), (1, 1), (75, 500), (10, 1)]:
        r = E.cost_threshold(_df(spark), cost_fn=cfn, cost_fp=cfp).first()
        assert r["threshold"] == 0.6 and r["false_negatives"] == 0 and r["false_positives"] == 0
        assert r["total_cost"] == 0


def _brute_threshold(y, p, cfn, cfp):
    best = None
    for t in sorted(set(p)):
        fn = sum(1 for a, b in zip(y, p) if a == 1 and b < t)
        fp = sum(1 for a, b in zip(y, p) if a == 0 and b >= t)
        c = fn * cfn + fp * cfp
        if best is None or c < best[0]:
            best = (c, t)
    return best


def test_cost_threshold_matches_quadratic_loop_and_is_monotone(spark):
    y = [1, 0, 1, 1, 0, 0, 1, 0, 0, 1, 0, 1, 0, 0, 1]
    p = [.9, .8, .7, .7, .6, .5, .5, .4, .3, .3, .2, .2, .1, .05, .65]
    prev = None
    for cfn in [1, 2, 5, 10, 50]:
        r = E.cost_threshold(_df(spark, y, p), cost_fn=cfn, cost_fp=1).first()
        c, t = _brute_threshold(y, p, cfn, 1)
        assert r["threshold"] == t and r["total_cost"] == c
        if prev is not None:
            assert r["threshold"] <= prev       # dearer FN never raises the threshold
        prev = r["threshold"]


def test_auc_rank_identity(spark):
    y = [1, 0, 1, 1, 0, 0, 1, 0, 0, 1, 0, 1, 0, 0, 1]
    p = [.9, .8, .7, .7, .6, .5, .5, .4, .3, .3, .2, .2, .1, .05, .65]
    pos = [b for a, b in zip(y, p) if a == 1]
    neg = [b for a, b in zip(y, p) if a == 0]
    want = sum(1.0 if a > b else 0.5 if a == b else 0.0
               for a, b in itertools.product(pos, neg)) / (len(pos) * len(neg))
    got = E.roc_auc(_df(spark, y, p)).first()["auc"]
    assert abs(got - want) < 1e-12


def test_classification_report_perfect(spark):
    df = _df(spark).selectExpr("label", "CAST(score >= 0.6 AS INT) AS prediction")
    rep = {r["class"]: r for r in E.classification_report(df).collect()}
    assert rep["accuracy"]["f1"] == 1.0
    assert rep["0"]["precision"] == 1.0 and rep["1"]["recall"] == 1.0


def test_recall_target(spark):
    r = E.recall_target_threshold(_df(spark), 0.8).first()
    assert r["threshold"] == 0.7 and r["recall"] == 0.8   # 4 of 5 positives score >= 0.7


def test_batch_score_tiers(spark):
    out = E.batch_score(_df(spark), 0.5, keep=("id",)).collect()
    tiers = {r["id"]: r["risk_tier"] for r in out}
    assert tiers[5] == "High" and tiers[7] == "Medium" and tiers[0] == "Low"
    s = E.batch_summary(E.batch_score(_df(spark), 0.5)).first()
    assert s["total"] == 10 and s["high_risk"] + s["medium_risk"] + s["low_risk"] == 10
