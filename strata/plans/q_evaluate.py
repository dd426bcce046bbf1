"""Registered evaluation queries over the
``scored`` stand-in ``(id, label, score)``, with DuckDB oracles."""

from __future__ import annotations

from pyspark.sql import functions as F

from strata.operators import evaluate as E
from strata.plans import standins as st
from strata.plans.catalog import register
from strata.plans.q_aggregates import _r

THRESHOLD = 0.2

_SC = f"""WITH {st.SCORED_SQL},
sc AS (SELECT score, SUM(label) AS pos, SUM(1 - label) AS neg FROM scored GROUP BY score),
tot AS (SELECT SUM(pos) AS P, SUM(neg) AS N FROM sc),
cum AS (SELECT score AS threshold, CAST(SUM(pos) OVER (ORDER BY score DESC) AS BIGINT) AS tp,
               CAST(SUM(neg) OVER (ORDER BY score DESC) AS BIGINT) AS fp FROM sc),
cc AS (SELECT threshold, tp, fp, CAST(P - tp AS BIGINT) AS fn, CAST(N - fp AS BIGINT) AS tn FROM cum, tot)"""

_PRED = f"""WITH {st.SCORED_SQL},
p AS (SELECT id, label, CAST(score >= {THRESHOLD} AS INTEGER) AS prediction, score FROM scored)"""


def _scored(spark, sf):
    return st.scored(spark, sf)


def _pred(spark, sf):
    return _scored(spark, sf).withColumn("prediction", (F.col("score") >= THRESHOLD).cast("int"))


@register("cumulative_confusion", sql=_SC + "\nSELECT * FROM cc")
def q_cumulative_confusion(spark, sf):
    return E.cumulative_confusion(_scored(spark, sf))


@register("roc_curve", sql=_SC + f"""
SELECT threshold, {_r('fp / (fp + tn)', 6)} AS fpr, {_r('tp / (tp + fn)', 6)} AS tpr FROM cc""")
def q_roc_curve(spark, sf):
    return E.roc_curve(_scored(spark, sf))


@register("pr_curve", sql=_SC + f"""
SELECT threshold, {_r('tp / (tp + fp)', 6)} AS precision, {_r('tp / (tp + fn)', 6)} AS recall FROM cc""")
def q_pr_curve(spark, sf):
    return E.pr_curve(_scored(spark, sf))


@register("roc_auc", headline=True, sql=f"""WITH {st.SCORED_SQL},
sc AS (SELECT score, SUM(label) AS pos, SUM(1 - label) AS neg FROM scored GROUP BY score),
a AS (SELECT pos, neg, SUM(neg) OVER (ORDER BY score) AS cn FROM sc)
SELECT CAST(SUM(pos * (2 * (cn - neg) + neg)) AS DOUBLE) / (2.0::DOUBLE * SUM(pos) * SUM(neg)) AS auc FROM a""")
def q_roc_auc(spark, sf):
    return E.roc_auc(_scored(spark, sf))


@register("cost_threshold", headline=True, sql=_SC + """
SELECT threshold, fn AS false_negatives, fp AS false_positives, fn * 500.0::DOUBLE + fp * 75.0::DOUBLE AS total_cost,
       fn * 500.0::DOUBLE AS missed_churner_cost, fp * 75.0::DOUBLE AS unnecessary_offer_cost
FROM cc ORDER BY total_cost, threshold LIMIT 1""")
def q_cost_threshold(spark, sf):
    return E.cost_threshold(_scored(spark, sf))


@register("recall_target_threshold", sql=_SC + f"""
SELECT threshold, {_r('tp / (tp + fp)', 6)} AS precision, {_r('tp / (tp + fn)', 6)} AS recall
FROM cc WHERE tp / (tp + fn) >= 0.8 ORDER BY threshold DESC LIMIT 1""")
def q_recall_target_threshold(spark, sf):
    return E.recall_target_threshold(_scored(spark, sf), 0.8)


@register("confusion_matrix", sql=_PRED + """
SELECT label AS actual, prediction AS predicted, COUNT(*) AS count FROM p GROUP BY 1, 2""")
def q_confusion_matrix(spark, sf):
    return E.confusion_matrix(_pred(spark, sf))


_REPORT = _PRED + """,
cm AS (SELECT label AS actual, prediction AS predicted, COUNT(*) AS c FROM p GROUP BY 1, 2),
ba AS (SELECT actual AS cls, SUM(c) AS support, SUM(CASE WHEN actual = predicted THEN c ELSE 0 END) AS tp
       FROM cm GROUP BY 1),
bp AS (SELECT predicted AS cls, SUM(c) AS npred FROM cm GROUP BY 1),
per0 AS (SELECT COALESCE(ba.cls, bp.cls) AS cls, CAST(COALESCE(support, 0) AS BIGINT) AS support,
                CAST(COALESCE(tp, 0) AS BIGINT) AS tp, CAST(COALESCE(npred, 0) AS BIGINT) AS npred
         FROM ba FULL JOIN bp ON ba.cls = bp.cls),
per1 AS (SELECT CAST(cls AS VARCHAR) AS class,
                CASE WHEN npred > 0 THEN tp / npred ELSE 0.0::DOUBLE END AS precision,
                CASE WHEN support > 0 THEN tp / support ELSE 0.0::DOUBLE END AS recall, support, tp FROM per0),
per AS (SELECT *, CASE WHEN precision + recall > 0 THEN 2 * precision * recall / (precision + recall)
                       ELSE 0.0::DOUBLE END AS f1 FROM per1),
rep AS (
  SELECT class, precision, recall, f1, support FROM per
  UNION ALL SELECT 'accuracy', NULL, NULL, SUM(tp) / SUM(support), SUM(support) FROM per
  UNION ALL SELECT 'macro avg', AVG(precision), AVG(recall), AVG(f1), SUM(support) FROM per
  UNION ALL SELECT 'weighted avg', SUM(precision * support) / SUM(support), SUM(recall * support) / SUM(support),
                   SUM(f1 * support) / SUM(support), SUM(support) FROM per)"""


@register("classification_report", sql=_REPORT + f"""
SELECT class, {_r('precision', 6)} AS precision, {_r('recall', 6)} AS recall, {_r('f1', 6)} AS f1,
       CAST(support AS BIGINT) AS support FROM rep""")
def q_classification_report(spark, sf):
    return E.classification_report(_pred(spark, sf))


@register("accuracy", sql=_REPORT + f"""
SELECT {_r("MAX(CASE WHEN class = 'accuracy' THEN f1 END)", 6)} AS accuracy,
       {_r("MAX(CASE WHEN class = 'weighted avg' THEN precision END)", 6)} AS precision,
       {_r("MAX(CASE WHEN class = 'weighted avg' THEN recall END)", 6)} AS recall,
       {_r("MAX(CASE WHEN class = 'weighted avg' THEN f1 END)", 6)} AS f1 FROM rep""")
def q_accuracy(spark, sf):
    return E.accuracy_scores(_pred(spark, sf))


@register("brier", sql=f"""WITH {st.SCORED_SQL}
SELECT {_r('AVG((score - label) * (score - label))', 8)} AS brier FROM scored""")
def q_brier(spark, sf):
    return E.brier(_scored(spark, sf))


@register("calibration_curve", sql=f"""WITH {st.SCORED_SQL}
SELECT CAST(LEAST(GREATEST(CEIL(score * 8.0) - 1, 0), 7) AS INTEGER) AS bin,
       {_r('AVG(score)', 6)} AS prob_pred, {_r('AVG(CAST(label AS DOUBLE))', 6)} AS prob_true, COUNT(*) AS count
FROM scored GROUP BY 1""")
def q_calibration_curve(spark, sf):
    return E.calibration_curve(_scored(spark, sf), 8)


_TIER = f"CASE WHEN score >= 0.7 THEN 'High' WHEN score >= {THRESHOLD} THEN 'Medium' ELSE 'Low' END"
_BATCH = f"""WITH {st.SCORED_SQL},
b AS (SELECT id, FLOOR(score * 10000 + 0.5) / 10000 AS churn_probability, score >= {THRESHOLD} AS churn_prediction,
             {_TIER} AS risk_tier,
             CASE {_TIER} WHEN 'High' THEN '{E.TIER_ACTION["High"]}' WHEN 'Medium' THEN '{E.TIER_ACTION["Medium"]}'
                  ELSE '{E.TIER_ACTION["Low"]}' END AS recommended_action,
             {THRESHOLD}::DOUBLE AS threshold_used,
             CASE {_TIER} WHEN 'High' THEN 500.0::DOUBLE WHEN 'Medium' THEN 300.0::DOUBLE ELSE 0.0::DOUBLE END
               AS estimated_cost_if_missed
      FROM scored)"""


@register("batch_score", sql=_BATCH + "\nSELECT * FROM b")
def q_batch_score(spark, sf):
    return E.batch_score(_scored(spark, sf), THRESHOLD, keep=("id",))


@register("batch_summary", sql=_BATCH + """
SELECT COUNT(*) AS total, COUNT(*) FILTER (WHERE churn_prediction) AS predicted_churners,
       COUNT(*) FILTER (WHERE risk_tier = 'High') AS high_risk,
       COUNT(*) FILTER (WHERE risk_tier = 'Medium') AS medium_risk,
       COUNT(*) FILTER (WHERE risk_tier = 'Low') AS low_risk,
       COALESCE(SUM(estimated_cost_if_missed) FILTER (WHERE churn_prediction), 0.0) AS total_risk_exposure
FROM b""")
def q_batch_summary(spark, sf):
    return E.batch_summary(E.batch_score(_scored(spark, sf), THRESHOLD))


@register("impact_estimate", sql=f"""WITH {st.SCORED_SQL},
a AS (SELECT COUNT(*) FILTER (WHERE label = 1) AS at_risk,
             COUNT(*) FILTER (WHERE label = 1 AND score >= {THRESHOLD}) AS detected,
             COUNT(*) FILTER (WHERE label = 1 AND NOT score >= {THRESHOLD}) AS missed FROM scored)
SELECT at_risk, detected, missed, at_risk * 500.0::DOUBLE AS cost_without_model,
       missed * 500.0::DOUBLE + detected * 75.0::DOUBLE AS cost_with_model,
       at_risk * 500.0::DOUBLE - (missed * 500.0::DOUBLE + detected * 75.0::DOUBLE) AS savings FROM a""")
def q_impact_estimate(spark, sf):
    return E.impact_estimate(_scored(spark, sf), THRESHOLD)


@register("risk_band", sql=f"""WITH {st.SCORED_SQL}
SELECT CASE WHEN score > 0.7 THEN 'high' WHEN score >= 0.3 THEN 'medium' ELSE 'low' END AS band,
       COUNT(*) AS n, {_r('AVG(CAST(label AS DOUBLE))', 6)} AS observed_rate
FROM scored GROUP BY 1""")
def q_risk_band(spark, sf):
    from strata.functions.numeric import round_half_up
    s = _scored(spark, sf)
    return s.groupBy(E.risk_band(F.col("score")).alias("band")).agg(
        F.count(F.lit(1)).alias("n"), round_half_up(F.avg(F.col("label").cast("double")), 6).alias("observed_rate"))


@register("value_weighted_risk", sql=f"""WITH {st.SCORED_SQL}
SELECT id, score, MonthlyCharges, score * MonthlyCharges AS expected_loss FROM scored
ORDER BY expected_loss DESC, id LIMIT 20""")
def q_value_weighted_risk(spark, sf):
    return E.value_weighted_risk(_scored(spark, sf), "score", "MonthlyCharges", "id", 20)


@register("position_size", sql=f"""WITH {st.TRADING_SQL}
SELECT ts_id, CASE WHEN ABS(2.0::DOUBLE * (feature_1 / 100.0::DOUBLE) - 1.0) > 0.1
                   THEN (2.0::DOUBLE * (feature_1 / 100.0::DOUBLE) - 1.0) * 1.0 ELSE 0.0 END AS size
FROM trading""")
def q_position_size(spark, sf):
    t = st.trading(spark, sf)
    return t.select("ts_id", E.position_size(F.col("feature_1") / F.lit(100.0), 1.0, 0.1).alias("size"))


@register("ab_assign", sql=f"""WITH {st.CHURN_SQL}
SELECT CASE WHEN substr(md5(CAST(customerID AS VARCHAR) || '#42'), 1, 8) < '{int(0.5 * 16 ** 8):08x}'
            THEN 'treatment' ELSE 'control' END AS arm,
       COUNT(*) AS n, {_r("AVG(CASE WHEN Churn = 'Yes' THEN 1.0::DOUBLE ELSE 0.0::DOUBLE END)", 6)} AS rate
FROM churn GROUP BY 1""")
def q_ab_assign(spark, sf):
    c = st.churn(spark, sf).withColumn("churned", (F.col("Churn") == "Yes").cast("double"))
    return E.ab_lift(E.ab_assign(c, "customerID", 42), "churned")
