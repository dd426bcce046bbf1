"""Exact evaluation on any ``(label, score)`` / ``(label, prediction)`` table
(SURVEY §2.11 metrics and curves, §2.17 business summaries).

Everything starts from the *score-count table* ``(score, pos, neg)``: one row
per distinct score, built with partial aggregation.  Curves and thresholds
need "how many positives / negatives score at least t", which are two-phase
prefix sums over that table (``orderstats.prefix_sums``) - O(n log n) and no
unpartitioned window over raw rows (the reference's threshold loop is
O(n²)).  AUC is the rank-sum identity with tie credit 1/2, computed from
integer sums, so it is exact (``BinaryClassificationEvaluator`` bins scores).
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from strata.functions.numeric import round_half_up
from strata.operators.orderstats import prefix_sums
from strata.operators.quality import row_scalar

# Fixed business parameters of the churn analysis (cost of a missed churner,
# cost of a retention offer, tier cut-off, per-tier exposure and actions).
COST_FN = 500.0
COST_FP = 75.0
HIGH_RISK = 0.7
TIER_COST = {"High": 500.0, "Medium": 300.0, "Low": 0.0}
TIER_ACTION = {
    "High": "Immediate outreach: personalized retention offer + account review",
    "Medium": "Proactive engagement: loyalty program enrollment + satisfaction survey",
    "Low": "Standard service: no immediate action required",
}


def score_counts(df: DataFrame, label: str = "label", score: str = "score") -> DataFrame:
    """``(score, pos, neg)`` - one row per distinct score.  Totals and prefix sums of
    one query share its exchange."""
    return (df.where(F.col(score).isNotNull())
            .groupBy(F.col(score).cast("double").alias("score"))
            .agg(F.sum(F.col(label).cast("long")).alias("pos"),
                 F.sum((1 - F.col(label)).cast("long")).alias("neg")))


def cumulative_confusion(df: DataFrame, label: str = "label", score: str = "score") -> DataFrame:
    """At every distinct threshold t (predict positive when score >= t):
    ``threshold, tp, fp, fn, tn``."""
    sc = score_counts(df, label, score)
    tot = row_scalar(sc.agg(F.sum("pos").alias("P"), F.sum("neg").alias("N")))
    cum = prefix_sums(sc, [], "score", ["pos", "neg"], descending=True)
    return cum.select(F.col("score").alias("threshold"),
                      F.col("cum_pos").alias("tp"), F.col("cum_neg").alias("fp"),
                      (tot["P"] - F.col("cum_pos")).alias("fn"),
                      (tot["N"] - F.col("cum_neg")).alias("tn"))


def roc_curve(df: DataFrame, label: str = "label", score: str = "score", digits: int = 6) -> DataFrame:
    cc = cumulative_confusion(df, label, score)
    return cc.select("threshold",
                     round_half_up(F.col("fp") / (F.col("fp") + F.col("tn")), digits).alias("fpr"),
                     round_half_up(F.col("tp") / (F.col("tp") + F.col("fn")), digits).alias("tpr"))


def pr_curve(df: DataFrame, label: str = "label", score: str = "score", digits: int = 6) -> DataFrame:
    cc = cumulative_confusion(df, label, score)
    return cc.select("threshold",
                     round_half_up(F.col("tp") / (F.col("tp") + F.col("fp")), digits).alias("precision"),
                     round_half_up(F.col("tp") / (F.col("tp") + F.col("fn")), digits).alias("recall"))


def roc_auc(df: DataFrame, label: str = "label", score: str = "score") -> DataFrame:
    """Exact AUC with ties counted 1/2: ``sum_s pos_s (2 neg_below_s + neg_s) / (2 P N)``."""
    sc = score_counts(df, label, score)
    cum = prefix_sums(sc, [], "score", ["pos", "neg"])    # ascending: negatives <= s
    num = F.sum(F.col("pos").cast("double") * (2 * (F.col("cum_neg") - F.col("neg")) + F.col("neg")))
    return cum.agg(num.alias("_num"), F.sum("pos").alias("_p"), F.sum("neg").alias("_n")) \
        .select((F.col("_num").cast("double") / (F.lit(2.0) * F.col("_p") * F.col("_n"))).alias("auc"))


def cost_threshold(df: DataFrame, label: str = "label", score: str = "score",
                   cost_fn: float = COST_FN, cost_fp: float = COST_FP) -> DataFrame:
    """Threshold minimising ``FN*cost_fn + FP*cost_fp`` over the distinct
    scores; ties go to the lowest threshold (first strict improvement when
    scanning thresholds upwards)."""
    cc = cumulative_confusion(df, label, score)
    cost = F.col("fn") * F.lit(cost_fn) + F.col("fp") * F.lit(cost_fp)
    return (cc.select("threshold", F.col("fn").alias("false_negatives"),
                      F.col("fp").alias("false_positives"), cost.alias("total_cost"),
                      (F.col("fn") * F.lit(cost_fn)).alias("missed_churner_cost"),
                      (F.col("fp") * F.lit(cost_fp)).alias("unnecessary_offer_cost"))
            .orderBy("total_cost", "threshold").limit(1))


def recall_target_threshold(df: DataFrame, target: float = 0.8, label: str = "label",
                            score: str = "score", digits: int = 6) -> DataFrame:
    """Highest threshold whose recall is still >= target (one row)."""
    pr = cumulative_confusion(df, label, score)
    recall = F.col("tp") / (F.col("tp") + F.col("fn"))
    return (pr.where(recall >= F.lit(target))
            .orderBy(F.col("threshold").desc()).limit(1)
            .select("threshold",
                    round_half_up(F.col("tp") / (F.col("tp") + F.col("fp")), digits).alias("precision"),
                    round_half_up(recall, digits).alias("recall")))


def confusion_matrix(df: DataFrame, label: str = "label", prediction: str = "prediction") -> DataFrame:
    return df.groupBy(F.col(label).alias("actual"), F.col(prediction).alias("predicted")) \
        .agg(F.count(F.lit(1)).alias("count"))


def classification_report(df: DataFrame, label: str = "label", prediction: str = "prediction",
                          digits: int = 6) -> DataFrame:
    """Per-class precision / recall / F1 / support plus ``accuracy``,
    ``macro avg`` and ``weighted avg`` rows (zero division -> 0), all from the
    confusion counts (a table of at most classes² rows)."""
    cm = confusion_matrix(df, label, prediction)
    by_actual = cm.groupBy(F.col("actual").alias("cls")).agg(
        F.sum("count").alias("support"),
        F.sum(F.when(F.col("actual") == F.col("predicted"), F.col("count")).otherwise(0)).alias("tp"))
    by_pred = cm.groupBy(F.col("predicted").alias("cls")).agg(F.sum("count").alias("npred"))
    per = by_actual.join(by_pred, "cls", "full").select(
        F.col("cls"), F.coalesce("support", F.lit(0)).alias("support"),
        F.coalesce("tp", F.lit(0)).alias("tp"), F.coalesce("npred", F.lit(0)).alias("npred"))
    p = F.coalesce(F.try_divide(F.col("tp"), F.col("npred")), F.lit(0.0))
    r = F.coalesce(F.try_divide(F.col("tp"), F.col("support")), F.lit(0.0))
    per = per.select(F.col("cls").cast("string").alias("class"), p.alias("precision"),
                     r.alias("recall"), "support", "tp")
    per = per.withColumn("f1", F.when(F.col("precision") + F.col("recall") > 0,
                                      2 * F.col("precision") * F.col("recall")
                                      / (F.col("precision") + F.col("recall"))).otherwise(0.0))
    tot = per.agg(F.sum("support").alias("n"), F.sum("tp").alias("tp"),
                  F.avg("precision").alias("mp"), F.avg("recall").alias("mr"), F.avg("f1").alias("mf"),
                  F.sum(F.col("precision") * F.col("support")).alias("wp"),
                  F.sum(F.col("recall") * F.col("support")).alias("wr"),
                  F.sum(F.col("f1") * F.col("support")).alias("wf"))
    extra = tot.select(F.explode(F.array(
        F.struct(F.lit("accuracy").alias("class"), F.lit(None).cast("double").alias("precision"),
                 F.lit(None).cast("double").alias("recall"), (F.col("tp") / F.col("n")).alias("f1"),
                 F.col("n").alias("support")),
        F.struct(F.lit("macro avg").alias("class"), F.col("mp").alias("precision"),
                 F.col("mr").alias("recall"), F.col("mf").alias("f1"), F.col("n").alias("support")),
        F.struct(F.lit("weighted avg").alias("class"), (F.col("wp") / F.col("n")).alias("precision"),
                 (F.col("wr") / F.col("n")).alias("recall"), (F.col("wf") / F.col("n")).alias("f1"),
                 F.col("n").alias("support")))).alias("s")).select("s.*")
    out = per.select("class", "precision", "recall", "f1", "support").unionByName(extra)
    rnd = (lambda c: round_half_up(c, digits).alias(c)) if digits is not None else F.col
    return out.select("class", *[rnd(c) for c in ("precision", "recall", "f1")],
                      F.col("support").cast("long").alias("support"))


def accuracy_scores(df: DataFrame, label: str = "label", prediction: str = "prediction",
                    digits: int = 6) -> DataFrame:
    """accuracy and support-weighted precision / recall / F1 (one row)."""
    rep = classification_report(df, label, prediction, digits=None)
    both = rep.where(F.col("class").isin("accuracy", "weighted avg")).agg(
        F.max(F.when(F.col("class") == "accuracy", F.col("f1"))).alias("accuracy"),
        F.max(F.when(F.col("class") == "weighted avg", F.col("precision"))).alias("precision"),
        F.max(F.when(F.col("class") == "weighted avg", F.col("recall"))).alias("recall"),
        F.max(F.when(F.col("class") == "weighted avg", F.col("f1"))).alias("f1"))
    return both.select(*[round_half_up(c, digits).alias(c) for c in ("accuracy", "precision", "recall", "f1")])


def positive_scores(df: DataFrame, label: str = "label", prediction: str = "prediction", digits: int = 6) -> DataFrame:
    """accuracy, and precision, recall and F1 of class 1 (one row; 0 where nothing is predicted or there)."""
    y, p = F.col(label) == 1, F.col(prediction) == 1
    one = df.agg(F.count("*").alias("n"), F.count_if(y == p).alias("ok"), F.count_if(y & p).alias("tp"),
                 F.count_if(y).alias("pos"), F.count_if(p).alias("said"))
    share = lambda a, b: F.when(b > 0, a / b).otherwise(F.lit(0.0))      # noqa: E731
    tp, pos, said = F.col("tp"), F.col("pos"), F.col("said")
    return one.select(*[round_half_up(c, digits).alias(name) for name, c in (
        ("accuracy", share(F.col("ok"), F.col("n"))), ("precision", share(tp, said)), ("recall", share(tp, pos)),
        ("f1", share(2 * tp, pos + said)))])


def brier(df: DataFrame, label: str = "label", score: str = "score", digits: int = 8) -> DataFrame:
    d = F.col(score) - F.col(label)
    return df.agg(round_half_up(F.avg(d * d), digits).alias("brier"))


def calibration_curve(df: DataFrame, n_bins: int = 8, label: str = "label", score: str = "score",
                      digits: int = 6) -> DataFrame:
    """Uniform bins on [0, 1]; bin k holds ``k/n < p <= (k+1)/n`` (p = 0 in bin 0);
    empty bins do not appear."""
    b = F.greatest(F.ceil(F.col(score) * F.lit(float(n_bins))) - 1, F.lit(0))
    b = F.least(b, F.lit(n_bins - 1)).cast("int")
    return df.groupBy(b.alias("bin")).agg(
        round_half_up(F.avg(score), digits).alias("prob_pred"),
        round_half_up(F.avg(F.col(label).cast("double")), digits).alias("prob_true"),
        F.count(F.lit(1)).alias("count"))


def tier(prob: Column, threshold: float) -> Column:
    return (F.when(prob >= F.lit(HIGH_RISK), F.lit("High"))
            .when(prob >= F.lit(threshold), F.lit("Medium")).otherwise(F.lit("Low")))


def batch_score(df: DataFrame, threshold: float, prob_col: str = "score",
                keep: tuple[str, ...] = ()) -> DataFrame:
    """Probability (4 dp), decision, risk tier, recommended action and
    exposure per row - one projection over the whole table."""
    p = F.col(prob_col)
    t = tier(p, threshold)
    action = F.create_map(*[x for k, v in TIER_ACTION.items() for x in (F.lit(k), F.lit(v))])
    cost = F.create_map(*[x for k, v in TIER_COST.items() for x in (F.lit(k), F.lit(v))])
    return df.select(*keep, round_half_up(p, 4).alias("churn_probability"),
                     (p >= F.lit(threshold)).alias("churn_prediction"),
                     t.alias("risk_tier"), action[t].alias("recommended_action"),
                     F.lit(round(threshold, 4)).alias("threshold_used"),
                     cost[t].alias("estimated_cost_if_missed"))


def batch_summary(scored: DataFrame) -> DataFrame:
    """One global aggregate over ``batch_score`` output."""
    pos = F.col("churn_prediction")
    return scored.agg(
        F.count(F.lit(1)).alias("total"), F.count_if(pos).alias("predicted_churners"),
        F.count_if(F.col("risk_tier") == "High").alias("high_risk"),
        F.count_if(F.col("risk_tier") == "Medium").alias("medium_risk"),
        F.count_if(F.col("risk_tier") == "Low").alias("low_risk"),
        F.coalesce(F.sum(F.when(pos, F.col("estimated_cost_if_missed"))), F.lit(0.0))
        .alias("total_risk_exposure"))


def impact_estimate(df: DataFrame, threshold: float, label: str = "label", score: str = "score",
                    loss: float = COST_FN, offer: float = COST_FP) -> DataFrame:
    """At-risk, detected, missed, unmitigated cost, cost with the model
    (missed losses + offers to the detected) and savings (one row)."""
    pred = F.col(score) >= F.lit(threshold)
    pos = F.col(label) == 1
    a = df.agg(F.count_if(pos).alias("at_risk"), F.count_if(pos & pred).alias("detected"),
               F.count_if(pos & ~pred).alias("missed"))
    unmitigated = F.col("at_risk") * F.lit(loss)
    with_model = F.col("missed") * F.lit(loss) + F.col("detected") * F.lit(offer)
    return a.select("at_risk", "detected", "missed", unmitigated.alias("cost_without_model"),
                    with_model.alias("cost_with_model"), (unmitigated - with_model).alias("savings"))


def risk_band(prob: Column, high: float = 0.7, low: float = 0.3) -> Column:
    """Care pathway bands: > high, [low, high], < low."""
    return (F.when(prob > F.lit(high), F.lit("high")).when(prob >= F.lit(low), F.lit("medium"))
            .otherwise(F.lit("low")))


def value_weighted_risk(df: DataFrame, prob: str, value: str, key: str, n: int = 20) -> DataFrame:
    """Expected loss = probability x value; top n (TakeOrderedAndProject)."""
    return (df.select(key, prob, value, (F.col(prob) * F.col(value)).alias("expected_loss"))
            .orderBy(F.col("expected_loss").desc(), F.col(key)).limit(n))


def position_size(prob: Column, max_size: float = 1.0, cost: float = 0.0) -> Column:
    """Signed size growing with confidence ``2p - 1``, zero when the edge
    does not cover the transaction cost."""
    edge = F.lit(2.0) * prob - F.lit(1.0)
    return F.when(F.abs(edge) > F.lit(cost), edge * F.lit(max_size)).otherwise(F.lit(0.0))


def ab_assign(df: DataFrame, key: str, seed: int = 42, treatment_share: float = 0.5) -> DataFrame:
    """Deterministic arm from the key's hash draw."""
    from strata.operators.sampling import hash_draw
    cut = f"{int(treatment_share * 16 ** 8):08x}"
    arm = F.when(F.substring(hash_draw(key, seed), 1, 8) < F.lit(cut), F.lit("treatment")) \
        .otherwise(F.lit("control"))
    return df.withColumn("arm", arm)


def ab_lift(assigned: DataFrame, outcome: str, digits: int = 6) -> DataFrame:
    return assigned.groupBy("arm").agg(
        F.count(F.lit(1)).alias("n"),
        round_half_up(F.avg(F.col(outcome).cast("double")), digits).alias("rate"))
