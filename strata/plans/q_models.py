"""Registered model, tuning and explanation queries (SURVEY §2.10 pipeline,
§2.11).  Model fits are not SQL-expressible: these are checked by row counts
here and by invariants in ``tests/test_models.py``."""

from __future__ import annotations

import uuid

from pyspark.ml.feature import StandardScalerModel
from pyspark.ml.functions import vector_to_array
from pyspark.sql import Window
from pyspark.sql import functions as F

from strata.functions.numeric import round_half_up
from strata.operators import models as M
from strata.operators import retrieve as RV
from strata.operators import sampling as S
from strata.operators import serving as SV
from strata.operators import tree_shap as TS
from strata.plans import standins as st
from strata.plans.catalog import register
from strata.session import checkpoint_dir, cut_lineage
from strata.sources.tables import read_table

NUMERIC = ["tenure", "MonthlyCharges", "n_orders", "TotalCharges"]
CATEGORICAL = ["Contract"]


def churn_model_table(spark, sf):
    """Churn rows with a 0/1 label, the exact stratified split and 5 folds."""
    c = st.churn(spark, sf).select(
        "customerID", "Contract", *[F.col(x).cast("double").alias(x) for x in NUMERIC],
        F.when(F.col("Churn") == "Yes", 1).otherwise(0).alias("label"))
    # iterative fitters scan their input many times: cut the derivation's
    # lineage once (reliable checkpoint in the shared checkpoint folder)
    return cut_lineage(S.split_and_folds(c, "label", "customerID", 0.2, 5, 42))


def _fit_eval(spark, sf, kind, data=None, **params):
    data = churn_model_table(spark, sf) if data is None else data
    train, test = data.where(~F.col("is_test")), data.where("is_test")
    est = M.estimator(kind, n_rows=train.count(), **params)
    pipe = M.build_pipeline(NUMERIC, CATEGORICAL, est, scale=True, impute=True)
    return M.fit_predict(train, test, pipe, ["customerID", "label"])


@register("logistic_regression")
def q_logistic_regression(spark, sf):
    return _fit_eval(spark, sf, "logistic_regression")


@register("decision_tree")
def q_decision_tree(spark, sf):
    return _fit_eval(spark, sf, "decision_tree", maxDepth=M.MAX_TREE_DEPTH, impurity="entropy")


@register("random_forest")
def q_random_forest(spark, sf):
    return _fit_eval(spark, sf, "random_forest", numTrees=200, maxDepth=10)


@register("gradient_boosting")
def q_gradient_boosting(spark, sf):
    return _fit_eval(spark, sf, "gradient_boosting", maxIter=20, maxDepth=3)


@register("xgboost")
def q_xgboost(spark, sf):
    return _fit_eval(spark, sf, "xgboost", maxIter=200, maxDepth=5, stepSize=0.1, subsamplingRate=0.8)


@register("linear_svm")
def q_linear_svm(spark, sf):
    return _fit_eval(spark, sf, "linear_svm", maxIter=50)


@register("mlp")
def q_mlp(spark, sf):
    # inputs: 4 numeric + 4 dummies (drop-first over 5 segments) = 8
    return _fit_eval(spark, sf, "mlp", layers=[8, 128, 64, 2], maxIter=50)


@register("ml_pipeline")
def q_pipeline(spark, sf):
    """impute -> dummies -> scale -> ANOVA-F top 4 -> logistic regression."""
    data = churn_model_table(spark, sf)
    train, test = data.where(~F.col("is_test")), data.where("is_test")
    est = M.estimator("logistic_regression", n_rows=train.count())
    pipe = M.build_pipeline(NUMERIC, CATEGORICAL, est, scale=True, impute=True, kbest=4)
    return M.fit_predict(train, test, pipe, ["customerID", "label"])


@register("cross_validate")
def q_cross_validate(spark, sf):
    data = churn_model_table(spark, sf).where(~F.col("is_test"))
    est = M.estimator("logistic_regression", n_rows=data.count())
    pipe = M.build_pipeline(NUMERIC, CATEGORICAL, est, impute=True)
    return M.cv_summary(M.cross_validate(data, pipe, "fold", 5))


@register("grid_search")
def q_grid_search(spark, sf):
    data = churn_model_table(spark, sf).where(~F.col("is_test"))
    est = M.estimator("decision_tree")
    pipe = M.build_pipeline(NUMERIC, CATEGORICAL, est, impute=True)
    return M.grid_search(data, pipe, est, {"maxDepth": [3, 5], "impurity": ["gini", "entropy"]}, "fold")


@register("randomized_search")
def q_randomized_search(spark, sf):
    data = churn_model_table(spark, sf).where(~F.col("is_test"))
    est = M.estimator("random_forest")
    pipe = M.build_pipeline(NUMERIC, CATEGORICAL, est, impute=True)
    grid = {"numTrees": [5, 10, 20], "maxDepth": [3, 5, 8], "featureSubsetStrategy": ["sqrt", "log2"]}
    return M.grid_search(data, pipe, est, grid, "fold", sample=10, seed=42)


@register("rank_grid_results")
def q_rank_grid_results(spark, sf):
    g = q_grid_search(spark, sf)
    return g.withColumn("rank_test_score", F.rank().over(Window.orderBy(F.col("mean_auc").desc())))


def _comparison(spark, sf):
    frames, data = [], churn_model_table(spark, sf)
    for kind, params in [("logistic_regression", {}), ("decision_tree", {"maxDepth": 5}),
                         ("random_forest", {"numTrees": 20, "maxDepth": 8}),
                         ("gradient_boosting", {"maxIter": 20})]:
        pred = _fit_eval(spark, sf, kind, data, **params)
        frames.append(M.metrics_row(pred).select(F.lit(kind).alias("model"), "*"))
    out = frames[0]
    for f in frames[1:]:
        out = out.unionByName(f)
    return out


@register("model_comparison")
def q_model_comparison(spark, sf):
    return _comparison(spark, sf)


@register("argmax_model")
def q_argmax_model(spark, sf):
    """Best model by recall of the positive class, ties to the first listed (``idxmax``)."""
    order = {"logistic_regression": 0, "decision_tree": 1, "random_forest": 2, "gradient_boosting": 3}
    cmp = _comparison(spark, sf)
    pos = F.create_map(*[x for k, v in order.items() for x in (F.lit(k), F.lit(v))])
    return cmp.orderBy(F.col("recall").desc(), pos[F.col("model")]).limit(1)


@register("feature_importance")
def q_feature_importance(spark, sf):
    data = churn_model_table(spark, sf)
    train = data.where(~F.col("is_test"))
    est = M.estimator("random_forest", numTrees=20, maxDepth=8)
    pipe = M.build_pipeline(NUMERIC, [], est, scale=False, impute=True)
    model = pipe.fit(train)
    rows = M.feature_importance(model.stages[-1], NUMERIC)
    df = spark.createDataFrame([(n, round(v, 6)) for n, v in rows], "feature string, importance double")
    return df.withColumn("rank", F.row_number().over(Window.orderBy(F.col("importance").desc(), "feature")))


def _linear_model(spark, sf):
    """Rows with the assembled features of the linear churn model in ``NUMERIC`` and one column per dummy, its coefficients
    and the statistics of its scaler."""
    data = churn_model_table(spark, sf)
    train = data.where(~F.col("is_test"))
    est = M.estimator("logistic_regression", n_rows=train.count())
    model = M.build_pipeline(NUMERIC, CATEGORICAL, est, scale=True, impute=True).fit(train)
    scaler = next(stage for stage in model.stages if isinstance(stage, StandardScalerModel))
    slots = feature_slots(model)
    names = [n if n in NUMERIC else f"{n}_{k}" for k, n in enumerate(slots)]
    x = vector_to_array("_assembled")
    rows = model.transform(data).select("customerID", "is_test", *[x[k].alias(n) for k, n in enumerate(names)])
    return rows, names, list(model.stages[-1].coefficients), {"mean": list(scaler.mean), "std": list(scaler.std)}


@register("explain")
def q_explain(spark, sf):
    """Top signed contributions per test row of the linear churn model, with the dummies of its categories."""
    rows, names, coefs, scaler = _linear_model(spark, sf)
    return M.linear_contributions(rows.where("is_test"), names, coefs, "customerID", top=10, **scaler)


@register("shap_summary")
def q_shap_summary(spark, sf):
    rows, names, coefs, scaler = _linear_model(spark, sf)
    contrib = M.linear_contributions(rows, names, coefs, "customerID", top=len(names), **scaler)
    return M.mean_abs_contribution(contrib)


@register("logit_inference")
def q_logit_inference(spark, sf):
    data = churn_model_table(spark, sf).na.fill(0.0, subset=["TotalCharges"])
    from strata.operators.features import standard_scale
    scaled = standard_scale(data, ["tenure", "MonthlyCharges"], digits=None)
    return M.logit_inference(scaled, ["tenure", "MonthlyCharges"], "label")


@register("knn_classifier", sql="""
WITH e AS (SELECT vec_id AS id, label, embedding FROM embeddings),
r AS (SELECT id, label, ROW_NUMBER() OVER (PARTITION BY label ORDER BY md5(CAST(id AS VARCHAR) || '#42') || CAST(id AS VARCHAR)) - 1 AS rk,
             COUNT(*) OVER (PARTITION BY label) AS n_c FROM e),
s AS (SELECT id, label, rk < FLOOR(n_c * 0.2::DOUBLE + 0.5) AS is_test FROM r),
lf AS (SELECT id, unnest(embedding) AS x, generate_subscripts(embedding, 1) AS i FROM e),
d AS (SELECT q.id AS qid, c.id AS cid, SUM((CAST(q.x AS DOUBLE) - CAST(c.x AS DOUBLE)) * (CAST(q.x AS DOUBLE) - CAST(c.x AS DOUBLE))) AS dist
      FROM lf q JOIN lf c ON q.i = c.i
      WHERE q.id IN (SELECT id FROM s WHERE is_test) AND c.id IN (SELECT id FROM s WHERE NOT is_test)
      GROUP BY q.id, c.id),
nn AS (SELECT qid, cid FROM (SELECT qid, cid, ROW_NUMBER() OVER (PARTITION BY qid ORDER BY dist, cid) AS rn FROM d) WHERE rn <= 7),
v AS (SELECT nn.qid, s.label, COUNT(*) AS n FROM nn JOIN s ON nn.cid = s.id GROUP BY nn.qid, s.label)
SELECT qid AS id, arg_min(label, (-n, label)) AS prediction FROM v GROUP BY qid""")
def q_knn_classifier(spark, sf):
    e = read_table(spark, sf, "embeddings").select(
        F.col("vec_id").alias("id"), "label", F.transform("embedding", lambda x: x.cast("double")).alias("v"))
    split = S.stratified_split(e, "label", "id", 0.2, 42)
    train = split.where(~F.col("is_test")).select("id", "v", "label")
    test = split.where("is_test").select("id", "v")
    return RV.knn_classify(train, test, k=7)


SERVED = {"maxIter": 60, "maxDepth": 5, "stepSize": 0.1}


def served_model(spark, sf, folds=0):
    """The model that is served, with class weights and all features, and its metadata."""
    data = churn_model_table(spark, sf)
    return (data, *SV.train_served(data, NUMERIC, CATEGORICAL, "xgboost", SERVED, folds))


@register("batch_score_model")
def q_batch_score_model(spark, sf):
    """Score every customer with the served model at its learnt threshold, tier and summarise."""
    from strata.operators import evaluate as E
    data, model, meta = served_model(spark, sf)
    return E.batch_summary(SV.serve(model, meta, data, ["customerID"]))


@register("train_served")
def q_train_served(spark, sf):
    """What training stores besides the model: ``(name, value)``, nested names joined by dots."""
    _, _, meta = served_model(spark, sf, folds=5)

    def flat(d, prefix=""):
        for k, v in d.items():
            yield from flat(v, f"{prefix}{k}.") if isinstance(v, dict) else [(prefix + k, str(v))]
    return spark.createDataFrame([r for r in flat(meta) if r[0] != "trained_at"], "name string, value string")


@register("prepare_training", sql=f"""WITH {st.CHURN_SQL}
SELECT CAST(tenure AS DOUBLE) AS tenure, CAST(MonthlyCharges AS DOUBLE) AS MonthlyCharges, CAST(n_orders AS DOUBLE) AS n_orders,
       CASE WHEN Churn = 'Yes' THEN 1 ELSE 0 END AS label,
       {", ".join(f"CASE WHEN Contract = '{v}' THEN 1.0::DOUBLE ELSE 0.0::DOUBLE END AS \"Contract_{v}\"" for v in
                  ("BUILDING", "FURNITURE", "HOUSEHOLD", "MACHINERY"))} FROM churn""")
def q_prepare_training(spark, sf):
    c = st.churn(spark, sf).select("customerID", "Contract", "tenure", "MonthlyCharges", "n_orders", "Churn")
    return SV.prepare_training(c, "Churn", "Yes", drop=["customerID"])


def feature_slots(model):
    """Feature of every slot of the assembled vector: the numbers, then a column's dummies under its own name."""
    sizes = [s for stage in model.stages if hasattr(stage, "categorySizes") for s in stage.categorySizes]
    return NUMERIC + [c for c, n in zip(CATEGORICAL, sizes) for _ in range(n - 1)]


@register("explain_tree")
def q_explain_tree(spark, sf):
    """Exact contributions of every feature to the served model's margin, for every test customer."""
    data, model, _ = served_model(spark, sf)
    folder = f"{checkpoint_dir(spark).rstrip('/')}/trees-{uuid.uuid4().hex}"
    return TS.tree_contributions(model, data.where("is_test"), feature_slots(model), "customerID", folder)


@register("explain_tree_sampled")
def q_explain_tree_sampled(spark, sf):
    """Sampled Shapley contributions of the gradient-boosted churn model for
    every test customer (top drivers per row)."""
    data = churn_model_table(spark, sf).na.fill(0.0, subset=["TotalCharges"])
    train = data.where(~F.col("is_test"))
    est = M.estimator("xgboost", maxIter=20, maxDepth=4)
    model = M.build_pipeline(NUMERIC, [], est, scale=True).fit(train)
    return M.sampled_shapley(model, data.where("is_test"), NUMERIC, "customerID", n_perm=8, top=10)
