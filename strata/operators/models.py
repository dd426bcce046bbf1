"""Models, tuning and explanation on Spark ML.

Every estimator is wrapped in the same pipeline builder (optional median
imputation -> optional scaling -> optional ANOVA-F selection -> estimator),
fitted on training rows only.  Folds come from the exact stratified fold
column (``sampling.stratified_kfold``), so cross-validation is reproducible
for a given seed and needs no ``rand()``.
"""

from __future__ import annotations

import itertools
import json
import random
from collections.abc import Sequence

from pyspark.ml import Pipeline, PipelineModel
from pyspark.ml.classification import (DecisionTreeClassifier, GBTClassifier, LinearSVC,
                                       LogisticRegression, MultilayerPerceptronClassifier,
                                       RandomForestClassifier)
from pyspark.ml.evaluation import BinaryClassificationEvaluator
from pyspark.ml.feature import Imputer, StandardScaler, VectorAssembler
from pyspark.ml.functions import vector_to_array
from pyspark.ml.regression import GeneralizedLinearRegression
from pyspark.ml.tuning import CrossValidator
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from strata.functions.numeric import round_half_up
from strata.operators import evaluate as E
from strata.operators.features import ml_kbest, ml_one_hot_stages

MAX_TREE_DEPTH = 30          # Spark's limit


def _depth(p: dict, default: int) -> int:
    depth = p.get("maxDepth", default)
    if depth > MAX_TREE_DEPTH:
        raise ValueError(f"maxDepth {depth}: trees have at most {MAX_TREE_DEPTH} levels")
    return depth


def estimator(kind: str, label: str = "label", features: str = "features", seed: int = 42,
              weight_col: str | None = None, n_rows: int | None = None, **p):
    """scikit-learn-like estimators expressed as Spark ML estimators."""
    common = dict(labelCol=label, featuresCol=features)
    if kind == "logistic_regression":
        # scikit-learn: L2, C=1 on the summed loss  ->  regParam = 1 / n on Spark's mean loss
        reg = p.get("regParam", 1.0 / n_rows if n_rows else 0.0)
        est = LogisticRegression(maxIter=p.get("maxIter", 100), regParam=reg, elasticNetParam=0.0,
                                 standardization=False, **common)
    elif kind == "decision_tree":
        est = DecisionTreeClassifier(maxDepth=_depth(p, 5),
                                     impurity=p.get("impurity", "gini"), seed=seed, **common)
    elif kind == "random_forest":
        est = RandomForestClassifier(numTrees=p.get("numTrees", 20),
                                     maxDepth=_depth(p, 5),
                                     featureSubsetStrategy=p.get("featureSubsetStrategy", "sqrt"),
                                     impurity=p.get("impurity", "gini"), seed=seed, **common)
    elif kind in ("gradient_boosting", "xgboost"):
        # xgboost is re-aimed to Spark's GBT (depth, eta, subsample, weights)
        est = GBTClassifier(maxIter=p.get("maxIter", 20), maxDepth=_depth(p, 3),
                            stepSize=p.get("stepSize", 0.1), subsamplingRate=p.get("subsamplingRate", 1.0),
                            featureSubsetStrategy=p.get("featureSubsetStrategy", "all"), seed=seed, **common)
    elif kind == "linear_svm":
        est = LinearSVC(maxIter=p.get("maxIter", 50), regParam=p.get("regParam", 0.0), **common)
    elif kind == "mlp":
        est = MultilayerPerceptronClassifier(layers=p["layers"], maxIter=p.get("maxIter", 50),
                                             blockSize=128, seed=seed, **common)
    else:
        raise ValueError(kind)
    if weight_col and hasattr(est, "setWeightCol") and kind != "mlp":
        est.setWeightCol(weight_col)
    return est


def build_pipeline(numeric: Sequence[str], categorical: Sequence[str], est, scale: bool = True,
                   impute: bool = False, kbest: int | None = None, drop_first: bool = True) -> Pipeline:
    """impute? -> dummies -> assemble -> scale? -> select? -> estimator."""
    stages = []
    num = list(numeric)
    if impute:
        stages.append(Imputer(inputCols=num, outputCols=[f"{c}__imp" for c in num],
                              strategy="median", relativeError=1e-4))
        num = [f"{c}__imp" for c in num]
    if categorical:
        stages += ml_one_hot_stages(categorical, drop_first=drop_first)
    inputs = num + [f"{c}__ohe" for c in categorical]
    stages.append(VectorAssembler(inputCols=inputs, outputCol="_assembled", handleInvalid="keep"))
    cur = "_assembled"
    if scale:
        stages.append(StandardScaler(inputCol=cur, outputCol="_scaled", withMean=True, withStd=True))
        cur = "_scaled"
    if kbest:
        stages.append(ml_kbest(cur, est.getLabelCol(), "_selected", kbest))
        cur = "_selected"
    est.setFeaturesCol(cur)
    stages.append(est)
    return Pipeline(stages=stages)


def positive_probability(pred: DataFrame) -> DataFrame:
    """Adds ``score`` = P(class 1) (``rawPrediction`` margin for SVMs)."""
    if "probability" in pred.columns:
        return pred.withColumn("score", vector_to_array("probability")[1])
    return pred.withColumn("score", vector_to_array("rawPrediction")[1])


def fit_predict(train: DataFrame, test: DataFrame, pipe: Pipeline, keep: Sequence[str]) -> DataFrame:
    model = pipe.fit(train)
    pred = positive_probability(model.transform(test))
    return pred.select(*keep, "score", F.col("prediction").cast("int").alias("prediction"))


def metrics_row(pred: DataFrame, label: str = "label") -> DataFrame:
    """accuracy, precision, recall and F1 of the positive class and exact AUC of a prediction table (one row)."""
    acc = E.positive_scores(pred, label, "prediction")
    auc = E.roc_auc(pred, label, "score")
    return _side_by_side(acc, auc)


def _side_by_side(a: DataFrame, b: DataFrame) -> DataFrame:
    """Combine two one-row frames column-wise (one struct scalar, no join)."""
    from strata.operators.quality import row_scalar
    s = row_scalar(b)
    return a.select("*", *[s[c].alias(c) for c in b.columns])


def cross_validate(df: DataFrame, pipe: Pipeline, fold_col: str = "fold", k: int = 5,
                   label: str = "label") -> DataFrame:
    """Per-fold metrics ``(fold, accuracy, precision, recall, f1, auc)``:
    fit on the other folds, score the held-out fold."""
    rows = None
    for f in range(k):
        train = df.where(F.col(fold_col) != f)
        test = df.where(F.col(fold_col) == f)
        model = pipe.fit(train)
        pred = positive_probability(model.transform(test)) \
            .withColumn("prediction", F.col("prediction").cast("int"))
        m = metrics_row(pred, label).select(F.lit(f).alias("fold"), "*")
        rows = m if rows is None else rows.unionByName(m)
    return rows


def cv_summary(per_fold: DataFrame, digits: int = 6) -> DataFrame:
    """mean and std per metric from ``cross_validate`` output."""
    metrics = [c for c in per_fold.columns if c != "fold"]
    long = per_fold.select(F.explode(F.array(*[
        F.struct(F.lit(m).alias("metric"), F.col(m).cast("double").alias("v")) for m in metrics])).alias("s")) \
        .select("s.*")
    return long.groupBy("metric").agg(round_half_up(F.avg("v"), digits).alias("mean"),
                                      round_half_up(F.stddev_samp("v"), digits).alias("std"))


def grid_search(df: DataFrame, pipe: Pipeline, est, grid: dict, fold_col: str = "fold",
                parallelism: int = 2, sample: int | None = None, seed: int = 42,
                num_folds: int = 5) -> DataFrame:
    """Exhaustive (or seeded random subset of) grid with k-fold CV on the
    fold column; returns ``(params, mean_auc, rank)`` ranked by score."""
    names = list(grid)
    combos = list(itertools.product(*[grid[n] for n in names]))
    if sample is not None and sample < len(combos):
        combos = random.Random(seed).sample(combos, sample)
    maps = [{est.getParam(n): v for n, v in zip(names, combo)} for combo in combos]
    cv = CrossValidator(estimator=pipe, estimatorParamMaps=maps,
                        evaluator=BinaryClassificationEvaluator(labelCol=est.getLabelCol(), numBins=0),
                        foldCol=fold_col, numFolds=num_folds, parallelism=parallelism, seed=seed)
    model = cv.fit(df)
    spark = df.sparkSession
    rows = [(json.dumps({n: v for n, v in zip(names, combo)}, sort_keys=True), float(s))
            for combo, s in zip(combos, model.avgMetrics)]
    table = spark.createDataFrame(rows, "params string, mean_auc double")
    w = Window.orderBy(F.col("mean_auc").desc(), F.col("params"))
    return table.withColumn("rank", F.rank().over(w))


def feature_importance(tree_model, names: Sequence[str]) -> list[tuple[str, float]]:
    imp = tree_model.featureImportances.toArray()
    return sorted(zip(names, [float(x) for x in imp]), key=lambda t: -t[1])


def linear_contributions(df: DataFrame, cols: Sequence[str], coefs: Sequence[float], key: str,
                         top: int = 10, digits: int = 4, mean: Sequence[float] | None = None,
                         std: Sequence[float] | None = None) -> DataFrame:
    """Exact per-row contributions of a linear model on standardised inputs:
    ``coef_j * (x_j - mean_j) / std_j``; the ``top`` largest |contribution|
    per row with their direction.  ``mean`` and ``std`` are those of the scaler
    that was fitted with the model; without them ``df`` is taken to be the rows
    the model was fitted on.  The per-row ranking window holds one row per
    feature (bounded)."""
    from strata.operators.quality import row_scalar
    if (mean is None) != (std is None):
        raise ValueError("give both mean and std, or none")
    if mean is None:
        st = row_scalar(df.agg(*[x for i, c in enumerate(cols) for x in (
            F.avg(c).alias(f"m{i}"), F.stddev_samp(c).alias(f"s{i}"))]))
        scale = [(st[f"m{i}"], F.when(st[f"s{i}"] != 0, st[f"s{i}"]).otherwise(1.0)) for i in range(len(cols))]
    else:
        scale = [(F.lit(float(m)), F.lit(float(s) or 1.0)) for m, s in zip(mean, std)]
    contribs = [F.struct(F.lit(c).alias("feature"), (F.lit(float(w)) * (F.col(c) - m) / s).alias("value"))
                for c, w, (m, s) in zip(cols, coefs, scale)]
    long = df.select(key, F.explode(F.array(*contribs)).alias("s")).select(key, "s.*")
    w = Window.partitionBy(key).orderBy(F.abs("value").desc(), "feature")
    return (long.withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= top)
            .select(key, "rank", "feature", round_half_up("value", digits).alias("shap_value"),
                    F.when(F.col("value") > 0, "increases_risk").otherwise("decreases_risk").alias("direction")))


def mean_abs_contribution(contrib: DataFrame, digits: int = 6) -> DataFrame:
    """Global importance: mean |contribution| per feature (SHAP summary bar)."""
    return contrib.groupBy("feature").agg(round_half_up(F.avg(F.abs("shap_value")), digits).alias("mean_abs"))


def logit_inference(df: DataFrame, cols: Sequence[str], label: str) -> DataFrame:
    """Binomial GLM: coefficient, standard error, z and p-value per term."""
    data = VectorAssembler(inputCols=list(cols), outputCol="_x").transform(df)
    glm = GeneralizedLinearRegression(family="binomial", link="logit", featuresCol="_x",
                                      labelCol=label, maxIter=50)
    m = glm.fit(data)
    s = m.summary
    names = list(cols) + ["intercept"]
    coefs = list(m.coefficients) + [m.intercept]
    rows = [(n, float(c), float(se), float(t), float(p)) for n, c, se, t, p in
            zip(names, coefs, s.coefficientStandardErrors, s.tValues, s.pValues)]
    return df.sparkSession.createDataFrame(rows, "term string, coef double, std_err double, z double, p_value double")


def save_model(model: PipelineModel, path: str, metadata: dict, spark: SparkSession) -> None:
    """Persist the fitted pipeline and a one-row JSON metadata table."""
    model.write().overwrite().save(f"{path}/pipeline")
    spark.createDataFrame([(json.dumps(metadata, sort_keys=True),)], "metadata string") \
        .coalesce(1).write.mode("overwrite").json(f"{path}/metadata")


def load_model(path: str, spark: SparkSession) -> tuple[PipelineModel, dict]:
    model = PipelineModel.load(f"{path}/pipeline")
    meta = json.loads(spark.read.json(f"{path}/metadata").first()["metadata"])
    return model, meta


def sampled_shapley(model, df: DataFrame, cols: Sequence[str], key: str, n_perm: int = 8,
                    seed: int = 42, top: int = 10, digits: int = 4, baseline: dict | None = None) -> DataFrame:
    """Monte-Carlo Shapley contributions for any fitted pipeline (trees
    included) on the positive-class probability.

    For each row and each of ``n_perm`` seeded feature permutations, the
    features are switched from the baseline (column means) to the row's
    values one at a time in permutation order; the change of the model's
    probability at each step is credited to the switched feature, and the
    credits are averaged over permutations.  Everything is one Spark job:
    rows are exploded into ``n_perm x (d + 1)`` hybrid rows, scored by one
    ``transform``, and differenced with a window over ``(row, permutation)``
    (d + 1 rows per window: bounded).  Contributions of a row sum exactly to
    ``f(x) - f(baseline)``."""
    cols = list(cols)
    d = len(cols)
    rnd = random.Random(seed)
    perms = [rnd.sample(range(d), d) for _ in range(n_perm)]
    if baseline is None:
        from strata.operators.quality import row_scalar
        base = row_scalar(df.agg(*[F.avg(c).alias(c) for c in cols]))
        base_of = {c: base[c] for c in cols}
    else:
        base_of = {c: F.lit(float(v)) for c, v in baseline.items()}
    # position of every feature in every permutation, as literal arrays
    pos = [[p.index(j) for j in range(d)] for p in perms]
    steps = F.explode(F.arrays_zip(
        F.flatten(F.array(*[F.array_repeat(F.lit(pi), d + 1) for pi in range(n_perm)])).alias("perm"),
        F.flatten(F.array(*[F.sequence(F.lit(0), F.lit(d)) for _ in range(n_perm)])).alias("step")))
    hyb = df.select(key, *cols, steps.alias("_s")).select(key, *cols, "_s.perm", "_s.step")
    pos_arr = F.array(*[F.array(*[F.lit(v) for v in row]) for row in pos])
    mixed = [F.when(F.element_at(F.element_at(pos_arr, F.col("perm") + 1), j + 1) < F.col("step"), F.col(c))
             .otherwise(base_of[c]).alias(c) for j, c in enumerate(cols)]
    hyb = hyb.select(key, "perm", "step", *mixed)
    scored = positive_probability(model.transform(hyb)).select(key, "perm", "step", "score")
    w = Window.partitionBy(key, "perm").orderBy("step")
    perm_arr = F.array(*[F.array(*[F.lit(cols[j]) for j in p]) for p in perms])
    deltas = (scored.withColumn("delta", F.col("score") - F.lag("score").over(w))
              .where(F.col("step") > 0)
              .withColumn("feature", F.element_at(F.element_at(perm_arr, F.col("perm") + 1), F.col("step"))))
    contrib = deltas.groupBy(key, "feature").agg((F.sum("delta") / F.lit(float(n_perm))).alias("value"))
    wr = Window.partitionBy(key).orderBy(F.abs("value").desc(), "feature")
    return (contrib.withColumn("rank", F.row_number().over(wr)).where(F.col("rank") <= top)
            .select(key, "rank", "feature", round_half_up("value", digits).alias("shap_value"),
                    F.when(F.col("value") > 0, "increases_risk").otherwise("decreases_risk").alias("direction")))
