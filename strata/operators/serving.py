"""From training to serving: one operator fits, chooses the threshold and describes the model,
another one scores with what was stored."""

from __future__ import annotations

import json
from collections.abc import Sequence
from datetime import datetime, timezone

from pyspark.ml import PipelineModel
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from strata.operators import evaluate as E
from strata.operators import models as M
from strata.operators.features import one_hot, with_class_weight
from strata.session import cut_lineage


def prepare_training(df: DataFrame, label: str, positive, drop: Sequence[str] = (), level_map: dict | None = None) -> DataFrame:
    """Features and 0/1 ``label`` in one step: ``drop`` and the source of the label go, text columns become dummies
    without their first level, the rest are doubles (null or not a number: 0)."""
    kept = [f for f in df.schema if f.name not in (*drop, label)]
    texts = [f.name for f in kept if f.dataType.simpleString() == "string"]
    numbers = [F.coalesce(F.nanvl(F.col(f"`{f.name}`").cast("double"), F.lit(0.0)), F.lit(0.0)).alias(f.name)
               for f in kept if f.name not in texts]
    target = F.when(F.col(f"`{label}`") == F.lit(positive), 1).otherwise(0).alias("label")
    return one_hot(df.select(*numbers, *[F.col(f"`{t}`") for t in texts], target), texts, drop_first=True, level_map=level_map)


def train_served(data: DataFrame, numeric: Sequence[str], categorical: Sequence[str], kind: str = "xgboost",
                 params: dict | None = None, folds: int = 5, cost_fn: float = E.COST_FN, cost_fp: float = E.COST_FP) -> tuple[PipelineModel, dict]:
    """Fit on the rows that aren't ``is_test`` with balanced class weights, and describe the model.

    ``data``: features, ``label`` (0/1), ``is_test`` and ``fold``.  The metadata has the threshold of least cost on the
    held-out rows with its costs, metrics of the positive class by cross-validation and on the held-out rows at
    that threshold, sizes, class shares, features and the time.  ``folds`` = 0 leaves out the cross-validation."""
    params = dict(params or {})
    train, test = cut_lineage(with_class_weight(data.where(~F.col("is_test")), "label")), data.where("is_test")
    est = M.estimator(kind, n_rows=train.count(), weight_col="weight", **params)
    pipe = M.build_pipeline(numeric, categorical, est, scale=True, impute=True)
    cv = {r["metric"]: r["mean"] for r in M.cv_summary(M.cross_validate(train, pipe, "fold", folds)).collect()} if folds else {}
    model = pipe.fit(train)
    held = cut_lineage(M.positive_probability(model.transform(test)).select("label", "score"))
    cost = E.cost_threshold(held, cost_fn=cost_fn, cost_fp=cost_fp).first().asDict()       # one row
    decided = held.withColumn("prediction", (F.col("score") >= cost["threshold"]).cast("int"))
    sizes = {t: (r["n"], r["p"]) for t, r in ((r["is_test"], r) for r in data.groupBy("is_test").agg(
        F.count("*").alias("n"), F.avg("label").alias("p")).collect())}                    # two rows
    meta = {"model_type": kind, "params": params, "feature_names": [*numeric, *categorical], "n_features": len(numeric) + len(categorical),
            "cv_metrics": cv, "holdout_metrics": M.metrics_row(decided).first().asDict(), "optimal_threshold": cost.pop("threshold"),
            "cost_assumptions": {"cost_fn": cost_fn, "cost_fp": cost_fp}, "cost_detail": cost,
            "trained_at": datetime.now(timezone.utc).isoformat(),
            "train_size": sizes.get(False, (0, None))[0], "test_size": sizes.get(True, (0, None))[0],
            "class_distribution": {"train_positive": sizes.get(False, (0, None))[1], "test_positive": sizes.get(True, (0, None))[1]}}
    return model, json.loads(json.dumps(meta, default=float))


def serve(model: PipelineModel, meta: dict, df: DataFrame, keep: Sequence[str]) -> DataFrame:
    """``batch_score`` of the rows by a stored model at its own stored threshold."""
    scored = M.positive_probability(model.transform(df))
    return E.batch_score(scored, float(meta["optimal_threshold"]), "score", keep=tuple(keep))
