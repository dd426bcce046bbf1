"""Exact Shapley contributions of a fitted tree ensemble.

The node table of the ensemble gives, for every leaf, the features that its path splits on; of each the
interval of values that leads to the leaf, and the share of training rows that follow the path's splits on
it (path-dependent weights).  A leaf's contribution to a feature is its value times the feature's weight in
all orders of the path's features, a sum over subsets that a polynomial product gives
in (features on the path)^2 steps.  Contributions of a row add up to the model's margin less its mean
over the training rows.

A model's node table is bounded by its size (trees x 2^depth), and goes to the tasks as it is; rows are
worked on in the partitions they lie in.
"""

from __future__ import annotations

import math
from collections.abc import Iterator, Sequence
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.ml import PipelineModel
from pyspark.ml.functions import vector_to_array
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from strata.functions.numeric import round_half_up


@dataclass
class Leaf:
    """A leaf: its weighted value, and per feature on its path: index, interval (low, high], allowed values, share."""

    value: float
    path: list[tuple[int, float, float, frozenset | None, float]]


def leaves(spark: SparkSession, ensemble, folder: str) -> list[Leaf]:
    """Leaves of a fitted tree ensemble (regression trees with weights), read from its saved node table."""
    ensemble.write().overwrite().save(folder)
    table = spark.read.parquet(f"{folder}/data").select("treeID", "nodeData.*")
    trees: dict[int, dict] = {}
    for r in table.collect():                       # the size of the model
        trees.setdefault(r["treeID"], {})[r["id"]] = r
    found = []

    def descend(nodes: dict, node, weight: float, known: dict) -> None:
        if node["leftChild"] < 0:
            found.append(Leaf(weight * node["prediction"], [(f, *v) for f, v in sorted(known.items())]))
            return
        f, split = node["split"]["featureIndex"], list(node["split"]["leftCategoriesOrThreshold"])
        low, high, allowed, share = known.get(f, (-math.inf, math.inf, None, 1.0))
        for child, is_left in ((nodes[node["leftChild"]], True), (nodes[node["rightChild"]], False)):
            if node["split"]["numCategories"] < 0:
                bounds = (low, min(high, split[0]), allowed) if is_left else (max(low, split[0]), high, allowed)
            else:
                every = frozenset(map(float, range(node["split"]["numCategories"]))) if allowed is None else allowed
                bounds = (low, high, every & set(split) if is_left else every - set(split))
            descend(nodes, child, weight, known | {f: (*bounds, share * child["rawCount"] / node["rawCount"])})

    for tree, weight in enumerate(ensemble.treeWeights):
        descend(trees[tree], trees[tree][0], float(weight), {})
    return found


def base_value(table: Sequence[Leaf]) -> float:
    """Mean margin over the rows that the trees were grown on."""
    return float(sum(leaf.value * math.prod(p[4] for p in leaf.path) for leaf in table))


def contributions(x: np.ndarray, table: Sequence[Leaf]) -> np.ndarray:
    """Contribution of every feature (column) to the margin of every row of ``x``."""
    out = np.zeros(x.shape)
    for leaf in table:
        m = len(leaf.path)
        follows = np.empty((m, len(x)))
        for k, (f, low, high, allowed, _) in enumerate(leaf.path):
            inside = (x[:, f] > low) & (x[:, f] <= high)
            follows[k] = inside if allowed is None else inside & np.isin(x[:, f], sorted(allowed))
        weight = [math.factorial(s) * math.factorial(m - 1 - s) / math.factorial(m) for s in range(m)]
        for k, (f, *_, share) in enumerate(leaf.path):
            # coefficient of t^s in the product over the others of (share + follows t): subsets of s followed ones
            poly = np.zeros((m, len(x)))
            poly[0] = 1.0
            for j, other in enumerate(leaf.path):
                if j != k:
                    up = poly * follows[j]
                    poly = poly * other[4]
                    poly[1:] += up[:-1]
            out[:, f] += leaf.value * (follows[k] - share) * np.tensordot(weight, poly, 1)
    return out


def tree_contributions(model: PipelineModel, df: DataFrame, names: Sequence[str], key: str, folder: str,
                       top: int = 10, digits: int = 4) -> DataFrame:
    """Per row the ``top`` largest contributions to the margin of a pipeline that ends in a boosted ensemble:
    ``(key, rank, feature, shap_value, direction)``.  ``names``: the feature of each slot of the ensemble's input;
    slots of one name (the dummies of a column) are added up.  ``folder``: a shared folder for the node table."""
    ensemble = model.stages[-1]
    table = leaves(df.sparkSession, ensemble, folder)
    every = sorted(set(names))
    slot = np.array([every.index(n) for n in names])

    def explain(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            if len(pdf):
                found = contributions(np.stack(pdf["x"].to_numpy()), table)
                summed = np.zeros((len(pdf), len(every)))
                np.add.at(summed.T, slot, found.T)
                yield pd.DataFrame({key: np.repeat(pdf[key].to_numpy(), len(every)), "feature": every * len(pdf), "value": summed.ravel()})

    rows = model.transform(df).select(key, vector_to_array(ensemble.getFeaturesCol()).alias("x"))
    kind = df.schema[key].dataType.simpleString()
    long = rows.mapInPandas(explain, f"`{key}` {kind}, feature string, value double")
    w = Window.partitionBy(key).orderBy(F.abs("value").desc(), "feature")      # one row per feature
    return (long.withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= top)
            .select(key, "rank", "feature", round_half_up("value", digits).alias("shap_value"),
                    F.when(F.col("value") > 0, "increases_risk").otherwise("decreases_risk").alias("direction")))
