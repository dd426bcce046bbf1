"""Clustering: k-means, elbow, silhouettes, grid DBSCAN,
cluster profiles.

Silhouettes use squared Euclidean distance (as ``ClusteringEvaluator``):
the mean squared distance from a point to every member of a cluster is
``|x|^2 - 2 x·mean_c + mean_c(|y|^2)``, so per-point silhouettes need only
the k cluster summaries (a bounded struct array read once as a scalar) and
never a pair of points.

DBSCAN itself is in ``density``.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.ml.clustering import KMeans
from pyspark.ml.feature import VectorAssembler
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from strata.functions.numeric import round_half_up
from strata.operators.density import density_clusters
from strata.operators.sampling import rank_within
from strata.session import cut_lineage


def kmeans(df: DataFrame, cols: Sequence[str], k: int, seed: int = 42, max_iter: int = 50,
           keep: Sequence[str] = ()):
    """Fit ``KMeans`` (k-means||) and return ``(model, assigned rows)``."""
    data = VectorAssembler(inputCols=list(cols), outputCol="_f", handleInvalid="skip").transform(df)
    model = KMeans(k=k, seed=seed, maxIter=max_iter, featuresCol="_f", predictionCol="cluster",
                   initMode="k-means||").fit(data)
    return model, model.transform(data).select(*keep, *cols, "cluster")


def total_variance(df: DataFrame, cols: Sequence[str]) -> float:
    """Inertia for k = 1: ``sum_j n * var_pop(x_j)`` (Spark KMeans rejects k=1)."""
    row = df.agg(*[(F.var_pop(c) * F.count(c)).alias(c) for c in cols]).first()
    return float(sum(row[c] or 0.0 for c in cols))


def elbow(df: DataFrame, cols: Sequence[str], ks: Sequence[int] = range(1, 10), seed: int = 42) -> DataFrame:
    rows = []
    for k in ks:
        if k == 1:
            rows.append((1, total_variance(df, cols)))
        else:
            model, _ = kmeans(df, cols, k, seed)
            rows.append((k, float(model.summary.trainingCost)))
    return df.sparkSession.createDataFrame(rows, "k int, inertia double")


def _summaries(assigned: DataFrame, cols: Sequence[str], cluster: str) -> DataFrame:
    sq = sum((F.col(c) * F.col(c) for c in cols), F.lit(0.0))
    return assigned.groupBy(cluster).agg(
        F.count(F.lit(1)).alias("n"), *[F.avg(c).alias(f"m_{c}") for c in cols],
        F.avg(sq).alias("msq"))


def silhouette_samples(assigned: DataFrame, cols: Sequence[str], cluster: str = "cluster",
                       key: str = "id", digits: int = 6) -> DataFrame:
    """Per-point silhouette (squared Euclidean) ``(key, cluster, silhouette)``.
    a = mean distance to the own cluster excluding the point itself,
    b = smallest mean distance to another cluster; singletons get 0."""
    summ = _summaries(assigned, cols, cluster)
    # the k summaries as one array in a one-row table, attached to every point
    # by an equi-join on a constant key (broadcast build side of one row;
    # higher-order functions cannot read a scalar subquery)
    one = summ.agg(F.collect_list(F.struct(F.col(cluster).alias("c"), "n", "msq",
                                           F.array(*[F.col(f"m_{c}") for c in cols]).alias("m")))
                   .alias("_arr")).withColumn("_k", F.lit(0))
    assigned = assigned.withColumn("_k", F.lit(0)).join(F.broadcast(one), "_k")
    arr = F.col("_arr")
    x = F.array(*[F.col(c).cast("double") for c in cols])
    xsq = sum((F.col(c) * F.col(c) for c in cols), F.lit(0.0))

    def mean_d(s):
        dot = F.aggregate(F.zip_with(x, s["m"], lambda a, b: a * b), F.lit(0.0), lambda acc, v: acc + v)
        return xsq - 2 * dot + s["msq"]

    own = F.filter(arr, lambda s: s["c"] == F.col(cluster))[0]
    # own-cluster mean over the other n-1 points: (n * mean_all - 0) / (n - 1)
    a = F.when(own["n"] > 1, mean_d(own) * own["n"] / (own["n"] - 1))
    others = F.transform(F.filter(arr, lambda s: s["c"] != F.col(cluster)), mean_d)
    b = F.array_min(others)
    sil = F.when(own["n"] <= 1, F.lit(0.0)).otherwise((b - a) / F.greatest(a, b))
    return assigned.select(key, cluster, round_half_up(sil, digits).alias("silhouette"))


def silhouette_score(assigned: DataFrame, cols: Sequence[str], cluster: str = "cluster",
                     key: str = "id") -> float:
    s = silhouette_samples(assigned, cols, cluster, key, digits=12)
    return float(s.agg(F.avg("silhouette")).first()[0])


def silhouette_select(df: DataFrame, cols: Sequence[str], ks: Sequence[int] = range(2, 9),
                      key: str = "id", seed: int = 42) -> DataFrame:
    """Mean silhouette for each k; ``best`` marks the maximum (ties: smaller k)."""
    rows = []
    for k in ks:
        _, assigned = kmeans(df, cols, k, seed, keep=[key])
        rows.append((k, silhouette_score(assigned, cols, "cluster", key)))
    best = max(rows, key=lambda r: (r[1], -r[0]))[0]
    return df.sparkSession.createDataFrame(
        [(k, round(s, 6), k == best) for k, s in rows], "k int, silhouette double, best boolean")


# ------------------------------------------------------------------ DBSCAN

def dbscan(df: DataFrame, x: str, y: str, key: str, eps: float, min_samples: int,
           max_iter: int | None = None) -> DataFrame:
    """DBSCAN on 2-D points (``density``); returns ``(key, cluster)`` with -1 for noise, which points without
    coordinates are too.  ``min_samples`` counts the point itself (scikit-learn semantics).  Labels spread until
    nothing changes; ``max_iter`` rounds without that are an error.  Clusters are numbered by their least core id."""
    found = density_clusters(df, x, y, key, [(eps, min_samples)], max_iter)
    roots = rank_within(found.where("root IS NOT NULL").select("root").distinct().withColumn("_g", F.lit(0)), "_g", "root", "cluster")
    places = found.join(roots.select("root", "cluster"), "root").select("x", "y", "cluster")
    rows = df.select(F.col(key), F.col(x).cast("double").alias("x"), F.col(y).cast("double").alias("y"))
    return rows.join(places, ["x", "y"], "left").select(key, F.coalesce("cluster", F.lit(-1)).cast("int").alias("cluster"))


def dbscan_sweep(df: DataFrame, x: str, y: str, key: str, eps: Sequence[float], min_samples: Sequence[int]) -> DataFrame:
    """Clusters and noise points of DBSCAN for every ``eps`` with every ``min_samples``, as ``dbscan`` finds
    them: ``(eps, min_samples, n_clusters, n_noise)``.  All settings go through the same joins."""
    settings = [(e, m) for e in eps for m in min_samples]
    found = density_clusters(df, x, y, key, settings)
    whole = df.select(F.count("*")).scalar()
    found = found.groupBy("s").agg(F.countDistinct("root").alias("c"), F.sum(F.when(F.col("root").isNotNull(), F.col("w"))).alias("w"))
    every = df.sparkSession.createDataFrame([(s, float(e), m) for s, (e, m) in enumerate(settings)], "s int, eps double, min_samples int")
    return every.join(found, "s", "left").select(
        "eps", "min_samples", F.coalesce("c", F.lit(0)).cast("int").alias("n_clusters"),
        (whole - F.coalesce("w", F.lit(0))).cast("int").alias("n_noise"))


def cluster_profile(assigned: DataFrame, cluster: str, label: str, cols: Sequence[str] = (),
                    digits: int = 6) -> DataFrame:
    """Size, label share and feature means per cluster."""
    return assigned.groupBy(cluster).agg(
        F.count(F.lit(1)).alias("size"),
        round_half_up(F.avg(F.col(label).cast("double")), digits).alias("label_rate"),
        *[round_half_up(F.avg(c), digits).alias(f"mean_{c}") for c in cols])
