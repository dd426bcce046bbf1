"""Feature engineering: dummies, scaling, ANOVA F selection,
PCA, minority oversampling (SMOTE) and class weights.

Column-level transforms (dummies, scaling) are plain projections with the
statistics read from one aggregation; ``ml_*`` helpers return the equivalent
Spark ML stages for use inside a ``Pipeline`` (fitted on training rows only).
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.ml import Pipeline
from pyspark.ml.feature import (OneHotEncoder, PCA, StandardScaler, StringIndexer,
                                UnivariateFeatureSelector, VectorAssembler)
from pyspark.ml.functions import vector_to_array
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from strata.functions.numeric import round_half_up
from strata.operators.quality import row_scalar

MAX_LEVELS = 1000


def _q(name: str) -> Column:
    return F.col(f"`{name}`")


def levels(df: DataFrame, col: str, max_levels: int = MAX_LEVELS) -> list:
    """Sorted distinct non-null levels of a categorical column (a bounded
    result: fails above ``max_levels`` instead of pulling an id column)."""
    rows = (df.select(_q(col)).where(_q(col).isNotNull()).distinct()
            .orderBy(_q(col)).limit(max_levels + 1).collect())
    if len(rows) > max_levels:
        raise ValueError(f"{col}: more than {max_levels} levels")
    return [r[0] for r in rows]


def one_hot(df: DataFrame, cols: Sequence[str], drop_first: bool = False,
            level_map: dict | None = None, prefix_sep: str = "_") -> DataFrame:
    """``pd.get_dummies``: one 0/1 double column per level (levels sorted);
    ``drop_first`` drops the alphabetically first level.  NULL -> all zeros."""
    level_map = dict(level_map or {})
    out_cols = [_q(c) for c in df.columns if c not in cols]
    for c in cols:
        lv = level_map.get(c) or levels(df, c)
        if drop_first:
            lv = lv[1:]
        out_cols += [F.when(_q(c) == F.lit(v), 1.0).otherwise(0.0).alias(f"{c}{prefix_sep}{v}") for v in lv]
    return df.select(*out_cols)


def level_codes(df: DataFrame, cols: Sequence[str]) -> DataFrame:
    """``column``, ``value``, ``code``: the non-null levels of categorical columns (as text), numbered from 0 in
    their order within each column.  Any number of levels; none is sorted in one task."""
    from strata.operators.sampling import rank_within
    values = F.explode(F.array(*[F.struct(F.lit(c).alias("column"), _q(c).cast("string").alias("value")) for c in cols]))
    found = df.select(values.alias("s")).select("s.*").where(F.col("value").isNotNull()).distinct()
    return rank_within(found, "column", "value", "code").select("column", "value", "code")


def one_hot_sparse(df: DataFrame, cols: Sequence[str], key: str, drop_first: bool = False,
                   codes: DataFrame | None = None) -> DataFrame:
    """One-hot encoding for any number of levels: per ``key`` (unique) the ``slots`` that are 1, ascending.

    The slots of a column follow those of the column before, in the order of ``cols``; ``drop_first`` leaves
    out each column's first level.  Null and unknown levels have no slot.  ``codes``: ``level_codes`` of the
    training rows (default: of ``df``)."""
    codes = level_codes(df, cols) if codes is None else codes
    skip = int(drop_first)
    place = F.array_position(F.array(*[F.lit(c) for c in cols]), F.col("column"))
    sizes = codes.groupBy("column").agg((F.max("code") + 1 - skip).alias("_size"))      # one row per column
    w = Window.orderBy(place).rowsBetween(Window.unboundedPreceding, -1)
    begin = sizes.select("column", F.coalesce(F.sum("_size").over(w), F.lit(0)).alias("_begin"))
    slots = codes.where(F.col("code") >= skip).join(F.broadcast(begin), "column").select(
        "column", "value", (F.col("_begin") + F.col("code") - skip).alias("slot"))
    values = F.explode(F.array(*[F.struct(F.lit(c).alias("column"), _q(c).cast("string").alias("value")) for c in cols]))
    cells = df.select(_q(key).alias(key), values.alias("s")).select(key, "s.*").join(slots, ["column", "value"])
    found = cells.groupBy(key).agg(F.array_sort(F.collect_list("slot")).alias("slots"))     # at most one per column
    return df.select(_q(key).alias(key)).join(found, key, "left").select(
        key, F.coalesce("slots", F.array().cast("array<bigint>")).alias("slots"))


def ml_one_hot_stages(cols: Sequence[str], drop_first: bool = False) -> list:
    """StringIndexer + OneHotEncoder.  ``dropLast`` drops the *last* index, so
    for drop-first semantics the levels are indexed in descending order."""
    order = "alphabetDesc" if drop_first else "alphabetAsc"
    # no "keep" bucket: with one, dropLast would drop the invalid bucket instead
    idx = [StringIndexer(inputCol=c, outputCol=f"{c}__idx", stringOrderType=order,
                         handleInvalid="error") for c in cols]
    enc = OneHotEncoder(inputCols=[f"{c}__idx" for c in cols], outputCols=[f"{c}__ohe" for c in cols],
                        dropLast=drop_first, handleInvalid="error")
    return idx + [enc]


def standard_scale(df: DataFrame, cols: Sequence[str], digits: int | None = 6) -> DataFrame:
    """``(x - mean) / population std`` per column (scikit-learn semantics;
    Spark's ``StandardScaler`` divides by the sample std).  Statistics are one
    aggregation read back as a single struct scalar."""
    st = row_scalar(df.agg(*[x for i, c in enumerate(cols) for x in (
        F.avg(_q(c)).alias(f"m{i}"), F.stddev_pop(_q(c)).alias(f"s{i}"))]))
    out = []
    for c in df.columns:
        if c in cols:
            i = list(cols).index(c)
            z = (_q(c) - st[f"m{i}"]) / F.when(st[f"s{i}"] != 0, st[f"s{i}"]).otherwise(F.lit(1.0))
            out.append((round_half_up(z, digits) if digits is not None else z).alias(c))
        else:
            out.append(_q(c))
    return df.select(*out)


def ml_standard_scaler(input_col: str, output_col: str) -> StandardScaler:
    return StandardScaler(inputCol=input_col, outputCol=output_col, withMean=True, withStd=True)


def anova_f(df: DataFrame, cols: Sequence[str], label: str, digits: int = 6) -> DataFrame:
    """ANOVA F statistic per feature (``f_classif``) from per-class count,
    sum and sum of squares - one long-form aggregation.

    ``F = (SSB / (k-1)) / (SSW / (n-k))`` with ``SSW = SST - SSB``.
    Output ``(feature, f_score, rank)``; the rank window sees one row per
    feature."""
    lf = df.select(_q(label).alias("_y"), F.explode(F.array(*[
        F.struct(F.lit(c).alias("feature"), _q(c).cast("double").alias("x")) for c in cols
    ])).alias("s")).select("_y", "s.*").where(F.col("x").isNotNull())
    per = lf.groupBy("feature", "_y").agg(F.count(F.lit(1)).alias("n"), F.sum("x").alias("s"),
                                          F.sum(F.col("x") * F.col("x")).alias("ss"))
    tot = per.groupBy("feature").agg(
        F.sum("n").alias("N"), F.sum("s").alias("S"), F.sum("ss").alias("SS"),
        F.count(F.lit(1)).alias("k"), F.sum(F.col("s") * F.col("s") / F.col("n")).alias("B"))
    sst = F.col("SS") - F.col("S") * F.col("S") / F.col("N")
    ssb = F.col("B") - F.col("S") * F.col("S") / F.col("N")
    ssw = sst - ssb
    f = (ssb / (F.col("k") - 1)) / (ssw / (F.col("N") - F.col("k")))
    res = tot.select("feature", round_half_up(f, digits).alias("f_score"))
    w = Window.orderBy(F.col("f_score").desc_nulls_last(), F.col("feature"))
    return res.withColumn("rank", F.row_number().over(w))


def select_k_best(df: DataFrame, cols: Sequence[str], label: str, k: int = 10) -> DataFrame:
    return anova_f(df, cols, label).where(F.col("rank") <= k)


def ml_kbest(features_col: str, label: str, output_col: str, k: int) -> UnivariateFeatureSelector:
    """Fitted-stage form of SelectKBest(f_classif) for continuous features."""
    return (UnivariateFeatureSelector(featuresCol=features_col, labelCol=label, outputCol=output_col,
                                      selectionMode="numTopFeatures")
            .setFeatureType("continuous").setLabelType("categorical").setSelectionThreshold(k))


def assemble(df: DataFrame, cols: Sequence[str], output_col: str = "features") -> DataFrame:
    return VectorAssembler(inputCols=list(cols), outputCol=output_col, handleInvalid="keep").transform(df)


def pca_fit(df: DataFrame, cols: Sequence[str], k: int):
    """PCA on *centred* features (``PCA.transform`` does not centre).
    Returns the fitted ``PipelineModel`` (assembler, centring scaler, PCA)."""
    pipe = Pipeline(stages=[
        VectorAssembler(inputCols=list(cols), outputCol="_raw", handleInvalid="skip"),
        StandardScaler(inputCol="_raw", outputCol="_centred", withMean=True, withStd=False),
        PCA(k=k, inputCol="_centred", outputCol="pca"),
    ])
    return pipe.fit(df)


def pca_project(df: DataFrame, cols: Sequence[str], k: int, keep: Sequence[str] = ()) -> DataFrame:
    """Rows projected on the first k principal components ``pc1..pck``
    (signs are arbitrary, as in every PCA)."""
    model = pca_fit(df, cols, k)
    arr = vector_to_array(F.col("pca"))
    return model.transform(df).select(*keep, *[arr[i].alias(f"pc{i + 1}") for i in range(k)])


def pca_explained(df: DataFrame, cols: Sequence[str], digits: int = 6) -> DataFrame:
    """Explained-variance ratio and cumulative ratio per component
    ``(component, ratio, cumulative)``; the covariance is a d×d aggregate."""
    model = pca_fit(df, cols, len(cols))
    ev = [float(v) for v in model.stages[-1].explainedVariance]
    spark = df.sparkSession
    rows, cum = [], 0.0
    for i, v in enumerate(ev):
        cum += v
        rows.append((i + 1, round(v, digits), round(cum, digits)))
    return spark.createDataFrame(rows, "component int, ratio double, cumulative double")


def pca_components_for(df: DataFrame, cols: Sequence[str], variance: float) -> int:
    """Smallest number of components whose cumulative ratio reaches ``variance``."""
    model = pca_fit(df, cols, len(cols))
    cum = 0.0
    for i, v in enumerate(model.stages[-1].explainedVariance):
        cum += float(v)
        if cum >= variance - 1e-12:
            return i + 1
    return len(cols)


def class_weights(df: DataFrame, label: str) -> DataFrame:
    """``balanced`` weights ``n / (classes * n_c)`` per class plus the
    ``scale_pos_weight`` ratio neg/pos for binary labels."""
    counts = df.groupBy(label).agg(F.count(F.lit(1)).alias("n_c"))
    tot = row_scalar(counts.agg(F.sum("n_c").alias("n"), F.count(F.lit(1)).alias("k"),
                                F.sum(F.when(F.col(label) == 1, F.col("n_c"))).alias("pos"),
                                F.sum(F.when(F.col(label) == 0, F.col("n_c"))).alias("neg")))
    return counts.select(label, "n_c",
                         round_half_up(tot["n"] / (tot["k"] * F.col("n_c")), 6).alias("weight"),
                         round_half_up(tot["neg"] / tot["pos"], 6).alias("scale_pos_weight"))


def with_class_weight(df: DataFrame, label: str, name: str = "weight") -> DataFrame:
    w = class_weights(df, label).select(label, F.col("weight").alias(name))
    return df.join(w, label)      # one row per class: AQE broadcasts it from its measured size


# ------------------------------------------------------------------- SMOTE

def smote(df: DataFrame, cols: Sequence[str], label: str, key: str, minority=1,
          k: int = 5, seed: int = 42) -> DataFrame:
    """Minority oversampling to parity (SMOTE, k neighbours).

    Each synthetic row interpolates a minority row towards one of its k
    nearest minority neighbours with a hash-seeded gap.  Neighbours come from
    ``retrieve.knn_points`` (cells that can hold a neighbour).  Output:
    original rows + synthetic rows with ``synthetic = true``; synthetic count =
    majority - minority.  A row with fewer than k neighbours draws among those it
    has; the only minority row is repeated.
    """
    from strata.operators.retrieve import knn_points
    counts = row_scalar(df.agg(
        F.count_if(F.col(label) == F.lit(minority)).alias("mino"),
        F.count_if(F.col(label) != F.lit(minority)).alias("majo")))
    mino = df.where(F.col(label) == F.lit(minority))
    pts = mino.select(F.col(key).alias("id"), F.array(*[_q(c).cast("double") for c in cols]).alias("v"))
    nn = knn_points(pts, pts, k=k, exclude_self=True)   # (qid, id, rank, dist)
    # how many synthetic rows each minority row generates: spread evenly by rank of the row
    need = counts["majo"] - counts["mino"]
    base = F.floor(need / counts["mino"])
    from strata.operators.sampling import hash_draw, rank_within
    ranked = rank_within(pts.withColumn("_g", F.lit(0)), "_g",
                         F.concat(hash_draw("id", seed), F.col("id").cast("string")), "_r")
    reps = ranked.select("id", "v", (base + F.when(F.col("_r") < need - base * counts["mino"], 1)
                                     .otherwise(0)).cast("int").alias("_reps"))
    expanded = reps.where(F.col("_reps") > 0).select(
        "id", "v", F.explode(F.sequence(F.lit(0), F.col("_reps") - 1)).alias("_j"))
    draw = F.conv(F.substring(F.md5(F.concat_ws("#", F.col("id").cast("string"), F.col("_j").cast("string"),
                                                F.lit(str(seed)))), 1, 8), 16, 10).cast("double")
    n_nb = nn.groupBy(F.col("qid").alias("id")).agg(F.count(F.lit(1)).alias("_n_nb"))
    expanded = expanded.join(n_nb, "id", "left") \
        .withColumn("_nb", (draw % F.coalesce("_n_nb", F.lit(1))).cast("int") + 1) \
        .withColumn("_gap", (draw / F.lit(float(16 ** 8))))
    pairs = expanded.join(nn.select(F.col("qid").alias("id"), F.col("id").alias("nid"),
                                    F.col("rank").alias("_nb")), ["id", "_nb"], "left")
    nv = pts.select(F.col("id").alias("nid"), F.col("v").alias("nv"))
    syn = pairs.join(nv, "nid", "left").withColumn("nv", F.coalesce("nv", "v")).select(
        F.concat(F.col("id").cast("string"), F.lit("-s"), F.col("_j").cast("string")).alias(key),
        F.zip_with("v", "nv", lambda a, b: a + (b - a) * F.col("_gap")).alias("_sv"))
    synthetic = syn.select(F.col(key), *[F.col("_sv")[i].alias(c) for i, c in enumerate(cols)],
                           F.lit(minority).alias(label), F.lit(True).alias("synthetic"))
    original = df.select(_q(key).cast("string").alias(key), *[_q(c).cast("double").alias(c) for c in cols],
                         _q(label), F.lit(False).alias("synthetic"))
    return original.unionByName(synthetic.withColumn(label, F.col(label).cast(df.schema[label].dataType)))
