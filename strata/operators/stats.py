"""Statistics: correlations, moments, rank test, normality, histograms, KDE
(SURVEY §2.8)."""

from __future__ import annotations

import math
from collections.abc import Iterator, Sequence

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType

from strata.functions.numeric import round_half_up
from strata.operators.orderstats import prefix_sums
from strata.operators.quality import row_scalar


def _q(name: str) -> Column:
    return F.col(f"`{name}`")


_GRAM = ["n", "sx", "sy", "sxx", "syy", "sxy"]


def pair_sums(df: DataFrame, cols: Sequence[str]) -> DataFrame:
    """``i``, ``j`` (i <= j) and the sums of each pair of columns over the rows that have both, of values less
    ``mx``, ``my`` (the columns' means): ``n``, ``sx``, ``sy``, ``sxx``, ``syy``, ``sxy``.

    One pass after the means: a task multiplies blocks of rows with themselves and emits its upper triangle, so
    any number of columns is one aggregation of (columns squared / 2) rows per task."""
    wide = df.select(*[_q(c).cast("double").alias(f"c{k}") for k, c in enumerate(cols)])
    means = wide.agg(*[F.avg(F.when(~F.isnan(c), F.col(c))).alias(c) for c in wide.columns])
    at = np.array([0.0 if v is None else v for v in means.first()])       # one row, of the columns' number
    left, right = np.triu_indices(len(cols))

    def sums(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        total = np.zeros((6, len(left)))
        for pdf in batches:
            x = pdf.to_numpy(np.float64, na_value=np.nan) - at
            here = ~np.isnan(x)
            x, m = np.where(here, x, 0.0), here.astype(np.float64)
            square = x * x
            parts = (m.T @ m, x.T @ m, m.T @ x, square.T @ m, m.T @ square, x.T @ x)
            total += np.stack([p[left, right] for p in parts])
        yield pd.DataFrame({"i": left, "j": right, **dict(zip(_GRAM, total))}).astype({"i": "int32", "j": "int32"})

    schema = "i int, j int, " + ", ".join(f"{g} double" for g in _GRAM)
    found = wide.mapInPandas(sums, schema).groupBy("i", "j").agg(*[F.sum(g).alias(g) for g in _GRAM])
    mean = F.array(*[F.lit(float(v)) for v in at])
    return found.withColumns({"mx": F.get(mean, F.col("i")), "my": F.get(mean, F.col("j"))})


def corr_matrix(df: DataFrame, cols: Sequence[str], digits: int = 6) -> DataFrame:
    """Pearson matrix in long form ``(col_a, col_b, corr)`` over the rows that have both, from ``pair_sums``."""
    cov = F.col("sxy") - F.col("sx") * F.col("sy") / F.col("n")
    vx = F.col("sxx") - F.col("sx") * F.col("sx") / F.col("n")
    vy = F.col("syy") - F.col("sy") * F.col("sy") / F.col("n")
    # a spread that is rounding only is none
    flat = (vx <= 1e-14 * F.col("n") * F.col("mx") * F.col("mx")) | (vy <= 1e-14 * F.col("n") * F.col("my") * F.col("my"))
    one = pair_sums(df, cols).where("n > 0").select("i", "j", F.when(~flat & (vx > 0) & (vy > 0), round_half_up(
        F.when(F.col("i") == F.col("j"), F.lit(1.0)).otherwise(cov / F.sqrt(vx) / F.sqrt(vy)), digits)).alias("corr"))
    name = F.array(*[F.lit(c) for c in cols])
    both = one.select("i", "j", "corr").unionByName(one.where("i < j").select(F.col("j").alias("i"), F.col("i").alias("j"), "corr"))
    return both.select(F.get(name, F.col("i")).alias("col_a"), F.get(name, F.col("j")).alias("col_b"), "corr")


def corr_with_target(df: DataFrame, cols: Sequence[str], target: str, digits: int = 6) -> DataFrame:
    """``(feature, corr, abs_corr, rank)`` sorted by |corr| (rank 1 = strongest).
    The ranking window runs over one row per feature (bounded)."""
    one = df.agg(*[F.corr(_q(c).cast("double"), _q(target).cast("double")).alias(f"c{i}")
                   for i, c in enumerate(cols)])
    structs = [F.struct(F.lit(c).alias("feature"), round_half_up(F.col(f"c{i}"), digits).alias("corr"))
               for i, c in enumerate(cols)]
    long = one.select(F.explode(F.array(*structs)).alias("s")).select("s.*") \
        .withColumn("abs_corr", F.abs("corr"))
    w = Window.orderBy(F.col("abs_corr").desc_nulls_last(), F.col("feature"))
    return long.withColumn("rank", F.row_number().over(w))


def top_correlated(df: DataFrame, cols: Sequence[str], target: str, n: int = 6) -> DataFrame:
    return corr_with_target(df, cols, target).where(F.col("rank") <= n)


def factorize_codes(df: DataFrame, cols: Sequence[str], order_col: str) -> DataFrame:
    """First-appearance integer codes (``pd.factorize``): per column, values
    ordered by their first ``order_col`` get codes 0, 1, ...  The code table
    has one row per distinct value (a window over distinct levels only)."""
    lf = df.select(_q(order_col).alias("_o"), F.explode(F.array(*[
        F.struct(F.lit(c).alias("column"), _q(c).cast("string").alias("value")) for c in cols
    ])).alias("s")).select("_o", "s.*").where(F.col("value").isNotNull())
    first = lf.groupBy("column", "value").agg(F.min("_o").alias("_first"))
    # rank levels by first appearance; two-phase, so a high-cardinality column
    # is not ranked inside one task
    from strata.operators.sampling import rank_within
    order = F.struct(F.col("_first"), F.col("value"))
    return rank_within(first, "column", order, "code").select("column", "value", "code")


def factorize(df: DataFrame, cols: Sequence[str], order_col: str) -> DataFrame:
    """Replace each categorical column by its code (NULL -> -1)."""
    codes = factorize_codes(df, cols, order_col)
    out = df
    for c in cols:
        m = codes.where(F.col("column") == c).select(F.col("value").alias(f"_v_{c}"),
                                                     F.col("code").alias(f"_code_{c}"))
        out = (out.join(m, out[f"`{c}`"].cast("string") == m[f"_v_{c}"], "left")
               .withColumn(c, F.coalesce(F.col(f"_code_{c}"), F.lit(-1)))
               .drop(f"_v_{c}", f"_code_{c}"))
    return out


def moments(df: DataFrame, cols: Sequence[str], digits: int = 6) -> DataFrame:
    """n, mean, sample skewness and sample excess kurtosis (pandas ``skew`` /
    ``kurt``): Spark's population moments g1, g2 with the n-corrections
    ``G1 = g1 sqrt(n(n-1))/(n-2)``, ``G2 = ((n+1) g2 + 6)(n-1)/((n-2)(n-3))``."""
    one = df.agg(*[x for i, c in enumerate(cols) for x in (
        F.count(_q(c)).alias(f"n{i}"), F.avg(_q(c)).alias(f"m{i}"),
        F.skewness(_q(c)).alias(f"g1_{i}"), F.kurtosis(_q(c)).alias(f"g2_{i}"))])
    structs = []
    for i, c in enumerate(cols):
        n = F.col(f"n{i}").cast("double")
        g1, g2 = F.col(f"g1_{i}"), F.col(f"g2_{i}")
        skew = g1 * F.sqrt(n * (n - 1)) / (n - 2)
        kurt = ((n + 1) * g2 + 6) * (n - 1) / ((n - 2) * (n - 3))
        structs.append(F.struct(F.lit(c).alias("column"), F.col(f"n{i}").alias("n"),
                                round_half_up(F.col(f"m{i}"), digits).alias("mean"),
                                round_half_up(skew, digits).alias("skewness"),
                                round_half_up(kurt, digits).alias("kurtosis")))
    return one.select(F.explode(F.array(*structs)).alias("s")).select("s.*")


def jarque_bera(df: DataFrame, cols: Sequence[str], digits: int = 6, jb_digits: int = 2) -> DataFrame:
    """Normality test from one pass of moments: ``JB = n/6 (g1^2 + g2^2/4)``,
    p-value = chi-square(2) survival ``exp(-JB/2)``.  Replaces Shapiro-Wilk,
    which is a small-sample procedure with no distributed form."""
    one = df.agg(*[x for i, c in enumerate(cols) for x in (
        F.count(_q(c)).alias(f"n{i}"), F.skewness(_q(c)).alias(f"g1_{i}"),
        F.kurtosis(_q(c)).alias(f"g2_{i}"))])
    structs = []
    for i, c in enumerate(cols):
        n = F.col(f"n{i}").cast("double")
        jb = n / 6 * (F.col(f"g1_{i}") * F.col(f"g1_{i}") + F.col(f"g2_{i}") * F.col(f"g2_{i}") / 4)
        structs.append(F.struct(F.lit(c).alias("column"), F.col(f"n{i}").alias("n"),
                                round_half_up(jb, jb_digits).alias("jb"),
                                round_half_up(F.exp(-jb / 2), digits).alias("p_value")))
    return one.select(F.explode(F.array(*structs)).alias("s")).select("s.*")


@F.pandas_udf(DoubleType())
def _normal_two_sided_p(z: pd.Series) -> pd.Series:
    """Two-sided normal p-value ``erfc(|z|/sqrt 2)`` (vectorised helper; Spark
    has no erfc built-in)."""
    return z.map(lambda v: math.erfc(abs(v) / math.sqrt(2.0)) if v == v else float("nan"))


def mann_whitney_u(df: DataFrame, value_col: str, group_col: str, group_a, group_b,
                   with_p: bool = True) -> DataFrame:
    """Two-sided Mann-Whitney U with tie correction and continuity correction
    (normal approximation).  Average ranks come from the value-count table
    with two-phase prefix sums, so no group is ranked inside one task.

    Output: n1, n2, u (statistic of group_a), z[, p_value]."""
    data = df.where(_q(group_col).isin(group_a, group_b)) \
        .select(_q(value_col).alias("v"), (_q(group_col) == F.lit(group_a)).cast("int").alias("a"))
    per_value = data.where(F.col("v").isNotNull()).groupBy("v").agg(
        F.count(F.lit(1)).alias("t"), F.sum("a").alias("ta"))
    rc = _rank_table(per_value)
    one = rc.agg(
        F.sum("ta").alias("n1"), F.sum(F.col("t") - F.col("ta")).alias("n2"),
        F.sum(F.col("ta") * F.col("avg_rank")).alias("r1"),
        F.sum(F.pow(F.col("t").cast("double"), F.lit(3.0)) - F.col("t")).alias("tie"))
    n1, n2 = F.col("n1").cast("double"), F.col("n2").cast("double")
    n = n1 + n2
    u1 = F.col("r1") - n1 * (n1 + 1) / 2
    mu = n1 * n2 / 2
    sigma = F.sqrt(n1 * n2 / 12 * ((n + 1) - F.col("tie") / (n * (n - 1))))
    u_big = F.greatest(u1, n1 * n2 - u1)
    z = (u_big - mu - F.lit(0.5)) / sigma
    out = one.select(F.col("n1"), F.col("n2"), round_half_up(u1, 6).alias("u"),
                     round_half_up(z, 6).alias("z"))
    if with_p:
        out = out.withColumn("p_value", _normal_two_sided_p(F.col("z")))
    return out


def _rank_table(per_value: DataFrame) -> DataFrame:
    """``(v, t, ta, avg_rank)`` where avg_rank is the 1-based average rank."""
    pref = prefix_sums(per_value, [], "v", ["t"])
    return pref.withColumn("avg_rank", (F.col("cum_t") - F.col("t")).cast("double")
                           + (F.col("t").cast("double") + 1) / 2)


def histogram(df: DataFrame, col: str, bins: int = 20, by: str | None = None) -> DataFrame:
    """Equal-width bins over [min, max] (numpy semantics: the maximum falls in
    the last bin).  ``(by?, bin, lo, hi, count)``; min/max form one scalar."""
    x = _q(col).cast("double")
    mm = row_scalar(df.agg(F.min(x).alias("lo"), F.max(x).alias("hi")))
    lo, hi = mm["lo"], mm["hi"]
    width = (hi - lo) / F.lit(float(bins))
    b = F.least(F.floor((x - lo) * F.lit(float(bins)) / (hi - lo)), F.lit(bins - 1)).cast("int")
    b = F.when(hi == lo, F.lit(0)).otherwise(b)
    keys = ([_q(by)] if by else []) + [b.alias("bin")]
    counts = df.where(x.isNotNull() & ~F.isnan(x)).groupBy(*keys).agg(F.count(F.lit(1)).alias("count"))
    return counts.select(*([by] if by else []), "bin",
                         round_half_up(lo + F.col("bin") * width, 6).alias("lo"),
                         round_half_up(lo + (F.col("bin") + 1) * width, 6).alias("hi"), "count")


def _hermite(n: int) -> list[list[float]]:
    """Coefficients, by power, of the probabilists' Hermite polynomials up to degree ``n``."""
    found = [[1.0], [0.0, 1.0]]
    for k in range(1, n):
        up, down = [0.0, *found[k]], [*found[k - 1], 0.0, 0.0]
        found.append([a - k * b for a, b in zip(up, down)])
    return found[:n + 1]


#: Bins per bandwidth and terms of the series: the relative error of a kernel value is below 16^-9 / sqrt(9!) < 3e-14.
KDE_BINS, KDE_TERMS = 8, 8


def kde_curve(df: DataFrame, col: str, grid_points: int = 50, digits: int = 8) -> DataFrame:
    """Gaussian KDE on an even grid over [min, max] with Scott's bandwidth
    ``h = std * n^(-1/5)`` (sample std).

    One aggregation puts values into bins of h / ``KDE_BINS`` and keeps each bin's moments t^k about its
    middle (in bandwidths); the kernel sums of a bin are then its Hermite series, exp(-(z - t)^2 / 2) =
    exp(-z^2 / 2) sum He_k(z) t^k / k!, of which ``KDE_TERMS`` + 1 terms are taken."""
    x = _q(col).cast("double")
    st = row_scalar(df.agg(F.min(x).alias("lo"), F.max(x).alias("hi"),
                           F.stddev_samp(x).alias("sd"), F.count(x).alias("n")))
    lo, hi, n = st["lo"], st["hi"], st["n"].cast("double")
    h = st["sd"] * F.pow(n, F.lit(-0.2))
    middle = lo + (F.col("_bin") + 0.5) * h / KDE_BINS
    binned = df.where(x.isNotNull()).select(x.alias("_v"), F.floor((x - lo) / h * KDE_BINS).alias("_bin"))
    t = (F.col("_v") - middle) / h
    bins = binned.groupBy("_bin").agg(*[F.sum(F.pow(t, F.lit(float(k))) if k else F.lit(1.0)).alias(f"_m{k}")
                                        for k in range(KDE_TERMS + 1)])
    at = bins.select("*", F.explode(F.sequence(F.lit(0), F.lit(grid_points - 1))).alias("gi"))
    gx = lo + (hi - lo) * F.col("gi").cast("double") / F.lit(float(grid_points - 1))
    at = at.withColumn("_z", (gx - middle) / h)
    terms = F.lit(0.0)
    for k, coefficients in enumerate(_hermite(KDE_TERMS)):
        value = F.lit(0.0)
        for c in reversed(coefficients):
            value = value * F.col("_z") + F.lit(c)
        terms = terms + value * F.col(f"_m{k}") / F.lit(float(math.factorial(k)))
    dens = at.groupBy("gi").agg(F.sum(F.exp(-F.col("_z") * F.col("_z") / 2) * terms).alias("_s"))
    return dens.select(F.col("gi").alias("point"), round_half_up(gx, digits).alias("x"),
                       round_half_up(F.col("_s") / (n * h * F.lit(math.sqrt(2 * math.pi))), digits)
                       .alias("density"))


def ks_normality(df: DataFrame, col: str, digits: int = 6) -> DataFrame:
    """One-sample Kolmogorov-Smirnov test against a normal with the column's
    own mean and sample std (``pyspark.ml.stat.KolmogorovSmirnovTest``: the
    empirical CDF is computed distributedly)."""
    from pyspark.ml.stat import KolmogorovSmirnovTest
    x = F.col(f"`{col}`").cast("double")
    data = df.select(x.alias("_x")).where(F.col("_x").isNotNull())
    m = data.agg(F.avg("_x").alias("m"), F.stddev_samp("_x").alias("s")).first()
    r = KolmogorovSmirnovTest.test(data, "_x", "norm", float(m["m"]), float(m["s"]))
    return r.select(F.lit(col).alias("column"), round_half_up("statistic", digits).alias("ks_statistic"),
                    round_half_up("pValue", digits).alias("p_value"))
