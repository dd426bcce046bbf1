"""Data-quality operators and per-column summaries.

Per-column statistics are computed in *one* aggregation over all columns
(then ``unpivot``-ed to one row per column), never one job per column.
Order statistics (quartiles, medians, fences, winsor limits) come from
``orderstats`` on the long form ``(column, value)``: exact, and no column is
ever sorted inside a single task.
"""

from __future__ import annotations

import re
from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType, FloatType

from strata.functions.numeric import round_half_up
from strata.operators.orderstats import long_form, order_statistics, quantiles, value_count_table
from strata.operators.relational import numeric_columns


def _q(name: str) -> Column:
    return F.col(f"`{name}`")


def _is_missing(df: DataFrame, c: str) -> Column:
    """NULL, or NaN for floating columns (pandas conflates the two)."""
    t = df.schema[c].dataType
    m = _q(c).isNull()
    if isinstance(t, (DoubleType, FloatType)):
        m = m | F.isnan(_q(c))
    return m


def row_scalar(one_row: DataFrame) -> Column:
    """A one-row frame as a single struct-valued scalar subquery: executed
    once, its fields read with ``col[field]`` (no join, no repeated job)."""
    return one_row.select(F.struct(*one_row.columns).alias("s")).scalar()


def _stack(df_one_row: DataFrame, cols: Sequence[str], fields: Sequence[str],
           common: Sequence[str] = ()) -> DataFrame:
    """Turn a one-row frame with ``<field>__<i>`` columns into one row per
    column (``common`` columns are repeated on every row)."""
    structs = [F.struct(F.lit(c).alias("column"), *[F.col(x) for x in common],
                        *[F.col(f"{f}__{i}").alias(f) for f in fields]) for i, c in enumerate(cols)]
    return df_one_row.select(F.explode(F.array(*structs)).alias("s")).select("s.*")


def missing_pct(df: DataFrame, cols: Sequence[str] | None = None) -> DataFrame:
    """Percent missing per column: the fraction rounded to 4 digits, times 100."""
    cols = list(cols or df.columns)
    one = df.agg(*[F.avg(_is_missing(df, c).cast("double")).alias(f"m__{i}")
                   for i, c in enumerate(cols)])
    return _stack(one, cols, ["m"]).select(
        "column", (round_half_up("m", 4) * F.lit(100.0)).alias("missing_pct"))


def dropna_any(df: DataFrame, subset: Sequence[str] | None = None) -> DataFrame:
    cols = list(subset or df.columns)
    cond = F.lit(True)
    for c in cols:
        cond = cond & ~_is_missing(df, c)
    return df.where(cond)


def fillna_value(df: DataFrame, value, cols: Sequence[str] | None = None) -> DataFrame:
    cols = set(cols or df.columns)
    return df.select(*[
        F.when(_is_missing(df, c), F.lit(value)).otherwise(_q(c)).alias(c) if c in cols else _q(c)
        for c in df.columns])


def fillna_stat(df: DataFrame, cols: Sequence[str], strategy: str = "mean") -> DataFrame:
    """Impute with the column mean (one global agg) or exact median
    (``orderstats``).  The statistics are a single row, referenced as scalar
    subqueries (computed once, broadcast as literals)."""
    cols = list(cols)
    if strategy == "mean":
        stats = df.agg(*[F.avg(F.when(~_is_missing(df, c), _q(c))).alias(f"s{i}")
                         for i, c in enumerate(cols)])
    elif strategy == "median":
        lf = long_form(df, cols)
        med = quantiles(lf, "value", [0.5], ["column"], ["s"], few_groups=True)
        stats = med.agg(*[F.max(F.when(F.col("column") == c, F.col("s"))).alias(f"s{i}")
                          for i, c in enumerate(cols)])
    else:
        raise ValueError(strategy)
    out = df
    sv = row_scalar(stats)
    for i, c in enumerate(cols):
        fill = sv[f"s{i}"]
        out = out.withColumn(c, F.when(_is_missing(df, c), fill.cast(df.schema[c].dataType))
                             .otherwise(_q(c)))
    return out


def distinct_counts(df: DataFrame) -> DataFrame:
    """``column``, ``distinct``: the number of different non-null values of every column.  Of each value only 128 bits
    of hash are shuffled, whatever its type and size (two different values of a column agree in them with a chance of 2^-128)."""
    cells = F.explode(F.array(*[F.when(_q(c).isNotNull(), F.struct(
        F.lit(k).alias("c"), F.xxhash64(_q(c)).alias("h1"), F.xxhash64(F.lit(k), _q(c), F.lit(1)).alias("h2")))
        for k, c in enumerate(df.columns)]))
    found = df.select(cells.alias("s")).where("s IS NOT NULL").select("s.*").distinct().groupBy("c").agg(F.count("*").alias("distinct"))
    return found.select(F.get(F.array(*[F.lit(c) for c in df.columns]), F.col("c")).alias("column"), "distinct")


def summarize_all(df: DataFrame, digits: int = 6) -> DataFrame:
    """``SUMMARIZE``: one row for every column of any type.  ``min_value`` and ``max_value`` of numbers (booleans count as
    0 and 1), ``min_text`` and ``max_text`` of texts, dates and times; nested columns have neither.  Exact ``n_unique``;
    mean, sample deviation and exact quartiles of numbers; ``count`` of values and ``null_percentage``."""
    kinds = {f.name: f.dataType.simpleString() for f in df.schema.fields}
    plain = re.compile(r"(tinyint|smallint|int|bigint|float|double|boolean|decimal.*)$")
    numbers = [c for c in df.columns if plain.match(kinds[c])]
    texts = [c for c in df.columns if kinds[c] in ("string", "date", "timestamp", "timestamp_ntz")]

    def text(c: str) -> Column:
        form = {"date": "yyyy-MM-dd", "timestamp": "yyyy-MM-dd HH:mm:ss", "timestamp_ntz": "yyyy-MM-dd HH:mm:ss"}.get(kinds[c])
        return F.date_format(_q(c), form) if form else _q(c)

    def of(c: str, k: int, names: list[str], makers: list) -> list[Column]:
        return [m(c).alias(f"{n}__{k}") for n, m in zip(names, makers)]

    num = lambda c: _q(c).cast("double")      # noqa: E731
    aggs = []
    for k, c in enumerate(df.columns):
        none, empty = F.lit(None).cast("double"), F.lit(None).cast("string")
        is_num, is_text = c in numbers, c in texts
        aggs += of(c, k, ["mn", "mx", "avg", "std"], [
            (lambda c, f=f: f(num(c)) if is_num else F.max(none)) for f in (F.min, F.max, F.avg, F.stddev_samp)])
        aggs += of(c, k, ["mnt", "mxt"], [(lambda c, f=f: f(text(c)) if is_text else F.max(empty)) for f in (F.min, F.max)])
        aggs.append(F.count(_q(c)).alias(f"cnt__{k}"))
    one = df.agg(F.count(F.lit(1)).alias("n"), *aggs)
    st = _stack(one, df.columns, ["mn", "mx", "avg", "std", "mnt", "mxt", "cnt"], common=["n"])
    out = st.join(distinct_counts(df), "column", "left")
    names = ["q25", "q50", "q75"]
    if numbers:
        out = out.join(quantiles(long_form(df, numbers), "value", [0.25, 0.5, 0.75], ["column"], names, few_groups=True), "column", "left")
    else:
        out = out.withColumns({n: F.lit(None).cast("double") for n in names})
    n = F.col("n")
    kind = F.create_map(*[x for c in df.columns for x in (F.lit(c), F.lit(kinds[c]))])
    return out.select(
        "column", kind[F.col("column")].alias("column_type"), F.col("mn").alias("min_value"), F.col("mx").alias("max_value"),
        F.col("mnt").alias("min_text"), F.col("mxt").alias("max_text"), F.coalesce("distinct", F.lit(0)).cast("long").alias("n_unique"),
        *[round_half_up(c, digits).alias(c) for c in ("avg", "std", *names)], F.col("cnt").alias("count"),
        F.when(n > 0, F.floor(F.lit(10000.0) * (n - F.col("cnt")) / n + F.lit(0.5)) / F.lit(100.0)).alias("null_percentage"))


def profile_table(df: DataFrame, exact_distinct: bool = True) -> DataFrame:
    """column, type, total rows, null count, null % (2 digits), distinct count;
    ordered by null % desc.  Distinct counts are exact (``distinct_counts``) or HLL."""
    cols = df.columns
    types = {f.name: f.dataType.simpleString() for f in df.schema.fields}
    one = df.agg(F.count(F.lit(1)).alias("n"),
                 *[F.count_if(_q(c).isNull()).alias(f"nulls__{i}") for i, c in enumerate(cols)],
                 *([] if exact_distinct else
                   [F.approx_count_distinct(_q(c)).alias(f"distinct__{i}") for i, c in enumerate(cols)]))
    fields = ["nulls"] if exact_distinct else ["nulls", "distinct"]
    st = _stack(one, cols, fields, common=["n"])
    n = F.col("n")
    if exact_distinct:
        st = st.join(distinct_counts(df), "column", "left").withColumn("distinct", F.coalesce("distinct", F.lit(0)))
    tmap = F.create_map(*[x for c in cols for x in (F.lit(c), F.lit(types[c]))])
    return (st.select("column", tmap[F.col("column")].alias("column_type"),
                      n.alias("total_rows"), F.col("nulls").alias("null_count"),
                      F.floor(F.lit(10000.0) * F.col("nulls") / n + F.lit(0.5)).cast("double")
                      .__truediv__(F.lit(100.0)).alias("null_pct"),
                      F.col("distinct").cast("long").alias("distinct_count"))
            .orderBy(F.col("null_pct").desc(), "column"))


def approx_column_quantiles(df: DataFrame, cols: Sequence[str], probs: Sequence[float],
                            names: Sequence[str], accuracy: int = 10000) -> DataFrame:
    """``(column, names...)`` from ``percentile_approx`` (Greenwald-Khanna
    sketches: bounded memory, one pass, partial aggregation) - the choice for
    continuous columns at very large scale."""
    q = long_form(df, cols).groupBy("column").agg(
        F.percentile_approx("value", list(probs), accuracy).alias("_q"))
    return q.select("column", *[F.col("_q")[i].alias(nm) for i, nm in enumerate(names)])


def summarize_table(df: DataFrame, cols: Sequence[str] | None = None, digits: int = 6,
                    exact: bool = True) -> DataFrame:
    """``SUMMARIZE`` for numeric columns: min, max, unique count, mean, sample
    std, q25/q50/q75, count, null %.  ``exact`` uses the value-count table
    (exact quartiles and distinct counts); otherwise GK quantile sketches and
    HLL distinct counts in one pass."""
    cols = list(cols or numeric_columns(df))
    names = ["q25", "q50", "q75"]
    if exact:
        one = df.agg(F.count(F.lit(1)).alias("n"), *chain_aggs(cols))
        st = _stack(one, cols, ["mn", "mx", "avg", "std", "cnt"], common=["n"])
        vc = value_count_table(long_form(df, cols), "value", ["column"])
        qs = quantiles(None, "value", [0.25, 0.5, 0.75], ["column"], names, counts=vc, few_groups=True)
        uniq = vc.groupBy("column").agg(F.count(F.lit(1)).alias("unique"))
    else:
        one = df.agg(F.count(F.lit(1)).alias("n"), *chain_aggs(cols),
                     *[F.approx_count_distinct(_q(c)).alias(f"unique__{i}") for i, c in enumerate(cols)])
        st = _stack(one, cols, ["mn", "mx", "avg", "std", "cnt", "unique"], common=["n"])
        qs = approx_column_quantiles(df, cols, [0.25, 0.5, 0.75], names)
        uniq = st.select("column", "unique")
        st = st.drop("unique")
    n = F.col("n")
    return (st.join(qs, "column", "left").join(uniq, "column", "left")
            .select("column", F.col("mn").alias("min"), F.col("mx").alias("max"),
                    F.coalesce("unique", F.lit(0)).cast("long").alias("approx_unique"),
                    round_half_up("avg", digits).alias("avg"), round_half_up("std", digits).alias("std"),
                    round_half_up("q25", digits).alias("q25"), round_half_up("q50", digits).alias("q50"),
                    round_half_up("q75", digits).alias("q75"),
                    F.col("cnt").alias("count"),
                    (F.floor(F.lit(10000.0) * (n - F.col("cnt")) / n + F.lit(0.5)) / F.lit(100.0))
                    .alias("null_percentage")))


def chain_aggs(cols: Sequence[str]) -> list[Column]:
    out = []
    for i, c in enumerate(cols):
        x = _q(c).cast("double")
        out += [F.min(x).alias(f"mn__{i}"), F.max(x).alias(f"mx__{i}"), F.avg(x).alias(f"avg__{i}"),
                F.stddev_samp(x).alias(f"std__{i}"), F.count(x).alias(f"cnt__{i}")]
    return out


def describe(df: DataFrame, cols: Sequence[str] | None = None, digits: int = 6,
             exact: bool = True) -> DataFrame:
    """``DataFrame.describe()``: count, mean, std, min, 25/50/75 %, max."""
    s = summarize_table(df, cols, digits, exact)
    return s.select("column", "count", F.col("avg").alias("mean"), "std", "min",
                    F.col("q25").alias("p25"), F.col("q50").alias("p50"),
                    F.col("q75").alias("p75"), "max")


def describe_categorical(df: DataFrame, cols: Sequence[str]) -> DataFrame:
    """``describe(include='all')`` for string columns: count, unique, top, freq
    (``top`` ties resolved to the smallest value)."""
    lf = df.select(F.explode(F.array(*[
        F.struct(F.lit(c).alias("column"), _q(c).cast("string").alias("v")) for c in cols])).alias("s")) \
        .select("s.*").where(F.col("v").isNotNull())
    vc = lf.groupBy("column", "v").agg(F.count(F.lit(1)).alias("f"))
    return vc.groupBy("column").agg(
        F.sum("f").alias("count"), F.count(F.lit(1)).alias("unique"),
        F.min_by("v", F.struct(-F.col("f"), F.col("v"))).alias("top"),
        F.max("f").alias("freq"))


def value_range(df: DataFrame, cols: Sequence[str]) -> DataFrame:
    """min / max / exact median per column (slider bounds)."""
    one = df.agg(*[x for i, c in enumerate(cols) for x in
                   (F.min(_q(c).cast("double")).alias(f"mn__{i}"), F.max(_q(c).cast("double")).alias(f"mx__{i}"))])
    st = _stack(one, cols, ["mn", "mx"])
    med = quantiles(long_form(df, cols), "value", [0.5], ["column"], ["median"], few_groups=True)
    return st.join(med, "column", "left").select(
        "column", F.col("mn").alias("min"), F.col("mx").alias("max"), "median")


THRESHOLDS = [1.0 + 0.5 * i for i in range(8)]   # 1.0 ... 4.5


def _quartile_fences(df: DataFrame, cols: Sequence[str], exact: bool = True) -> tuple[DataFrame, DataFrame]:
    """``(column, value)`` rows and the per-column quartiles, exact or from GK
    sketches; both only shuffle histograms or sketches, never the rows."""
    names = ["q1", "median", "q3"]
    values = long_form(df, cols).where(F.col("value").isNotNull() & ~F.isnan("value"))
    if exact:
        qs = quantiles(values, "value", [0.25, 0.5, 0.75], ["column"], names, few_groups=True)
    else:
        qs = approx_column_quantiles(df, cols, [0.25, 0.5, 0.75], names)
    return values, qs.withColumn("iqr", F.col("q3") - F.col("q1"))


def iqr_outlier_sweep(df: DataFrame, cols: Sequence[str],
                      thresholds: Sequence[float] = THRESHOLDS, exact: bool = True) -> DataFrame:
    """Outliers outside ``[q1 - t*iqr, q3 + t*iqr]`` for every threshold t.
    Counted on the rows joined to the per-column fences (one row per column:
    bounded, broadcast)."""
    values, qs = _quartile_fences(df, cols, exact)
    j = values.join(F.broadcast(qs), "column")
    aggs = [F.sum(F.when((F.col("value") < F.col("q1") - F.lit(t) * F.col("iqr"))
                         | (F.col("value") > F.col("q3") + F.lit(t) * F.col("iqr")), 1)
                  .otherwise(0)).alias(f"o{i}")
            for i, t in enumerate(thresholds)]
    counts = j.groupBy("column").agg(F.count(F.lit(1)).alias("n"), *aggs)
    structs = [F.struct(F.lit(float(t)).alias("threshold"), F.col(f"o{i}").alias("outliers"))
               for i, t in enumerate(thresholds)]
    return counts.select("column", "n", F.explode(F.array(*structs)).alias("s")) \
        .select("column", "s.threshold", "s.outliers",
                round_half_up(F.lit(100.0) * F.col("s.outliers") / F.col("n"), 4).alias("outlier_pct"))


def boxplot_stats(df: DataFrame, cols: Sequence[str], whisker: float = 1.5,
                  exact: bool = True) -> DataFrame:
    """q1, median, q3, whiskers (extreme values inside the 1.5·IQR fences) and
    the number of fliers, per column."""
    values, qs = _quartile_fences(df, cols, exact)
    j = values.join(F.broadcast(qs), "column")
    lo = F.col("q1") - F.lit(whisker) * F.col("iqr")
    hi = F.col("q3") + F.lit(whisker) * F.col("iqr")
    inside = (F.col("value") >= lo) & (F.col("value") <= hi)
    return j.groupBy("column", "q1", "median", "q3").agg(
        F.min(F.when(inside, F.col("value"))).alias("whisker_lo"),
        F.max(F.when(inside, F.col("value"))).alias("whisker_hi"),
        F.count_if(~inside).alias("fliers"))


def winsor_limits(df: DataFrame, col: str, lower: float, upper: float) -> DataFrame:
    """One row ``(lo_value, hi_value)``: the order statistics at 0-based ranks
    ``int(n*lower)`` and ``n - int(n*upper) - 1`` (not interpolated)."""
    return order_statistics(df, col, [
        lambda n: F.floor(n.cast("double") * F.lit(lower)),
        lambda n: n - F.floor(n.cast("double") * F.lit(upper)) - 1], ["lo_value", "hi_value"]).drop("_n")


def winsorize(df: DataFrame, col: str, lower: float = 0.05, upper: float = 0.05,
              name: str | None = None) -> DataFrame:
    lim = row_scalar(winsor_limits(df, col, lower, upper))
    lo, hi = lim["lo_value"], lim["hi_value"]
    x = F.col(col).cast("double")
    return df.withColumn(name or col, F.when(x.isNull(), x).otherwise(F.least(F.greatest(x, lo), hi)))


def zscore_filter(df: DataFrame, cols: Sequence[str], z: float = 3.0) -> DataFrame:
    """Keep rows whose |z| < z for every column (population std).  A column
    with zero spread gives a NULL z, which passes (instead of dropping all)."""
    stats = df.agg(*[x for i, c in enumerate(cols) for x in
                     (F.avg(_q(c)).alias(f"m{i}"), F.stddev_pop(_q(c)).alias(f"s{i}"))])
    cond = F.lit(True)
    sv = row_scalar(stats)
    for i, c in enumerate(cols):
        m, s = sv[f"m{i}"], sv[f"s{i}"]
        zc = F.abs(_q(c) - m) / F.when(s != 0, s)
        cond = cond & (zc.isNull() | (zc < F.lit(z)))
    return df.where(cond)
