"""Registered data-quality, statistics and window queries
with their DuckDB oracles."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from strata.functions.numeric import round_half_up
from strata.operators import quality as Q
from strata.operators import stats as T
from strata.operators import windows as W
from strata.plans import standins as st
from strata.plans.catalog import register
from strata.plans.q_aggregates import _r
from strata.sources.tables import read_table


def _union(parts):
    return "\nUNION ALL\n".join(parts)


DL_COLS = ["doc_id", "lang", "source", "n_chars", "quality", "toxic"]
DL_TYPES = {"doc_id": "bigint", "lang": "string", "source": "string", "n_chars": "bigint",
            "quality": "int", "toxic": "int"}


@register("missing_pct", sql=f"""
WITH {st.DOC_LABELS_SQL}
""" + _union([f"SELECT '{c}' AS column, FLOOR(AVG(CASE WHEN {c} IS NULL THEN 1.0::DOUBLE ELSE 0.0::DOUBLE END)"
              f" * 10000 + 0.5) / 10000 * 100.0 AS missing_pct FROM doc_labels" for c in DL_COLS]))
def q_missing_pct(spark, sf):
    return Q.missing_pct(st.doc_labels(spark, sf))


@register("dropna_any", sql=f"""
WITH {st.DOC_LABELS_SQL}
SELECT doc_id, quality, toxic FROM doc_labels WHERE quality IS NOT NULL AND toxic IS NOT NULL""")
def q_dropna_any(spark, sf):
    return Q.dropna_any(st.doc_labels(spark, sf).select("doc_id", "quality", "toxic"))


@register("fillna_zero", sql=f"""
WITH {st.DOC_LABELS_SQL}
SELECT doc_id, COALESCE(quality, 0) AS quality, COALESCE(toxic, 0) AS toxic FROM doc_labels""")
def q_fillna_zero(spark, sf):
    return Q.fillna_value(st.doc_labels(spark, sf).select("doc_id", "quality", "toxic"), 0)


@register("fillna_mean", sql=f"""
WITH {st.DOC_LABELS_SQL}
SELECT doc_id, COALESCE(CAST(quality AS DOUBLE), (SELECT AVG(quality) FROM doc_labels)) AS quality,
       COALESCE(CAST(toxic AS DOUBLE), (SELECT AVG(toxic) FROM doc_labels)) AS toxic
FROM doc_labels""")
def q_fillna_mean(spark, sf):
    d = st.doc_labels(spark, sf).select("doc_id", F.col("quality").cast("double").alias("quality"),
                                        F.col("toxic").cast("double").alias("toxic"))
    return Q.fillna_stat(d, ["quality", "toxic"], "mean")


@register("impute_median", sql=f"""
WITH {st.DOC_LABELS_SQL}
SELECT doc_id, COALESCE(CAST(quality AS DOUBLE), (SELECT quantile_cont(quality, 0.5) FROM doc_labels)) AS quality,
       COALESCE(CAST(toxic AS DOUBLE), (SELECT quantile_cont(toxic, 0.5) FROM doc_labels)) AS toxic
FROM doc_labels""")
def q_impute_median(spark, sf):
    d = st.doc_labels(spark, sf).select("doc_id", F.col("quality").cast("double").alias("quality"),
                                        F.col("toxic").cast("double").alias("toxic"))
    return Q.fillna_stat(d, ["quality", "toxic"], "median")


@register("profile_table", sql=f"""
WITH {st.DOC_LABELS_SQL}
""" + _union([
    f"SELECT '{c}' AS column, '{DL_TYPES[c]}' AS column_type, COUNT(*) AS total_rows, "
    f"COUNT(*) - COUNT({c}) AS null_count, "
    f"FLOOR(10000.0::DOUBLE * (COUNT(*) - COUNT({c})) / COUNT(*) + 0.5) / 100.0 AS null_pct, "
    f"COUNT(DISTINCT {c}) AS distinct_count FROM doc_labels" for c in DL_COLS]))
def q_profile_table(spark, sf):
    return Q.profile_table(st.doc_labels(spark, sf))


RATIO_COLS = ["l_quantity", "l_extendedprice", "l_discount", "l_tax", "unit_price"]


def _summ_sql(c, d=4):
    return (f"SELECT '{c}' AS column, CAST(MIN({c}) AS DOUBLE) AS min, CAST(MAX({c}) AS DOUBLE) AS max, "
            f"COUNT(DISTINCT {c}) AS approx_unique, {_r(f'AVG({c})', d)} AS avg, "
            f"{_r(f'STDDEV_SAMP({c})', d)} AS std, {_r(f'quantile_cont({c}, 0.25)', d)} AS q25, "
            f"{_r(f'quantile_cont({c}, 0.5)', d)} AS q50, {_r(f'quantile_cont({c}, 0.75)', d)} AS q75, "
            f"COUNT({c}) AS count, FLOOR(10000.0::DOUBLE * (COUNT(*) - COUNT({c})) / COUNT(*) + 0.5) / 100.0 "
            f"AS null_percentage FROM ratios")


@register("summarize_table", sql=f"WITH {st.RATIOS_SQL}\n" + _union([_summ_sql(c) for c in RATIO_COLS]))
def q_summarize_table(spark, sf):
    return Q.summarize_table(st.ratios(spark, sf), RATIO_COLS, digits=4)


#: Kinds of the columns of the summarised tables: number, text, date, time, list.
SUMMARISED = {
    "orders": "o_orderkey:bigint o_custkey:bigint o_orderstatus:string o_totalprice:double o_orderdate:timestamp_ntz o_orderpriority:string",
    "events": "event_id:bigint user_id:bigint ts:timestamp_ntz event_type:string value:double props:string",
    "documents": "doc_id:bigint text:string lang:string source:string n_chars:bigint",
    "embeddings": "vec_id:bigint embedding:array<float> label:int",
    "conversations": "conv_id:bigint turn:bigint role:string text:string",
}


def _summarize_all_sql(table: str, column: str, kind: str) -> str:
    number, time = kind in ("bigint", "int", "double"), {"date": "%Y-%m-%d", "timestamp_ntz": "%Y-%m-%d %H:%M:%S"}.get(kind)
    text = f"strftime({column}, '{time}')" if time else column if kind == "string" else "NULL"
    value = f"CAST({column} AS DOUBLE)" if number else "NULL"

    def stat(sql: str) -> str:
        return _r(sql, 4) if number else "CAST(NULL AS DOUBLE)"
    quartiles = ", ".join(f"{stat(f'quantile_cont({value}, {q})')} AS q{int(100 * q)}" for q in (0.25, 0.5, 0.75))
    return (f"SELECT '{table}' AS table_name, '{column}' AS column, '{kind}' AS column_type, CAST(MIN({value}) AS DOUBLE) AS min_value, "
            f"CAST(MAX({value}) AS DOUBLE) AS max_value, CAST(MIN({text}) AS VARCHAR) AS min_text, CAST(MAX({text}) AS VARCHAR) AS max_text, "
            f"COUNT(DISTINCT {column}) AS n_unique, {stat(f'AVG({value})')} AS avg, {stat(f'STDDEV_SAMP({value})')} AS std, {quartiles}, "
            f"COUNT({column}) AS count, FLOOR(10000.0::DOUBLE * (COUNT(*) - COUNT({column})) / COUNT(*) + 0.5) / 100.0 AS null_percentage FROM {table}")


@register("summarize_all", sql=_union([_summarize_all_sql(t, *c.split(":")) for t, cols in SUMMARISED.items() for c in cols.split()]))
def q_summarize_all(spark, sf):
    """Every column of five tables, whatever its type."""
    parts = [Q.summarize_all(read_table(spark, sf, t), 4).withColumn("table_name", F.lit(t)) for t in SUMMARISED]
    return reduce(DataFrame.unionByName, parts)


CHURN_NUM = ["tenure", "MonthlyCharges", "n_orders"]


@register("describe", sql=f"WITH {st.CHURN_SQL}\n" + _union([
    f"SELECT '{c}' AS column, COUNT({c}) AS count, {_r(f'AVG({c})', 4)} AS mean, "
    f"{_r(f'STDDEV_SAMP({c})', 4)} AS std, CAST(MIN({c}) AS DOUBLE) AS min, "
    f"{_r(f'quantile_cont({c}, 0.25)', 4)} AS p25, {_r(f'quantile_cont({c}, 0.5)', 4)} AS p50, "
    f"{_r(f'quantile_cont({c}, 0.75)', 4)} AS p75, CAST(MAX({c}) AS DOUBLE) AS max FROM churn"
    for c in CHURN_NUM]))
def q_describe(spark, sf):
    return Q.describe(st.churn(spark, sf), CHURN_NUM, digits=4)


CHURN_CAT = ["Contract", "region", "Churn"]


@register("describe_categorical", sql=f"WITH {st.CHURN_SQL}\n" + _union([
    f"SELECT '{c}' AS column, CAST(SUM(f) AS BIGINT) AS count, COUNT(*) AS unique, arg_min(v, (-f, v)) AS top, "
    f"MAX(f) AS freq FROM (SELECT {c} AS v, COUNT(*) AS f FROM churn WHERE {c} IS NOT NULL GROUP BY {c})"
    for c in CHURN_CAT]))
def q_describe_categorical(spark, sf):
    return Q.describe_categorical(st.churn(spark, sf), CHURN_CAT).select(
        "column", F.col("count").cast("long").alias("count"), "unique", "top", "freq")


@register("value_range", sql=f"WITH {st.TRADING_SQL}\n" + _union([
    f"SELECT '{c}' AS column, MIN({c}) AS min, MAX({c}) AS max, quantile_cont({c}, 0.5) AS median "
    f"FROM trading" for c in ["weight", "resp"]]))
def q_value_range(spark, sf):
    return Q.value_range(st.trading(spark, sf), ["weight", "resp"])


IQR_COLS = ["l_extendedprice", "unit_price"]
_LF_SQL = " UNION ALL ".join(f"SELECT '{c}' AS \"column\", {c} AS value FROM ratios" for c in IQR_COLS)


@register("iqr_outlier_sweep", sql=f"""
WITH {st.RATIOS_SQL}, lf AS (
  {_LF_SQL}),
q AS (SELECT "column", quantile_cont(value, 0.25) AS q1, quantile_cont(value, 0.75) AS q3 FROM lf GROUP BY "column"),
t AS (SELECT unnest([{", ".join(repr(t) for t in Q.THRESHOLDS)}]) AS threshold)
SELECT lf."column", t.threshold,
       COUNT(*) FILTER (WHERE value < q1 - t.threshold * (q3 - q1) OR value > q3 + t.threshold * (q3 - q1)) AS outliers,
       {_r("100.0::DOUBLE * COUNT(*) FILTER (WHERE value < q1 - t.threshold * (q3 - q1) OR value > q3 + t.threshold * (q3 - q1)) / COUNT(*)", 4)} AS outlier_pct
FROM lf JOIN q ON lf."column" = q."column" CROSS JOIN t
GROUP BY lf."column", t.threshold""")
def q_iqr_outlier_sweep(spark, sf):
    return Q.iqr_outlier_sweep(st.ratios(spark, sf), IQR_COLS)


@register("boxplot_stats", sql=f"""
WITH {st.RATIOS_SQL}, lf AS (
  {_LF_SQL}),
q AS (SELECT "column", quantile_cont(value, 0.25) AS q1, quantile_cont(value, 0.5) AS median,
             quantile_cont(value, 0.75) AS q3 FROM lf GROUP BY "column")
SELECT q."column", q1, median, q3,
       MIN(value) FILTER (WHERE value >= q1 - 1.5 * (q3 - q1) AND value <= q3 + 1.5 * (q3 - q1)) AS whisker_lo,
       MAX(value) FILTER (WHERE value >= q1 - 1.5 * (q3 - q1) AND value <= q3 + 1.5 * (q3 - q1)) AS whisker_hi,
       COUNT(*) FILTER (WHERE NOT (value >= q1 - 1.5 * (q3 - q1) AND value <= q3 + 1.5 * (q3 - q1))) AS fliers
FROM lf JOIN q ON lf."column" = q."column" GROUP BY q."column", q1, median, q3""")
def q_boxplot_stats(spark, sf):
    return Q.boxplot_stats(st.ratios(spark, sf), IQR_COLS)


@register("winsorize", sql=f"""
WITH {st.RATIOS_SQL},
r AS (SELECT l_extendedprice AS v, ROW_NUMBER() OVER (ORDER BY l_extendedprice) - 1 AS rk,
             COUNT(*) OVER () AS n FROM ratios),
lim AS (SELECT MAX(v) FILTER (WHERE rk = FLOOR(n * 0.05::DOUBLE)) AS lo,
               MAX(v) FILTER (WHERE rk = n - FLOOR(n * 0.05::DOUBLE) - 1) AS hi FROM r)
SELECT l_orderkey, l_linenumber, LEAST(GREATEST(l_extendedprice, lo), hi) AS l_extendedprice_w
FROM ratios, lim""")
def q_winsorize(spark, sf):
    r = st.ratios(spark, sf)
    return Q.winsorize(r, "l_extendedprice", 0.05, 0.05, "l_extendedprice_w") \
        .select("l_orderkey", "l_linenumber", "l_extendedprice_w")


Z_COLS = ["l_quantity", "l_extendedprice", "unit_price"]


@register("zscore_filter", sql=f"""
WITH {st.RATIOS_SQL}, s AS (
  SELECT {", ".join(f"AVG({c}) AS m_{c}, STDDEV_POP({c}) AS s_{c}" for c in Z_COLS)} FROM ratios)
SELECT l_orderkey, l_linenumber, l_quantity, l_extendedprice FROM ratios, s
WHERE {" AND ".join(f"(s_{c} = 0 OR ABS({c} - m_{c}) / s_{c} < 3)" for c in Z_COLS)}""")
def q_zscore_filter(spark, sf):
    return Q.zscore_filter(st.ratios(spark, sf), Z_COLS) \
        .select("l_orderkey", "l_linenumber", "l_quantity", "l_extendedprice")


CORR_COLS = ["l_quantity", "l_extendedprice", "l_discount", "unit_price"]


@register("corr_matrix", sql=f"WITH {st.RATIOS_SQL}\n" + _union([
    f"SELECT '{a}' AS col_a, '{b}' AS col_b, {_r(f'CORR({a}, {b})', 6)} AS corr FROM ratios"
    for a in CORR_COLS for b in CORR_COLS]))
def q_corr_matrix(spark, sf):
    return T.corr_matrix(st.ratios(spark, sf), CORR_COLS)


_CWT = f"WITH {st.RATIOS_SQL}, c AS (\n" + _union([
    f"SELECT '{a}' AS feature, {_r(f'CORR({a}, label)', 6)} AS corr FROM ratios" for a in CORR_COLS]) + ")"


@register("corr_with_target", sql=_CWT + """
SELECT feature, corr, ABS(corr) AS abs_corr,
       CAST(ROW_NUMBER() OVER (ORDER BY ABS(corr) DESC NULLS LAST, feature) AS INTEGER) AS rank FROM c""")
def q_corr_with_target(spark, sf):
    return T.corr_with_target(st.ratios(spark, sf), CORR_COLS, "label")


@register("top_correlated", sql=_CWT + """
SELECT * FROM (SELECT feature, corr, ABS(corr) AS abs_corr,
       CAST(ROW_NUMBER() OVER (ORDER BY ABS(corr) DESC NULLS LAST, feature) AS INTEGER) AS rank FROM c) WHERE rank <= 2""")
def q_top_correlated(spark, sf):
    return T.top_correlated(st.ratios(spark, sf), CORR_COLS, "label", 2)


@register("factorize_corr", sql=f"""
WITH {st.CHURN_SQL},
cc AS (SELECT Contract AS value, ROW_NUMBER() OVER (ORDER BY MIN(customerID), Contract) - 1 AS code
       FROM churn GROUP BY Contract),
ch AS (SELECT Churn AS value, ROW_NUMBER() OVER (ORDER BY MIN(customerID), Churn) - 1 AS code
       FROM churn GROUP BY Churn),
f AS (SELECT cc.code AS Contract, ch.code AS Churn, churn.tenure FROM churn
      JOIN cc ON churn.Contract = cc.value JOIN ch ON churn.Churn = ch.value)
""" + _union([f"SELECT '{a}' AS col_a, '{b}' AS col_b, {_r(f'CORR({a}, {b})', 6)} AS corr FROM f"
              for a in ["Contract", "Churn", "tenure"] for b in ["Contract", "Churn", "tenure"]]))
def q_factorize_corr(spark, sf):
    coded = T.factorize(st.churn(spark, sf), ["Contract", "Churn"], "customerID")
    return T.corr_matrix(coded, ["Contract", "Churn", "tenure"])


MOM_COLS = ["l_quantity", "unit_price"]


@register("kurtosis", sql=f"WITH {st.RATIOS_SQL}\n" + _union([
    f"SELECT '{c}' AS column, COUNT({c}) AS n, {_r(f'AVG({c})', 6)} AS mean, "
    f"{_r(f'SKEWNESS({c})', 6)} AS skewness, {_r(f'KURTOSIS({c})', 6)} AS kurtosis FROM ratios"
    for c in MOM_COLS]))
def q_kurtosis(spark, sf):
    return T.moments(st.ratios(spark, sf), MOM_COLS)


def _jb_sql(c):
    return (f"SELECT '{c}' AS column, n, {_r('jb', 2)} AS jb, {_r('EXP(-jb / 2)', 6)} AS p_value FROM ("
            f"SELECT n, n / 6.0::DOUBLE * (m3 * m3 / (m2 * m2 * m2) + (m4 / (m2 * m2) - 3) * (m4 / (m2 * m2) - 3) / 4) AS jb "
            f"FROM (SELECT COUNT(*) AS n, AVG(POWER(d, 2)) AS m2, AVG(POWER(d, 3)) AS m3, AVG(POWER(d, 4)) AS m4 "
            f"FROM (SELECT {c} - AVG({c}) OVER () AS d FROM ratios)))")


@register("normality_test", sql=f"WITH {st.RATIOS_SQL}\n" + _union([_jb_sql(c) for c in MOM_COLS]))
def q_normality_test(spark, sf):
    return T.jarque_bera(st.ratios(spark, sf), MOM_COLS)


@register("mann_whitney_u", sql=f"""
WITH {st.CHURN_SQL}, r AS (
  SELECT Churn, (RANK() OVER (ORDER BY MonthlyCharges) + RANK() OVER (ORDER BY MonthlyCharges)
                 + COUNT(*) OVER (PARTITION BY MonthlyCharges) - 1) / 2.0::DOUBLE AS rk,
         COUNT(*) OVER (PARTITION BY MonthlyCharges) AS t
  FROM churn WHERE Churn IN ('Yes', 'No')),
tie AS (SELECT SUM(t * t * t - t) AS tie FROM (SELECT DISTINCT MonthlyCharges, COUNT(*) AS t FROM churn
        WHERE Churn IN ('Yes', 'No') GROUP BY MonthlyCharges)),
a AS (SELECT COUNT(*) FILTER (WHERE Churn = 'Yes') AS n1, COUNT(*) FILTER (WHERE Churn = 'No') AS n2,
             SUM(rk) FILTER (WHERE Churn = 'Yes') AS r1 FROM r),
u AS (SELECT n1, n2, r1 - n1 * (n1 + 1) / 2.0 AS u1, CAST(n1 AS DOUBLE) AS d1, CAST(n2 AS DOUBLE) AS d2, tie FROM a, tie)
SELECT n1, n2, {_r('u1', 6)} AS u,
       {_r('(GREATEST(u1, d1 * d2 - u1) - d1 * d2 / 2 - 0.5) / SQRT(d1 * d2 / 12 * ((d1 + d2 + 1) - tie / ((d1 + d2) * (d1 + d2 - 1))))', 6)} AS z
FROM u""")
def q_mann_whitney_u(spark, sf):
    return T.mann_whitney_u(st.churn(spark, sf), "MonthlyCharges", "Churn", "Yes", "No", with_p=False)


@register("mann_whitney_p")
def q_mann_whitney_p(spark, sf):
    """``mann_whitney_u`` with its two-sided p-value."""
    return T.mann_whitney_u(st.churn(spark, sf), "MonthlyCharges", "Churn", "Yes", "No")


def _hist_sql(src, col, bins, by=None):
    byc = f"{by}, " if by else ""
    return f"""
SELECT {byc}bin, {_r(f'lo + bin * (hi - lo) / {float(bins)}', 6)} AS lo,
       {_r(f'lo + (bin + 1) * (hi - lo) / {float(bins)}', 6)} AS hi, COUNT(*) AS count
FROM (SELECT {byc}CAST(LEAST(FLOOR(({col} - lo) * {float(bins)} / (hi - lo)), {bins - 1}) AS INTEGER) AS bin, lo, hi
      FROM {src}, (SELECT CAST(MIN({col}) AS DOUBLE) AS lo, CAST(MAX({col}) AS DOUBLE) AS hi FROM {src}) m
      WHERE {col} IS NOT NULL)
GROUP BY {byc}bin, lo, hi"""


@register("histogram", sql=f"WITH {st.RAIL_SQL}" + _hist_sql("rail", "delay", 20))
def q_histogram(spark, sf):
    return T.histogram(st.rail(spark, sf), "delay", 20)


@register("histogram_by_class", sql=f"WITH {st.RATIOS_SQL}" + _hist_sql("ratios", "unit_price", 30, "label"))
def q_histogram_by_class(spark, sf):
    return T.histogram(st.ratios(spark, sf), "unit_price", 30, by="label")


@register("kde_curve", sql=f"""
WITH {st.TRADING_SQL},
s AS (SELECT MIN(weight) AS lo, MAX(weight) AS hi, STDDEV_SAMP(weight) * POWER(COUNT(weight), -0.2) AS h,
             CAST(COUNT(weight) AS DOUBLE) AS n FROM trading),
vc AS (SELECT weight AS v, COUNT(*) AS cnt FROM trading WHERE weight IS NOT NULL GROUP BY weight),
g AS (SELECT CAST(range AS INTEGER) AS gi FROM range(50))
SELECT gi AS point, {_r('lo + (hi - lo) * gi / 49.0', 8)} AS x,
       {_r('SUM(cnt * EXP(-((lo + (hi - lo) * gi / 49.0 - v) / h) * ((lo + (hi - lo) * gi / 49.0 - v) / h) / 2)) / (n * h * SQRT(2 * PI()))', 8)} AS density
FROM vc, g, s GROUP BY gi, lo, hi, n, h""")
def q_kde_curve(spark, sf):
    return T.kde_curve(st.trading(spark, sf), "weight", 50)


@register("rolling_mean_7", sql=f"""
WITH {st.RAIL_SQL}, d AS (SELECT date, AVG(delay) AS mean_delay FROM rail GROUP BY date)
SELECT strftime(date, '%Y-%m-%d') AS day, {_r('mean_delay', 4)} AS mean_delay,
       {_r('AVG(mean_delay) OVER (ORDER BY date ROWS BETWEEN 6 PRECEDING AND CURRENT ROW)', 4)} AS rolling_mean_7
FROM d""")
def q_rolling_mean_7(spark, sf):
    from strata.functions.numeric import round_half_up
    daily = st.rail(spark, sf).groupBy("date").agg(F.avg("delay").alias("mean_delay"))
    r = W.rolling_mean(daily, "date", "mean_delay", 7, "rolling_mean_7")
    return r.select(F.date_format("date", "yyyy-MM-dd").alias("day"),
                    round_half_up("mean_delay", 4).alias("mean_delay"),
                    round_half_up("rolling_mean_7", 4).alias("rolling_mean_7"))


@register("ffill", sql=f"""
WITH {st.DOC_LABELS_SQL}
SELECT doc_id, lang,
       CAST(LAST_VALUE(quality IGNORE NULLS) OVER (PARTITION BY lang ORDER BY doc_id
                                              ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS DOUBLE) AS quality
FROM doc_labels""")
def q_ffill(spark, sf):
    d = st.doc_labels(spark, sf).select("doc_id", "lang", F.col("quality").cast("double").alias("quality"))
    return W.ffill(d, ["lang"], "doc_id", ["quality"])


@register("lag_features", sql="""
SELECT event_id, user_id, value,
       LAG(value, 1) OVER (PARTITION BY user_id ORDER BY ts, event_id) AS value_lag1,
       LAG(value, 2) OVER (PARTITION BY user_id ORDER BY ts, event_id) AS value_lag2,
       LAG(value, 3) OVER (PARTITION BY user_id ORDER BY ts, event_id) AS value_lag3
FROM events""")
def q_lag_features(spark, sf):
    from strata.sources.tables import read_table
    ev = read_table(spark, sf, "events").select("event_id", "user_id", "value", "ts")
    return W.lag_features(ev, ["user_id"], ["ts", "event_id"], "value").drop("ts")


@register("seasonal_naive", sql=f"""
WITH {st.RAIL_SQL}, d AS (SELECT date, AVG(delay) AS mean_delay FROM rail GROUP BY date)
SELECT strftime(date, '%Y-%m-%d') AS day, {_r('mean_delay', 4)} AS mean_delay,
       {_r('LAG(mean_delay, 7) OVER (ORDER BY date)', 4)} AS forecast FROM d""")
def q_seasonal_naive(spark, sf):
    from pyspark.sql import Window
    from strata.functions.numeric import round_half_up
    daily = st.rail(spark, sf).groupBy("date").agg(F.avg("delay").alias("mean_delay"))
    w = Window.orderBy("date")          # one row per day: a bounded series
    return daily.select(F.date_format("date", "yyyy-MM-dd").alias("day"),
                        round_half_up("mean_delay", 4).alias("mean_delay"),
                        round_half_up(F.lag("mean_delay", 7).over(w), 4).alias("forecast"))


CHURN_FEATS = ["tenure", "MonthlyCharges", "n_orders"]


@register("rank_features", sql=f"""WITH {st.SCORED_SQL},
sc AS (SELECT s.label, s.tenure, s.MonthlyCharges, c.n_orders FROM scored s JOIN churn c ON s.id = c.customerID),
c AS (""" + _union([f"SELECT '{a}' AS feature, {_r(f'CORR({a}, label)', 6)} AS corr FROM sc" for a in CHURN_FEATS]) + """)
SELECT feature, corr, ABS(corr) AS abs_corr,
       CAST(ROW_NUMBER() OVER (ORDER BY ABS(corr) DESC NULLS LAST, feature) AS INTEGER) AS rank FROM c""")
def q_rank_features(spark, sf):
    """Churn features ranked by |Pearson correlation| with the label."""
    s = st.scored(spark, sf).join(st.churn(spark, sf).select(F.col("customerID").alias("id"), "n_orders"), "id")
    return T.corr_with_target(s, CHURN_FEATS, "label")


@register("scalar_functions", sql=f"""
SELECT event_id,
       TRY_CAST(strftime(ts, '%Y-%m-%d') AS DATE) IS NOT NULL AS date_ok,
       CAST(TRY_CAST(event_type || '-01' AS DATE) AS VARCHAR) AS bad_date,
       CAST(isodow(ts) - 1 AS INTEGER) AS weekday,
       ['Mon', 'Tue', 'Wed', 'Thu', 'Fri', 'Sat', 'Sun'][isodow(ts)] AS day_label,
       dayname(ts) AS day_name,
       CAST(hour(ts) AS INTEGER) AS hour,
       upper(trim(event_type)) || ' → ' || CAST(user_id AS VARCHAR) AS label,
       contains(lower(props), '"k"') AS has_k,
       LEAST(GREATEST(value, 1.0), 100.0) AS clipped,
       {_r('value', 1)} AS rounded,
       CASE WHEN value >= 70 THEN 'High' WHEN value >= 30 THEN 'Medium' ELSE 'Low' END AS tier
FROM events""")
def q_scalar_functions(spark, sf):
    """The scalar-function families of SURVEY §2.9 on ``events``."""
    from strata.functions import (arrow_concat, bounded, coerce_date, day_label, day_name,
                                  round_half_up, weekday_mon0)
    from strata.sources.tables import read_table
    ev = read_table(spark, sf, "events")
    return ev.select(
        "event_id",
        coerce_date(F.date_format("ts", "yyyy-MM-dd")).isNotNull().alias("date_ok"),
        coerce_date(F.concat("event_type", F.lit("-01"))).cast("string").alias("bad_date"),
        weekday_mon0("ts").alias("weekday"),
        day_label(weekday_mon0("ts")).alias("day_label"),
        day_name("ts").alias("day_name"),
        F.hour("ts").alias("hour"),
        arrow_concat(F.upper(F.trim("event_type")), F.col("user_id").cast("string")).alias("label"),
        F.lower("props").contains('"k"').alias("has_k"),
        bounded("value", 1.0, 100.0).alias("clipped"),
        round_half_up("value", 1).alias("rounded"),
        F.when(F.col("value") >= 70, "High").when(F.col("value") >= 30, "Medium").otherwise("Low").alias("tier"))


_APART = ("list_sum(list_transform(list_zip(CAST(embedding[1:8] AS DOUBLE[]), CAST(embedding[9:16] AS DOUBLE[])), "
          "lambda p: (p[1] - p[2]) * (p[1] - p[2])))")


@register("array_functions", sql=f"""
SELECT vec_id, CAST(embedding[1:4] AS DOUBLE[]) AS first_four, len(embedding) AS dims,
       {_r(_APART, 6)} AS apart
FROM embeddings""")
def q_array_functions(spark, sf):
    """Slices, lengths and distances of the embeddings."""
    from strata.functions.vectors import sq_l2, to_double_array
    e = read_table(spark, sf, "embeddings")
    return e.select("vec_id", to_double_array(F.slice("embedding", 1, 4)).alias("first_four"), F.size("embedding").cast("long").alias("dims"),
                    round_half_up(sq_l2(F.slice("embedding", 1, 8), F.slice("embedding", 9, 8)), 6).alias("apart"))


@register("ks_normality")
def q_ks_normality(spark, sf):
    """Kolmogorov-Smirnov normality check of the unit price (beside Jarque-Bera)."""
    return T.ks_normality(st.ratios(spark, sf), "unit_price")
