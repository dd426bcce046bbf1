"""Grouped aggregates: the canned EDA queries and the generic summaries.

Every operator is a single ``groupBy().agg()`` (partial aggregation runs
map-side, so only one row per group and task is shuffled) or a global
``agg``; percentiles come from ``orderstats.quantiles`` (exact, no group held
in one task) unless ``exact=False`` asks for ``percentile_approx``.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from strata.functions.dates import day_name, sql_day_number, weekday_mon0
from strata.functions.numeric import pct, round_half_up
from strata.functions.text import arrow_concat
from strata.operators.orderstats import quantiles, value_count_table


def _approx_quantiles(df, value_col, probs, group_cols, names, accuracy=10000):
    q = F.percentile_approx(F.col(value_col), list(probs), accuracy)
    out = df.groupBy(*group_cols).agg(q.alias("_q"))
    return out.select(*group_cols, *[F.col("_q")[i].alias(n) for i, n in enumerate(names)])


def grouped_quantiles(df, value_col, probs, group_cols, names, exact=True):
    if exact:
        return quantiles(df, value_col, probs, group_cols, names)
    return _approx_quantiles(df, value_col, probs, group_cols, names)


# ---------------------------------------------------------------- rail queries

def delay_by_station(trips: DataFrame, station_col: str = "from_station",
                     delay_col: str = "delay", late_after: float = 5,
                     limit: int = 20, exact: bool = True) -> DataFrame:
    """trips, mean / median / p95 delay, delayed trips and share per station;
    top ``limit`` by mean delay (ties by station name).

    The trips are reduced once to a ``(station, delay, cnt)`` value-count
    table (map-side partial aggregation: delays are whole days, so the table
    is tiny); count, mean, late count and the exact percentiles all come from
    it, so the big join feeding ``trips`` runs once."""
    d = F.col(delay_col)
    if not exact:
        base = trips.groupBy(F.col(station_col).alias("station")).agg(
            F.count(F.lit(1)).alias("trips"), F.avg(d).alias("_avg"),
            F.count_if(d > late_after).alias("delayed_trips"))
        qs = _approx_quantiles(trips.select(F.col(station_col).alias("station"), d.alias("_d")),
                               "_d", [0.5, 0.95], ["station"], ["_med", "_p95"])
    else:
        vc = value_count_table(trips.select(F.col(station_col).alias("station"), d.alias("_d")),
                               "_d", ["station"])
        base = vc.groupBy("station").agg(
            F.sum("cnt").alias("trips"),
            (F.sum(F.col("_d") * F.col("cnt")).cast("double") / F.sum("cnt")).alias("_avg"),
            F.sum(F.when(F.col("_d") > late_after, F.col("cnt")).otherwise(0)).alias("delayed_trips"))
        qs = quantiles(None, "_d", [0.5, 0.95], ["station"], ["_med", "_p95"], counts=vc)
    out = base.join(qs, "station", "left").select(
        "station", "trips",
        round_half_up("_avg", 1).alias("avg_delay"),
        round_half_up("_med", 1).alias("median_delay"),
        round_half_up("_p95", 1).alias("p95_delay"),
        "delayed_trips",
        pct("delayed_trips", "trips", 1).alias("delay_pct"))
    return out.orderBy(F.col("avg_delay").desc(), F.col("station")).limit(limit)


def delay_by_day_of_week(trips: DataFrame, date_col: str = "date", delay_col: str = "delay",
                         late_after: float = 5) -> DataFrame:
    d = F.col(delay_col)
    return (trips.groupBy(day_name(date_col).alias("day_of_week"),
                          sql_day_number(date_col).alias("day_num"))
            .agg(F.count(F.lit(1)).alias("trips"), F.avg(d).alias("_avg"),
                 F.count_if(d > late_after).alias("_late"))
            .select("day_of_week", "day_num", "trips",
                    round_half_up("_avg", 1).alias("avg_delay"),
                    pct("_late", "trips", 1).alias("delay_pct"))
            .orderBy("day_num"))


def worst_routes(trips: DataFrame, from_col: str = "from_station", to_col: str = "to_station",
                 delay_col: str = "delay", min_trips: int = 10, limit: int = 15) -> DataFrame:
    d = F.col(delay_col)
    return (trips.groupBy(from_col, to_col)
            .agg(F.count(F.lit(1)).alias("trips"), F.avg(d).alias("_avg"), F.max(d).alias("_max"))
            .where(F.col("trips") >= min_trips)                       # HAVING
            .select(arrow_concat(from_col, to_col).alias("route"), "trips",
                    round_half_up("_avg", 1).alias("avg_delay"),
                    round_half_up("_max", 1).alias("max_delay"))
            .orderBy(F.col("avg_delay").desc(), F.col("route"))
            .limit(limit))


# --------------------------------------------------------------- churn queries

def churn_by_contract(churn: DataFrame, contract_col: str = "Contract", label_col: str = "Churn",
                      positive: str = "Yes", charges_col: str = "MonthlyCharges",
                      tenure_col: str = "tenure") -> DataFrame:
    return (churn.groupBy(contract_col)
            .agg(F.count(F.lit(1)).alias("customers"),
                 F.count_if(F.col(label_col) == positive).alias("churned"),
                 F.sum(F.col(charges_col).cast("decimal(18,2)")).cast("double").alias("_sum"),
                 F.avg(tenure_col).alias("_ten"))
            .select(contract_col, "customers", "churned",
                    pct("churned", "customers", 1).alias("churn_rate"),
                    round_half_up(F.col("_sum") / F.col("customers"), 2).alias("avg_monthly"),
                    round_half_up("_ten", 1).alias("avg_tenure"))
            .orderBy(F.col("churn_rate").desc(), F.col(contract_col)))


def high_value_at_risk(churn: DataFrame, min_charges: float, min_tenure: int,
                       columns: Sequence[str], key: str = "customerID",
                       label_col: str = "Churn", positive: str = "Yes",
                       charges_col: str = "MonthlyCharges", tenure_col: str = "tenure",
                       limit: int = 20) -> DataFrame:
    """Conjunctive filter + ``ORDER BY charges DESC LIMIT n`` (planned as
    ``TakeOrderedAndProject``: each task keeps its top n, the driver merges
    n × tasks rows)."""
    return (churn.where((F.col(label_col) == positive) & (F.col(charges_col) > min_charges)
                        & (F.col(tenure_col) > min_tenure))
            .select(*columns)
            .orderBy(F.col(charges_col).desc(), F.col(key))
            .limit(limit))


def revenue_impact(churn: DataFrame, label_col: str = "Churn",
                   charges_col: str = "MonthlyCharges", tenure_col: str = "tenure") -> DataFrame:
    return (churn.groupBy(label_col)
            .agg(F.count(F.lit(1)).alias("customers"),
                 F.sum(F.col(charges_col).cast("decimal(18,2)")).cast("double").alias("_sum"),
                 F.avg(tenure_col).alias("_ten"))
            .select(label_col, "customers",
                    round_half_up("_sum", 2).alias("total_monthly_revenue"),
                    round_half_up(F.col("_sum") / F.col("customers"), 2).alias("avg_monthly"),
                    round_half_up("_ten", 1).alias("avg_tenure")))


# ------------------------------------------------------------- generic summaries

def value_counts(df: DataFrame, col: str) -> DataFrame:
    return (df.groupBy(col).agg(F.count(F.lit(1)).alias("count"))
            .orderBy(F.col("count").desc(), F.col(col)))


def value_share(df: DataFrame, col: str, digits: int = 2) -> DataFrame:
    """Share of each value in percent.  The total is a scalar subquery
    (computed once, broadcast as a literal) - no window over all rows."""
    total = df.select(F.count(F.lit(1))).scalar()
    return (df.groupBy(col).agg(F.count(F.lit(1)).alias("count"))
            .select(col, "count", pct(F.col("count"), total, digits).alias("share_pct")))


def crosstab(df: DataFrame, row: str, col: str, values: Sequence | None = None,
             normalize: bool = False, digits: int = 4) -> DataFrame:
    """Counts by ``row`` x ``col`` with the column levels pivoted out (explicit
    ``values`` avoid the extra distinct job); missing cells are 0.  With
    ``normalize`` each row is divided by its total.  A table can't have any number of columns: for
    more than 10,000 levels ``crosstab_long`` has the same cells as rows."""
    if values is None:   # bounded distinct-value job (pivot needs the levels)
        values = [r[0] for r in df.select(col).distinct().orderBy(col).limit(10_001).collect()]
        if len(values) > 10_000:
            raise ValueError("too many pivot levels; pass values explicitly")
    counts = (df.groupBy(row).pivot(col, list(values)).agg(F.count(F.lit(1)))
              .na.fill(0, subset=[str(v) for v in values]))
    names = [str(v) for v in values]
    counts = counts.select(row, *[F.col(f"`{n}`").cast("long").alias(n) for n in names])
    if not normalize:
        return counts
    total = sum((F.col(f"`{n}`") for n in names), F.lit(0))
    return counts.select(row, *[round_half_up(F.col(f"`{n}`") / total, digits).alias(n)
                                for n in names])


def crosstab_long(df: DataFrame, row: str, col: str, normalize: bool = False, digits: int = 4) -> DataFrame:
    """The cells of a crosstab that aren't 0, one row each: ``row``, ``col``, ``count``, and with ``normalize``
    the ``share`` of its row.  Any number of levels on either side."""
    cells = df.groupBy(row, col).agg(F.count(F.lit(1)).alias("count"))
    if not normalize:
        return cells
    totals = cells.groupBy(F.col(row).alias("_row")).agg(F.sum("count").alias("_n"))
    return cells.join(totals, F.col(row).eqNullSafe(F.col("_row"))).select(
        row, col, "count", round_half_up(F.col("count") / F.col("_n"), digits).alias("share"))


def grouped_counts(df: DataFrame, cols: Sequence[str]) -> DataFrame:
    return df.groupBy(*cols).agg(F.count(F.lit(1)).alias("count"))


def daily_series(df: DataFrame, date_col: str, value_col: str, window_rows: int = 7,
                 exact: bool = True) -> DataFrame:
    """Mean, median and count per day plus a ``window_rows``-row trailing mean
    of the daily mean (``min_periods=1``).  Exact mode builds one
    ``(day, value, cnt)`` table and derives all three statistics from it;
    the trailing window runs on the daily table (one row per day, a bounded
    series), never on raw rows."""
    if exact:
        vc = value_count_table(df.select(F.col(date_col).alias("day"), F.col(value_col).alias("_v")),
                               "_v", ["day"])
        daily = vc.groupBy("day").agg(
            (F.sum(F.col("_v") * F.col("cnt")).cast("double") / F.sum("cnt")).alias("mean"),
            F.sum("cnt").alias("count"))
        med = quantiles(None, "_v", [0.5], ["day"], ["median"], counts=vc)
    else:
        daily = df.groupBy(F.col(date_col).alias("day")).agg(
            F.avg(value_col).alias("mean"), F.count(F.lit(1)).alias("count"))
        med = _approx_quantiles(df.select(F.col(date_col).alias("day"), F.col(value_col).alias("_v")),
                                "_v", [0.5], ["day"], ["median"])
    w = Window.orderBy("day").rowsBetween(-(window_rows - 1), 0)
    return (daily.join(med, "day", "left")
            .select(F.date_format("day", "yyyy-MM-dd").alias("day"),
                    round_half_up("mean", 4).alias("mean"),
                    round_half_up("median", 4).alias("median"), "count",
                    round_half_up(F.avg("mean").over(w), 4).alias("rolling_mean_7")))


def seasonality(df: DataFrame, value_col: str, part: str, ts_col: str) -> DataFrame:
    """Mean of ``value_col`` by weekday (0 = Monday) or by hour."""
    key = weekday_mon0(ts_col) if part == "dow" else F.hour(ts_col)
    name = "dow" if part == "dow" else "hour"
    return (df.groupBy(key.alias(name)).agg(F.avg(value_col).alias("_m"), F.count(F.lit(1)).alias("n"))
            .select(name, round_half_up("_m", 4).alias(f"mean_{value_col}"), "n")
            .orderBy(name))


def pivot_dow_hour(df: DataFrame, ts_col: str, value_col: str) -> DataFrame:
    """Weekday x hour mean; the 24 hour levels are given explicitly so the
    pivot needs no extra distinct job."""
    hours = list(range(24))
    base = df.select(weekday_mon0(ts_col).alias("dow"), F.hour(ts_col).alias("_h"),
                     F.col(value_col).alias("_v"))
    p = base.groupBy("dow").pivot("_h", hours).agg(F.avg("_v"))
    return p.select("dow", *[round_half_up(F.col(str(h)), 4).alias(f"h{h:02d}") for h in hours])


def group_sum_weighted(df: DataFrame, group_col: str, value_col: str) -> DataFrame:
    """Treemap rollup: sum of value and value-weighted mean of value per group."""
    v = F.col(value_col)
    return (df.groupBy(group_col)
            .agg(F.sum(v).alias("_s"), F.sum(v * v).alias("_ss"), F.count(F.lit(1)).alias("n"))
            .select(group_col, "n", round_half_up("_s", 4).alias("total"),
                    round_half_up(F.try_divide(F.col("_ss"), F.col("_s")), 4).alias("weighted_mean")))


def distinct_values(df: DataFrame, col: str) -> DataFrame:
    return df.select(col).distinct()


def group_mean_max(df: DataFrame, group_col: str, cols: Sequence[str], digits: int = 4) -> DataFrame:
    aggs = []
    for c in cols:
        aggs += [round_half_up(F.avg(c), digits).alias(f"mean_{c}"), F.max(c).alias(f"max_{c}")]
    return df.groupBy(group_col).agg(*aggs)
