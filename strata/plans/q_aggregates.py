"""Registered aggregate queries with their DuckDB oracles."""

from __future__ import annotations

from pyspark.sql import functions as F

from strata.operators import aggregates as agg
from strata.plans import standins as st
from strata.plans.catalog import register
from strata.sources.tables import read_table


def _r(expr: str, digits: int) -> str:
    """SQL twin of ``round_half_up``."""
    scale = 10 ** digits
    return f"(SIGN(({expr})) * FLOOR(ABS(({expr})) * {scale} + 0.5) / {scale})"


def _pct(num: str, den: str, digits: int = 1) -> str:
    scale = 10 ** digits
    return f"FLOOR({100 * scale}.0::DOUBLE * ({num}) / ({den}) + 0.5) / {scale}"


LATE = "delay > 5"


@register("delay_by_station", headline=True, sql=f"""
WITH {st.RAIL_SQL}
SELECT from_station AS station, COUNT(*) AS trips,
       {_r('AVG(delay)', 1)} AS avg_delay,
       {_r('quantile_cont(delay, 0.5)', 1)} AS median_delay,
       {_r('quantile_cont(delay, 0.95)', 1)} AS p95_delay,
       COUNT(*) FILTER (WHERE {LATE}) AS delayed_trips,
       {_pct(f'COUNT(*) FILTER (WHERE {LATE})', 'COUNT(*)')} AS delay_pct
FROM rail GROUP BY from_station
ORDER BY avg_delay DESC, station LIMIT 20""")
def q_delay_by_station(spark, sf):
    return agg.delay_by_station(st.rail(spark, sf))


@register("delay_by_day_of_week", headline=True, sql=f"""
WITH {st.RAIL_SQL}
SELECT dayname(date) AS day_of_week, dayofweek(date) AS day_num, COUNT(*) AS trips,
       {_r('AVG(delay)', 1)} AS avg_delay,
       {_pct(f'COUNT(*) FILTER (WHERE {LATE})', 'COUNT(*)')} AS delay_pct
FROM rail GROUP BY 1, 2""")
def q_delay_by_dow(spark, sf):
    return agg.delay_by_day_of_week(st.rail(spark, sf)).withColumn(
        "day_num", F.col("day_num").cast("long"))


@register("worst_routes", headline=True, sql=f"""
WITH {st.RAIL_SQL}
SELECT from_station || ' → ' || to_station AS route, COUNT(*) AS trips,
       {_r('AVG(delay)', 1)} AS avg_delay, {_r('MAX(delay)', 1)} AS max_delay
FROM rail GROUP BY from_station, to_station HAVING COUNT(*) >= 10
ORDER BY avg_delay DESC, route LIMIT 15""")
def q_worst_routes(spark, sf):
    return agg.worst_routes(st.rail(spark, sf))


@register("churn_by_contract", sql=f"""
WITH {st.CHURN_SQL}
SELECT Contract, COUNT(*) AS customers, COUNT(*) FILTER (WHERE Churn = 'Yes') AS churned,
       {_pct("COUNT(*) FILTER (WHERE Churn = 'Yes')", 'COUNT(*)')} AS churn_rate,
       {_r('CAST(SUM(CAST(MonthlyCharges AS DECIMAL(18,2))) AS DOUBLE) / COUNT(*)', 2)} AS avg_monthly,
       {_r('AVG(tenure)', 1)} AS avg_tenure
FROM churn GROUP BY Contract""")
def q_churn_by_contract(spark, sf):
    return agg.churn_by_contract(st.churn(spark, sf))


@register("revenue_impact", sql=f"""
WITH {st.CHURN_SQL}
SELECT Churn, COUNT(*) AS customers,
       {_r('CAST(SUM(CAST(MonthlyCharges AS DECIMAL(18,2))) AS DOUBLE)', 2)} AS total_monthly_revenue,
       {_r('CAST(SUM(CAST(MonthlyCharges AS DECIMAL(18,2))) AS DOUBLE) / COUNT(*)', 2)} AS avg_monthly,
       {_r('AVG(tenure)', 1)} AS avg_tenure
FROM churn GROUP BY Churn""")
def q_revenue_impact(spark, sf):
    return agg.revenue_impact(st.churn(spark, sf))


@register("value_counts", sql="""
SELECT event_type, COUNT(*) AS count FROM events GROUP BY event_type""")
def q_value_counts(spark, sf):
    return agg.value_counts(read_table(spark, sf, "events"), "event_type")


@register("value_share", sql=f"""
WITH {st.CHURN_SQL}
SELECT Churn, COUNT(*) AS count, {_pct('COUNT(*)', '(SELECT COUNT(*) FROM churn)', 2)} AS share_pct
FROM churn GROUP BY Churn""")
def q_value_share(spark, sf):
    return agg.value_share(st.churn(spark, sf), "Churn")


@register("crosstab", sql=f"""
WITH {st.CHURN_SQL}
SELECT Contract, COUNT(*) FILTER (WHERE Churn = 'No') AS "No",
       COUNT(*) FILTER (WHERE Churn = 'Yes') AS "Yes"
FROM churn GROUP BY Contract""")
def q_crosstab(spark, sf):
    return agg.crosstab(st.churn(spark, sf), "Contract", "Churn", ["No", "Yes"])


@register("crosstab_normalized", sql=f"""
WITH {st.CHURN_SQL}, ct AS (
  SELECT Contract, COUNT(*) FILTER (WHERE Churn = 'No') AS n_no,
         COUNT(*) FILTER (WHERE Churn = 'Yes') AS n_yes FROM churn GROUP BY Contract)
SELECT Contract, {_r('n_no / (n_no + n_yes)', 4)} AS "No", {_r('n_yes / (n_no + n_yes)', 4)} AS "Yes"
FROM ct""")
def q_crosstab_normalized(spark, sf):
    return agg.crosstab(st.churn(spark, sf), "Contract", "Churn", ["No", "Yes"], normalize=True)


@register("crosstab_long", sql=f"""
WITH c AS (SELECT user_id, event_type, COUNT(*) AS count FROM events GROUP BY user_id, event_type)
SELECT user_id, event_type, count, {_r('count / SUM(count) OVER (PARTITION BY user_id)', 4)} AS share FROM c""")
def q_crosstab_long(spark, sf):
    """Users by event type: as many levels as there are users."""
    return agg.crosstab_long(read_table(spark, sf, "events"), "user_id", "event_type", normalize=True)


@register("grouped_countplot", sql=f"""
WITH {st.RAIL_SQL}
SELECT line, type, delay > 15 AS late, COUNT(*) AS count FROM rail GROUP BY 1, 2, 3""")
def q_grouped_countplot(spark, sf):
    trips = st.rail(spark, sf).withColumn("late", F.col("delay") > 15)
    return agg.grouped_counts(trips, ["line", "type", "late"])


@register("daily_series", headline=True, sql=f"""
WITH {st.RAIL_SQL}, d AS (
  SELECT date AS day, AVG(delay) AS mean, quantile_cont(delay, 0.5) AS median, COUNT(*) AS count
  FROM rail GROUP BY date)
SELECT strftime(day, '%Y-%m-%d') AS day, {_r('mean', 4)} AS mean, {_r('median', 4)} AS median, count,
       {_r('AVG(mean) OVER (ORDER BY day ROWS BETWEEN 6 PRECEDING AND CURRENT ROW)', 4)} AS rolling_mean_7
FROM d""")
def q_daily_series(spark, sf):
    return agg.daily_series(st.rail(spark, sf), "date", "delay")


@register("seasonality_dow", sql=f"""
SELECT CAST(isodow(ts) - 1 AS INTEGER) AS dow, {_r('AVG(value)', 4)} AS mean_value, COUNT(*) AS n
FROM events GROUP BY 1""")
def q_seasonality_dow(spark, sf):
    return agg.seasonality(read_table(spark, sf, "events"), "value", "dow", "ts")


@register("seasonality_hour", sql=f"""
SELECT CAST(hour(ts) AS INTEGER) AS hour, {_r('AVG(value)', 4)} AS mean_value, COUNT(*) AS n
FROM events GROUP BY 1""")
def q_seasonality_hour(spark, sf):
    return agg.seasonality(read_table(spark, sf, "events"), "value", "hour", "ts")


_HOURS = ",\n       ".join(
    f"{_r(f'AVG(value) FILTER (WHERE hour(ts) = {h})', 4)} AS h{h:02d}" for h in range(24))


@register("pivot_dow_hour", sql=f"""
SELECT CAST(isodow(ts) - 1 AS INTEGER) AS dow,
       {_HOURS}
FROM events GROUP BY 1""")
def q_pivot_dow_hour(spark, sf):
    return agg.pivot_dow_hour(read_table(spark, sf, "events"), "ts", "value")


@register("group_sum_by_region", sql=f"""
WITH {st.POINTS_SQL}
SELECT region, COUNT(*) AS n, {_r('SUM(value)', 4)} AS total,
       {_r('SUM(value * value) / SUM(value)', 4)} AS weighted_mean
FROM points GROUP BY region""")
def q_group_sum_by_region(spark, sf):
    return agg.group_sum_weighted(st.points(spark, sf), "region", "value")


@register("distinct_values", sql="SELECT DISTINCT lang FROM documents")
def q_distinct_values(spark, sf):
    return agg.distinct_values(read_table(spark, sf, "documents"), "lang")


@register("group_mean_max", sql=f"""
WITH {st.RATIOS_SQL}
SELECT label, {_r('AVG(l_quantity)', 4)} AS mean_l_quantity, MAX(l_quantity) AS max_l_quantity,
       {_r('AVG(l_discount)', 4)} AS mean_l_discount, MAX(l_discount) AS max_l_discount
FROM ratios GROUP BY label""")
def q_group_mean_max(spark, sf):
    return agg.group_mean_max(st.ratios(spark, sf), "label", ["l_quantity", "l_discount"])
