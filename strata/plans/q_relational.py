"""Registered projection / filter / join / ordering / sampling queries
(SURVEY §2.2, 2.3, 2.6, 2.7) with their DuckDB oracles."""

from __future__ import annotations

from pyspark.sql import functions as F

from strata.operators import joins as J
from strata.operators import relational as R
from strata.operators import sampling as S
from strata.plans import standins as st
from strata.plans.catalog import register
from strata.sources.tables import read_table

SEED = 42


def _md5(key_sql: str) -> str:
    return f"md5(CAST({key_sql} AS VARCHAR) || '#{SEED}')"


@register("drop_columns", sql=f"""
WITH {st.RAIL_SQL}
SELECT train_id, stop_sequence, from_station, to_station, delay, line FROM rail""")
def q_drop_columns(spark, sf):
    return R.drop_columns(st.rail(spark, sf),
                          ["date", "scheduled_time", "actual_time", "type", "not_a_column"])


@register("select_numeric", sql=f"""
WITH {st.CHURN_SQL}
SELECT customerID, tenure, MonthlyCharges, TotalCharges, n_orders FROM churn""")
def q_select_numeric(spark, sf):
    return R.select_numeric(st.churn(spark, sf))


@register("select_by_name", sql=f"""
WITH {st.TRADING_SQL}
SELECT feature_0, feature_1, feature_2 FROM trading""")
def q_select_by_name(spark, sf):
    return R.select_by_name(st.trading(spark, sf), "feature")


@register("drop_constant", sql="""
SELECT event_id, user_id, value, props FROM events WHERE event_type = 'click'""")
def q_drop_constant(spark, sf):
    ev = read_table(spark, sf, "events").select("event_id", "user_id", "event_type", "value", "props")
    return R.drop_constant(ev.where(F.col("event_type") == "click"))


@register("drop_constant_all", sql="""
SELECT event_id, user_id, event_type, value, props FROM events""")
def q_drop_constant_all(spark, sf):
    """``drop_constant`` over every event, with a column that is constant."""
    ev = read_table(spark, sf, "events").select("event_id", "user_id", "event_type", "value", "props")
    return R.drop_constant(ev.withColumn("source", F.lit("events")))


@register("filter_compare", sql=f"""
WITH {st.TRADING_SQL}
SELECT ts_id, date, weight, resp FROM trading WHERE weight <> 0 AND date > 15""")
def q_filter_compare(spark, sf):
    t = st.trading(spark, sf).select("ts_id", "date", "weight", "resp")
    return R.filter_compare(t, [("weight", "!=", 0), ("date", ">", 15)])


@register("high_value_at_risk", sql=f"""
WITH {st.CHURN_SQL}
SELECT customerID, Contract, tenure, MonthlyCharges, region, n_orders FROM churn
WHERE Churn = 'Yes' AND MonthlyCharges > 5000 AND tenure > 12
ORDER BY MonthlyCharges DESC, customerID LIMIT 20""")
def q_high_value_at_risk(spark, sf):
    from strata.operators.aggregates import high_value_at_risk
    return high_value_at_risk(st.churn(spark, sf), 5000, 12,
                              ["customerID", "Contract", "tenure", "MonthlyCharges", "region", "n_orders"])


@register("filter_region_range", sql=f"""
WITH {st.POINTS_SQL}
SELECT id, region, value FROM points WHERE region = 'North' AND value BETWEEN -5 AND 5""")
def q_filter_region_range(spark, sf):
    p = st.points(spark, sf).select("id", "region", "value")
    return R.filter_region_range(p, "region", "North", "value", -5.0, 5.0)


@register("filter_by_cluster", sql=f"""
WITH {st.POINTS_SQL}
SELECT id, label, x, y FROM points WHERE label = 3""")
def q_filter_by_cluster(spark, sf):
    return R.filter_by_cluster(st.points(spark, sf).select("id", "label", "x", "y"), "label", 3)


@register("threshold_flag", sql=f"""
WITH {st.RAIL_SQL}
SELECT train_id, stop_sequence, delay > 15 AS late FROM rail""")
def q_threshold_flag(spark, sf):
    return R.threshold_flag(st.rail(spark, sf), "delay", 15, "late") \
        .select("train_id", "stop_sequence", "late")


@register("product_sign_label", sql=f"""
WITH {st.TRADING_SQL}
SELECT ts_id, CAST(weight * resp > 0 AS INTEGER) AS action FROM trading""")
def q_product_sign_label(spark, sf):
    return R.product_sign_label(st.trading(spark, sf), "weight", "resp").select("ts_id", "action")


@register("not_equal_label", sql="""
SELECT o_orderkey, CAST(o_orderstatus <> 'F' AS INTEGER) AS label FROM orders""")
def q_not_equal_label(spark, sf):
    return R.not_equal_label(read_table(spark, sf, "orders"), "o_orderstatus", "F") \
        .select("o_orderkey", "label")


@register("map_values", sql=f"""
WITH {st.CHURN_SQL}
SELECT customerID, CASE Churn WHEN 'Yes' THEN 1 WHEN 'No' THEN 0 END AS churn_flag FROM churn""")
def q_map_values(spark, sf):
    return R.map_values(st.churn(spark, sf), "Churn", {"Yes": 1, "No": 0}, "churn_flag") \
        .select("customerID", "churn_flag")


@register("downcast", sql=f"""
WITH {st.RATIOS_SQL}
SELECT l_orderkey, l_linenumber, CAST(l_quantity AS FLOAT) AS l_quantity,
       CAST(l_extendedprice AS FLOAT) AS l_extendedprice, CAST(l_discount AS FLOAT) AS l_discount,
       CAST(l_tax AS FLOAT) AS l_tax, CAST(unit_price AS FLOAT) AS unit_price, label
FROM ratios""")
def q_downcast(spark, sf):
    return R.downcast(st.ratios(spark, sf))


@register("rename", sql=f"""
WITH {st.RAIL_SQL}
SELECT train_id, from_station AS "from", to_station AS "to", delay AS delay_days FROM rail""")
def q_rename(spark, sf):
    r = st.rail(spark, sf).select("train_id", "from_station", "to_station", "delay")
    return R.rename(r, {"from_station ": "from", "to_station": "to", "delay": "delay_days"})


@register("resolve_target", sql="""
SELECT toxic AS target, COUNT(*) AS count FROM labels GROUP BY toxic""")
def q_resolve_target(spark, sf):
    lab = read_table(spark, sf, "labels")
    t = R.resolve_target(lab, ("target", "output"))
    return lab.groupBy(F.col(t).alias("target")).agg(F.count(F.lit(1)).alias("count"))


CHURN_RULES = [R.Rule("TotalCharges"), R.Rule("tenure", ge=0, le=72),
               R.Rule("MonthlyCharges", ge=0, le=8000)]


@register("validate_record", sql=f"""
WITH {st.CHURN_SQL}, v AS (
  SELECT customerID, concat_ws(';',
      CASE WHEN TotalCharges IS NULL THEN 'TotalCharges:missing' END,
      CASE WHEN tenure IS NULL THEN 'tenure:missing' END,
      CASE WHEN tenure < 0 THEN 'tenure:<0' END,
      CASE WHEN tenure > 72 THEN 'tenure:>72' END,
      CASE WHEN MonthlyCharges IS NULL THEN 'MonthlyCharges:missing' END,
      CASE WHEN MonthlyCharges < 0 THEN 'MonthlyCharges:<0' END,
      CASE WHEN MonthlyCharges > 8000 THEN 'MonthlyCharges:>8000' END) AS violations
  FROM churn)
SELECT customerID, violations = '' AS is_valid, violations FROM v""")
def q_validate_record(spark, sf):
    v = R.validate_records(st.churn(spark, sf), CHURN_RULES)
    return v.select("customerID", "is_valid", F.array_join("violations", ";").alias("violations"))


@register("attach_labels", sql=f"""
WITH {st.CHURN_SQL}
SELECT o.o_orderkey, c.Churn FROM orders o LEFT JOIN churn c ON o.o_custkey = c.customerID""")
def q_attach_labels(spark, sf):
    labels = st.churn(spark, sf).select(F.col("customerID").alias("o_custkey"), "Churn")
    o = read_table(spark, sf, "orders").select("o_orderkey", "o_custkey")
    return J.attach_labels(o, labels, "o_custkey").select("o_orderkey", "Churn")


@register("align_schema", sql=f"""
WITH {st.CHURN_SQL}
SELECT customerID, tenure, MonthlyCharges, 0.0::DOUBLE AS PaperlessBilling_Yes FROM churn""")
def q_align_schema(spark, sf):
    c = st.churn(spark, sf).select("customerID", "tenure", "MonthlyCharges", "Contract")
    return J.align_schema(c, ["customerID", "tenure", "MonthlyCharges", "PaperlessBilling_Yes"])


@register("star_delay", sql=f"""
WITH {st.RAIL_SQL}
SELECT train_id, stop_sequence, from_station, to_station, delay FROM rail""")
def q_star_delay(spark, sf):
    return st.rail(spark, sf).select("train_id", "stop_sequence", "from_station", "to_station", "delay")


@register("order_limit", sql="""
SELECT event_id, user_id, value FROM events ORDER BY value DESC, event_id LIMIT 10""")
def q_order_limit(spark, sf):
    ev = read_table(spark, sf, "events").select("event_id", "user_id", "value")
    return S.order_limit(ev, "value", 10, "event_id")


@register("head_sample", sql=f"""
WITH {st.CHURN_SQL}
SELECT customerID, Churn FROM churn ORDER BY {_md5('customerID')}, customerID LIMIT 100""")
def q_head_sample(spark, sf):
    return S.head_sample(st.churn(spark, sf).select("customerID", "Churn"), 100, "customerID", SEED)


@register("random_sample", sql=f"""
SELECT event_id, value FROM events
WHERE substr({_md5('event_id')}, 1, 8) < '{int(0.05 * 16 ** 8):08x}'""")
def q_random_sample(spark, sf):
    ev = read_table(spark, sf, "events").select("event_id", "value")
    return S.fraction_sample(ev, 0.05, "event_id", SEED)


@register("duplicated_rows", sql="""
SELECT md5(text) AS text_md5, COUNT(*) AS copies FROM documents GROUP BY text HAVING COUNT(*) > 1""")
def q_duplicated_rows(spark, sf):
    docs = read_table(spark, sf, "documents").select("text")
    return S.duplicate_texts(docs, "text").select(F.md5("text").alias("text_md5"), "copies")


@register("duplicate_count", sql="""
SELECT CAST(COALESCE(SUM(c - 1), 0) AS BIGINT) AS duplicates
FROM (SELECT COUNT(*) AS c FROM lineitem GROUP BY ALL_COLUMNS_PLACEHOLDER HAVING COUNT(*) > 1)""".replace(
    "ALL_COLUMNS_PLACEHOLDER",
    "l_orderkey, l_partkey, l_suppkey, l_linenumber, l_quantity, l_extendedprice, l_discount, "
    "l_tax, l_returnflag, l_linestatus, l_shipdate"))
def q_duplicate_count(spark, sf):
    return S.count_duplicates(read_table(spark, sf, "lineitem"))


_RANK_IN_CLASS = ("ROW_NUMBER() OVER (PARTITION BY Churn ORDER BY "
                  f"{_md5('customerID')} || CAST(customerID AS VARCHAR)) - 1")


@register("stratified_split", sql=f"""
WITH {st.CHURN_SQL}, r AS (
  SELECT customerID, Churn, {_RANK_IN_CLASS} AS rk,
         COUNT(*) OVER (PARTITION BY Churn) AS n_c FROM churn)
SELECT customerID, Churn, rk < FLOOR(n_c * 0.2::DOUBLE + 0.5) AS is_test FROM r""")
def q_stratified_split(spark, sf):
    c = st.churn(spark, sf).select("customerID", "Churn")
    return S.stratified_split(c, "Churn", "customerID", 0.2, SEED)


@register("stratified_kfold", sql=f"""
WITH {st.CHURN_SQL}
SELECT customerID, Churn, CAST(({_RANK_IN_CLASS}) % 5 AS INTEGER) AS fold FROM churn""")
def q_stratified_kfold(spark, sf):
    c = st.churn(spark, sf).select("customerID", "Churn")
    return S.stratified_kfold(c, "Churn", "customerID", 5, SEED)


@register("plain_cv", sql=f"""
WITH {st.CHURN_SQL}, r AS (
  SELECT customerID, Churn, ROW_NUMBER() OVER (PARTITION BY Churn ORDER BY customerID) - 1 AS rk,
         COUNT(*) OVER (PARTITION BY Churn) AS n_c FROM churn)
SELECT customerID, Churn, CAST(FLOOR(rk * 5 / n_c) AS INTEGER) AS fold FROM r""")
def q_plain_cv(spark, sf):
    c = st.churn(spark, sf).select("customerID", "Churn")
    return S.stratified_kfold(c, "Churn", "customerID", 5, SEED, shuffle=False)


_TS_PROBS = [i / 6 for i in range(1, 6)]


@register("time_series_split", sql=f"""
WITH {st.TRADING_SQL}, cuts AS (
  SELECT {", ".join(f"quantile_cont(date, {p!r}::DOUBLE) AS b{i}" for i, p in enumerate(_TS_PROBS, 1))}
  FROM trading)
SELECT ts_id, date, {" + ".join(f"CAST(date > b{i} AS INTEGER)" for i in range(1, 6))} AS block
FROM trading, cuts""")
def q_time_series_split(spark, sf):
    t = st.trading(spark, sf).select("ts_id", "date")
    return S.time_series_split(t, "date", 5)


@register("sql_query", sql="""
SELECT l_returnflag, l_linestatus, COUNT(*) AS n, CAST(SUM(l_quantity) AS DOUBLE) AS sum_qty
FROM lineitem WHERE l_discount > 0.02 GROUP BY l_returnflag, l_linestatus""")
def q_sql_query(spark, sf):
    """``query(sql)``: the tables registered as temp views, a SQL string run by Spark."""
    from strata.sources.files import sql
    from strata.sources.tables import register_tables
    register_tables(spark, sf)
    return sql(spark, """
        SELECT l_returnflag, l_linestatus, COUNT(*) AS n, CAST(SUM(l_quantity) AS DOUBLE) AS sum_qty
        FROM lineitem WHERE l_discount > 0.02 GROUP BY l_returnflag, l_linestatus""")
