"""Stand-in domain tables derived by Spark from the test data.

The operators are written for the domains of the analyses they come from
(rail delays, telecom churn, trading rows, financial ratios, geo points,
embeddings).  The test data is a TPC-H-like star schema, so each domain is
*derived* from it with joins and aggregates; the work therefore grows with
the input tables.  Each builder has an equivalent SQL CTE (DuckDB dialect)
used by the oracle check.

Scale notes
-----------
* ``rail``: lineitem ⋈ orders is the one big-big join (shuffle on orderkey,
  or none when both sides are bucketed on it, see ``sources.files``).
  customer/supplier are first reduced to ``key -> nation name`` (nation has
  25 rows: a proven bound, so it is broadcast); the key maps are joined
  without hints so AQE picks broadcast only when the *measured* size fits.
* ``churn``: orders are pre-aggregated per customer (map-side partial agg)
  before the customer join, so the join sees one row per customer.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from strata.sources.tables import read_table

# Fixed parameters of the stand-in derivations.
CHURN_GAP_DAYS = 365      # no order in the last year -> churned
TENURE_DAYS_PER_MONTH = 30
REGIONS4 = ["North", "South", "Central", "Coast"]


def rail(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Trips: one row per lineitem.

    Columns: train_id, stop_sequence, from_station, to_station, date,
    scheduled_time, actual_time, delay (days, int), line, type.
    """
    li = read_table(spark, sf_dir, "lineitem").select(
        "l_orderkey", "l_linenumber", "l_suppkey", "l_shipdate", "l_returnflag", "l_linestatus")
    o = read_table(spark, sf_dir, "orders").select("o_orderkey", "o_custkey", "o_orderdate")
    nation = read_table(spark, sf_dir, "nation").select("n_nationkey", "n_name")
    cust_nation = (read_table(spark, sf_dir, "customer").select("c_custkey", "c_nationkey")
                   .join(nation, F.col("c_nationkey") == F.col("n_nationkey"))
                   .select("c_custkey", F.col("n_name").alias("to_station")))
    supp_nation = (read_table(spark, sf_dir, "supplier").select("s_suppkey", "s_nationkey")
                   .join(nation, F.col("s_nationkey") == F.col("n_nationkey"))
                   .select("s_suppkey", F.col("n_name").alias("from_station")))
    return (
        li.join(o, F.col("l_orderkey") == F.col("o_orderkey"))
        .join(cust_nation, F.col("o_custkey") == F.col("c_custkey"))
        .join(supp_nation, F.col("l_suppkey") == F.col("s_suppkey"))
        .select(
            F.col("l_orderkey").alias("train_id"),
            F.col("l_linenumber").alias("stop_sequence"),
            "from_station", "to_station",
            F.to_date("o_orderdate").alias("date"),
            F.col("o_orderdate").alias("scheduled_time"),
            F.col("l_shipdate").alias("actual_time"),
            F.datediff(F.to_date("l_shipdate"), F.to_date("o_orderdate")).alias("delay"),
            F.col("l_returnflag").alias("line"),
            F.col("l_linestatus").alias("type"),
        )
    )


RAIL_SQL = """rail AS (
  SELECT l.l_orderkey AS train_id, l.l_linenumber AS stop_sequence,
         sn.n_name AS from_station, cn.n_name AS to_station,
         CAST(o.o_orderdate AS DATE) AS date,
         o.o_orderdate AS scheduled_time, l.l_shipdate AS actual_time,
         CAST(date_diff('day', CAST(o.o_orderdate AS DATE), CAST(l.l_shipdate AS DATE)) AS INTEGER) AS delay,
         l.l_returnflag AS line, l.l_linestatus AS type
  FROM lineitem l
  JOIN orders o ON l.l_orderkey = o.o_orderkey
  JOIN customer c ON o.o_custkey = c.c_custkey
  JOIN nation cn ON c.c_nationkey = cn.n_nationkey
  JOIN supplier s ON l.l_suppkey = s.s_suppkey
  JOIN nation sn ON s.s_nationkey = sn.n_nationkey)"""


def churn(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Customers with a churn label.

    Columns: customerID, Contract, region, tenure (months), MonthlyCharges,
    TotalCharges, n_orders, Churn ('Yes'/'No').
    """
    orders = read_table(spark, sf_dir, "orders")
    ref = orders.select(F.max(F.to_date("o_orderdate"))).scalar()   # scalar subquery
    per = (orders.groupBy("o_custkey").agg(
        F.min(F.to_date("o_orderdate")).alias("first_order"),
        F.max(F.to_date("o_orderdate")).alias("last_order"),
        F.count(F.lit(1)).alias("n_orders"),
        F.sum(F.col("o_totalprice").cast("decimal(18,2)")).cast("double").alias("TotalCharges")))
    nation = read_table(spark, sf_dir, "nation").select("n_nationkey", "n_name")
    cust = read_table(spark, sf_dir, "customer").select(
        "c_custkey", "c_nationkey", "c_acctbal", "c_mktsegment")
    return (
        cust.join(nation, F.col("c_nationkey") == F.col("n_nationkey"), "left")
        .join(per, F.col("c_custkey") == F.col("o_custkey"), "left")
        .select(
            F.col("c_custkey").alias("customerID"),
            F.col("c_mktsegment").alias("Contract"),
            F.col("n_name").alias("region"),
            F.coalesce(F.expr(f"datediff(last_order, first_order) div {TENURE_DAYS_PER_MONTH}"),
                       F.lit(0).cast("long")).alias("tenure"),
            F.col("c_acctbal").alias("MonthlyCharges"),
            "TotalCharges",
            F.coalesce("n_orders", F.lit(0).cast("long")).alias("n_orders"),
            F.when(F.col("last_order").isNull()
                   | (F.datediff(ref, F.col("last_order")) > CHURN_GAP_DAYS), F.lit("Yes"))
            .otherwise(F.lit("No")).alias("Churn"),
        )
    )


CHURN_SQL = f"""churn_per AS (
  SELECT o_custkey, MIN(CAST(o_orderdate AS DATE)) AS first_order,
         MAX(CAST(o_orderdate AS DATE)) AS last_order, COUNT(*) AS n_orders,
         CAST(SUM(CAST(o_totalprice AS DECIMAL(18,2))) AS DOUBLE) AS TotalCharges
  FROM orders GROUP BY o_custkey),
churn AS (
  SELECT c.c_custkey AS customerID, c.c_mktsegment AS Contract, n.n_name AS region,
         COALESCE(date_diff('day', p.first_order, p.last_order) // {TENURE_DAYS_PER_MONTH}, 0) AS tenure,
         c.c_acctbal AS MonthlyCharges, p.TotalCharges,
         COALESCE(p.n_orders, 0) AS n_orders,
         CASE WHEN p.last_order IS NULL
                OR date_diff('day', p.last_order, (SELECT MAX(CAST(o_orderdate AS DATE)) FROM orders)) > {CHURN_GAP_DAYS}
              THEN 'Yes' ELSE 'No' END AS Churn
  FROM customer c
  LEFT JOIN nation n ON c.c_nationkey = n.n_nationkey
  LEFT JOIN churn_per p ON c.c_custkey = p.o_custkey)"""


def scored(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(id, label, score) table for the evaluation operators.

    ``score = 1 / (1 + n_orders)``: a fixed, SQL-reproducible risk score with
    many ties (exercises tie handling in every curve/threshold operator)."""
    c = churn(spark, sf_dir)
    return c.select(
        F.col("customerID").alias("id"),
        F.when(F.col("Churn") == "Yes", 1).otherwise(0).alias("label"),
        (F.lit(1.0) / (F.col("n_orders") + F.lit(1))).alias("score"),
        "MonthlyCharges", "tenure", "Contract",
    )


SCORED_SQL = CHURN_SQL + """,
scored AS (
  SELECT customerID AS id, CASE WHEN Churn = 'Yes' THEN 1 ELSE 0 END AS label,
         1.0::DOUBLE / (n_orders + 1) AS score, MonthlyCharges, tenure, Contract
  FROM churn)"""


def trading(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Trading-like rows from ``events``.

    Columns: ts_id, date (day index), weight, resp, feature_0..2, event_type, user_id, ts.
    """
    ev = read_table(spark, sf_dir, "events")
    t0 = ev.select(F.min(F.to_date("ts"))).scalar()
    k = F.get_json_object("props", "$.k").cast("int")
    return ev.select(
        F.col("event_id").alias("ts_id"),
        F.datediff(F.to_date("ts"), t0).alias("date"),
        F.col("value").alias("weight"),
        ((k - F.lit(50)).cast("double") / F.lit(100.0)).alias("resp"),
        F.col("value").alias("feature_0"),
        k.cast("double").alias("feature_1"),
        F.hour("ts").cast("double").alias("feature_2"),
        "event_type", "user_id", "ts",
    )


TRADING_SQL = """trading AS (
  SELECT event_id AS ts_id,
         CAST(date_diff('day', (SELECT MIN(CAST(ts AS DATE)) FROM events), CAST(ts AS DATE)) AS INTEGER) AS date,
         value AS weight,
         CAST(CAST(json_extract_string(props, '$.k') AS INTEGER) - 50 AS DOUBLE) / 100.0::DOUBLE AS resp,
         value AS feature_0,
         CAST(CAST(json_extract_string(props, '$.k') AS INTEGER) AS DOUBLE) AS feature_1,
         CAST(hour(ts) AS DOUBLE) AS feature_2,
         event_type, user_id, ts
  FROM events)"""


def ratios(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Numeric-ratio table with a binary label (``l_returnflag = 'R'``)."""
    li = read_table(spark, sf_dir, "lineitem")
    return li.select(
        "l_orderkey", "l_linenumber", "l_quantity", "l_extendedprice", "l_discount", "l_tax",
        (F.col("l_extendedprice") / F.col("l_quantity")).alias("unit_price"),
        F.when(F.col("l_returnflag") == "R", 1).otherwise(0).alias("label"),
    )


RATIOS_SQL = """ratios AS (
  SELECT l_orderkey, l_linenumber, l_quantity, l_extendedprice, l_discount, l_tax,
         l_extendedprice / l_quantity AS unit_price,
         CASE WHEN l_returnflag = 'R' THEN 1 ELSE 0 END AS label
  FROM lineitem)"""


def points(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Geo-like points from the first embedding coordinates.

    Columns: id, lat, lon, value, region, label, x, y."""
    e = read_table(spark, sf_dir, "embeddings")
    x = F.element_at("embedding", 1).cast("double")
    y = F.element_at("embedding", 2).cast("double")
    v = F.element_at("embedding", 3).cast("double")
    regions = F.array(*[F.lit(r) for r in REGIONS4])
    return e.select(
        F.col("vec_id").alias("id"),
        (F.lit(40.0) + F.lit(4.0) * x).alias("lat"),
        (F.lit(-74.0) + F.lit(4.0) * y).alias("lon"),
        (F.lit(100.0) * v).alias("value"),
        F.element_at(regions, (F.col("label") % 4 + 1).cast("int")).alias("region"),
        "label", x.alias("x"), y.alias("y"),
    )


POINTS_SQL = """points AS (
  SELECT vec_id AS id,
         40.0::DOUBLE + 4.0::DOUBLE * CAST(embedding[1] AS DOUBLE) AS lat,
         -74.0::DOUBLE + 4.0::DOUBLE * CAST(embedding[2] AS DOUBLE) AS lon,
         100.0::DOUBLE * CAST(embedding[3] AS DOUBLE) AS value,
         ['North', 'South', 'Central', 'Coast'][label % 4 + 1] AS region,
         label, CAST(embedding[1] AS DOUBLE) AS x, CAST(embedding[2] AS DOUBLE) AS y
  FROM embeddings)"""


def doc_labels(spark: SparkSession, sf_dir: str) -> DataFrame:
    """documents ⋈ labels (left): labels cover only some documents, so
    ``quality``/``toxic`` are missing for the rest (the null source for the
    data-quality operators).  labels is one row per labelled document."""
    docs = read_table(spark, sf_dir, "documents").select("doc_id", "lang", "source", "n_chars")
    lab = read_table(spark, sf_dir, "labels")
    return docs.join(lab, "doc_id", "left")


DOC_LABELS_SQL = """doc_labels AS (
  SELECT d.doc_id, d.lang, d.source, d.n_chars, l.quality, l.toxic
  FROM documents d LEFT JOIN labels l ON d.doc_id = l.doc_id)"""
