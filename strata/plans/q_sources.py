"""Registered source / sink / catalog queries.

CSV inputs are *derived* from the given tables: Spark writes them into the
shared folder named by ``spark.checkpoint.dir`` and the operators read them
back, so the work grows with the tables and nothing is synthesised."""

from __future__ import annotations

import os
import uuid
from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from strata.plans import standins as st
from strata.plans.catalog import register
from strata.session import checkpoint_dir
from strata.sources import files as FS
from strata.sources.tables import TABLES, read_table, register_tables

CUSTOMER_SCHEMA = "c_custkey long, c_name string, c_nationkey int, c_acctbal double, c_mktsegment string"


def _scratch(spark, name: str) -> str:
    return f"{checkpoint_dir(spark).rstrip('/')}/io/{name}-{uuid.uuid4().hex}"


def _customer_csv(spark, sf) -> str:
    path = _scratch(spark, "customer_csv")
    FS.write_csv(read_table(spark, sf, "customer"), path)
    return path


@register("load_csv", sql="SELECT c_custkey, c_name, c_nationkey, c_acctbal, c_mktsegment FROM customer")
def q_load_csv(spark, sf):
    """write_csv + load_csv round trip: the customer table through CSV, loaded
    with an explicit schema (bad rows skipped) and registered as a view."""
    FS.load_csv(spark, "customer_from_csv", _customer_csv(spark, sf), CUSTOMER_SCHEMA)
    return spark.table("customer_from_csv")


@register("load_csv_skip_bad", sql="SELECT o_orderkey, o_custkey, o_totalprice FROM orders WHERE o_orderpriority <> '1-URGENT'")
def q_load_csv_skip_bad(spark, sf):
    """Orders as CSV lines, those of urgent ones malformed (a text for the price, or a field too many): they are skipped."""
    o = read_table(spark, sf, "orders")
    good = F.concat_ws(",", *[F.col(c).cast("string") for c in ("o_orderkey", "o_custkey", "o_totalprice")])
    bad = F.when(F.col("o_custkey") % 2 == 0, F.concat(good, F.lit(",more"))).otherwise(
        F.concat_ws(",", F.col("o_orderkey").cast("string"), F.col("o_custkey").cast("string"), F.lit("much")))
    path = _scratch(spark, "orders_csv")
    o.select(F.when(F.col("o_orderpriority") == "1-URGENT", bad).otherwise(good)).write.text(path)
    FS.load_csv(spark, "orders_from_csv", path, "o_orderkey long, o_custkey long, o_totalprice double", header=False)
    return spark.table("orders_from_csv").select("*")


@register("load_csv_encoding", sql="""
SELECT c_custkey, c_name || ' caf' || chr(233) AS c_name FROM customer""")
def q_load_csv_encoding(spark, sf):
    """Customers in a latin-1 file: not valid UTF-8, so read again as latin-1."""
    path = _scratch(spark, "latin_csv")
    c = read_table(spark, sf, "customer").select("c_custkey", F.concat("c_name", F.lit(" caf\u00e9")).alias("c_name"))
    c.write.option("header", True).option("encoding", "ISO-8859-1").csv(path)
    return FS.read_csv_encoding(spark, path, "c_custkey long, c_name string")


@register("load_two_table", sql=f"""WITH {st.TRADING_SQL},
meta AS (SELECT 'weight' AS feature, 'size' AS tag UNION ALL SELECT 'resp', 'return')
SELECT feature, tag, COUNT(*) AS n, COUNT(CASE WHEN feature = 'weight' THEN weight ELSE resp END) AS n_values FROM trading, meta GROUP BY feature, tag""")
def q_load_two_table(spark, sf):
    """The trading rows and a table about their columns, both through CSV, joined by column name."""
    rows, meta = _scratch(spark, "trading_csv"), _scratch(spark, "features_csv")
    t = st.trading(spark, sf).select("weight", "resp")
    FS.write_csv(t, rows)
    FS.write_csv(spark.createDataFrame([("weight", "size"), ("resp", "return")], "feature string, tag string"), meta)
    train, about = FS.load_two_table(spark, rows, meta, "weight double, resp double")
    long = train.select(F.explode(F.array(*[F.struct(F.lit(c).alias("feature"), F.col(c).alias("v")) for c in train.columns])).alias("s"))
    counts = long.groupBy("s.feature").agg(F.count("*").alias("n"), F.count("s.v").alias("n_values"))
    return about.join(counts, "feature").select("feature", "tag", "n", "n_values")


@register("load_dataframe", sql=f"""WITH {st.CHURN_SQL}
SELECT Contract, COUNT(*) AS customers FROM churn GROUP BY Contract""")
def q_load_dataframe(spark, sf):
    """A derived frame registered as a table, then queried with SQL."""
    FS.load_dataframe(spark, "churn_view", st.churn(spark, sf), count=False)
    return FS.sql(spark, "SELECT Contract, COUNT(*) AS customers FROM churn_view GROUP BY Contract")


@register("normalize_columns", sql=f"""WITH {st.CHURN_SQL}
SELECT customerID, MonthlyCharges, TotalCharges, tenure, Churn FROM churn""")
def q_normalize_columns(spark, sf):
    """Raw-file spellings (padded names, spaces) normalised to the canonical
    churn schema; the label is derived from ``Churn Label``."""
    raw = st.churn(spark, sf).select(
        F.col("customerID").alias(" CustomerID"), F.col("MonthlyCharges").alias("Monthly Charges"),
        F.col("TotalCharges").alias("Total Charges"), F.col("tenure").alias("Tenure Months"),
        F.concat(F.lit(" "), F.col("Churn")).alias("Churn Label"))
    out = FS.derive_label(FS.normalize_columns(raw))
    return out.select("customerID", "MonthlyCharges", "TotalCharges", "tenure", "Churn")


@register("derive_label", sql=f"""WITH {st.CHURN_SQL}
SELECT customerID, Churn FROM churn""")
def q_derive_label(spark, sf):
    """``Churn Value`` 1/0 mapped to Yes/No."""
    raw = st.churn(spark, sf).select(
        "customerID", F.when(F.col("Churn") == "Yes", 1).otherwise(0).alias("Churn Value"))
    return FS.derive_label(raw).select("customerID", "Churn")


@register("underscore_columns", sql="""
SELECT o_orderkey AS order_key, o_totalprice AS total_price FROM orders""")
def q_underscore_columns(spark, sf):
    o = read_table(spark, sf, "orders").select(F.col("o_orderkey").alias("order key"),
                                              F.col("o_totalprice").alias("total price"))
    return FS.underscore_columns(o)


@register("tables", sql="\nUNION ALL\n".join(f"SELECT '{t}' AS name, COUNT(*) AS n_rows FROM {t}" for t in TABLES))
def q_tables(spark, sf):
    """The catalog after registering every test table as a view, with the rows of each."""
    register_tables(spark, sf)
    counts = [spark.table(t).agg(F.lit(t).alias("name"), F.count(F.lit(1)).alias("n_rows"))
              for t in FS.tables(spark) if t in TABLES]
    return reduce(DataFrame.unionAll, counts)


@register("find_file", sql="SELECT COUNT(*) AS n FROM lineitem")
def q_find_file(spark, sf):
    """Preferred file discovery (case-insensitive / substring match) in the
    data folder, then a read of the file found."""
    path = FS.find_file(spark, sf, "LINEITEM", suffix=".parquet")
    return spark.read.parquet(path).agg(F.count(F.lit(1)).alias("n"))


@register("write_read_model")
def q_write_read_model(spark, sf):
    """Fit the churn pipeline, persist it with JSON metadata in the shared
    folder, load both back and score every customer with the loaded model."""
    from strata.operators import models as M
    from strata.operators import serving as SV
    from strata.plans.q_models import served_model
    data, model, meta = served_model(spark, sf)
    path = _scratch(spark, "model")
    M.save_model(model, path, meta, spark)
    return SV.serve(*M.load_model(path, spark), data, ["customerID"])
