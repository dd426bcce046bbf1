"""Registered feature-engineering queries."""

from __future__ import annotations

from pyspark.sql import functions as F

from strata.functions.numeric import round_half_up
from strata.operators import features as FE
from strata.plans import standins as st
from strata.plans.catalog import register
from strata.plans.q_aggregates import _r
from strata.sources.tables import read_table

# The market segments of the test data (levels of ``Contract``).
SEGMENTS = ["AUTOMOBILE", "BUILDING", "FURNITURE", "HOUSEHOLD", "MACHINERY"]


def _dummies_sql(levels):
    return ", ".join(f"CASE WHEN Contract = '{v}' THEN 1.0::DOUBLE ELSE 0.0::DOUBLE END AS \"Contract_{v}\""
                     for v in levels)


@register("one_hot", sql=f"WITH {st.CHURN_SQL}\nSELECT customerID, {_dummies_sql(SEGMENTS)} FROM churn")
def q_one_hot(spark, sf):
    c = st.churn(spark, sf).select("customerID", "Contract")
    return FE.one_hot(c, ["Contract"])


@register("one_hot_drop_first",
          sql=f"WITH {st.CHURN_SQL}\nSELECT customerID, {_dummies_sql(SEGMENTS[1:])} FROM churn")
def q_one_hot_drop_first(spark, sf):
    c = st.churn(spark, sf).select("customerID", "Contract")
    return FE.one_hot(c, ["Contract"], drop_first=True)


@register("one_hot_sparse", sql="""
WITH u AS (SELECT DISTINCT CAST(user_id AS VARCHAR) AS v FROM events WHERE user_id IS NOT NULL),
t AS (SELECT DISTINCT event_type AS v FROM events WHERE event_type IS NOT NULL),
codes AS (SELECT 1 AS c, v, ROW_NUMBER() OVER (ORDER BY v) - 1 AS slot FROM u
          UNION ALL SELECT 2, v, (SELECT COUNT(*) FROM u) + ROW_NUMBER() OVER (ORDER BY v) - 1 FROM t),
cells AS (SELECT event_id, 1 AS c, CAST(user_id AS VARCHAR) AS v FROM events UNION ALL SELECT event_id, 2, event_type FROM events)
SELECT event_id, list(slot ORDER BY slot) AS slots FROM cells JOIN codes USING (c, v) GROUP BY event_id""")
def q_one_hot_sparse(spark, sf):
    """User and type of every event as positions in one vector."""
    return FE.one_hot_sparse(read_table(spark, sf, "events"), ["user_id", "event_type"], "event_id")


@register("standard_scale", sql=f"""WITH {st.CHURN_SQL},
s AS (SELECT AVG(tenure) AS m0, STDDEV_POP(tenure) AS s0, AVG(MonthlyCharges) AS m1,
             STDDEV_POP(MonthlyCharges) AS s1 FROM churn)
SELECT customerID, {_r('(tenure - m0) / CASE WHEN s0 <> 0 THEN s0 ELSE 1.0 END', 6)} AS tenure,
       {_r('(MonthlyCharges - m1) / CASE WHEN s1 <> 0 THEN s1 ELSE 1.0 END', 6)} AS MonthlyCharges
FROM churn, s""")
def q_standard_scale(spark, sf):
    c = st.churn(spark, sf).select("customerID", "tenure", "MonthlyCharges")
    return FE.standard_scale(c, ["tenure", "MonthlyCharges"])


KB_COLS = ["l_quantity", "l_extendedprice", "l_discount", "l_tax", "unit_price"]

_ANOVA = f"""WITH {st.RATIOS_SQL},
lf AS ({" UNION ALL ".join(f"SELECT '{c}' AS feature, label AS y, CAST({c} AS DOUBLE) AS x FROM ratios" for c in KB_COLS)}),
per AS (SELECT feature, y, COUNT(*) AS n, SUM(x) AS s, SUM(x * x) AS ss FROM lf WHERE x IS NOT NULL GROUP BY feature, y),
tot AS (SELECT feature, SUM(n) AS N, SUM(s) AS S, SUM(ss) AS SS, COUNT(*) AS k, SUM(s * s / n) AS B
        FROM per GROUP BY feature),
f AS (SELECT feature, {_r('((B - S * S / N) / (k - 1)) / (((SS - S * S / N) - (B - S * S / N)) / (N - k))', 6)} AS f_score
      FROM tot)"""


@register("select_k_best", sql=_ANOVA + """
SELECT * FROM (SELECT feature, f_score, CAST(ROW_NUMBER() OVER (ORDER BY f_score DESC NULLS LAST, feature) AS INTEGER) AS rank
               FROM f) WHERE rank <= 3""")
def q_select_k_best(spark, sf):
    return FE.select_k_best(st.ratios(spark, sf), KB_COLS, "label", 3)


@register("class_weight", sql=f"""WITH {st.SCORED_SQL},
c AS (SELECT label, COUNT(*) AS n_c FROM scored GROUP BY label),
t AS (SELECT SUM(n_c) AS n, COUNT(*) AS k, SUM(n_c) FILTER (WHERE label = 1) AS pos,
             SUM(n_c) FILTER (WHERE label = 0) AS neg FROM c)
SELECT label, n_c, {_r('n / (k * n_c)', 6)} AS weight, {_r('neg / pos', 6)} AS scale_pos_weight FROM c, t""")
def q_class_weight(spark, sf):
    return FE.class_weights(st.scored(spark, sf), "label")


def _emb(spark, sf, dims=64):
    e = read_table(spark, sf, "embeddings")
    return e.select(F.col("vec_id").alias("id"), "label",
                    *[F.element_at("embedding", i + 1).cast("double").alias(f"e{i}") for i in range(dims)])


EMB_COLS = [f"e{i}" for i in range(64)]


@register("pca_k")
def q_pca_k(spark, sf):
    return FE.pca_project(_emb(spark, sf), EMB_COLS, 2, keep=["id"])


@register("pca_explained")
def q_pca_explained(spark, sf):
    return FE.pca_explained(_emb(spark, sf), EMB_COLS)


@register("pca_variance")
def q_pca_variance(spark, sf):
    df = _emb(spark, sf)
    rows = [(v, FE.pca_components_for(df, EMB_COLS, v)) for v in (0.5, 0.95)]
    return spark.createDataFrame(rows, "variance double, components int")


SMOTE_COLS = ["tenure", "MonthlyCharges", "n_orders"]


@register("smote")
def q_smote(spark, sf):
    c = st.scored(spark, sf).join(st.churn(spark, sf).select(F.col("customerID").alias("id"), "n_orders"), "id")
    out = FE.smote(c.select("id", "label", *[F.col(x).cast("double").alias(x) for x in SMOTE_COLS]),
                   SMOTE_COLS, "label", "id", minority=1, k=5, seed=42)
    return out.groupBy("label", "synthetic").agg(F.count(F.lit(1)).alias("n"),
                                                 *[round_half_up(F.avg(x), 4).alias(f"mean_{x}") for x in SMOTE_COLS])
