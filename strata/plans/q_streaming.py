"""Registered streaming queries.

Each runs a real Structured Streaming query over the ``events`` Parquet file
(``trigger(availableNow=True)``) into a Parquet sink in the shared checkpoint
folder and returns the sink.  In append mode a window/session is emitted
once the watermark (max event time - 1 hour) passes its end, which is what
the oracle SQL reproduces in batch form.
"""

from __future__ import annotations

from pyspark.sql import functions as F

from strata import streaming as SS
from strata.functions.numeric import round_half_up
from strata.plans import standins as st
from strata.plans.catalog import register
from strata.plans.q_aggregates import _r
from strata.sources.tables import read_table

FMT = "yyyy-MM-dd HH:mm:ss"
FMT_US = "yyyy-MM-dd HH:mm:ss.SSSSSS"


@register("stream_window_delay", sql=f"""
WITH w AS (SELECT time_bucket(INTERVAL '10 minutes', ts) AS ws, COUNT(*) AS n, AVG(value) AS m
           FROM events GROUP BY 1)
SELECT strftime(ws, '%Y-%m-%d %H:%M:%S') AS window_start,
       strftime(ws + INTERVAL '10 minutes', '%Y-%m-%d %H:%M:%S') AS window_end,
       n, {_r('m', 4)} AS mean_value
FROM w WHERE ws + INTERVAL '10 minutes' <= (SELECT MAX(ts) FROM events) - INTERVAL '1 hour'""")
def q_stream_window_delay(spark, sf):
    s = SS.read_stream(spark, sf, "events")
    out = SS.run_to_table(SS.windowed_mean(s, "ts", "value", "10 minutes", watermark="1 hour"),
                          "window_delay")
    return out.select(F.date_format("window_start", FMT).alias("window_start"),
                      F.date_format("window_end", FMT).alias("window_end"), "n",
                      round_half_up("mean_value", 4).alias("mean_value"))


@register("stream_session", sql="""
WITH e AS (SELECT user_id, ts,
                  CASE WHEN ts - LAG(ts) OVER (PARTITION BY user_id ORDER BY ts) < INTERVAL '30 minutes'
                       THEN 0 ELSE 1 END AS new_session FROM events),
s AS (SELECT user_id, ts, SUM(new_session) OVER (PARTITION BY user_id ORDER BY ts
                                                 ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS sid FROM e)
SELECT user_id, strftime(MIN(ts), '%Y-%m-%d %H:%M:%S.%f') AS session_start,
       strftime(MAX(ts) + INTERVAL '30 minutes', '%Y-%m-%d %H:%M:%S.%f') AS session_end, COUNT(*) AS events
FROM s GROUP BY user_id, sid
HAVING MAX(ts) + INTERVAL '30 minutes' <= (SELECT MAX(ts) FROM events) - INTERVAL '1 hour'""")
def q_stream_session(spark, sf):
    s = SS.read_stream(spark, sf, "events")
    out = SS.run_to_table(SS.sessions(s, "ts", "user_id", "30 minutes", "1 hour"), "sessions")
    return out.select("user_id", F.date_format("session_start", FMT_US).alias("session_start"),
                      F.date_format("session_end", FMT_US).alias("session_end"), "events")


@register("stream_dedup", sql="""
WITH e AS (SELECT *, CASE WHEN ts - LAG(ts) OVER (PARTITION BY user_id, event_type ORDER BY ts, event_id) < INTERVAL '1 hour'
                          THEN 0 ELSE 1 END AS opens FROM events),
s AS (SELECT *, SUM(opens) OVER (PARTITION BY user_id, event_type ORDER BY ts, event_id
                                 ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS sid FROM e)
SELECT MIN_BY(event_id, (ts, event_id)) AS event_id, strftime(MIN(ts), '%Y-%m-%d %H:%M:%S.%f') AS ts, user_id, event_type,
       MIN_BY(value, (ts, event_id)) AS value
FROM s GROUP BY user_id, event_type, sid
HAVING MAX(ts) + INTERVAL '1 hour' <= (SELECT MAX(ts) FROM events) - INTERVAL '1 hour'""")
def q_stream_dedup(spark, sf):
    """First event per (user, type) of those that follow each other within an hour."""
    s = SS.read_stream(spark, sf, "events").select("event_id", "ts", "user_id", "event_type", "value")
    out = SS.run_to_table(SS.dedup_within_watermark(s, "ts", ["user_id", "event_type"], "1 hour", "event_id"), "dedup")
    return out.withColumn("ts", F.date_format("ts", FMT_US))


@register("stream_score")
def q_stream_score(spark, sf):
    """A churn-style model fitted on the batch events, applied to the stream."""
    from pyspark.ml import Pipeline
    from pyspark.ml.classification import LogisticRegression
    from pyspark.ml.feature import StandardScaler, VectorAssembler
    feats = ["value", "hour"]
    batch = read_table(spark, sf, "events").select(
        "event_id", "value", F.hour("ts").cast("double").alias("hour"),
        (F.col("event_type") == "purchase").cast("double").alias("label"))
    model = Pipeline(stages=[
        VectorAssembler(inputCols=feats, outputCol="_raw"),
        StandardScaler(inputCol="_raw", outputCol="features", withMean=True),
        LogisticRegression(featuresCol="features", labelCol="label", maxIter=20),
    ]).fit(batch)
    s = SS.read_stream(spark, sf, "events").select(
        "event_id", "value", F.hour("ts").cast("double").alias("hour"))
    from pyspark.ml.functions import vector_to_array
    scored = SS.score_stream(s, model).select(
        "event_id", vector_to_array("probability")[1].alias("score"),
        F.col("prediction").cast("int").alias("prediction"))
    return SS.run_to_table(scored, "score")


_PSI_BINS = 10


@register("drift_psi", sql=f"""
WITH {st.TRADING_SQL},
ref AS (SELECT MIN(weight) AS lo, MAX(weight) AS hi FROM trading WHERE date < 15),
b AS (SELECT CASE WHEN date < 15 THEN 'reference' ELSE 'current' END AS period,
             CAST(LEAST(GREATEST(FLOOR((weight - lo) * {float(_PSI_BINS)} / (hi - lo)), 0), {_PSI_BINS - 1}) AS INTEGER) AS bin
      FROM trading, ref WHERE weight IS NOT NULL),
c AS (SELECT bin, COUNT(*) FILTER (WHERE period = 'reference') AS n_ref,
             COUNT(*) FILTER (WHERE period = 'current') AS n_cur FROM b GROUP BY bin),
p AS (SELECT bin, GREATEST(n_ref / SUM(n_ref) OVER (), 0.0001) AS p_ref,
             GREATEST(n_cur / SUM(n_cur) OVER (), 0.0001) AS p_cur FROM c)
SELECT {_r('SUM((p_cur - p_ref) * LN(p_cur / p_ref))', 6)} AS psi, COUNT(*) AS bins FROM p""")
def q_drift_psi(spark, sf):
    from strata.operators.monitor import psi
    t = st.trading(spark, sf)
    return psi(t, "weight", F.col("date") < 15, bins=_PSI_BINS)
