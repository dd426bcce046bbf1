"""Streaming sources, operators and the table sink."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from strata.session import checkpoint_dir


def read_stream(spark: SparkSession, directory: str, table: str, max_files: int | None = None) -> DataFrame:
    """File stream over ``<directory>/<table>.parquet``, a file or a folder of part
    files (schema taken from the batch reader: streaming file sources need an explicit schema).
    ``TIMESTAMP_NTZ`` columns become ``TIMESTAMP`` (event-time columns for
    watermarks must be zoned; the wall clock is kept in the session zone)."""
    schema = spark.read.parquet(f"{directory}/{table}.parquet").schema
    reader = spark.readStream.schema(schema).format("parquet")
    if max_files:
        reader = reader.option("maxFilesPerTrigger", max_files)
    # as a pattern: a plain path would have to be a folder
    stream = reader.load(f"{directory}/[{table[0]}]{table[1:]}.parquet")
    return stream.select(*[
        F.col(f.name).cast("timestamp").alias(f.name) if f.dataType.simpleString() == "timestamp_ntz"
        else F.col(f.name) for f in schema.fields])


def windowed_mean(stream: DataFrame, ts: str, value: str, window: str = "10 minutes",
                  slide: str | None = None, watermark: str = "1 hour",
                  keys: tuple[str, ...] = ()) -> DataFrame:
    """Tumbling (or sliding) window count / mean with a watermark; in append
    mode a window is emitted once the watermark passes its end and its state
    is dropped, so state stays bounded by the watermark delay."""
    w = F.window(ts, window, slide) if slide else F.window(ts, window)
    return (stream.withWatermark(ts, watermark)
            .groupBy(w.alias("w"), *keys)
            .agg(F.count(F.lit(1)).alias("n"), F.avg(value).alias("mean_value"))
            .select(F.col("w.start").alias("window_start"), F.col("w.end").alias("window_end"),
                    *keys, "n", "mean_value"))


def sessions(stream: DataFrame, ts: str, key: str, gap: str = "30 minutes",
             watermark: str = "1 hour") -> DataFrame:
    """Session windows per key (a session closes after ``gap`` without events)."""
    return (stream.withWatermark(ts, watermark)
            .groupBy(F.session_window(ts, gap).alias("s"), key)
            .agg(F.count(F.lit(1)).alias("events"))
            .select(key, F.col("s.start").alias("session_start"), F.col("s.end").alias("session_end"),
                    "events"))


def dedup_within_watermark(stream: DataFrame, ts: str, keys: list[str],
                           watermark: str = "1 hour", tiebreak: str | None = None) -> DataFrame:
    """The earliest event of each key, without those that repeat the key within ``watermark`` of the one before.

    A session per key keeps its earliest event (ties: the least ``tiebreak``) and is emitted when the watermark
    has passed its end, so what stays depends on event times only, not on how events were batched.  Events later
    than the watermark are dropped, as by every watermark."""
    first = F.struct(ts, tiebreak) if tiebreak else F.struct(ts)
    row = F.struct(*[c for c in stream.columns if c not in keys])
    kept = (stream.withWatermark(ts, watermark).groupBy(F.session_window(ts, watermark).alias("s"), *keys)
            .agg(F.min_by(row, first).alias("row")))
    return kept.select(*keys, "row.*").select(*stream.columns)


def score_stream(stream: DataFrame, model) -> DataFrame:
    """Stateless scoring: a fitted ``PipelineModel`` applied to arriving rows."""
    return model.transform(stream)


def run_to_table(result: DataFrame, name: str, mode: str = "append",
                 available_now: bool = True) -> DataFrame:
    """Run the streaming query into a Parquet sink in the shared checkpoint
    folder (exactly-once file sink + its own checkpoint) and return the sink
    as a batch DataFrame.  Waits until all that is there has been processed; a
    failure of the query is raised."""
    spark = result.sparkSession
    base = f"{checkpoint_dir(spark).rstrip('/')}/streams/{name}-{uuid.uuid4().hex}"
    writer = (result.writeStream.format("parquet").outputMode(mode)
              .option("path", f"{base}/data").option("checkpointLocation", f"{base}/_checkpoint"))
    writer = writer.trigger(availableNow=True) if available_now else writer.trigger(processingTime="10 seconds")
    q = writer.start()
    q.awaitTermination()
    return spark.read.schema(result.schema).parquet(f"{base}/data")
