"""Structured Streaming versions of the batch operators.

Sources are file streams over Parquet, operators are watermarked
aggregations / session windows / deduplication / stateless model scoring,
and results go to an exactly-once Parquet file sink whose data and
checkpoint live in the shared folder named by ``spark.checkpoint.dir`` (so
a restarted query resumes instead of recomputing, and nothing is collected
on the driver).
"""

from strata.streaming.core import (  # noqa: F401
    read_stream, windowed_mean, sessions, dedup_within_watermark, score_stream, run_to_table,
)
