"""Join helpers: key-carrying attach, schema alignment."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def attach_labels(source: DataFrame, labels: DataFrame, key: str | list[str],
                  how: str = "left") -> DataFrame:
    """Attach per-key results (cluster label, score) back to the source rows.

    pandas attaches by row position; Spark rows have no position, so the key
    is carried through the pipeline and joined back."""
    return source.join(labels, on=key, how=how)


def align_schema(df: DataFrame, columns: list[str], fill=0.0) -> DataFrame:
    """Select exactly ``columns``: missing ones filled with ``fill``, extras dropped
    (aligning a scoring frame with the training feature list)."""
    present = set(df.columns)
    return df.select(*[
        F.col(c) if c in present else F.lit(fill).alias(c) for c in columns
    ])
