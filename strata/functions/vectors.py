"""Array (vector) expressions evaluated with higher-order functions (JVM side)."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def _c(x) -> Column:
    return F.col(x) if isinstance(x, str) else x


def to_double_array(x) -> Column:
    return F.transform(_c(x), lambda v: v.cast("double"))


def sq_l2(a, b) -> Column:
    """Squared Euclidean distance of two equal-length arrays (as a flat L2
    index reports it), accumulated in double precision."""
    diffs = F.zip_with(_c(a), _c(b), lambda x, y: (x.cast("double") - y.cast("double")) * (x.cast("double") - y.cast("double")))
    return F.aggregate(diffs, F.lit(0.0), lambda acc, v: acc + v)
