"""String expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Fixed value: separator used for route labels ("A → B").
ROUTE_ARROW = " → "


def _c(x) -> Column:
    return F.col(x) if isinstance(x, str) else x


def arrow_concat(a, b) -> Column:
    """``a || ' → ' || b`` (NULL if either side is NULL, like SQL ``||``)."""
    return F.concat(_c(a), F.lit(ROUTE_ARROW), _c(b))


def join_text(*cols, sep: str = " ") -> Column:
    """Row-wise join of text columns, skipping NULLs."""
    return F.concat_ws(sep, *[_c(c).cast("string") for c in cols])
