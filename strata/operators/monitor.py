"""Drift monitoring."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from strata.functions.numeric import round_half_up
from strata.operators.quality import row_scalar

FLOOR_P = 0.0001     # share used for an empty bin (keeps the log finite)


def psi(df: DataFrame, col: str, is_reference: Column, bins: int = 10, digits: int = 6) -> DataFrame:
    """Population stability index of ``col`` between the reference rows and
    the rest.  Bins are equal-width over the reference range (values outside
    go to the end bins); ``PSI = sum (p_cur - p_ref) ln(p_cur / p_ref)``.
    Two passes: reference min/max (one row), then one grouped count."""
    x = F.col(col).cast("double")
    rng = row_scalar(df.where(is_reference).agg(F.min(x).alias("lo"), F.max(x).alias("hi")))
    b = F.least(F.greatest(F.floor((x - rng["lo"]) * F.lit(float(bins)) / (rng["hi"] - rng["lo"])),
                           F.lit(0)), F.lit(bins - 1)).cast("int")
    counts = (df.where(x.isNotNull())
              .groupBy(b.alias("bin"))
              .agg(F.count_if(is_reference).alias("n_ref"), F.count_if(~is_reference).alias("n_cur")))
    tot = row_scalar(counts.agg(F.sum("n_ref").alias("r"), F.sum("n_cur").alias("c")))
    p = counts.select(F.greatest(F.col("n_ref") / tot["r"], F.lit(FLOOR_P)).alias("p_ref"),
                      F.greatest(F.col("n_cur") / tot["c"], F.lit(FLOOR_P)).alias("p_cur"))
    return p.agg(round_half_up(F.sum((F.col("p_cur") - F.col("p_ref")) * F.log(F.col("p_cur") / F.col("p_ref"))),
                               digits).alias("psi"),
                 F.count(F.lit(1)).alias("bins"))
