"""Numeric expressions.

``round_half_up`` is ``sign(x) * floor(|x| * 10^d + 0.5) / 10^d`` (halves go away
from zero; beyond 2^52 a scaled value has no fraction left and stays).  It is written with
plain IEEE double arithmetic instead of ``round()`` because ``round`` goes
through a decimal string in Spark and through the binary value elsewhere,
so ``round(1.005, 2)`` differs between engines; the floor form gives the
same bits everywhere for the same input.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def _c(x) -> Column:
    return F.col(x) if isinstance(x, str) else x


def round_half_up(x, digits: int = 0) -> Column:
    scale = float(10 ** digits)
    x = _c(x).cast("double")
    scaled = F.abs(x) * F.lit(scale)
    return F.when(scaled >= F.lit(2.0 ** 52), x).otherwise(
        F.signum(x) * F.floor(scaled + F.lit(0.5)) / F.lit(scale))


def safe_div(num, den) -> Column:
    """NULL instead of an error (ANSI mode) when the denominator is 0."""
    return F.try_divide(_c(num).cast("double"), _c(den))


def pct(num, den, digits: int = 1) -> Column:
    """``round(100 * num / den, digits)`` with half-up rounding."""
    scale = float(10 ** digits)
    raw = F.lit(100.0 * scale) * _c(num).cast("double") / _c(den)
    return F.floor(raw + F.lit(0.5)) / F.lit(scale)


def bounded(x, lo, hi) -> Column:
    """Clip to ``[lo, hi]`` (``least(greatest(x, lo), hi)``)."""
    lo_c = lo if isinstance(lo, Column) else F.lit(lo)
    hi_c = hi if isinstance(hi, Column) else F.lit(hi)
    return F.least(F.greatest(_c(x), lo_c), hi_c)
