"""Window operators: trailing means, forward fill, lags, ranks.

Forward fill and lags never need a key in one task (one vehicle may have a third of the rows).
Rows are sliced by the digits of ``orderstats``, pure expressions of the order column; a window
works inside each (key, slice), and what comes in from earlier slices is carried by a small table:
within a leading digit first, then from earlier leading digits.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from strata.operators.orderstats import LEADING_BITS, LONGER_BITS, as_number, digit, join_groups


def _q(name: str) -> Column:
    return F.col(f"`{name}`")


def rolling_mean(df: DataFrame, order_col: str, value_col: str, rows: int = 7,
                 name: str | None = None, partition_cols: Sequence[str] = ()) -> DataFrame:
    """``rolling(rows, min_periods=1).mean()`` over ``rows`` *rows* (not days).
    Meant for already aggregated series (one row per day)."""
    w = Window.partitionBy(*partition_cols).orderBy(order_col).rowsBetween(-(rows - 1), 0)
    return df.withColumn(name or f"rolling_{value_col}", F.avg(value_col).over(w))


def _sliced(df: DataFrame, order_col: str) -> DataFrame:
    number = as_number(df, _q(order_col), df.schema[order_col].dataType)
    return df.withColumn("_lead", digit(number, LEADING_BITS)).withColumn("_digit", digit(number, LONGER_BITS))


def ffill(df: DataFrame, key_cols: Sequence[str], order_col: str, cols: Sequence[str]) -> DataFrame:
    """Forward fill ``cols`` within each key in ``order_col`` order (a null order comes first).
    ``order_col`` must be unique within a key."""
    key_cols = list(key_cols)
    cut = _sliced(df, order_col)
    slices, leads = [*key_cols, "_digit"], [*key_cols, "_lead"]

    def last_over(names: Sequence[str], prefix: str, partition: Sequence[str], order: str, end: int) -> list[Column]:
        w = Window.partitionBy(*[_q(c) for c in partition]).orderBy(_q(order)).rowsBetween(Window.unboundedPreceding, end)
        return [F.last(_q(c), ignorenulls=True).over(w).alias(f"{prefix}{k}") for k, c in enumerate(names)]

    local = cut.select("*", *last_over(cols, "_loc", slices, order_col, Window.currentRow))
    # the last value of a slice: the greatest pair of order and value that has a value
    pair = [F.max(F.when(_q(c).isNotNull(), F.struct(_q(order_col).alias("o"), _q(c).alias("v")))).alias(f"_end{k}")
            for k, c in enumerate(cols)]
    ends = [f"_end{k}" for k in range(len(cols))]
    longer = cut.groupBy(*[_q(c) for c in leads], "_digit").agg(*pair)
    leading = longer.groupBy(*[_q(c) for c in leads]).agg(*[F.max(e).alias(e) for e in ends])
    leading = leading.select(*[_q(c) for c in leads], *last_over(ends, "_far", key_cols, "_lead", -1))
    longer = longer.select(*[_q(c) for c in leads], "_digit", *last_over(ends, "_near", leads, "_digit", -1))
    carry = join_groups(longer, leading, leads).select(*[_q(c) for c in slices], *[
        F.coalesce(f"_near{k}", f"_far{k}").getField("v").alias(f"_in{k}") for k in range(len(cols))])
    out = join_groups(local, carry, slices)
    filled = {c: F.coalesce(f"_loc{k}", f"_in{k}").alias(c) for k, c in enumerate(cols)}
    return out.select(*[filled.get(c, _q(c)) for c in df.columns])


def lag_features(df: DataFrame, key_cols: Sequence[str], order_cols: str | Sequence[str],
                 value_col: str, lags: Sequence[int] = (1, 2, 3)) -> DataFrame:
    """``value_col`` shifted by each lag inside the key, in time order
    (``order_cols`` unique within a key).

    The first rows of a slice take what they lack from the last ``max(lags)`` rows of earlier slices."""
    key_cols = list(key_cols)
    order_cols = [order_cols] if isinstance(order_cols, str) else list(order_cols)
    most = max(lags)
    cut = _sliced(df, order_cols[0])
    slices, leads = [*key_cols, "_digit"], [*key_cols, "_lead"]

    def by(partition: Sequence[str], descending: bool = False):
        turn = [(_q(c).desc() if descending else _q(c).asc()) for c in order_cols]
        return Window.partitionBy(*[_q(c) for c in partition]).orderBy(*turn)

    def last_rows(rows: DataFrame, partition: Sequence[str]) -> DataFrame:
        return rows.withColumn("_back", F.row_number().over(by(partition, True))).where(F.col("_back") <= most).drop("_back")

    def incoming(rows: DataFrame, inside: Sequence[str], partition: Sequence[str], name: str) -> DataFrame:
        """For each ``partition``: the last ``most`` values before it ``inside`` a wider group, oldest first."""
        earlier = F.collect_list(F.struct(_q(value_col).alias("v"))).over(by(inside).rowsBetween(-most, -1))
        return (rows.select("*", earlier.alias(name), F.row_number().over(by(partition)).alias("_first"))
                .where(F.col("_first") == 1))

    w = by(slices)
    local = cut.select("*", F.row_number().over(w).alias("_i"),
                       *[F.lag(_q(value_col), j).over(w).alias(f"_loc{j}") for j in lags])
    names = list(dict.fromkeys([*leads, "_digit", *order_cols, value_col]))
    tails = last_rows(cut.select(*[_q(c) for c in names]), [*leads, "_digit"])
    near = incoming(tails, leads, [*leads, "_digit"], "_near").select(*[_q(c) for c in leads], "_digit", "_near")
    far = incoming(last_rows(tails, leads), key_cols, leads, "_far").select(*[_q(c) for c in leads], "_far")
    carry = join_groups(near, far, leads).select(*[_q(c) for c in slices], F.concat("_far", "_near").alias("_in"))
    out = join_groups(local, carry, slices)
    cols = [F.when(F.col("_i") > j, F.col(f"_loc{j}"))
            .otherwise(F.try_element_at("_in", F.nullif(F.greatest(F.size("_in") + F.col("_i") - j, F.lit(0)), F.lit(0)))["v"])
            .alias(f"{value_col}_lag{j}") for j in lags]
    return out.select(*[_q(c) for c in df.columns], *cols)


def rank_by(df: DataFrame, by: str, descending: bool = True, tiebreak: str | None = None,
            method: str = "row_number", name: str = "rank") -> DataFrame:
    """Rank a *small* result table (features, models, grid points) by a metric."""
    o = F.col(by).desc_nulls_last() if descending else F.col(by).asc_nulls_last()
    order = [o] + ([F.col(tiebreak)] if tiebreak else [])
    w = Window.orderBy(*order)
    fn = {"row_number": F.row_number, "rank": F.rank, "dense_rank": F.dense_rank}[method]
    return df.withColumn(name, fn().over(w))
