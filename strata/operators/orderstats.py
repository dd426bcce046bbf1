"""Exact order statistics without unbounded groups, by radix of the value.

Quantiles, ranks and running totals all ask "how many values come before this one".  A plain
``Window.partitionBy(g).orderBy(v)`` puts a whole group into one task.  Here a value has *digits*:
pure, monotone expressions of the value (sign, then bits of the logarithm of its magnitude), so equal
values share them and no cut points have to be found first.

* Selection (quantiles): rows are counted per group and leading digit, only rows with the digit that
  holds a wanted rank are counted per value, those again per longer digit, and only values of the
  one that holds the rank are sorted.  What is shuffled is a histogram per task and a small share of
  the values, once each; the input is read twice (once, if it is a table of counts: both passes then read
  the same exchange).
* Running totals: values are sorted inside the longer digit, and get the totals of earlier ones: of
  the same leading digit, then of earlier leading digits, each a short window.

Nothing depends on the number of partitions, and nothing is written or collected.  Quantiles use linear
interpolation between the order statistics at ``floor((n-1)p)`` and ``ceil((n-1)p)``:
``lo + (hi - lo) * frac`` (the SQL ``PERCENTILE_CONT`` definition).
"""

from __future__ import annotations

from collections.abc import Callable, Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import BooleanType, DateType, StringType, StructType, TimestampNTZType, TimestampType

#: Bits of the logarithm's fraction in a leading and in a longer digit: 16 and about a million
#: digits for each doubling of the magnitude.
LEADING_BITS, LONGER_BITS = 4, 20
#: Above every binary logarithm of a double, and below minus it.
_MOST = 1100
_BYTES = 6


def digit(number: Column, bits: int) -> Column:
    """Digit of a double: rises with it, equal for equal values; null comes first, NaN last."""
    scale = 1 << bits
    magnitude = F.floor(F.least(F.log2(F.abs(number)), F.lit(float(_MOST))) * scale) + _MOST * scale
    signed = F.when(number == 0, F.lit(0)).when(number < 0, -magnitude).otherwise(magnitude)
    return F.coalesce(F.when(F.isnan(number), F.lit(1 << 62)).otherwise(signed),
                      F.when(number.isNull(), F.lit(-(1 << 62))), F.lit(0)).cast("long")


def _common_prefix(df: DataFrame, text: Column) -> Column:
    """Number of leading bytes that all texts share: those that the least and the greatest share."""
    ends = df.agg(F.min(text).alias("a"), F.max(text).alias("b"))
    a, b = F.hex(F.col("a").cast("binary")), F.hex(F.col("b").cast("binary"))
    same = F.filter(F.sequence(F.lit(1), F.greatest(F.length(a), F.length(b)) + 1), lambda k: F.substring(a, 1, k) != F.substring(b, 1, k))
    return ends.select(F.coalesce(F.floor((F.array_min(same) - 1) / 2), F.lit(0)).cast("int")).scalar()


def as_number(df: DataFrame, value: Column, kind) -> Column:
    """A double that never falls where ``value`` rises (equal values stay equal)."""
    if isinstance(kind, StructType):      # structs compare by their first field first
        return as_number(df, value[kind[0].name], kind[0].dataType)
    if isinstance(kind, StringType):      # six bytes after those that all share
        part = F.substring(value.cast("binary"), _common_prefix(df, value) + 1, F.lit(_BYTES))
        return F.conv(F.rpad(F.hex(part), 2 * _BYTES, "0"), 16, 10).cast("double")
    if isinstance(kind, DateType):
        return F.unix_date(value).cast("double")
    if isinstance(kind, (TimestampType, TimestampNTZType)):
        return value.cast("timestamp").cast("double")
    if isinstance(kind, BooleanType):
        return value.cast("int").cast("double")
    return value.cast("double")


def join_groups(left: DataFrame, right: DataFrame, cols: Sequence[str], how: str = "inner") -> DataFrame:
    """Join on equal ``cols``, null equal to null, keeping the left ones."""
    renamed = right.select(*[F.col(f"`{c}`").alias(f"_r{k}") for k, c in enumerate(cols)],
                           *[F.col(f"`{c}`") for c in right.columns if c not in cols])
    same = reduce(Column.__and__, [F.col(f"`{c}`").eqNullSafe(F.col(f"_r{k}")) for k, c in enumerate(cols)])
    return left.join(renamed, same, how).drop(*[f"_r{k}" for k in range(len(cols))])


def prefix_sums(df: DataFrame, group_cols: Sequence[str], order_col: str,
                sum_cols: Sequence[str], descending: bool = False, number: Column | None = None) -> DataFrame:
    """Inclusive running totals ``cum_<c>`` of ``sum_cols`` within each group, ordered by ``order_col``
    (unique within a group; a null comes first, or last if ``descending``), and ``all_<c>`` of the whole group.
    ``number``: a double that never falls where ``order_col`` rises, where the caller knows one."""
    group_cols = list(group_cols)
    turn = (lambda c: F.col(c).desc()) if descending else (lambda c: F.col(c).asc())
    number = as_number(df, F.col(order_col), df.schema[order_col].dataType) if number is None else number
    cut = df.withColumn("_lead", digit(number, LEADING_BITS)).withColumn("_digit", digit(number, LONGER_BITS))

    def running(partition, order, cols, prefix, end):
        w = Window.partitionBy(*partition).orderBy(order).rowsBetween(Window.unboundedPreceding, end)
        return [F.coalesce(F.sum(c).over(w), F.lit(0)).alias(f"{prefix}{k}") for k, c in enumerate(cols)]

    local = cut.select("*", *running([*group_cols, "_digit"], turn(order_col), sum_cols, "_loc", Window.currentRow))
    keys = [*group_cols, "_lead"]
    totals = [f"_tot{k}" for k in range(len(sum_cols))]
    longer = cut.groupBy(*keys, "_digit").agg(*[F.sum(c).alias(t) for c, t in zip(sum_cols, totals)])
    leading = longer.groupBy(*keys).agg(*[F.sum(t).alias(t) for t in totals])
    leading = leading.select(*keys, *running(group_cols, turn("_lead"), totals, "_far", -1), *[
        F.sum(t).over(Window.partitionBy(*group_cols)).alias(f"_all{k}") for k, t in enumerate(totals)])
    longer = longer.select(*keys, "_digit", *running(keys, turn("_digit"), totals, "_near", -1))
    offsets = join_groups(longer, leading, keys).drop("_lead")
    joined = join_groups(local, offsets, [*group_cols, "_digit"])
    return joined.select(*[F.col(f"`{c}`") for c in df.columns], *[
        x for k, c in enumerate(sum_cols) for x in (
            (F.col(f"_far{k}") + F.col(f"_near{k}") + F.col(f"_loc{k}")).alias(f"cum_{c}"), F.col(f"_all{k}").alias(f"all_{c}"))])


def value_count_table(df: DataFrame, value_col: str, group_cols: Sequence[str] = (),
                      drop_nan: bool = True) -> DataFrame:
    """``(group..., value, cnt)`` with NULL (and NaN) values removed.  Several readers of it in one
    query share its exchange, so the input is derived once."""
    v = F.col(value_col)
    cond = v.isNotNull()
    if drop_nan:
        cond = cond & ~F.isnan(v.cast("double"))
    for g in group_cols:
        cond = cond & F.col(f"`{g}`").isNotNull()
    return df.where(cond).groupBy(*group_cols, value_col).agg(F.count(F.lit(1)).alias("cnt"))


def order_statistics(df: DataFrame, value_col: str, ranks: Sequence[Callable[[Column], Column]],
                     names: Sequence[str], group_cols: Sequence[str] = (), counts: bool = False,
                     few_groups: bool = False) -> DataFrame:
    """The values at 0-based ``ranks`` (expressions of the group's number of values), as doubles in
    columns ``names``, and that number as ``_n``.  Nulls, NaN and null groups take no part.

    ``counts``: ``df`` has one row per group and value with their number in ``cnt``.  ``few_groups``: the
    groups are known to be few (columns of a table, or none); what is sought is then broadcast.
    """
    keys = [f"_k{i}" for i in range(len(group_cols))]
    kind = df.schema[value_col].dataType
    value = F.col(value_col).cast("timestamp").cast("double") if isinstance(kind, TimestampNTZType) else F.col(value_col).cast("double")
    rows = df.select(*[F.col(f"`{g}`").alias(k) for g, k in zip(group_cols, keys)], value.alias("_v"),
                     F.col("cnt").cast("long").alias("_c") if counts else F.lit(1).cast("long").alias("_c"))
    rows = rows.where(reduce(Column.__and__, [F.col(k).isNotNull() for k in keys], F.col("_v").isNotNull() & ~F.isnan("_v")))
    rows = rows.withColumn("_lead", digit(F.col("_v"), LEADING_BITS))

    def sought(first: Column, size: Column) -> Column:
        """The wanted ranks among ``size`` values from ``first`` on."""
        all_ranks = F.array(*[F.struct(F.lit(i).alias("i"), r(F.col("_n")).cast("long").alias("r")) for i, r in enumerate(ranks)])
        return F.filter(all_ranks, lambda x: (x["r"] >= first) & (x["r"] < first + size))

    def hint(table: DataFrame) -> DataFrame:
        return F.broadcast(table) if few_groups or not keys else table

    def before(order: str, *partition: str) -> Column:
        w = Window.partitionBy(*partition).orderBy(order).rowsBetween(Window.unboundedPreceding, Window.currentRow)
        return F.sum("_c").over(w) - F.col("_c")

    lead = rows.groupBy(*keys, "_lead").agg(F.sum("_c").alias("_c"))
    lead = lead.select(*keys, "_lead", "_c", before("_lead", *keys).alias("_before"),
                       F.sum("_c").over(Window.partitionBy(*keys)).alias("_n"))
    lead = lead.where(F.size(sought(F.col("_before"), F.col("_c"))) > 0).drop("_c")
    inside = rows.join(hint(lead), [*keys, "_lead"])
    inside = inside.withColumn("_digit", digit(F.col("_v"), LONGER_BITS))
    place = [*keys, "_lead", "_before", "_n", "_digit"]
    values = inside.groupBy(*place, "_v").agg(F.sum("_c").alias("_c"))
    longer = values.groupBy(*place).agg(F.sum("_c").alias("_c"))
    longer = longer.select(*keys, "_digit", "_n", "_c", (F.col("_before") + before("_digit", *keys, "_lead")).alias("_first"))
    longer = longer.where(F.size(sought(F.col("_first"), F.col("_c"))) > 0).select(*keys, "_digit", "_first")
    last = values.join(hint(longer), [*keys, "_digit"])
    last = last.withColumn("_place", F.col("_first") + before("_v", *keys, "_digit"))
    last = last.select(*keys, "_n", "_v", F.explode(sought(F.col("_place"), F.col("_c"))).alias("_x"))
    out = last.groupBy(*keys).agg(F.first("_n").alias("_n"), *[
        F.max(F.when(F.col("_x.i") == i, F.col("_v"))).alias(name) for i, name in enumerate(names)])
    out = out if keys else out.where(F.col("_n").isNotNull())
    return out.select(*[F.col(k).alias(g) for g, k in zip(group_cols, keys)], "_n", *names)


def quantiles(df: DataFrame | None, value_col: str, probs: Sequence[float],
              group_cols: Sequence[str] = (), names: Sequence[str] | None = None,
              counts: DataFrame | None = None, few_groups: bool = False) -> DataFrame:
    """Exact ``PERCENTILE_CONT`` of ``value_col`` per group.

    Returns one row per group with one column per probability (named by ``names`` or ``q<p>``).
    Pass ``counts`` (a ``(group..., value, cnt)`` table) instead of ``df`` where other statistics read it
    too, or where values repeat a lot."""
    names = list(names) if names else [f"q{int(round(p * 100))}" for p in probs]

    def place(p: float) -> Callable[[Column], Column]:
        return lambda n: (n - 1).cast("double") * F.lit(float(p))

    ranks, found = [], []
    for i, p in enumerate(probs):
        ranks += [lambda n, p=p: F.floor(place(p)(n)), lambda n, p=p: F.ceil(place(p)(n))]
        found += [f"_lo{i}", f"_hi{i}"]
    out = order_statistics(counts if df is None or counts is not None else df, value_col, ranks, found,
                           group_cols, counts is not None, few_groups)
    return out.select(*[F.col(f"`{g}`") for g in group_cols], *[
        (F.col(f"_lo{i}") + (F.col(f"_hi{i}") - F.col(f"_lo{i}")) * (place(p)(F.col("_n")) - F.floor(place(p)(F.col("_n"))))
         ).alias(name) for i, (p, name) in enumerate(zip(probs, names))])


def long_form(df: DataFrame, cols: Sequence[str], id_cols: Sequence[str] = (),
              var: str = "column", val: str = "value") -> DataFrame:
    """Unpivot ``cols`` (cast to double) into ``(id..., column, value)``."""
    casted = df.select(*id_cols, *[F.col(f"`{c}`").cast("double").alias(c) for c in cols])
    return casted.unpivot(list(id_cols), list(cols), var, val)
