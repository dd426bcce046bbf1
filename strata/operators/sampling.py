"""Ordering, top-k, deterministic sampling, duplicate detection, splits and
folds (SURVEY §2.6, §2.7).

Spark rows have no position and ``rand()`` depends on partitioning, so every
operator here takes an explicit key and seed: the row's pseudo-random draw is
``md5(key || seed)`` (identical in Spark and SQL engines).
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from strata.operators.orderstats import join_groups, prefix_sums

#: Slices of a class by its rows' draws: the most rows a class has in the table of slices.
SLICES = 4096


def hash_draw(key: str | Column, seed: int) -> Column:
    """32 hex chars; lexicographic order = uniform pseudo-random order."""
    k = F.col(key) if isinstance(key, str) else key
    return F.md5(F.concat(k.cast("string"), F.lit(f"#{seed}")))


def order_limit(df: DataFrame, by: str, n: int, tiebreak: str, descending: bool = True) -> DataFrame:
    """``ORDER BY by DESC, tiebreak LIMIT n`` (TakeOrderedAndProject)."""
    o = F.col(by).desc() if descending else F.col(by).asc()
    return df.orderBy(o, F.col(tiebreak)).limit(n)


def head_sample(df: DataFrame, n: int, key: str, seed: int = 42) -> DataFrame:
    """n rows chosen by hash order: deterministic stand-in for ``df[:n]``/``sample(n)``."""
    return df.orderBy(hash_draw(key, seed), F.col(key)).limit(n)


def fraction_sample(df: DataFrame, fraction: float, key: str, seed: int = 42) -> DataFrame:
    """Bernoulli sample by hash: keep when the first 8 hex digits of the draw
    fall below ``fraction * 16^8`` (fixed-width hex compares as a number)."""
    cut = f"{int(fraction * 16 ** 8):08x}"
    return df.where(F.substring(hash_draw(key, seed), 1, 8) < F.lit(cut))


def duplicate_groups(df: DataFrame, cols: Sequence[str] | None = None) -> DataFrame:
    """Distinct rows that occur more than once, with their number of copies."""
    cols = list(cols or df.columns)
    return (df.groupBy(*cols).agg(F.count(F.lit(1)).alias("copies"))
            .where(F.col("copies") > 1))


def duplicate_texts(df: DataFrame, text_col: str) -> DataFrame:
    """Texts that occur more than once, with their number of copies.

    Whole texts are compared, but the big shuffle moves only a 16-byte
    ``md5`` and the length per row: candidate hashes with more than one row
    are found first, then only rows carrying a candidate hash are grouped by
    the full text (so a hash collision can never merge different texts)."""
    h = df.select(F.md5(F.col(text_col)).alias("_h"), F.length(text_col).alias("_len"), F.col(text_col))
    cand = (h.groupBy("_h", "_len").agg(F.count(F.lit(1)).alias("_c")).where(F.col("_c") > 1)
            .select("_h", "_len"))
    return (h.join(cand, ["_h", "_len"], "left_semi")
            .groupBy(text_col).agg(F.count(F.lit(1)).alias("copies"))
            .where(F.col("copies") > 1))


def count_duplicates(df: DataFrame, cols: Sequence[str] | None = None) -> DataFrame:
    """``df.duplicated().sum()``: rows repeating an earlier identical row."""
    return duplicate_groups(df, cols).agg(
        F.coalesce(F.sum(F.col("copies") - 1), F.lit(0)).cast("long").alias("duplicates"))


def rank_within(df: DataFrame, group_col: str, order_col: Column | str, name: str = "_rank",
                number: Column | None = None, size_name: str | None = None) -> DataFrame:
    """0-based rank of each row inside its group by a unique order column, and the group's size in ``size_name``,
    via ``prefix_sums`` (no group is sorted in a single task).  ``number``: see there."""
    tmp = df.withColumn("_ord", order_col if isinstance(order_col, Column) else F.col(order_col)) \
            .withColumn("_one", F.lit(1))
    ranked = prefix_sums(tmp, [group_col], "_ord", ["_one"], number=number)
    out = ranked.withColumn(name, F.col("cum__one") - 1)
    return (out.withColumn(size_name, F.col("all__one")) if size_name else out).drop("_ord", "_one", "cum__one", "all__one")


def _drawn(df: DataFrame, label: str, key: str, seed: int) -> DataFrame:
    """Rows with ``_rank`` in hash order within their class and its size ``_n_class``.  The draw is uniform, so its
    first digits deal each class into ``SLICES`` even slices: rows are sorted within theirs, after one exchange,
    and the rows before it come from a table with one row per class and slice."""
    draw = hash_draw(key, seed)
    digits = F.conv(F.substring(draw, 1, 8), 16, 10).cast("long")
    rows = df.withColumn("_draw", draw).withColumn("_slice", F.coalesce(F.floor(digits * SLICES / 16 ** 8), F.lit(-1)).cast("int"))
    in_slice = Window.partitionBy(f"`{label}`", "_slice").orderBy("_draw", F.col(f"`{key}`").cast("string"))
    local = rows.withColumn("_rank", F.row_number().over(in_slice))
    of_class = Window.partitionBy(f"`{label}`")
    before = F.sum("_n").over(of_class.orderBy("_slice").rowsBetween(Window.unboundedPreceding, -1))
    slices = rows.groupBy(f"`{label}`", "_slice").agg(F.count("*").alias("_n")).select(
        F.col(f"`{label}`"), "_slice", F.coalesce(before, F.lit(0)).alias("_before"), F.sum("_n").over(of_class).alias("_n_class"))
    placed = join_groups(local, slices, [label, "_slice"])
    return placed.select(*[F.col(f"`{c}`") for c in df.columns], (F.col("_before") + F.col("_rank") - 1).alias("_rank"), "_n_class")


def _is_test(test_fraction: float) -> Column:
    return F.col("_rank") < F.floor(F.col("_n_class").cast("double") * F.lit(test_fraction) + F.lit(0.5))


def stratified_split(df: DataFrame, label: str, key: str, test_fraction: float = 0.2,
                     seed: int = 42) -> DataFrame:
    """Exact stratified split: in every class the ``round(frac * n_c)`` rows
    with the smallest hash draw form the test set.  Adds ``is_test``."""
    return _drawn(df, label, key, seed).withColumn("is_test", _is_test(test_fraction)).drop("_rank", "_n_class")


def stratified_kfold(df: DataFrame, label: str, key: str, k: int = 5, seed: int = 42,
                     shuffle: bool = True) -> DataFrame:
    """Fold id per row, balanced within every class.

    ``shuffle=True``: rows of a class are dealt round-robin in hash order.
    ``shuffle=False``: contiguous blocks in key order (the unshuffled
    stratified k-fold)."""
    if shuffle:
        return _drawn(df, label, key, seed).withColumn("fold", (F.col("_rank") % k).cast("int")).drop("_rank", "_n_class")
    ranked = rank_within(df, label, F.col(key), size_name="_n_class")
    return (ranked.withColumn("fold", F.floor(F.col("_rank") * k / F.col("_n_class")).cast("int"))
            .drop("_rank", "_n_class"))


def split_and_folds(df: DataFrame, label: str, key: str, test_fraction: float = 0.2, k: int = 5, seed: int = 42) -> DataFrame:
    """``stratified_split`` and the shuffled ``stratified_kfold`` of the same seed, which rank the rows alike: one ranking for both."""
    return (_drawn(df, label, key, seed).withColumn("is_test", _is_test(test_fraction))
            .withColumn("fold", (F.col("_rank") % k).cast("int")).drop("_rank", "_n_class"))


def time_series_split(df: DataFrame, time_col: str, n_splits: int = 5) -> DataFrame:
    """Expanding-window split: ``block`` = time quantile bucket (0..n_splits);
    split i trains on blocks < i and tests on block i."""
    from strata.operators.orderstats import quantiles
    probs = [i / (n_splits + 1) for i in range(1, n_splits + 1)]
    names = [f"b{i}" for i in range(1, n_splits + 1)]
    cuts = quantiles(df, time_col, probs, names=names)
    row = cuts.first()        # n_splits numbers: bounded
    block = F.lit(0)
    for nm in names:
        block = block + (F.col(time_col).cast("double") > F.lit(row[nm])).cast("int")
    return df.withColumn("block", block)
