"""Projections, filters, predicates and row validation."""

from __future__ import annotations

from collections.abc import Mapping, Sequence
from dataclasses import dataclass
from itertools import chain

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import NumericType


def _q(name: str) -> Column:
    return F.col(f"`{name}`")


def drop_columns(df: DataFrame, cols: Sequence[str]) -> DataFrame:
    """Drop listed columns; names that are absent are ignored."""
    return df.drop(*[c for c in cols if c in df.columns])


def numeric_columns(df: DataFrame) -> list[str]:
    return [f.name for f in df.schema.fields if isinstance(f.dataType, NumericType)]


def select_numeric(df: DataFrame) -> DataFrame:
    return df.select(*[_q(c) for c in numeric_columns(df)])


def select_by_name(df: DataFrame, contains: str, case: bool = False) -> DataFrame:
    if case:
        keep = [c for c in df.columns if contains in c]
    else:
        keep = [c for c in df.columns if contains.lower() in c.lower()]
    return df.select(*[_q(c) for c in keep])


def constant_columns(df: DataFrame, cols: Sequence[str] | None = None) -> list[str]:
    """Columns with at most one distinct non-null value.

    One aggregation (``min``/``max`` per column, partial aggregation map-side)
    returning a single row - no distinct-count shuffle."""
    cols = list(cols or df.columns)
    row = df.agg(*chain.from_iterable(
        (F.min(_q(c)).alias(f"mn{i}"), F.max(_q(c)).alias(f"mx{i}")) for i, c in enumerate(cols)
    )).first()
    return [c for i, c in enumerate(cols)
            if row[f"mn{i}"] is None or row[f"mn{i}"] == row[f"mx{i}"]]


def drop_constant(df: DataFrame, cols: Sequence[str] | None = None) -> DataFrame:
    const = set(constant_columns(df, cols))
    return df.select(*[_q(c) for c in df.columns if c not in const])


_OPS = {
    "==": lambda a, b: a == b, "!=": lambda a, b: a != b, ">": lambda a, b: a > b,
    ">=": lambda a, b: a >= b, "<": lambda a, b: a < b, "<=": lambda a, b: a <= b,
}


def compare(col: str, op: str, value) -> Column:
    return _OPS[op](_q(col), F.lit(value))


def filter_compare(df: DataFrame, conditions: Sequence[tuple[str, str, object]]) -> DataFrame:
    """Conjunction of ``(column, op, value)`` comparisons; pushed into the scan."""
    cond = F.lit(True)
    for c, op, v in conditions:
        cond = cond & compare(c, op, v)
    return df.where(cond)


def filter_region_range(df: DataFrame, region_col: str, region: str | None,
                        value_col: str, lo: float, hi: float, all_label: str = "All") -> DataFrame:
    """Optional equality (``All`` switches it off) AND inclusive range."""
    cond = _q(value_col).between(lo, hi)
    if region is not None and region != all_label:
        cond = cond & (_q(region_col) == region)
    return df.where(cond)


def filter_by_cluster(df: DataFrame, cluster_col: str, cluster) -> DataFrame:
    """Rows of one cluster (a predicate; never n materialised copies)."""
    return df.where(_q(cluster_col) == cluster)


def threshold_flag(df: DataFrame, col: str, threshold: float, name: str) -> DataFrame:
    return df.withColumn(name, _q(col) > F.lit(threshold))


def product_sign_label(df: DataFrame, a: str, b: str, name: str = "action") -> DataFrame:
    return df.withColumn(name, ((_q(a) * _q(b)) > 0).cast("int"))


def not_equal_label(df: DataFrame, col: str, value, name: str = "label") -> DataFrame:
    return df.withColumn(name, (_q(col) != F.lit(value)).cast("int"))


def map_values(df: DataFrame, col: str, mapping: Mapping, name: str | None = None) -> DataFrame:
    """Dictionary lookup (``Series.map``); unmapped values become NULL."""
    m = F.create_map(*chain.from_iterable((F.lit(k), F.lit(v)) for k, v in mapping.items()))
    return df.withColumn(name or col, m[_q(col)])


def downcast(df: DataFrame, cols: Sequence[str] | None = None) -> DataFrame:
    """double -> float (storage only; computations should stay in double)."""
    cols = set(cols) if cols else {f.name for f in df.schema.fields
                                   if f.dataType.simpleString() == "double"}
    return df.select(*[_q(c).cast("float").alias(c) if c in cols else _q(c) for c in df.columns])


def resolve_target(df: DataFrame, candidates: Sequence[str] = ("target", "output")) -> str:
    """First candidate present (case-insensitive), else the last column."""
    lower = {c.lower(): c for c in df.columns}
    for cand in candidates:
        if cand.lower() in lower:
            return lower[cand.lower()]
    return df.columns[-1]


def rename(df: DataFrame, mapping: Mapping[str, str], strip: bool = True) -> DataFrame:
    """Rename by a mapping; names are stripped first so ``'exang '`` matches."""
    if strip:
        df = df.toDF(*[c.strip() for c in df.columns])
        mapping = {k.strip(): v for k, v in mapping.items()}
    return df.withColumnsRenamed({k: v for k, v in mapping.items() if k in df.columns})


@dataclass(frozen=True)
class Rule:
    """Field rule: required (not null) and optional inclusive bounds."""
    column: str
    ge: float | None = None
    le: float | None = None
    required: bool = True


def violations(rules: Sequence[Rule]) -> Column:
    """``array<string>`` of violated rules, in rule order."""
    checks = []
    for r in rules:
        c = _q(r.column)
        if r.required:
            checks.append(F.when(c.isNull(), F.lit(f"{r.column}:missing")))
        if r.ge is not None:
            checks.append(F.when(c < F.lit(r.ge), F.lit(f"{r.column}:<{r.ge}")))
        if r.le is not None:
            checks.append(F.when(c > F.lit(r.le), F.lit(f"{r.column}:>{r.le}")))
    return F.filter(F.array(*checks), lambda x: x.isNotNull())


def validate_records(df: DataFrame, rules: Sequence[Rule]) -> DataFrame:
    """Adds ``violations`` (array) and ``is_valid``; split with ``where``."""
    v = violations(rules)
    return df.withColumn("violations", v).withColumn("is_valid", F.size("violations") == 0)


def split_valid(df: DataFrame, rules: Sequence[Rule]) -> tuple[DataFrame, DataFrame]:
    checked = validate_records(df, rules)
    return checked.where("is_valid").drop("violations", "is_valid"), checked.where("NOT is_valid")
