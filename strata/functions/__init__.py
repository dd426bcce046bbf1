"""Column-expression helpers.  All return ``Column`` objects built from
``pyspark.sql.functions`` so they stay inside whole-stage codegen."""

from strata.functions.numeric import round_half_up, pct, safe_div, bounded  # noqa: F401
from strata.functions.dates import (  # noqa: F401
    coerce_date, coerce_timestamp, day_name, sql_day_number, weekday_mon0,
    day_label,
)
from strata.functions.vectors import sq_l2, to_double_array  # noqa: F401
from strata.functions.text import arrow_concat, join_text  # noqa: F401
