"""Column helpers: guarded ratios, strict greatest, conditional aggregates, ordered rules."""

from __future__ import annotations

from collections.abc import Iterable, Sequence

from pyspark.sql import Column
from pyspark.sql import functions as F


def safe_ratio(num: Column, den: Column) -> Column:
    """num / den as double, NULL where den is zero or NULL."""
    return num.cast("double") / F.nullif(den.cast("double"), F.lit(0.0))


def greatest_strict(*cols: Column) -> Column:
    """Largest value, NULL as soon as one argument is NULL."""
    present = cols[0].isNotNull()
    for col in cols[1:]:
        present = present & col.isNotNull()
    return F.when(present, F.greatest(*cols))


def sum_if(pred: Column, value: Column) -> Column:
    """Conditional sum, zero when no row qualifies."""
    return F.sum(F.when(pred, value).otherwise(F.lit(0)))


def sum_if_null(pred: Column, value: Column) -> Column:
    """Conditional sum, NULL when no row qualifies."""
    return F.sum(F.when(pred, value))


def count_where(pred: Column) -> Column:
    return F.count(F.when(pred, F.lit(1)))


def max_if(pred: Column, value: Column) -> Column:
    return F.max(F.when(pred, value))


def min_if(pred: Column, value: Column) -> Column:
    return F.min(F.when(pred, value))


def flag(pred: Column) -> Column:
    """1 where pred holds, else 0 (also for an unknown pred)."""
    return F.when(pred, F.lit(1)).otherwise(F.lit(0))


def truth(pred: Column) -> Column:
    """pred as a boolean that is never NULL."""
    return F.coalesce(pred, F.lit(False))


def one_of(col: Column, values: Iterable) -> Column:
    return col.isin(list(values))


def ordered_rules(rules: Sequence[tuple[Column, object]], default=None) -> Column:
    """First label whose condition holds. The order of the rules is part of their meaning."""
    (pred, label), *rest = rules
    out = F.when(pred, _as_col(label))
    for pred, label in rest:
        out = out.when(pred, _as_col(label))
    return out if default is None else out.otherwise(_as_col(default))


def _as_col(value) -> Column:
    return value if isinstance(value, Column) else F.lit(value)


def text_flag(col: Column) -> Column:
    """'TRUE'/'FALSE' text as 1/0, anything else as NULL."""
    return F.when(col == "TRUE", 1).when(col == "FALSE", 0)
