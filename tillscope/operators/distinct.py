"""Distinct counts under many conditions without row expansion.

`count(distinct case when p then key end)` for many p in one SELECT makes Spark copy each row
once per distinct group. Here each (group, key) is first reduced to one row of 0/1 flags (with
map-side partial aggregation), then the flags are summed.
"""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def count_keys(
    df: DataFrame, by: Sequence[str], key: str, flags: Mapping[str, Column]
) -> DataFrame:
    """Distinct keys per group that satisfy each condition; groups without any key keep zeros."""
    per_key = (
        df.groupBy(*by, key)
        .agg(*[F.max(F.when(p, 1).otherwise(0)).alias(n) for n, p in flags.items()])
    )
    live = F.col(key).isNotNull()
    sums = [
        F.sum(F.when(live, F.col(n)).otherwise(0)).cast("long").alias(n) for n in flags
    ]
    return per_key.groupBy(*by).agg(*sums)
