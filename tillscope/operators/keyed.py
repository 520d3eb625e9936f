"""Pick rows per key.

The rank filters keep the form `row_number() <= n`, so Spark puts a group limit before the
shuffle: each map task sends at most n rows per key, however large the key is.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

_RANK = "_rank"


def _cols(items) -> list[Column]:
    return [F.col(i) if isinstance(i, str) else i for i in items]


def ascending(*cols) -> list[Column]:
    """Ascending order with NULLs last."""
    return [c.asc_nulls_last() for c in _cols(cols)]


def descending(*cols) -> list[Column]:
    """Descending order with NULLs last."""
    return [c.desc_nulls_last() for c in _cols(cols)]


def first_per_key(df: DataFrame, keys: Sequence[str], order: Sequence[Column]) -> DataFrame:
    """Row ranked first per key; `order` must end in a unique column."""
    return nth_per_key(df, keys, order, 1)


def latest_per_key(
    df: DataFrame, keys: Sequence[str], at: str, tie: Sequence[str] = ()
) -> DataFrame:
    """Last row per key by `at`, ties by the highest `tie`."""
    return nth_per_key(df, keys, descending(at, *tie), 1)


def nth_per_key(df: DataFrame, keys: Sequence[str], order: Sequence[Column], n: int) -> DataFrame:
    """Row ranked n-th per key; keys with fewer rows give nothing."""
    w = Window.partitionBy(*_cols(keys)).orderBy(*order)
    return df.withColumn(_RANK, F.row_number().over(w)).filter(F.col(_RANK) == n).drop(_RANK)


def top_per_key(df: DataFrame, keys: Sequence[str], order: Sequence[Column], n: int) -> DataFrame:
    """The first n rows per key."""
    w = Window.partitionBy(*_cols(keys)).orderBy(*order)
    return df.withColumn(_RANK, F.row_number().over(w)).filter(F.col(_RANK) <= n).drop(_RANK)


def ranked_first(df: DataFrame, keys: Sequence[str], order: Sequence[Column]) -> DataFrame:
    """All rows that share rank 1, ties kept."""
    w = Window.partitionBy(*_cols(keys)).orderBy(*order)
    return df.withColumn(_RANK, F.rank().over(w)).filter(F.col(_RANK) == 1).drop(_RANK)


def nth_value(
    df: DataFrame, key: str, at: str, tie: Sequence[str], n: int, out: str
) -> DataFrame:
    """Every key with its n-th smallest `at`, NULL where the key has fewer than n rows.

    The n earliest rows per key are kept before the shuffle; rank 1 keeps every key in the result.
    """
    w = Window.partitionBy(key).orderBy(*ascending(at, *tie))
    return (
        df.select(key, at, *[t for t in tie if t != at])
        .withColumn(_RANK, F.row_number().over(w))
        .filter(F.col(_RANK) <= n)
        .groupBy(key)
        .agg(F.max(F.when(F.col(_RANK) == n, F.col(at))).alias(out))
    )
