"""Joins that stay balanced when one key, or NULL, holds a large part of all rows.

The rows of each key are counted once and only keys above an absolute row limit are kept, each with as
many salts as it takes to bring a salt below the limit. Rows of those keys are dealt by salt and the other
side's rows of those keys are repeated once per salt; all other keys keep salt 0. NULL is counted like
a key: it never matches, but in an outer join its rows would all meet in one task. Where no key is above
the limit the join is a plain one.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tillscope.session import staged

#: Rows of one key that a task may get.
ROW_LIMIT = 1_000_000
#: Up to so many keys the list is broadcast; with more it is stored and Spark's size check decides.
FEW_KEYS = 100_000


def heavy_keys(
    df: DataFrame, keys: Sequence[str], limit: int = ROW_LIMIT, few: int = FEW_KEYS
) -> tuple[DataFrame | None, bool]:
    """Keys with more than `limit` rows and their number of salts, counted once, and whether they are
    few; None where there are none. Up to `few` keys come to the driver, more are stored."""
    counts = df.groupBy(*keys).agg(F.count(F.lit(1)).alias("_n"))
    heavy = counts.filter(F.col("_n") > limit).select(
        *keys, F.ceil(F.col("_n") / F.lit(limit)).cast("int").alias("_salts")
    )
    found = heavy.limit(few + 1).collect()
    if not found:
        return None, True
    if len(found) > few:
        return staged(heavy), False
    return df.sparkSession.createDataFrame(found, heavy.schema), True


def _with_salts(df: DataFrame, heavy: DataFrame, keys: Sequence[str], few: bool) -> DataFrame:
    renamed = heavy.select(*[F.col(k).alias(f"_heavy_{k}") for k in keys], "_salts")
    same = F.lit(True)
    for k in keys:
        same = same & F.col(k).eqNullSafe(F.col(f"_heavy_{k}"))
    joined = df.join(F.broadcast(renamed) if few else renamed, same, "left")
    return joined.drop(*[f"_heavy_{k}" for k in keys])


def skew_join(
    facts: DataFrame,
    other: DataFrame,
    keys: Sequence[str],
    how: str = "inner",
    spread: Column | None = None,
    limit: int = ROW_LIMIT,
) -> DataFrame:
    """Equi join of a possibly skewed fact side with any other side, inner, left or left_semi.

    `spread` gives the salt source of a fact row; by default a hash of all its columns, so rows
    that are alike in every column share a salt.
    """
    if how not in ("inner", "left", "left_semi"):
        raise ValueError(f"skew_join keeps the fact side only: {how}")
    heavy, few = heavy_keys(facts, keys, limit)
    if heavy is None:
        return facts.join(other, list(keys), how)
    source = spread if spread is not None else F.xxhash64(*facts.columns)
    salt = F.when(F.col("_salts").isNotNull(), F.pmod(source, F.col("_salts"))).otherwise(0)
    salted = _with_salts(facts, heavy, keys, few).withColumn("_salt", salt.cast("int")).drop("_salts")
    each = F.sequence(F.lit(0), F.coalesce(F.col("_salts"), F.lit(1)) - 1)
    known = other.dropna(subset=list(keys))
    copies = _with_salts(known, heavy, keys, few).withColumn("_salt", F.explode(each)).drop("_salts")
    return salted.join(copies, [*keys, "_salt"], how).drop("_salt")


def outer_lookup(
    facts: DataFrame, lookup: DataFrame, key: str, limit: int | None = ROW_LIMIT
) -> DataFrame:
    """Left join of facts to a lookup table by a key that is often NULL or the same.

    Every fact row stays, with NULLs where the key is NULL or unknown. `limit` is None for keys of
    few rows, which need no count; NULL rows are dealt by their hash in that case too.
    """
    if limit is not None:
        return skew_join(facts, lookup, [key], "left", limit=limit)
    apart = F.when(F.col(key).isNull(), F.xxhash64(*facts.columns)).otherwise(F.lit(0))
    known = lookup.filter(F.col(key).isNotNull()).withColumn("_apart", F.lit(0).cast("long"))
    return facts.withColumn("_apart", apart).join(known, [key, "_apart"], "left").drop("_apart")


def not_first_rows(
    df: DataFrame, key: str, at: str, tie: str, limit: int = ROW_LIMIT
) -> DataFrame:
    """All rows but the earliest of each key, without sorting a whole key in one task.

    `tie` is unique within the key. The earliest row per key is an aggregate; rows are then
    compared with it through a join that spreads heavy keys.
    """
    first = df.groupBy(key).agg(
        F.min(F.struct(F.col(at).alias("a"), F.col(tie).alias("t"))).alias("_first")
    )
    joined = skew_join(df, first, [key], "inner", limit=limit)
    mine = F.struct(F.col(at).alias("a"), F.col(tie).alias("t"))
    return joined.filter(mine > F.col("_first")).drop("_first")
