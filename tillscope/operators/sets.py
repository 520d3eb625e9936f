"""Semi, anti and presence joins with their NULL rules."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def keep_members(df: DataFrame, keys: DataFrame, on: str) -> DataFrame:
    """Rows whose key is in the set (IN subquery)."""
    return df.join(keys.select(on), on, "left_semi")


def drop_members(df: DataFrame, keys: DataFrame, on: str) -> DataFrame:
    """NOT IN subquery: a NULL probe or any NULL in a non-empty set yields no row.

    Written as an anti join on the non-NULL keys plus two scalar facts about the set, so it stays
    a hash or sort-merge join at any size of the set.
    """
    member = keys.select(F.col(on).alias("_k"))
    facts = member.agg(
        F.count(F.lit(1)).alias("n"), F.count(F.when(F.col("_k").isNull(), 1)).alias("nulls")
    )
    n, nulls = facts.select("n").scalar(), facts.select("nulls").scalar()
    kept = df.join(member.filter(F.col("_k").isNotNull()), F.col(on) == F.col("_k"), "left_anti")
    return kept.filter((nulls == 0) & (F.col(on).isNotNull() | (n == 0)))


def with_membership(df: DataFrame, keys: DataFrame, on: str, out: str) -> DataFrame:
    """Adds a boolean: is the key in the set. The set is reduced to distinct keys first."""
    marked = keys.select(on).distinct().withColumn("_in", F.lit(True))
    return (
        df.join(marked, on, "left")
        .withColumn(out, F.coalesce("_in", F.lit(False)))
        .drop("_in")
    )


def outer_by_keys(
    sides: Mapping[str, DataFrame], keys: Sequence[str], values: Mapping[str, Sequence[str]]
) -> DataFrame:
    """Full outer join of sources that are each unique on `keys`, as union and group.

    One shuffle for all sides instead of one sort-merge join per side; a value is NULL where its
    side has no row. Rows with a NULL key part are grouped with each other.
    """
    stacked = None
    for name, df in sides.items():
        part = df.select(*keys, *values[name], F.lit(True).alias(f"in_{name}"))
        stacked = (
            part if stacked is None else stacked.unionByName(part, allowMissingColumns=True)
        )
    aggs: list[Column] = []
    for name in sides:
        aggs += [F.max(v).alias(v) for v in values[name]]
        aggs.append(F.coalesce(F.max(f"in_{name}"), F.lit(False)).alias(f"in_{name}"))
    return stacked.groupBy(*keys).agg(*aggs)
