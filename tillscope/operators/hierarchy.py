"""Facts of units moved to their merchants, before any window or rule sees them.

A unit belongs to one merchant through the parent link of the user table. Facts are first reduced per unit,
so a unit sends one row for each day, product or card to the join, whatever its size; the rows of
sister units are then merged, counts and sums by adding, first instants and flags by minimum and maximum.
"""

from __future__ import annotations

from collections.abc import Callable, Mapping, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tillscope.operators.skew import ROW_LIMIT, outer_lookup

#: A measure: its aggregate over the rows of a unit, and how the units of a merchant are merged.
Measure = tuple[Column, Callable[[str], Column]]


def links(users: DataFrame, unit: str, merchant: str, kind: str | None = None) -> DataFrame:
    """Merchant of each user; a merchant is its own. `kind` keeps users of one type."""
    own = F.when(F.col("user_type") == "MERCHANT", F.col("user_id")).otherwise(F.col("parent_id"))
    rows = users if kind is None else users.filter(F.col("user_type") == kind)
    return rows.select(F.col("user_id").alias(unit), own.alias(merchant))


def to_merchant(
    df: DataFrame, users: DataFrame, user: str, merchant: str = "merchant_id",
    kind: str | None = None, limit: int | None = ROW_LIMIT,
) -> DataFrame:
    """Left join user → merchant; rows with an unknown or no user stay, with a NULL merchant."""
    return outer_lookup(df, links(users, user, merchant, kind), user, limit)


def only_targets(grouped: DataFrame, targets: DataFrame, key: str) -> DataFrame:
    """Grouped facts of the target keys. Where the targets are small enough to be broadcast, Spark
    moves this join below the grouping, so only their facts are grouped; else it stays behind it
    and raw facts aren't shuffled for it."""
    return grouped.join(targets.select(key), key, "left_semi")


def roll_up(
    facts: DataFrame, users: DataFrame, unit: str, by: Sequence[str],
    measures: Mapping[str, Measure], merchant: str = "seller_id", kind: str | None = "UNIT",
    targets: DataFrame | None = None,
) -> DataFrame:
    """One row per merchant and `by` with the measures of all its units together.

    A unit has one row per `by` at the join; where that is many, Spark splits its partition. With
    `targets`, a table of merchants, only their facts are kept. Facts of unknown units have no
    merchant and drop out.
    """
    link = links(users, unit, merchant, kind)
    per_unit = facts.groupBy(unit, *by).agg(*[first.alias(n) for n, (first, _) in measures.items()])
    if targets is not None:
        link = link.join(targets.select(merchant), merchant, "left_semi")
        per_unit = only_targets(per_unit, link, unit)
    return (
        per_unit.join(link, unit)
        .groupBy(merchant, *by)
        .agg(*[merge(n).alias(n) for n, (_, merge) in measures.items()])
    )


def merchant_flags(
    users: DataFrame, active_units: DataFrame, unit: str, by: Sequence[str], flags: Sequence[str],
    merchant: str = "seller_id",
) -> DataFrame:
    """Per merchant and attribute of its units: the highest value of each flag over the units in
    `active_units`, whose columns beside the unit are added up."""
    counts = [c for c in active_units.columns if c != unit]
    units = users.filter(F.col("user_type") == "UNIT").select(
        F.col("user_id").alias(unit), F.col("parent_id").alias(merchant), *by, *flags
    )
    return active_units.join(units, unit).groupBy(merchant, *by).agg(
        *[F.max(f).alias(f) for f in flags], *[F.sum(c).alias(c) for c in counts]
    )
