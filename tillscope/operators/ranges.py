"""Joins on validity ranges, calendars and one-row tables."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tillscope.functions.dates import as_date
from tillscope.operators.timeline import asof


def scd2_lookup(
    df: DataFrame,
    history: DataFrame,
    key: str,
    at: Column,
    attributes: Sequence[str],
    begin: str = "effective_begin",
    end: str = "effective_end",
    limit: int | None = None,
) -> DataFrame:
    """Left join to the history row valid at `at` (both bounds inclusive): one row per fact.

    Facts and versions share one sorted line and the last version that has begun is carried to the
    facts behind it; it holds if it has not ended. Versions that begin on one day: the one that
    ends last. `limit`: rows of a key that a window may sort, to be given for raw facts; facts
    that are one per key and day need none.
    """
    probe = df.withColumn("_at", at)
    versions = history.select(
        key, F.col(begin).alias("_begin"), F.col(end).alias("_end"),
        *[F.col(a).alias(f"_v_{a}") for a in attributes],
    )
    carry = ["_end", *[f"_v_{a}" for a in attributes]]
    placed = asof(probe, versions, key, "_at", "_begin", carry, limit=limit, outer=True)
    holds = F.col("_at") <= F.col("_end")
    return placed.select(
        *df.columns, *[F.when(holds, F.col(f"_v_{a}")).alias(a) for a in attributes]
    )


def calendar_fill(df: DataFrame, start: Column, end: Column, out: str) -> DataFrame:
    """One row per day from start to end, both inclusive; rows without a valid span give none."""
    span = F.when(start <= end, F.sequence(start, end, F.expr("interval 1 day")))
    return df.withColumn(out, F.explode(span))


def uncovered_spells(
    covered: DataFrame,
    key: str,
    day: str,
    first: str,
    end,
    window: int,
) -> DataFrame:
    """Maximal runs of days in [first, end] that no activity of the last `window` days covers.

    `covered` holds one row per (key, active day) with the key's calendar start in `first`. An
    active day d covers [d, d + window - 1]. The runs follow from the distance to the next
    active day, so no calendar is built: the work is one row per active day, not per day. A key's
    first row also gives the run before it, so `covered` is read once.
    """
    w = Window.partitionBy(key).orderBy(day, first)
    last = as_date(end)
    rows = covered.select(
        key, F.col(first).alias("_first"), F.col(day).alias("_day"),
        F.date_sub(F.lead(day).over(w), 1).alias("_end"), (F.row_number().over(w) == 1).alias("_opens"),
    )
    after = F.struct(
        F.greatest(F.date_add("_day", window), "_first").alias("spell_start"),
        F.least(F.coalesce("_end", last), last).alias("spell_end"),
    )
    before = F.struct(
        F.col("_first").alias("spell_start"), F.least(F.date_sub("_day", 1), last).alias("spell_end")
    )
    spells = F.array_compact(F.array(after, F.when(F.col("_opens"), before)))
    return (
        rows.select(key, F.explode(spells).alias("_spell"))
        .select(key, "_spell.*")
        .filter(F.col("spell_start") <= F.col("spell_end"))
    )


def attach_scalar(df: DataFrame, one_row: DataFrame, name: str) -> DataFrame:
    """Adds the single value of a one-row, one-column aggregate to every row."""
    return df.withColumn(name, one_row.scalar())
