"""Neighbours and as-of matches on event time lines, cut into slices of bounded length.

A window over a whole key would put a very large seller into one task. The rows of each key are counted
by minute; a key with more rows than the limit is cut into slices of whole minutes, and a minute with
more rows than the limit into equal parts. Windows run inside (key, slice); what crosses a border travels
through a table with one row per (key, slice). Rows of one instant stay together. Where no key is above the
limit there is one slice per key and nothing crosses.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tillscope.operators.keyed import ascending, descending
from tillscope.session import staged

#: Rows of one key that a window may sort.
ROW_LIMIT = 1_000_000
PARTS = 1 << 20


def slices(line: DataFrame, key: str, at: str, limit: int = ROW_LIMIT) -> DataFrame | None:
    """The line with `_slice`, which grows with time inside a key; None where no key needs it.

    The minutes of a key are bounded by the calendar, so they may be added up in one window. Only
    those of keys above the limit are stored and joined back.
    """
    sizes = line.filter(F.col(key).isNotNull()).groupBy(key).agg(F.count(F.lit(1)).alias("_n"))
    if not sizes.filter(F.col("_n") > limit).limit(1).collect():
        return None
    minute = F.date_trunc("minute", F.col(at))
    counts = line.groupBy(key, minute.alias("_minute")).agg(F.count(F.lit(1)).alias("_n"))
    whole = Window.partitionBy(key)
    before = whole.orderBy("_minute").rowsBetween(Window.unboundedPreceding, -1)
    heavy = staged(
        counts.withColumn("_total", F.sum("_n").over(whole))
        .withColumn("_before", F.coalesce(F.sum("_n").over(before), F.lit(0)))
        .filter((F.col("_total") > limit) & F.col(key).isNotNull())
        .select(
            key, "_minute", F.floor(F.col("_before") / F.lit(limit)).alias("_cut"),
            F.least(F.ceil(F.col("_n") / F.lit(limit)), F.lit(PARTS)).alias("_parts"),
        )
    )
    passed = F.extract(F.lit("SECOND"), F.col(at)).cast("double") / 60
    part = F.least(F.floor(passed * F.col("_parts")), F.col("_parts") - 1)
    return (
        line.withColumn("_minute", minute)
        .join(heavy, [key, "_minute"], "left")
        .withColumn("_slice", F.coalesce(F.col("_cut") * PARTS + part, F.lit(0)).cast("long"))
        .drop("_minute", "_cut", "_parts")
    )


def with_neighbours(
    df: DataFrame,
    key: str,
    at: str,
    tie: str,
    next_name: str = "next_at",
    last_name: str = "last_at",
    limit: int = ROW_LIMIT,
) -> DataFrame:
    """Adds the instants of the next and the previous row of the same key."""
    df = df.filter(F.col(key).isNotNull())
    cut = slices(df, key, at, limit)
    if cut is None:
        w = Window.partitionBy(key).orderBy(*ascending(at, tie))
        return df.withColumn(next_name, F.lead(at).over(w)).withColumn(last_name, F.lag(at).over(w))
    inside = Window.partitionBy(key, "_slice").orderBy(*ascending(at, tie))
    across = Window.partitionBy(key).orderBy("_slice")
    borders = (
        cut.groupBy(key, "_slice")
        .agg(F.min(at).alias("_first"), F.max(at).alias("_final"))
        .select(
            key,
            "_slice",
            F.lead("_first").over(across).alias("_after"),
            F.lag("_final").over(across).alias("_before"),
        )
    )
    return (
        cut.withColumn(next_name, F.lead(at).over(inside))
        .withColumn(last_name, F.lag(at).over(inside))
        .join(borders, [key, "_slice"], "inner")
        .withColumn(next_name, F.coalesce(next_name, "_after"))
        .withColumn(last_name, F.coalesce(last_name, "_before"))
        .drop("_slice", "_after", "_before")
    )


def asof(
    probes: DataFrame,
    anchors: DataFrame,
    key: str,
    probe_at: str,
    anchor_at: str,
    carry: Sequence[str],
    backward: bool = True,
    limit: int | None = ROW_LIMIT,
    outer: bool = False,
) -> DataFrame:
    """probes plus the carried columns of the nearest anchor at or before (backward) or at or
    after each probe. Probes without such an anchor drop out, or stay with NULLs (outer).

    `carry` starts with the anchor's unique id, which decides ties. Both sides share one sorted
    line and the last anchor is carried along it, so no (probe, anchor) pairs are built. `limit` is
    None where keys have few rows by construction, so that none has to be counted.
    """
    # the anchor as one struct ordered by (instant, id, …), so max/min pick the nearest
    anchor = F.struct(F.col(anchor_at).alias("_a_at"), *[F.col(c) for c in carry])
    marks = anchors.filter(F.col(key).isNotNull() & F.col(anchor_at).isNotNull()).select(
        key, F.col(anchor_at).alias("_at"), anchor.alias("_anchor")
    )
    no_row = F.lit(None).cast(probes.select(F.struct("*").alias("r")).schema["r"].dataType)
    no_anchor = F.lit(None).cast(marks.schema["_anchor"].dataType)
    if not outer:
        probes = probes.filter(F.col(key).isNotNull() & F.col(probe_at).isNotNull())
    line = probes.select(
        key, F.col(probe_at).alias("_at"), no_anchor.alias("_anchor"), F.struct("*").alias("_row"),
    ).unionByName(marks.withColumn("_row", no_row))
    order = ascending if backward else descending
    probe_last = F.when(F.col("_row").isNull(), 0).otherwise(1)
    # Rows without a key or an instant match nothing; they are dealt by their hash.
    lost = F.when(F.col(key).isNull() | F.col("_at").isNull(), F.xxhash64("_row")).otherwise(0)
    sort = [*order("_at"), probe_last, *order("_anchor")]
    running = (Window.unboundedPreceding, Window.currentRow)
    cut = None if limit is None else slices(line, key, "_at", limit)
    if cut is None:
        inside = Window.partitionBy(key, "_lost").orderBy(*sort).rowsBetween(*running)
        hit = line.withColumn("_lost", lost).withColumn(
            "_hit", F.last("_anchor", ignorenulls=True).over(inside)
        ).filter(F.col("_row").isNotNull())
    else:
        cut = cut.withColumn("_lost", lost)
        inside = Window.partitionBy(key, "_slice", "_lost").orderBy(*sort).rowsBetween(*running)
        nearest = F.max if backward else F.min
        across = (
            Window.partitionBy(key)
            .orderBy(F.col("_slice").asc() if backward else F.col("_slice").desc())
            .rowsBetween(Window.unboundedPreceding, -1)
        )
        edges = (
            cut.filter("_lost = 0").groupBy(key, "_slice")
            .agg(nearest("_anchor").alias("_edge"))
            .select(key, "_slice", F.lit(0).cast("long").alias("_lost"),
                    F.last("_edge", ignorenulls=True).over(across).alias("_carry"))
        )
        hit = (
            cut.withColumn("_near", F.last("_anchor", ignorenulls=True).over(inside))
            .filter(F.col("_row").isNotNull())
            .join(edges, [key, "_slice", "_lost"], "left")
            .withColumn("_hit", F.coalesce("_near", "_carry"))
        )
    if not outer:
        hit = hit.filter(F.col("_hit").isNotNull())
    return hit.select("_row.*", F.col("_hit._a_at").alias(anchor_at),
                      *[F.col(f"_hit.{c}").alias(c) for c in carry])


def _match(
    anchors: DataFrame, probes: DataFrame, key: str, anchor_at: str, border_at: str,
    probe_at: str, carry: Sequence[str], backward: bool, limit: int,
) -> DataFrame:
    inside = asof(probes, anchors, key, probe_at, anchor_at, carry, backward, limit)
    borders = anchors.filter(F.col(border_at).isNotNull()).select(
        key, F.col(border_at).alias(probe_at), anchor_at, *carry
    )
    touching = probes.join(borders, [key, probe_at], "inner")
    return inside.unionByName(touching)


def interval_match(
    anchors: DataFrame, probes: DataFrame, key: str, anchor_at: str, next_at: str,
    probe_at: str, carry: Sequence[str], limit: int = ROW_LIMIT,
) -> DataFrame:
    """Pairs of probe and anchor with probe in [anchor, next anchor], both ends inclusive.

    Every probe has one anchor at or before it; it also lies in the intervals that end exactly at
    it. Both are found with sorted slices and an equi join, so the number of pairs handled equals
    the number of pairs returned. Returns the probe columns, `anchor_at` and `carry`.
    """
    return _match(anchors, probes, key, anchor_at, next_at, probe_at, carry, True, limit)


def lookback_match(
    anchors: DataFrame, probes: DataFrame, key: str, anchor_at: str, last_at: str,
    probe_at: str, carry: Sequence[str], limit: int = ROW_LIMIT,
) -> DataFrame:
    """Pairs of probe and anchor with probe in [previous anchor, anchor], both ends inclusive.

    The mirror image of `interval_match`; a minimum age is a filter on the result.
    """
    return _match(anchors, probes, key, anchor_at, last_at, probe_at, carry, False, limit)


def running_by_day(
    df: DataFrame, key: str, day: str, measures: Sequence[str]
) -> DataFrame:
    """Running totals over rows that are already one per (key, day): bounded by the calendar."""
    w = (
        Window.partitionBy(key)
        .orderBy(day)
        .rowsBetween(Window.unboundedPreceding, Window.currentRow)
    )
    return df.select(key, day, *[F.sum(m).over(w).alias(m) for m in measures])


def trailing_sum_at(
    facts: DataFrame,
    anchors: DataFrame,
    key: str,
    fact_day: str,
    anchor_day: str,
    value: str,
    days: int,
    out: str,
) -> DataFrame:
    """Sum of `value` over fact days in [anchor - days, anchor] for each distinct anchor.

    Facts are first reduced to one row per (key, day); facts and anchors then share one sorted
    line and a RANGE frame, so no (anchor, fact) pairs are built. NULL where no fact is in range.
    """
    daily = facts.groupBy(key, F.col(fact_day).alias("_day")).agg(F.sum(value).alias("_v"))
    points = anchors.select(key, F.col(anchor_day).alias("_day")).distinct()
    line = daily.withColumn("_is_anchor", F.lit(0)).unionByName(
        points.withColumn("_is_anchor", F.lit(1)), allowMissingColumns=True
    )
    per_day = line.groupBy(key, "_day").agg(
        F.sum("_v").alias("_v"), F.max("_is_anchor").alias("_is_anchor")
    )
    number = F.datediff("_day", F.lit("1970-01-01").cast("date"))
    w = Window.partitionBy(key).orderBy("_n").rangeBetween(-days, Window.currentRow)
    return (
        per_day.withColumn("_n", number)
        .withColumn(out, F.sum("_v").over(w))
        .filter(F.col("_is_anchor") == 1)
        .select(key, F.col("_day").alias(anchor_day), out)
    )
