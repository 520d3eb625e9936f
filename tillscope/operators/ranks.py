"""Global ranks and shares without a single-partition window."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

BUCKETS = 1024
#: Rows that one task may order.
ROW_LIMIT = 1_000_000


def value_at_rank(df: DataFrame, value: str, rank: DataFrame, limit: int = ROW_LIMIT) -> DataFrame:
    """One row: the value at a descending rank, exact, ties counted one by one; none where the
    rank is beyond the rows.

    The span of the values is cut into equal buckets, which are counted; the bucket that holds the
    rank is cut again, until it holds one value or no more than `limit` rows. Only those are ordered.
    The driver sees the counts of the buckets of a round.
    """
    rows = df.filter(F.col(value).isNotNull()).select(F.col(value).alias("_v"))
    wanted = rank.first()
    left = wanted[0] if wanted else None
    span = rows.agg(F.min("_v").alias("lo"), F.max("_v").alias("hi"), F.count("*").alias("n")).first()
    lo, hi, n = span
    none = rows.filter(F.lit(False)).select(F.col("_v").alias(value))
    if left is None or not 1 <= left <= n:
        return none
    number = F.col("_v").cast("double")
    while n > limit and float(lo) < float(hi):
        inside = rows.filter(F.col("_v").between(F.lit(lo), F.lit(hi)))
        step = (float(hi) - float(lo)) / BUCKETS
        bucket = F.floor((number - F.lit(float(lo))) / F.lit(step)) if step else F.lit(0)
        found = inside.groupBy(bucket.alias("b")).agg(
            F.min("_v").alias("lo"), F.max("_v").alias("hi"), F.count("*").alias("n")).collect()
        for _, low, high, count in sorted(found, reverse=True):
            if left <= count:
                break
            left -= count
        if (low, high, count) == (lo, hi, n):
            break  # the values differ by less than a double can tell
        lo, hi, n = low, high, count
    counted = rows.filter(F.col("_v").between(F.lit(lo), F.lit(hi))).groupBy("_v").agg(F.count("*").alias("_n"))
    upto = Window.orderBy(F.col("_v").desc()).rowsBetween(Window.unboundedPreceding, Window.currentRow)
    return (
        counted.withColumn("_to", F.sum("_n").over(upto))
        .filter((F.col("_to") - F.col("_n") < left) & (F.lit(left) <= F.col("_to")))
        .select(F.col("_v").alias(value))
    )


def with_share(df: DataFrame, value: str, out: str) -> DataFrame:
    """value / grand total; the total is a one-row scalar, not an unpartitioned window."""
    total = df.agg(F.sum(value).cast("double"))
    return df.withColumn(out, F.col(value).cast("double") / F.nullif(total.scalar(), F.lit(0.0)))
