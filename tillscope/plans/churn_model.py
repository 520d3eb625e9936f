"""Populations and features for a churn model: scoring set, training set, labels."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tillscope.functions.dates import as_date, days_between, week_start, weeks_between
from tillscope.functions.exprs import one_of


def scoring_population(
    users: DataFrame, lifetime: DataFrame, as_of,
    countries: Sequence[str] = ("US",), languages: Sequence[str] = ("en-US", "es-US"),
    min_age: int = 91, max_age: int = 182,
) -> DataFrame:
    """Live units of live merchants whose first payment is min_age to max_age days ago."""
    unit = users.filter(
        (F.col("user_type") == "UNIT")
        & (F.col("is_frozen") == 0)
        & (F.col("is_deactivated") == 0)
        & F.col("is_active")
    ).select(F.col("parent_id").alias("merchant_id"), F.col("user_id").alias("unit_id"))
    merchant = users.filter(
        (F.col("user_type") == "MERCHANT")
        & (F.col("is_deleted") == 0)
        & one_of(F.col("country"), countries)
        & one_of(F.col("language"), languages)
    ).select(F.col("user_id").alias("merchant_id"))
    aged = lifetime.filter(
        F.col("first_date").between(
            F.date_sub(as_date(as_of), max_age), F.date_sub(as_date(as_of), min_age)
        )
    ).select("merchant_id")
    return (
        unit.join(merchant, "merchant_id")
        .join(aged, "merchant_id")
        .select("merchant_id", "unit_id")
        .distinct()
    )


def rf_features(daily: DataFrame, training_date, gap: int = 28, horizon: int = 118) -> DataFrame:
    """Recency, frequency and the future label from one pass over the daily table.

    Past days build the features; days in (date + gap, date + horizon] decide the label.
    """
    at = as_date(training_date)
    past = F.col("paid_date") <= at
    future = (F.col("paid_date") > F.date_add(at, gap)) & (
        F.col("paid_date") <= F.date_add(at, horizon)
    )
    used = daily.filter(
        (F.col("card_count") > 0) & (F.col("paid_date") <= F.date_add(at, horizon))
    )
    # first to (seller, day), then to (seller, week): the distinct counts become plain counts
    per_day = used.groupBy("seller_id", "paid_date").agg(F.sum("card_count").alias("n"))
    per_week = per_day.groupBy("seller_id", week_start(F.col("paid_date")).alias("week")).agg(
        F.min(F.when(past, F.col("paid_date"))).alias("d0"),
        F.max(F.when(past, F.col("paid_date"))).alias("d1"),
        F.count(F.when(past, 1)).alias("days"),
        F.sum(F.when(past, F.col("n"))).alias("n"),
        F.sum(F.when(future, F.col("n"))).alias("future_n"),
    )
    first, last = F.col("first_date"), F.col("last_date")
    return (
        per_week.groupBy("seller_id")
        .agg(
            F.min("d0").alias("first_date"),
            F.max("d1").alias("last_date"),
            F.sum("n").alias("payments_to_date"),
            F.sum("days").alias("days_to_date"),
            F.count(F.when(F.col("days") > 0, 1)).alias("weeks"),
            F.sum("future_n").alias("future_n"),
        )
        .filter(first.isNotNull())
        .select(
            "seller_id", "first_date", "last_date", "payments_to_date",
            at.alias("training_date"),
            (F.col("days_to_date") - 1).alias("frequency"),
            days_between(first, last).alias("recency"),
            days_between(first, at).alias("time_active"),
            days_between(last, at).alias("days_since_last"),
            (F.col("weeks") / (weeks_between(first, last) + 1)).alias("weeks_active"),
            F.when(F.col("future_n") > 0, 0).otherwise(1).alias("is_churned"),
        )
    )


def with_trailing_profit(
    sample: DataFrame, revenue: DataFrame, fees: DataFrame, days: int
) -> DataFrame:
    """Sample rows with revenue minus fees and volume of the `days` before their last payment.

    A side without rows stays NULL and makes the profit NULL. The reference's day-by-day outer
    join of the two facts followed by sums equals one stacked sum, so only one shuffle is needed.
    """
    def daily(facts: DataFrame, cols: Sequence[str]) -> DataFrame:
        return facts.groupBy("seller_id", "report_date").agg(*[F.sum(c).alias(c) for c in cols])

    stacked = daily(revenue, ["revenue", "gpv_net"]).unionByName(
        daily(fees, ["fee"]), allowMissingColumns=True
    )
    inside = F.col("report_date").between(F.date_sub("last_date", days), F.col("last_date"))
    return (
        stacked.join(sample, "seller_id")
        .filter(inside)
        .groupBy(*sample.columns)
        .agg(
            (F.sum("revenue") - F.sum("fee")).alias("profit_91d"),
            F.sum("gpv_net").alias("gpv_91d"),
        )
    )


def training_population(
    daily: DataFrame, users: DataFrame, revenue: DataFrame, fees: DataFrame, training_date,
    countries: Sequence[str] | None = ("US",), source_type: str = "seller", gap: int = 28, horizon: int = 118,
    min_payments: int = 10, min_age: int = 14, max_age: int = 182, min_weeks_active: float = 0.3,
    min_profit: int = 2000, min_yearly_volume: int = 500_000, days: int = 91,
) -> DataFrame:
    """Training rows: features, label and trailing profit, kept by profit and yearly volume.

    Money limits are in minor units.
    """
    at = as_date(training_date)
    live = users.filter(
        (F.col("is_frozen") == 0) & (F.col("is_deactivated") == 0)
        & (F.col("source_user_type") == source_type)
    )
    if countries is not None:
        live = live.filter(one_of(F.col("country"), countries))
    sample = rf_features(daily, training_date, gap, horizon).filter(
        (F.col("payments_to_date") > min_payments)
        & (F.col("first_date") < F.date_sub(at, min_age))
        & (F.col("first_date") >= F.date_sub(at, max_age))
        & (F.col("weeks_active") > min_weeks_active)
    ).join(
        live.select(
            F.col("user_id").alias("seller_id"), "country", F.col("parent_id").alias("merchant_id"),
            F.when(F.col("user_type") == "UNIT", F.col("user_id")).alias("unit_id"),
        ),
        "seller_id",
    )
    return (
        with_trailing_profit(sample, revenue, fees, days)
        .filter((F.col("profit_91d") > min_profit) & (F.col("gpv_91d") * 4 > min_yearly_volume))
        .select(
            "unit_id", F.col("seller_id").alias("user_id"), "merchant_id", "country", "first_date",
            "last_date", "training_date", "frequency", "recency", "time_active", "days_since_last",
            "is_churned", "profit_91d",
        )
    )
