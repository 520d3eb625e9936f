"""Yearly cohorts: churn spells, the decision date before the first one, profile at that date."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tillscope.functions.dates import as_date, days_between
from tillscope.functions.exprs import greatest_strict, one_of, safe_ratio, sum_if_null
from tillscope.operators.ranges import scd2_lookup, uncovered_spells


def cohort_of_year(
    sellers: DataFrame, lifetime: DataFrame, year: int, countries: Sequence[str] | None = ("US",)
) -> DataFrame:
    """Sellers whose first payment falls into the year; the year test is a date range."""
    first = F.col("first_date")
    entered = lifetime.filter(
        (first >= as_date(f"{year}-01-01")) & (first < as_date(f"{year + 1}-01-01"))
    ).select("seller_id", "first_date", "last_date", "payment_count")
    who = sellers.select("seller_id", "category", "country")
    if countries is not None:
        who = who.filter(one_of(F.col("country"), countries))
    return who.join(entered, "seller_id").drop("country")


def first_churns(cohort: DataFrame, active_days: DataFrame, end: Column, window: int) -> DataFrame:
    """First day without trailing activity and number of such spells per seller."""
    covered = active_days.join(cohort.select("seller_id", "first_date"), "seller_id").filter(
        F.col("paid_date") >= F.date_sub("first_date", window)
    )
    spells = uncovered_spells(covered, "seller_id", "paid_date", "first_date", end, window)
    return spells.groupBy("seller_id").agg(
        F.min("spell_start").alias("first_churn_date"), F.count(F.lit(1)).alias("num_churns")
    )


def cohort_churn_milestones(
    sellers: DataFrame, lifetime: DataFrame, active_days: DataFrame, segments: DataFrame,
    facts: DataFrame, year: int, as_of, window: int = 91,
    countries: Sequence[str] | None = ("US",), currency: str = "USD",
) -> DataFrame:
    """One row per cohort seller: churn history and profile in the days before the decision.

    The decision date is `window` days before the first churn day, not before the first payment;
    it is NULL for a seller that never churned, who then has no segment and no trailing rates.
    """
    cohort = cohort_of_year(sellers, lifetime, year, countries)
    end = active_days.agg(F.max("paid_date")).scalar()
    first, last = F.col("first_date"), F.col("last_date")
    decided = cohort.join(first_churns(cohort, active_days, end, window), "seller_id", "left")
    decided = decided.withColumn(
        "decision_date", greatest_strict(F.date_sub("first_churn_date", window), first)
    )
    decision = F.col("decision_date")
    daily = facts.groupBy("seller_id", "report_date").agg(
        F.count(F.lit(1)).alias("trx"),
        F.count(F.when(F.col("card_presence") == "CNP", 1)).alias("cnp"),
        F.count(F.when(F.col("product") == "terminal", 1)).alias("terminal"),
    )
    # one row per seller and day on the fact side; the left join keeps sellers without facts
    inside = F.col("report_date").between(F.date_sub(decision, window), decision)
    counts = (
        decided.join(daily, "seller_id", "left")
        .groupBy(*decided.columns)
        .agg(*[sum_if_null(inside, F.col(c)).alias(c) for c in ("trx", "cnp", "terminal")])
    )
    day = days_between(first, decision) + 1
    history = segments.filter(F.col("currency") == currency)
    profile = scd2_lookup(counts, history, "seller_id", decision, ["sub_segment"])
    return profile.select(
        "seller_id", "category", "first_date", "last_date",
        (F.col("payment_count") / (days_between(first, last) + 1) * 365).alias("annualized_pmt"),
        F.coalesce("num_churns", F.lit(0)).alias("num_churns"),
        F.coalesce(last < F.date_sub(as_date(as_of), window), F.lit(False)).alias("is_churned_now"),
        "decision_date",
        day.alias("decision_day"),
        F.ceil(day / 7).alias("decision_week"),
        F.ceil(day / 30).alias("decision_month"),
        F.col("sub_segment").alias("sub_segment_at_decision"),
        (F.col("trx") / window * 365).alias("annualized_pmt_at_decision"),
        safe_ratio(F.col("cnp"), F.col("trx")).alias("cnp_rate_at_decision"),
        safe_ratio(F.col("terminal"), F.col("trx")).alias("terminal_rate_at_decision"),
    )


def churn_calendar(
    cohort: DataFrame, active_days: DataFrame, end: Column, window: int
) -> DataFrame:
    """The same spells day by day: start, end and length of each run without activity."""
    covered = active_days.join(cohort.select("seller_id", "first_date"), "seller_id").filter(
        F.col("paid_date") >= F.date_sub("first_date", window)
    )
    return uncovered_spells(
        covered, "seller_id", "paid_date", "first_date", end, window
    ).withColumn("days", F.datediff("spell_end", "spell_start") + 1)
