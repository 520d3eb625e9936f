"""Grants against their use, by month, currency and the category of the grant."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tillscope.functions.dates import as_date, month_start
from tillscope.functions.exprs import one_of, ordered_rules
from tillscope.operators.sets import outer_by_keys

OWN_NAME = ("campaign", "partner", "system_referral")
TEAM_TAGS = ("account_management", "customer_support")
BY_TAG = ("other", "rebate")


def grant_category() -> Column:
    """Category of a grant; a manual grant without tag has none (NULL is not "another tag")."""
    kind, tag = F.col("change_type"), F.col("product_tag")
    manual = kind == "manual_referral"
    return ordered_rules([
        (one_of(kind, OWN_NAME), kind),
        (manual & one_of(tag, TEAM_TAGS), tag),
        (manual & ~one_of(tag, TEAM_TAGS), "customer_support"),
        (one_of(kind, BY_TAG), tag),
    ])


def grant_vs_usage(changes: DataFrame, since, balance_type: str = "free_processing") -> DataFrame:
    """Granted and used amounts side by side; NULL categories of both sides share one row.

    A use meets every grant of its balance. Both sides are first reduced per balance, and the
    grants enter as a count, so no (use, grant) pairs are built. The sides are unique per month,
    currency and category, so stacking and grouping equals their full outer join regrouped.
    """
    recent = F.col("changed_date") > as_date(since)
    this_type = F.col("balance_type") == balance_type
    month = month_start(F.col("changed_date"))
    is_grant = F.col("action") == "Grant"
    marked = changes.withColumn("category", grant_category()).withColumn("month", month)

    granted = (
        marked.filter(recent & is_grant & this_type)
        .groupBy("month", "currency", "category")
        .agg(
            F.count(F.lit(1)).alias("granted_rewards"),
            F.sum("amount").alias("granted_amount"),
            F.avg("to_usd").alias("rate"),
        )
        .withColumn("granted_usd", F.col("granted_amount") * F.col("rate"))
        .drop("rate")
    )
    uses = (
        marked.filter(
            recent & this_type & one_of(F.col("action"), ["Use", "Refund", "Undo Refund"])
        )
        .groupBy("balance_id", "month", "currency")
        .agg(
            F.count(F.when(F.col("action") == "Use", 1)).alias("uses"),
            F.sum("amount").alias("amount"),
            F.sum("contra_revenue").alias("contra"),
            F.sum("to_usd").alias("rate_sum"),
            F.count("to_usd").alias("rate_n"),
        )
    )
    grants = (
        marked.filter(is_grant)
        .groupBy("balance_id", "category")
        .agg(F.count(F.lit(1)).alias("grants"))
    )
    times = F.col("grants")
    used = (
        uses.join(grants, "balance_id")
        .groupBy("month", "currency", "category")
        .agg(
            F.sum(F.col("uses") * times).alias("uses"),
            (F.lit(0) - F.sum(F.col("amount") * times)).alias("used_amount"),
            F.sum(F.col("contra") * times).alias("contra_revenue"),
            (F.sum(F.col("rate_sum") * times) / F.sum(F.col("rate_n") * times)).alias("rate"),
        )
        .withColumn("used_usd", F.col("used_amount") * F.col("rate"))
        .withColumn("contra_revenue_usd", F.col("contra_revenue") * F.col("rate"))
        .drop("rate")
    )
    sides = {
        "granted": ["granted_rewards", "granted_amount", "granted_usd"],
        "used": ["uses", "used_amount", "used_usd", "contra_revenue", "contra_revenue_usd"],
    }
    both = outer_by_keys(
        {"granted": granted, "used": used}, ["month", "currency", "category"], sides
    )
    return both.withColumnRenamed("month", "report_month").drop("in_granted", "in_used")
