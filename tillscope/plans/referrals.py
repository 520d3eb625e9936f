"""Referral spine, exposure rates, quality by timing and support cases per pair."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tillscope.functions.dates import NEVER, as_date
from tillscope.functions.exprs import count_where, one_of, ordered_rules, safe_ratio
from tillscope.operators.skew import skew_join

NEVER_AT = "9999-09-09 00:00:00"
ONBOARD = ("onboard_web", "onboard_app")
IN_APP = ("dashboard", "app_android", "app_ios")


def never_at():
    return F.lit(NEVER_AT).cast("timestamp_ntz")


def referral_spine(
    sellers: DataFrame, signups: DataFrame, lifetime: DataFrame, referrals: DataFrame
) -> DataFrame:
    """One row per seller and referral made, with payment instants (sentinel for "never")."""
    made = referrals.select(
        F.col("referrer_id").alias("seller_id"), F.col("action_at").alias("referred_at"),
        "referee_amount",
    )
    base = (
        sellers.select("seller_id")
        .join(signups.select("seller_id", "signup_date", "activation_date"), "seller_id", "left")
        .join(lifetime.select("seller_id", "first_at", "last_at"), "seller_id", "left")
    )
    # distinct referrals first: the other columns are unique per seller
    return base.join(made.distinct(), "seller_id", "left").select(
        "seller_id", "signup_date", "activation_date",
        F.coalesce("first_at", never_at()).alias("first_payment_at"),
        F.coalesce("last_at", never_at()).alias("latest_payment_at"),
        "referred_at", "referee_amount",
    )


def exposure_referral_rates(
    spine: DataFrame, touchpoints: DataFrame, since, onboard: Sequence[str] = ONBOARD,
    in_app: Sequence[str] = IN_APP,
) -> DataFrame:
    """Global exposure and referral rates, overall and by channel group.

    "Some referral after some touchpoint" holds exactly when the last referral is later than the
    first touchpoint, so each side is reduced to one row per seller before they meet and no
    (referral, touchpoint) pairs are built.
    """
    per_seller = (
        spine.filter(F.col("activation_date") != F.lit(NEVER))
        .groupBy("seller_id")
        .agg(F.max("referred_at").alias("last_ref"), F.min("first_payment_at").alias("first_at"))
    )
    channel, at = F.col("channel"), F.col("action_at")
    touches = touchpoints.groupBy("seller_id").agg(
        F.min(at).alias("touch"),
        F.min(F.when(one_of(channel, onboard), at)).alias("touch_onboard"),
        F.min(F.when(one_of(channel, in_app), at)).alias("touch_app"),
    )
    row = per_seller.join(touches, "seller_id", "left")
    ref, first = F.col("last_ref"), F.col("first_at")
    paid = first != never_at()
    n = row.agg(
        F.count(F.lit(1)).alias("total"),
        count_where(ref > as_date(since).cast("timestamp_ntz")).alias("referred"),
        *[count_where(F.col(c).isNotNull()).alias(c)
          for c in ("touch", "touch_onboard", "touch_app")],
        *[count_where(ref > F.col(c)).alias(f"ref_{c}")
          for c in ("touch", "touch_onboard", "touch_app")],
        count_where(paid).alias("paid"),
        count_where(paid & (ref > first)).alias("ref_paid"),
    )

    def rate(num: str, den: str, name: str):
        return safe_ratio(F.col(num), F.col(den)).alias(name)

    return n.select(
        "total",
        rate("referred", "total", "referral_rate"),
        rate("touch", "total", "exposed_rate"),
        rate("touch_onboard", "total", "onboard_exposed_rate"),
        rate("touch_app", "total", "app_exposed_rate"),
        rate("ref_touch", "touch", "referral_rate_exposed"),
        rate("ref_touch_onboard", "touch_onboard", "referral_rate_onboard"),
        rate("ref_touch_app", "touch_app", "referral_rate_app"),
        rate("paid", "total", "payer_rate"),
        rate("ref_paid", "paid", "referral_rate_payers"),
    )


def referral_quality_by_point(spine: DataFrame) -> DataFrame:
    """Referrals made before and after the referrer's first payment, and what they brought."""
    made = spine.filter(
        (F.col("activation_date") != F.lit(NEVER)) & F.col("referred_at").isNotNull()
    )
    point = ordered_rules([
        (F.col("referred_at") < F.col("first_payment_at"), "before first payment"),
        (F.col("referred_at") > F.col("first_payment_at"), "after first payment"),
    ])
    per_referrer = made.groupBy(point.alias("referral_point"), "seller_id").agg(
        F.count(F.lit(1)).alias("n"),
        F.sum(F.coalesce("referee_amount", F.lit(0))).alias("amount"),
        F.count("referee_amount").alias("paying"),
    )
    n, amount, referrers = F.sum("n"), F.sum("amount"), F.count("seller_id")
    return per_referrer.groupBy("referral_point").agg(
        n.alias("referrals"),
        safe_ratio(amount, n).alias("amount_per_referee"),
        safe_ratio(F.sum("paying"), n).alias("paying_rate"),
        safe_ratio(amount, referrers).alias("amount_per_referrer"),
        safe_ratio(n, referrers).alias("referees_per_referrer"),
    )


def cases_by_pair(
    referrals: DataFrame, cases: DataFrame, labels: DataFrame, since, bucket: str = "referrals"
) -> DataFrame:
    """Distinct labelled cases of both sides of each referral.

    The two case branches would multiply each other; since only distinct counts are wanted, each
    seller's cases are counted once and looked up for both sides. A referrer may own a large
    part of all pairs, so that lookup spreads hot referrers.
    """
    pairs = (
        referrals.filter(F.col("action_at") > as_date(since).cast("timestamp_ntz"))
        .select("referrer_id", "referee_id")
        .distinct()
    )
    labelled = labels.filter(F.col("issue_bucket") == bucket).select("case_id").distinct()
    per_seller = (
        cases.join(labelled, "case_id")
        .select("seller_id", "case_id")
        .distinct()
        .groupBy("seller_id")
        .agg(F.count(F.lit(1)).alias("n"))
    )
    left = per_seller.select(F.col("seller_id").alias("referrer_id"),
                             F.col("n").alias("referrer_cases"))
    right = per_seller.select(F.col("seller_id").alias("referee_id"),
                              F.col("n").alias("referee_cases"))
    return (
        skew_join(pairs, left, ["referrer_id"], "left")
        .join(right, "referee_id", "left")
        .select(
            "referrer_id", "referee_id",
            F.coalesce("referrer_cases", F.lit(0)).alias("referrer_cases"),
            F.coalesce("referee_cases", F.lit(0)).alias("referee_cases"),
        )
    )


def cases_per_pair(pairs: DataFrame) -> DataFrame:
    """Totals over all pairs."""
    return pairs.agg(
        F.sum(F.col("referrer_cases") + F.col("referee_cases")).alias("cases"),
        F.count(F.concat("referrer_id", "referee_id")).alias("pairs"),
    )
