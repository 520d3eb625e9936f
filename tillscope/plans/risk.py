"""Sellers that stopped completely, with the risk cases and chargebacks around their last sale."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tillscope.functions.dates import as_date, days_between
from tillscope.functions.exprs import flag, one_of
from tillscope.operators.ranges import scd2_lookup
from tillscope.operators.skew import skew_join
from tillscope.operators.sets import drop_members, keep_members, with_membership

# Case groups that are not about risk, chargeback types with their own count.
NON_RISK_GROUPS = ("compliance", "chargebacks", "finance", "underwriting")
TAXONOMY = ("fake_account", "gone_bad", "takeover", "buyer_fraud", "credit_risk", "inline")


def exclusive_churned_sellers(
    revenue: DataFrame, sellers: DataFrame, as_of, since, product: str = "terminal",
    category: str = "Processing", silent_days: int = 91, min_volume: int = 100,
) -> DataFrame:
    """Sellers with product volume since a date and no sale of any kind in the last days.

    "Not in the recent sellers" keeps its NULL rule. `only_product` is true when the seller has
    used no other product of the category since the date.
    """
    start = as_date(since)
    recent = revenue.filter(
        F.col("report_date") > F.date_sub(as_date(as_of), silent_days)
    ).select(F.col("seller_id").alias("user_id")).distinct()
    others = revenue.filter(
        (F.col("report_date") >= start) & (F.col("product") != product)
        & (F.col("category") == category)
    ).select("seller_id")
    volumes = (
        revenue.filter((F.col("product") == product) & (F.col("report_date") >= start))
        .groupBy("seller_id")
        .agg(F.sum("volume_gross").alias("volume"), F.max("report_date").alias("last_sale"))
        .filter(F.col("volume") > min_volume)
    )
    who = sellers.select("seller_id", F.col("category"), F.col("seller_id").alias("user_id"))
    gone = drop_members(volumes.join(who, "seller_id", "left"), recent, "user_id")
    return (
        with_membership(gone, others, "seller_id", "_other")
        .withColumn("only_product", ~F.col("_other"))
        .select("seller_id", "category", "volume", "only_product", "last_sale")
    )


def last_cases(
    cases: DataFrame, churned: DataFrame, kinds: Mapping[str, Column], days: int = 30
) -> DataFrame:
    """Cases within `days` of the last sale, per kind: their number and the latest one.

    All kinds come from one pass. Cases are reduced to one row per seller and day before they
    meet the sellers. Equal dates are decided by the highest case id.
    """
    attrs = ["case_group", "case_type", "subroute", "deactivated", "frozen"]
    case = F.struct("case_id", *attrs)
    per_day = []
    for kind, holds in kinds.items():
        per_day.append(F.count(F.when(holds, F.col("case_id"))).alias(f"n_{kind}"))
        per_day.append(F.max(F.when(holds, case)).alias(f"top_{kind}"))
    near = F.col("created_date").between(
        F.date_sub("last_sale", days), F.date_add("last_sale", days)
    )
    per_seller, out = [], []
    for kind in kinds:
        top = F.col(f"top_{kind}")
        latest = F.when(top.isNotNull(), F.struct(F.col("created_date"), top.alias("top")))
        per_seller += [F.sum(f"n_{kind}").alias(f"n_{kind}"), F.max(latest).alias(f"last_{kind}")]
        out += [
            F.nullif(F.col(f"n_{kind}"), F.lit(0)).alias(f"case_count_{kind}"),
            F.col(f"last_{kind}.created_date").alias(f"last_case_date_{kind}"),
            *[F.col(f"last_{kind}.top.{a}").alias(f"last_{a}_{kind}") for a in attrs],
        ]
    return (
        cases.groupBy("seller_id", "created_date")
        .agg(*per_day)
        .join(churned.select("seller_id", "last_sale"), "seller_id")
        .filter(near)
        .groupBy("seller_id")
        .agg(*per_seller)
        .select("seller_id", *out)
    )


def is_risk_case() -> Column:
    return ~one_of(F.col("case_group"), NON_RISK_GROUPS) & ~F.col("subroute").like("%requeue%")


def case_kinds() -> dict[str, Column]:
    return {"any": F.lit(True), "risk": is_risk_case()}


def chargeback_counts(
    chargebacks: DataFrame, churned: DataFrame, since, kinds: Sequence[str] = TAXONOMY
) -> DataFrame:
    kind = F.col("taxonomy")
    counts = chargebacks.filter(F.col("chargeback_date") >= as_date(since)).groupBy(
        "seller_id"
    ).agg(
        *[F.sum(flag(kind == k)).alias(f"chargeback_{k}") for k in kinds],
        F.sum(flag(kind.isNull())).alias("chargeback_none"),
    )
    return keep_members(counts, churned, "seller_id")


def churned_with_risk_history(
    churned: DataFrame, created: DataFrame, adoptions: DataFrame, segments: DataFrame,
    cases: DataFrame, chargebacks: DataFrame, since, days: int = 30, mature_days: int = 456,
) -> DataFrame:
    """One row per churned seller: age, segment at the last sale, latest cases, chargebacks.

    The source joins every case row of both kinds to the seller, which multiplies them. Here each
    kind contributes its latest case; `case_rows` has all of them, once each.
    """
    first_activity = keep_members(
        adoptions.groupBy("seller_id").agg(F.min("first_date").alias("first_activity_date")),
        churned, "seller_id",
    )
    aged = (
        churned.join(created.select("seller_id", "created_date"), "seller_id", "left")
        .join(first_activity, "seller_id", "left")
        .withColumn(
            "is_mature",
            F.coalesce(
                days_between(F.col("first_activity_date"), F.col("last_sale")) > mature_days,
                F.lit(False),
            ),
        )
    )
    placed = scd2_lookup(aged, segments, "seller_id", F.col("last_sale"), ["segment"])
    return (
        placed.join(last_cases(cases, churned, case_kinds(), days), "seller_id", "left")
        .join(chargeback_counts(chargebacks, churned, since), "seller_id", "left")
    )


def case_rows(cases: DataFrame, churned: DataFrame, days: int = 30) -> DataFrame:
    """Every case of a churned seller once: is it of risk, the latest of its kind in the window.

    Carries all rows that the source's joins multiply, without the multiplication.
    """
    marks = [f"{m}_{k}" for k in case_kinds() for m in ("case_count", "last_case_date")]
    per_seller = churned.select("seller_id").join(
        last_cases(cases, churned, case_kinds(), days).select("seller_id", *marks),
        "seller_id", "left",
    )
    risk = is_risk_case()
    at = F.col("created_date")
    any_is_last = at == F.col("last_case_date_any")
    risk_is_last = at == F.col("last_case_date_risk")
    return skew_join(cases, per_seller, ["seller_id"]).select(
        "seller_id", "case_id", "created_date", "case_group", "case_type", "subroute",
        "deactivated", "frozen",
        F.when(any_is_last, F.col("case_count_any")).alias("case_count_any"),
        F.when(any_is_last, F.col("last_case_date_any")).alias("last_case_date_any"),
        F.when(risk_is_last, F.col("case_count_risk")).alias("case_count_risk"),
        F.when(risk_is_last, F.col("last_case_date_risk")).alias("last_case_date_risk"),
        flag(risk).alias("is_risk_case"),
    )
