"""Wide seller features for a persona study, from eight sources reduced to one row per seller."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tillscope.functions.dates import NEVER, OPEN_END, as_date, days_between, never_to_null
from tillscope.functions.exprs import (
    count_where,
    max_if,
    one_of,
    ordered_rules,
    safe_ratio,
    sum_if,
)
from tillscope.functions.text import json_field
from tillscope.operators.hierarchy import only_targets, roll_up
from tillscope.operators.keyed import ascending, first_per_key
from tillscope.operators.sets import with_membership
from tillscope.plans.trailing import READERS

PRODUCTS = ("pos", "terminal", "virtual", "invoice")
SHOWN_PRODUCTS = (*PRODUCTS, "misc")
# Rank-prefixed segment names, so that max() gives the highest.
SEGMENT_RANKS = {"SMB": "2 - SMB", "Micro": "1 - Micro", "Mid-Market": "3 - Mid-Market",
                 "Enterprise": "4 - Enterprise"}
# Software products with their own first-use date.
SOFTWARE = {"payroll": "payroll", "appt": "appointments", "giftcard": "gift cards",
            "marketing": "marketing", "tm": "team management", "loyalty": "loyalty",
            "store": "online store"}
PAYMENT_PRODUCTS = {"term": "terminal", "pos": "pos", "invoices": "invoice", "virtual": "virtual"}
# Columns of the account history that the profile keeps.
HISTORY = ("total_times_unfrozen", "total_times_deactivated", "is_cbd_merchant")


def persona_targets(
    intents: DataFrame, revenue: DataFrame, signed_from, signed_to, signal: str,
    product: str = "terminal", small_unit_country: str = "JP", min_small_unit: int = 10_000,
    min_volume: int = 100,
) -> DataFrame:
    """First intent row of each seller of the sign-up period with enough product volume."""
    signed = F.col("signup_date")
    base = first_per_key(
        intents.filter(
            (signed >= as_date(signed_from)) & (signed < as_date(signed_to))
            & (F.col("signal") == signal)
        ),
        ["seller_id"], ascending("first_payment_date", "payment_product"),
    )
    volume = revenue.filter(F.col("product") == product).groupBy("seller_id").agg(
        F.sum("volume_gross").alias("product_volume")
    )
    small_unit = F.col("country") == small_unit_country
    return base.join(volume, "seller_id").filter(
        (small_unit & (F.col("product_volume") > min_small_unit))
        | (~small_unit & (F.col("product_volume") > min_volume))
    ).drop("signal")


def persona_attributes(
    targets: DataFrame, sellers: DataFrame, funnel: DataFrame, referrals: DataFrame,
    history: DataFrame,
) -> DataFrame:
    """Days from sign-up to each milestone, profile, account history and referred flag; activated
    sellers only."""
    signup = F.col("signup_date")
    steps = {
        "activation": "activation_date", "bank_link": "bank_linked_date",
        "onboard_completion": "onboarded_date", "first_app_event": "first_app_date",
        "first_payment": "first_payment_date", "hardware_order": "hardware_order_date",
    }
    who = sellers.select("seller_id", "num_units", "category", "is_business_seller")
    known = funnel.select("seller_id", "activation_date", "hardware_order_date")
    joined = (
        targets.drop("activation_date")
        .join(who, "seller_id", "left")
        .join(known, "seller_id", "left")
        .join(history.select("seller_id", *HISTORY), "seller_id", "left")
        .filter(F.col("activation_date") != F.lit(NEVER))
    )
    referred = referrals.select(F.col("referee_id").alias("seller_id"))
    return with_membership(joined, referred, "seller_id", "is_referred").select(
        "seller_id", "signup_date", "source_application", "country", "device_os",
        "intent_value", F.col("payment_product").alias("first_payment_product"),
        "first_payment_date",
        *[days_between(signup, never_to_null(F.col(c))).alias(f"days_to_{n}")
          for n, c in steps.items()],
        "num_units", "category", *HISTORY, "is_business_seller", "is_referred",
    )


def _day_measures(readers: Sequence[str]) -> dict[str, Column]:
    product, reader = F.col("product"), F.col("reader")
    present = F.col("is_card_present")
    out = {p: product == p for p in PRODUCTS}
    out["misc"] = ~one_of(product, PRODUCTS)
    out["cnp"] = reader.isNull() & (present == 0)
    out["cp"] = reader.isNotNull() & (present == 1)
    out |= {r: reader == r for r in readers}
    return out


def persona_payment_summary(
    attributes: DataFrame, payments: DataFrame, since, test_limit: int = 100,
    readers: Sequence[str] = READERS,
) -> DataFrame:
    """Totals, tickets, product days and time windows per seller.

    Where the targets are few, only their payments are grouped. Payments are pivoted per seller and
    day first (payment ids are unique, so the distinct counts of the source are plain counts). A seller without payments keeps one row with zero counts and
    an unknown total volume.
    """
    measures = _day_measures(readers)
    amount = F.col("amount")
    daily = (
        payments.filter(
            (F.col("paid_date") >= as_date(since)) & (F.col("is_gpv") == 1)
            & (amount > test_limit)
        )
        .groupBy("seller_id", F.col("paid_date").alias("day"))
        .agg(
            F.count(F.lit(1)).alias("payment"),
            F.sum(amount).alias("volume"),
            count_where(F.col("is_refunded") == 1).alias("refunded"),
            *[count_where(p).alias(f"{n}_pmt") for n, p in measures.items()],
            *[sum_if(p, amount).alias(f"{n}_volume") for n, p in measures.items()],
        )
    )
    base = attributes.select("seller_id", "signup_date", "first_payment_date")
    daily = only_targets(daily, base, "seller_id")
    counts = ["payment", "refunded", *[f"{n}_{x}" for n in measures for x in ("pmt", "volume")]]
    joined = base.join(daily, "seller_id", "left").fillna(0, subset=counts)
    day, signup, first = F.col("day"), F.col("signup_date"), F.col("first_payment_date")
    n, terminal = F.col("payment"), F.col("terminal_pmt")

    def in_days(start: Column, low: int, high: int) -> Column:
        return day.between(F.date_add(start, low), F.date_add(start, high))

    since_signup, since_first = in_days(signup, 0, 180), in_days(first, 0, 180)
    windows = {"3m": in_days(first, 0, 90), "3m_6m": in_days(first, 91, 180),
               "6m": day > F.date_add(first, 180)}
    counted = {"total": n} | {p: F.col(f"{p}_pmt") for p in SHOWN_PRODUCTS}
    total_n, total_v = F.sum(n), F.sum("volume")
    aggs = [
        (F.datediff(F.max(day), F.max(first)) + 1).alias("payment_tenure_days"),
        F.count(day).alias("active_days"),
        F.count(F.when(terminal == n, day)).alias("pure_term_days"),
        F.count(F.when(terminal == 0, day)).alias("pure_non_term_days"),
        F.count(F.when((terminal > 0) & (n > terminal), day)).alias("hybrid_term_days"),
        total_n.alias("total_payment"),
        total_v.alias("total_volume"),
        safe_ratio(F.sum("refunded"), total_n).alias("refund_rate"),
        safe_ratio(total_v, total_n).alias("ticket_size"),
        sum_if(since_signup, n).alias("payment_180d_since_signup"),
        sum_if(since_signup, F.col("volume")).alias("volume_180d_since_signup"),
        sum_if(since_first, n).alias("payment_180d_since_first"),
        sum_if(since_first, F.col("volume")).alias("volume_180d_since_first"),
    ]
    for m in measures:
        aggs += [F.sum(f"{m}_pmt").alias(f"{m}_pmt"), F.sum(f"{m}_volume").alias(f"{m}_volume")]
    for m in (*SHOWN_PRODUCTS, "cnp", "cp"):
        ticket = safe_ratio(F.sum(f"{m}_volume"), F.sum(f"{m}_pmt"))
        aggs.append(ticket.alias(f"{m}_ticket_size"))
    for w, inside in windows.items():
        aggs += [sum_if(inside, c).alias(f"{p}_pmt_{w}") for p, c in counted.items()]
    return joined.groupBy("seller_id", "signup_date", "first_payment_date").agg(*aggs)


def persona_highest_segment(summary: DataFrame, segments: DataFrame) -> DataFrame:
    """Highest segment a seller ever had."""
    rank = ordered_rules(
        [(F.col("segment") == s, label) for s, label in SEGMENT_RANKS.items()],
        default="0 - Other",
    )
    best = segments.groupBy("seller_id").agg(F.max(rank).alias("highest_segment"))
    return summary.select("seller_id").join(best, "seller_id")


def persona_repeat_cards(
    attributes: DataFrame, card_payments: DataFrame, users: DataFrame, since
) -> DataFrame:
    """Distinct cards and cards used in more than one payment at the units of a merchant; zeros
    without any card. Few targets: only their payments are grouped.

    A card was used in several payments when its lowest and highest payment id differ, so the
    card level needs no distinct.
    """
    cards = roll_up(
        card_payments.filter(
            (F.col("paid_date") >= as_date(since)) & F.col("card_id").isNotNull()
        ),
        users, "unit_id", ["card_id"],
        {"a": (F.min("payment_id"), F.min), "b": (F.max("payment_id"), F.max)},
        targets=attributes,
    )
    per_card = (
        cards.groupBy("seller_id")
        .agg(
            F.count(F.lit(1)).alias("total_card"),
            count_where(F.col("a") != F.col("b")).alias("repeat_card"),
        )
    )
    return attributes.select("seller_id").join(per_card, "seller_id", "left").select(
        "seller_id", F.coalesce("total_card", F.lit(0)).alias("total_card"),
        F.coalesce("repeat_card", F.lit(0)).alias("repeat_card"),
    )


def _used_products(attributes: DataFrame, adoptions: DataFrame, category: str) -> DataFrame:
    return adoptions.filter(
        (F.col("category") == category) & (F.col("net_new_date") != F.lit(OPEN_END))
    ).join(attributes.select("seller_id"), "seller_id", "left_semi").select(
        "seller_id", "product", "net_new_date"
    )


def _usage(used: DataFrame, out: str, dates: Sequence[Column]) -> DataFrame:
    """First product and its date, and the given dates (each a maximum), from one pass; products of
    the same first date are resolved to the last by name."""
    date = F.col("net_new_date")
    per_date = used.groupBy("seller_id", "net_new_date").agg(F.max("product").alias("_product"), *dates)
    names = [c for c in per_date.columns if c not in ("seller_id", "net_new_date", "_product")]
    return per_date.groupBy("seller_id").agg(
        F.min_by("_product", date).alias(out), F.min(date).alias("_date"),
        *[F.max(n).alias(n) for n in names],
    )


def _first_dates(names: Mapping[str, str]) -> list[Column]:
    date = F.col("net_new_date")
    return [max_if(F.col("product") == p, date).alias(f"{n}_date") for n, p in names.items()]


def persona_saas_usage(attributes: DataFrame, adoptions: DataFrame) -> DataFrame:
    used = _used_products(attributes, adoptions, "SaaS")
    deposit = F.col("product").like("%deposit%")
    date = F.col("net_new_date")
    other = ~one_of(F.col("product"), SOFTWARE.values()) & ~deposit
    return _usage(used, "first_saas_product", [
        *_first_dates(SOFTWARE),
        max_if(deposit, date).alias("deposit_date"),
        max_if(other, date).alias("other_saas_date"),
    ]).withColumnRenamed("_date", "first_saas_date")


def persona_payment_products(attributes: DataFrame, adoptions: DataFrame) -> DataFrame:
    used = _used_products(attributes, adoptions, "Processing")
    other = ~one_of(F.col("product"), PAYMENT_PRODUCTS.values())
    return _usage(used, "first_pmt_product", [
        *_first_dates(PAYMENT_PRODUCTS),
        max_if(other, F.col("net_new_date")).alias("other_pmt_date"),
    ]).drop("_date")


def persona_employees(employees: DataFrame) -> DataFrame:
    return (
        employees.filter(F.col("is_active") & F.col("deleted_at").isNull())
        .select(F.col("merchant_id").alias("seller_id"), "person_id")
        .distinct()
        .groupBy("seller_id")
        .agg(F.count("person_id").alias("employees"))
    )


def persona_app_visits(
    attributes: DataFrame, log: DataFrame, users: DataFrame, since, text: str,
    details: Mapping[str, str], field: str = "k",
) -> DataFrame:
    """Visits of all users of a merchant, its own included, by the JSON detail of the app-selected
    event."""
    visits = log.filter(
        (F.col("recorded_at").cast("date") >= as_date(since))
        & (F.col("text") == text) & (F.col("name") == "Action") & F.col("user_id").isNotNull()
    ).select(
        F.col("user_id").cast("long").alias("user_id"),
        F.lower(json_field(F.col("props"), field)).alias("detail"),
    )
    return roll_up(
        visits, users, "user_id", [],
        {f"{n}_visits": (count_where(F.col("detail") == d), F.sum) for n, d in details.items()},
        kind=None, targets=attributes,
    )


def persona_final(
    attributes: DataFrame, cards: DataFrame, segment: DataFrame, employees: DataFrame,
    summary: DataFrame, saas: DataFrame, products: DataFrame, visits: DataFrame,
    readers: Sequence[str] = READERS,
) -> DataFrame:
    """All sources side by side: lags from sign-up and ratios, sellers with payments only."""
    wide = attributes
    for source in (cards, segment, employees, summary.drop("signup_date", "first_payment_date"),
                   saas, products, visits):
        wide = wide.join(source, "seller_id", "left")
    c, signup = F.col, F.col("signup_date")
    tenure, total = c("payment_tenure_days"), c("total_payment")
    lags = {
        "saas": "first_saas_date", "term": "term_date", "pos": "pos_date",
        "invoices": "invoices_date", "virtual": "virtual_date", "payroll": "payroll_date",
        "marketing": "marketing_date", "deposit": "deposit_date", "giftcard": "giftcard_date",
        "appt": "appt_date", "tm": "tm_date", "loyalty": "loyalty_date", "store": "store_date",
    }
    shares = [*PRODUCTS, "cnp", *readers]
    observed = c("days_to_first_payment") + tenure
    visit_names = [v for v in visits.columns if v.endswith("_visits")]
    own_lags = ["activation", "hardware_order", "bank_link", "onboard_completion",
                "first_app_event", "first_payment"]
    return wide.filter(total > 0).select(
        "seller_id", "signup_date", "source_application", "country", "device_os", "num_units",
        "category", *HISTORY, "is_business_seller", "is_referred", "highest_segment", "employees",
        safe_ratio(c("repeat_card"), c("total_card")).alias("repeat_card_pct"),
        "intent_value",
        F.coalesce("first_payment_product", "first_pmt_product").alias("first_payment_product"),
        "first_saas_product",
        *[f"days_to_{n}" for n in own_lags],
        *[days_between(signup, c(d)).alias(f"days_to_{n}") for n, d in lags.items()],
        ordered_rules([
            (tenure < 90, "<3M"), (tenure.between(90, 180), "3M-6M"), (tenure > 180, ">6M"),
        ]).alias("tenure_group"),
        safe_ratio(c("active_days"), tenure).alias("active_days_pct"),
        safe_ratio(c("pure_term_days"), c("active_days")).alias("pure_term_days_pct"),
        safe_ratio(c("hybrid_term_days"), c("active_days")).alias("hybrid_term_days_pct"),
        "total_payment",
        safe_ratio(total, c("active_days")).alias("trx_per_active_day"),
        "payment_180d_since_signup", "payment_180d_since_first", "ticket_size", "refund_rate",
        *[safe_ratio(c(f"{s}_pmt"), total).alias(f"{s}_pmt_pct") for s in shares],
        *[safe_ratio(c(f"terminal_pmt_{w}"), c(f"total_pmt_{w}")).alias(f"terminal_pmt_{w}_pct")
          for w in ("3m", "3m_6m", "6m")],
        *[safe_ratio(c(v), observed).alias(f"daily_{v}") for v in visit_names],
    )
