"""Seller tags, wide features, mix bands and the segment label."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tillscope.functions.dates import OPEN_END, as_date, days_between
from tillscope.functions.exprs import flag, one_of, ordered_rules, safe_ratio
from tillscope.operators.keyed import latest_per_key
from tillscope.operators.ranges import scd2_lookup
from tillscope.plans.trailing import READERS

# Segments above the lowest, and category groups of the bands.
UPPER_SEGMENTS = ("SMB", "Mid-Market", "Enterprise")
MIXES = ("custom", "item", "invoice", "virtual", "online", "present")


def seller_tags(
    sellers: DataFrame, book: DataFrame, deals: DataFrame, accounts: DataFrame, as_of,
    excluded_programs: Sequence[str] = (), excluded_owners: Sequence[str] = (),
    deal_segments: Sequence[str] = ("Sales", "Strat", "Enterprise", "Field Sales"),
) -> DataFrame:
    """All sellers with the managed-book and closed-deal tags (the matched key is the tag)."""
    day = as_date(as_of)
    quarter = F.concat(F.year(day), F.lit(" Q"), F.quarter(day))
    current = book.filter(
        (F.col("quarter") == quarter)
        & F.col("program").isNotNull()
        & (F.col("arm") == "Treatment")
        & F.col("owner_name").isNotNull()
        & ~one_of(F.col("owner_name"), excluded_owners)
        & ~one_of(F.col("program"), excluded_programs)
    )
    managed = latest_per_key(current, ["seller_id"], "quarter", ["entry_id"]).select(
        "seller_id", F.col("seller_id").alias("managed_id")
    )
    closed = (
        deals.filter(one_of(F.col("sales_segment"), deal_segments))
        .join(accounts, "deal_id")
        .groupBy("seller_id")
        .agg(F.min("close_date").alias("sales_close_date"))
        .withColumn("sales_closed_id", F.col("seller_id"))
    )
    return (
        sellers.select("seller_id").distinct()
        .join(managed, "seller_id", "left")
        .join(closed, "seller_id", "left")
        .select("seller_id", "managed_id", "sales_closed_id", "sales_close_date")
    )


def seller_features(
    population: DataFrame, lifetime: DataFrame, sellers: DataFrame, mix: DataFrame,
    revenue: DataFrame, as_of, days: int = 365, category: str = "Processing",
) -> DataFrame:
    """Population with risk flag, volumes in major units and activity of the last year.

    Every source is reduced to one row per seller before it is joined, so the wide grouping of
    the source query is not needed.
    """
    known = lifetime.select("seller_id", "first_date", "last_date").join(
        sellers.select("seller_id", "category", "is_frozen", "is_deactivated"), "seller_id"
    )
    risk = flag((F.col("is_frozen") == 1) | (F.col("is_deactivated") == 1))
    recent = (
        revenue.filter(
            (F.col("category") == category)
            & (F.col("report_date") > F.date_sub(as_date(as_of), days))
        )
        .groupBy("seller_id", "report_date")
        .agg(F.sum("volume_count").alias("n"))
        .groupBy("seller_id")
        .agg(
            F.count(F.lit(1)).alias("active_days_365d"),
            safe_ratio(F.sum("n"), F.count("n")).alias("trx_per_active_day_365d"),
        )
    )
    money = [c for c in mix.columns if c != "seller_id" and not c.startswith("ticket_")]
    ticket = [c for c in mix.columns if c.startswith("ticket_")]
    wide = (
        population.select("seller_id")
        .join(known.withColumn("is_risk", risk), "seller_id", "left")
        .join(mix, "seller_id", "left")
        .join(recent, "seller_id", "left")
    )
    return wide.select(
        "seller_id", "category", "first_date", "last_date",
        F.coalesce("is_risk", F.lit(0)).alias("is_risk_account"),
        *[F.coalesce(F.col(c) / 100, F.lit(0.0)).alias(c) for c in money],
        *[(F.col(c) / 100).alias(c) for c in ticket],
        F.coalesce("active_days_365d", F.lit(0)).alias("active_days_365d"),
        "trx_per_active_day_365d",
    )


# Software products with their own "currently used" flag.
SOFTWARE_FLAGS = {
    "payroll": "payroll", "online_store": "online store", "appointments": "appointments",
    "marketing": "marketing", "loyalty": "loyalty", "team": "team management",
    "gift_cards": "gift cards", "retail": "retail", "restaurants": "restaurants",
}


def open_product_flags(history: DataFrame) -> DataFrame:
    """1/0 per product family whose validity is still open."""
    saas = F.col("category") == "SaaS"
    product = F.col("product")
    flags = {"saas": saas, "saas_deposit": saas & product.ilike("%deposit%")}
    flags |= {f"saas_{n}": saas & (product == p) for n, p in SOFTWARE_FLAGS.items()}
    flags["capital"] = F.col("category") == "Capital"
    return (
        history.filter(F.col("effective_end") == F.lit(OPEN_END))
        .groupBy("seller_id")
        .agg(*[F.max(flag(p)).alias(f"is_currently_{n}") for n, p in flags.items()])
    )


def active_children(children: DataFrame, item: str, out: str) -> DataFrame:
    return (
        children.filter(F.col("is_active"))
        .select(F.col("merchant_id").alias("seller_id"), item)
        .distinct()
        .groupBy("seller_id")
        .agg(F.count(item).alias(out))
    )


def inactive_dates(segments: DataFrame, inactive: str = "Inactive") -> DataFrame:
    """Begin of the last and of the second-last inactive range."""
    w = Window.partitionBy("seller_id").orderBy("effective_begin")
    return (
        segments.filter(F.col("segment") == inactive)
        .withColumn("_before", F.lag("effective_begin").over(w))
        .groupBy("seller_id")
        .agg(
            F.max("effective_begin").alias("last_churn_date"),
            F.max("_before").alias("second_last_churn_date"),
        )
    )


def seller_features_plus(
    features: DataFrame, history: DataFrame, employees: DataFrame, locations: DataFrame,
    segments: DataFrame, funnel: DataFrame,
) -> DataFrame:
    return (
        features.join(open_product_flags(history), "seller_id", "left")
        .join(active_children(employees, "person_id", "employees"), "seller_id", "left")
        .join(active_children(locations, "location_id", "locations"), "seller_id", "left")
        .join(funnel.select("seller_id", "is_business_seller"), "seller_id", "left")
        .join(inactive_dates(segments), "seller_id", "left")
    )


def mix_bands(
    features: DataFrame, segments: DataFrame, as_of, young_days: int = 456,
    trial_days: int = 7,
    in_person: Sequence[str] = ("retail", "food_and_drink", "beauty_and_personal_care"),
    remote: Sequence[str] = ("home_and_repair", "professional_services"),
) -> DataFrame:
    """Shares, activity status, product and presence bands, one-hot flags, year over year.

    The bands are ordered rules; later columns use earlier ones.
    """
    volume, custom, present = (F.col(f"{c}_91d") for c in ("volume", "custom", "present"))
    risk = F.col("is_risk_account")
    young = F.col("first_date") > F.date_sub(as_date(as_of), young_days)
    silent = volume <= 0
    hidden = young | silent
    age = days_between(F.col("first_date"), F.col("last_date"))
    share = safe_ratio(custom, volume)
    status = ordered_rules([
        (young & (volume > 0), "new active"),
        (silent & (risk == 1), "risk churn"),
        (silent & (risk == 0) & (age <= trial_days), "trialist churn"),
        (silent & (risk == 0), "other churn"),
        (volume > 0, "mature active"),
    ])
    product_mix = ordered_rules([
        (silent, F.lit(None).cast("string")),
        (custom == volume, "pure custom"),
        (custom == 0, "pure other"),
        (share >= 0.5, "mostly custom"),
        (share < 0.5, "mostly other"),
    ])
    presence = ordered_rules([
        (hidden, F.lit(None).cast("string")),
        (present <= 0, "pure remote"),
        (present == volume, "pure present"),
        (present > 0, "hybrid"),
    ])
    current = scd2_lookup(features, segments, "seller_id", as_date(as_of), ["sub_segment"])
    banded = current.select(
        "*",
        flag(one_of(F.col("category"), in_person)).alias("is_inperson_category"),
        flag(one_of(F.col("category"), remote)).alias("is_remote_category"),
        F.when(hidden, None).otherwise(share).alias("custom_rate"),
        F.when(hidden, None).otherwise(safe_ratio(present, volume)).alias("present_rate"),
        status.alias("activity_status"),
        product_mix.alias("product_mix"),
        presence.alias("presence_mix"),
    )
    mix, pres = F.col("product_mix"), F.col("presence_mix")
    one_hot = {
        "is_pure_custom": mix == "pure custom", "is_mostly_custom": mix == "mostly custom",
        "is_mostly_other": mix == "mostly other", "is_pure_other": mix == "pure other",
        "is_pure_present": pres == "pure present", "is_hybrid": pres == "hybrid",
        "is_pure_remote": pres == "pure remote",
    }
    return banded.select(
        "*",
        *[flag(p).alias(n) for n, p in one_hot.items()],
        (safe_ratio(volume, F.col("volume_91d_52w")) - 1).alias("volume_yoy"),
        (safe_ratio(custom, F.col("custom_91d_52w")) - 1).alias("custom_yoy"),
    )


def label_rules() -> Column:
    """Ordered rules of the final label. "Not in" is unknown for a NULL and then does not match."""
    status, mix = F.col("activity_status"), F.col("product_mix")
    sub, yoy = F.col("sub_segment"), F.col("volume_yoy")
    mature = status == "mature active"
    custom_led = one_of(mix, ["pure custom", "mostly custom"])
    upper = one_of(sub, UPPER_SEGMENTS)
    return ordered_rules([
        (mature & custom_led & upper, "High Value"),
        (mature & custom_led & ~upper & ((yoy >= 0) | yoy.isNull()), "High Growth"),
        ((status == "new active") & custom_led, "New Active"),
        (one_of(status, ["new active", "mature active"]) & ~custom_led, "Graduate Active"),
        (mature & ~upper & (yoy < 0), "Diminishing Active"),
        (status.ilike("%churn%"), "Churn"),
    ])


def segment_label(
    bands: DataFrame, sellers: DataFrame, readers: Sequence[str] = READERS[:3]
) -> DataFrame:
    """One label per seller with its profile columns."""
    positive = {
        "is_invoice_91d": "invoice_91d", "is_virtual_91d": "virtual_91d",
        "is_item_91d": "item_91d", "is_online_91d": "online_91d",
    } | {f"is_{r}_91d": f"{r}_91d" for r in readers}
    profile = sellers.select(
        "seller_id", "business_type", "country", "language", "source_application"
    )
    business = F.col("is_business_seller")
    return bands.join(profile, "seller_id", "left").select(
        "seller_id",
        label_rules().alias("segment_label"),
        "category", "business_type", "country", "language", "first_date", "source_application",
        F.when(business, 1).when(~business, 0).alias("is_business_seller"),
        flag(F.col("employees") > 1).alias("is_multi_employees"),
        flag(F.col("locations") > 1).alias("is_multi_locations"),
        *[flag(F.col(c) > 0).alias(n) for n, c in positive.items()],
        safe_ratio(F.col("present_91d"), F.col("volume_91d")).alias("present_rate"),
        "ticket_91d", "active_days_365d", "trx_per_active_day_365d",
        *[c for c in bands.columns if c.startswith("is_currently_")],
        "is_risk_account",
    )
