"""Event families, click funnels, text fields and log reports."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tillscope.functions.dates import as_date, never_to_null
from tillscope.functions.exprs import one_of, ordered_rules, safe_ratio
from tillscope.functions.text import contains_ci, field_int, int_after, strip_prefix
from tillscope.operators.distinct import count_keys
from tillscope.sources.io import conform, declared

# Event texts that define each family.
ONBOARD_VALUE = "us_referrals"
ONBOARD_LINKS = ("facebook", "twitter", "mail")
DASHBOARD_CLICKS = (
    "Checklist Action Item: Refer A Friend",
    "Settings Navigation: Referrals",
    "Global Navigation: Referrals",
    "Settings Referrals: Twitter Share",
    "Settings Referrals: Facebook Share",
    "Settings Referrals: Email Share",
)
DASHBOARD_VIEW = "Settings: Referrals"
MOBILE_APPS = ("app_android", "app_ios")
ONBOARD_APP = (("View", "Onboard: Activation Flow Referrals"),
               ("Action", "Activation Referral Button"))
HELP_VIEW = "Help Flow: Referral"
REFERRAL_BUTTON = "Referral Button"

EVENT_TABLE = [
    ("user_id", "varchar(64)", False),
    ("text", "varchar(1000)", True),
    ("name", "varchar(1000)", True),
    ("app", "varchar(64)", True),
    ("family", "varchar(64)", True),
    ("recorded_at", "timestamp_ntz", True),
]


def event_family() -> Column:
    """Family of an event, NULL for an event of no family."""
    app, name, text = F.col("app"), F.col("name"), F.col("text")
    link = contains_ci(name, "Link")
    shared = contains_ci(text, ONBOARD_LINKS[0])
    for word in ONBOARD_LINKS[1:]:
        shared = shared | contains_ci(text, word)
    mobile = one_of(app, MOBILE_APPS)
    activation = None
    for n, t in ONBOARD_APP:
        hit = (name == n) & (text == t)
        activation = hit if activation is None else activation | hit
    return ordered_rules([
        ((app == "onboard") & ((text == ONBOARD_VALUE) | (link & shared)), "onboard web"),
        ((app == "dashboard") & (((name == "Click") & one_of(text, DASHBOARD_CLICKS))
                                 | ((name == "View") & (text == DASHBOARD_VIEW))), "dashboard"),
        (mobile & activation, "onboard app"),
        (mobile & (((name == "View") & (text == HELP_VIEW))
                   | (one_of(name, ["Tap", "Action"]) & (text == REFERRAL_BUTTON))), "app"),
    ])


def classify_events(log: DataFrame) -> DataFrame:
    """All four families in one scan; rows without user or family are dropped.

    The families name disjoint sets of events, so one ordered rule list gives the same rows as
    four separate appends.
    """
    return (
        log.filter(F.col("user_id").isNotNull())
        .withColumn("family", event_family())
        .filter(F.col("family").isNotNull())
        .select("user_id", "text", "name", "app", "family", "recorded_at")
    )


def classify_family(log: DataFrame, family: str) -> DataFrame:
    return classify_events(log).filter(F.col("family") == family)


def event_table(log: DataFrame) -> DataFrame:
    """The classified events under the declared schema."""
    return conform(classify_events(log), declared(EVENT_TABLE))


# Click families, tested in this order; the last one is relabelled.
CLICK_FAMILIES = (
    ("Keypad: Tap Charge Button", "Keypad: Tap Charge Button"),
    ("Keypad: Tap Show Cart", "Keypad: Tap Show Cart"),
    ("Keypad: Add Custom Amount to Cart", "Keypad: Add Custom Amount to Cart"),
    ("Keypad: Clear Single Amount", "Keypad: Clear Single Amount"),
    ("Keypad: Clear Cart Confirm", "Keypad: Clear Cart Confirm"),
    ("Cart: Clear Cart", "Cart: Clear Cart"),
    ("Keypad: Tap Backspace", "Cart: Tap Backspace"),
)
CART_CLICKS = ("Keypad: Tap Show Cart", "Keypad: Clear Cart Confirm", "Cart: Clear Cart")
NO_NUMBERS = "Keypad: Tap Backspace"
CHARGE, ADD = CLICK_FAMILIES[0][1], CLICK_FAMILIES[2][1]
CLEARS = ("Keypad: Clear Single Amount", "Keypad: Clear Cart Confirm", "Cart: Clear Cart",
          "Cart: Tap Backspace")


def parse_click_text(clicks: DataFrame, prefix: str = "Keypad: ") -> DataFrame:
    """Keypad clicks with their family, amount, custom count and item count.

    Cart texts carry a brace list of three numbers, the others one amount after the colon. Text
    without the expected number gives NULL.
    """
    text = F.col("description")
    starts = {p: text.startswith(p) for p, _ in CLICK_FAMILIES}
    family = ordered_rules([(starts[p], label) for p, label in CLICK_FAMILIES], default=text)
    cart = starts[CART_CLICKS[0]] | starts[CART_CLICKS[1]] | starts[CART_CLICKS[2]]
    plain = int_after(strip_prefix(text, prefix), r"^[^:]*:.(-?\d+)\s*$")
    amount = F.when(starts[NO_NUMBERS], None).when(cart, field_int(text, "total")).otherwise(plain)
    return clicks.filter(text.ilike("keypad%") | text.ilike("cart: clear cart%")).select(
        "event_id", "user_id", "recorded_at", "description",
        family.alias("family"),
        amount.cast("int").alias("amount"),
        F.when(cart, field_int(text, "custom")).alias("custom_count"),
        F.when(cart, field_int(text, "items")).alias("item_count"),
    )


def option_click_conversion(
    clicks: DataFrame, lifetime: DataFrame, as_of, action: str, description: str, days: int = 7
) -> DataFrame:
    """Clickers per option in the last `days` days and the share with any payment.

    Clickers are reduced to distinct (option, seller) before the join. A seller without a first
    payment is absent or carries the sentinel day.
    """
    day = F.col("recorded_at").cast("date")
    chosen = clicks.filter(
        (F.col("action") == action)
        & (F.col("description") == description)
        & day.between(F.date_sub(as_date(as_of), days), F.date_sub(as_date(as_of), 1))
    ).select("description", "detail", "seller_id").distinct()
    paid = lifetime.select("seller_id", never_to_null(F.col("first_date")).isNotNull().alias("paid"))
    flags = {"clicks": F.col("seller_id").isNotNull(), "payers": F.col("paid")}
    return (
        count_keys(chosen.join(paid, "seller_id", "left"), ["description", "detail"],
                   "seller_id", flags)
        .withColumn("payer_rate", safe_ratio(F.col("payers"), F.col("clicks")))
        .drop("payers")
    )


def log_text_search(log: DataFrame, user: str, part: str, since) -> DataFrame:
    """Log rows of one user that contain a text, newest first."""
    return (
        log.filter(
            (F.col("user_name") == user)
            & (F.col("started_at") >= as_date(since).cast("timestamp_ntz"))
            & contains_ci(F.col("query_text"), part)
        )
        .select("query_id", "query_text", "started_at")
        .orderBy(F.col("started_at").desc_nulls_last(), F.col("query_id").desc())
    )


def log_usage_rollup(
    log: DataFrame, part: str, as_of, days: int = 365, tool_user: str = "reporting"
) -> DataFrame:
    """Uses and last use by user and cluster; a tool's rows count for the tag that drove it."""
    user = F.coalesce(F.nullif(F.col("user_name"), F.lit(tool_user)), F.upper("query_tag"))
    since = F.date_sub(as_date(as_of), days).cast("timestamp_ntz")
    return (
        log.filter(
            (F.col("started_at") >= since) & F.lower("query_text").contains(part.lower())
        )
        .groupBy(user.alias("user_name"), "cluster")
        .agg(F.count(F.lit(1)).alias("frequency"), F.max("started_at").alias("last_used_at"))
    )
