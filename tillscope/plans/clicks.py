"""From keypad clicks to payments: interval match, lookback counts, behaviour rates."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tillscope.functions.dates import as_date, days_between
from tillscope.functions.exprs import count_where, one_of, ordered_rules, safe_ratio
from tillscope.operators.hierarchy import links
from tillscope.operators.keyed import ascending
from tillscope.operators.timeline import interval_match, lookback_match, with_neighbours
from tillscope.plans.events import ADD, CHARGE, CLEARS
from tillscope.session import staged

CUSTOM_NAMES = ("UNKNOWN", "", "Custom Amount")


def itemized_payment_master(
    payments: DataFrame, lines: DataFrame, users: DataFrame, since,
    products: Sequence[str] = ("terminal", "pos", "invoice", "online"),
) -> DataFrame:
    """Payment × bill line with the seller's attributes.

    Filters on the line date make the line join an inner join. Payments and lines meet on the
    payment id; the seller attributes come from a dimension that is unique per seller.
    """
    recent = as_date(since)
    chosen = payments.filter(
        (F.col("paid_at").cast("date") >= recent)
        & (one_of(F.col("product"), products) | (F.col("is_gpv") == 0))
    ).select("payment_id", "seller_id", "paid_at", "amount", "tip", "product", "entry_method")
    bills = lines.filter(F.col("completed_at").cast("date") >= recent).select(
        F.col("bill_id").alias("payment_id"), "completed_at", "name", "quantity",
        F.col("amount").alias("line_amount"),
    )
    who = users.select("seller_id", "category", "country")
    return chosen.join(bills, "payment_id").join(who, "seller_id", "left")


def payments_with_items(master: DataFrame) -> DataFrame:
    """One row per payment: charged amount and numbers of custom and catalog lines."""
    name = F.col("name")
    return master.groupBy("payment_id", "seller_id", "product", "entry_method", "paid_at").agg(
        safe_ratio(F.sum(F.col("amount") - F.col("tip")), F.count(F.lit(1))).alias("charged"),
        F.count(F.lit(1)).alias("total_items"),
        count_where(one_of(name, CUSTOM_NAMES)).alias("custom_items"),
        count_where(~one_of(name, CUSTOM_NAMES)).alias("library_items"),
    ).withColumn("product", F.coalesce("product", F.lit("no volume")))


def click_payment_match(clicks: DataFrame, master: DataFrame) -> DataFrame:
    """Each charge click with its payments: paid before the next click and for the same amount.

    A payment at the instant of the next click belongs to both clicks. `match_rank` numbers the
    payments of a click; a click without payment keeps one row with rank 1.
    """
    charges = staged(
        with_neighbours(
            clicks.filter(F.col("family") == CHARGE), "user_id", "recorded_at", "event_id"
        ).select("event_id", "user_id", "recorded_at", "description", "family", "amount",
                 "next_at", "last_at")
    )
    paid = payments_with_items(master).withColumnRenamed("seller_id", "user_id")
    pairs = interval_match(
        charges, paid, "user_id", "recorded_at", "next_at", "paid_at", ["event_id", "amount"]
    )
    matched = pairs.filter(F.col("charged") == F.col("amount")).drop(
        "amount", "user_id", "recorded_at"
    )
    in_click = Window.partitionBy("event_id").orderBy(*ascending("paid_at", "payment_id"))
    numbered = matched.withColumn("match_rank", F.row_number().over(in_click))
    return charges.join(numbered, "event_id", "left").withColumn(
        "match_rank", F.coalesce("match_rank", F.lit(1))
    )


def first_payment_per_click(matches: DataFrame) -> DataFrame:
    """The row ranked 1 of each click."""
    return matches.filter(F.col("match_rank") == 1).drop("match_rank")


def lookback_event_counts(
    matches: DataFrame, clicks: DataFrame, minutes: int = 5
) -> DataFrame:
    """Clears and adds in the `minutes` before each charge click and after the previous one.

    "Last" clear means the latest with an amount; clears without an amount rank behind.
    """
    base = staged(first_payment_per_click(matches))
    anchors = base.select("event_id", "user_id", "recorded_at", "last_at").withColumnRenamed(
        "recorded_at", "charged_at"
    )
    others = clicks.filter(one_of(F.col("family"), [*CLEARS, ADD])).select(
        "user_id", F.col("recorded_at").alias("at"), F.col("event_id").alias("other_id"),
        F.col("family").alias("other_family"), F.col("amount").alias("other_amount"),
    )
    pairs = lookback_match(
        anchors, others, "user_id", "charged_at", "last_at", "at", ["event_id"]
    )
    near = pairs.filter(F.col("at") > F.col("charged_at") - F.expr(f"interval {minutes} minutes"))
    is_add = F.col("other_family") == ADD
    # clears with an amount first, then the latest, then the highest id
    rank = F.struct(F.col("other_amount").isNotNull(), F.col("at"), F.col("other_id"))
    clear = F.when(~is_add, F.struct(rank.alias("r"), F.col("other_amount").alias("amount"),
                                     F.col("other_family").alias("family")))
    counts = near.groupBy("event_id").agg(
        count_where(~is_add).alias("clears"),
        F.max(clear).alias("_last"),
        F.max(F.when(~is_add, F.col("at"))).alias("last_cleared_at"),
        count_where(is_add).alias("plus_count"),
        F.max(F.when(is_add, F.col("at"))).alias("last_plus_at"),
    )
    return base.join(counts, "event_id", "left").select(
        "event_id", "user_id", F.col("recorded_at").alias("charged_at"), "last_at",
        "description", "family", "amount", "payment_id", "product", "entry_method", "paid_at",
        "charged", "total_items", "custom_items", "library_items",
        F.nullif(F.col("clears"), F.lit(0)).alias("clear_count"),
        F.col("_last.amount").alias("last_cleared_amount"),
        F.col("_last.family").alias("last_clear_event"),
        "last_cleared_at",
        F.coalesce("plus_count", F.lit(0)).alias("plus_count"),
        "last_plus_at",
    )


def basket_type() -> Column:
    custom, library = F.col("custom_items"), F.col("library_items")
    return ordered_rules([
        ((custom > 0) & (library == 0), "pure custom"),
        ((custom > 0) & (library > 0), "hybrid"),
        ((custom == 0) & (library > 0), "pure item"),
    ])


def click_behaviour_rates(
    counts: DataFrame, users: DataFrame, activations: DataFrame, start, end,
    countries: Sequence[str], new_days: int = 30, days: int = 7,
) -> DataFrame:
    """Clicks and rates by basket type and tenure: days since the activation of the user's merchant."""
    who = users.filter(one_of(F.col("country"), countries)).select("user_id")
    since = links(users, "user_id", "merchant_id").join(
        activations.select("merchant_id", "activation_date"), "merchant_id"
    ).drop("merchant_id")
    day = F.col("charged_at").cast("date")
    cleared = F.col("clear_count").isNotNull()

    def last_clear(family: str) -> Column:
        return cleared & (F.col("last_clear_event") == family)

    # clicks are reduced to seller, day and basket before the seller attributes are joined
    names = ("single", "confirm", "cart", "backspace")
    measures = ["n", "plus", "multi", "cleared", *names]
    daily = (
        counts.filter(day.between(as_date(start), as_date(end)))
        .groupBy("user_id", day.alias("day"), basket_type().alias("basket"))
        .agg(
            F.count(F.lit(1)).alias("n"),
            count_where(F.col("plus_count") != 0).alias("plus"),
            count_where(F.col("total_items") > 1).alias("multi"),
            count_where(cleared).alias("cleared"),
            *[count_where(last_clear(f)).alias(x) for x, f in zip(names, CLEARS)],
        )
    )
    age = days_between(F.col("activation_date"), F.col("day"))
    tenure = F.when(age < new_days, "new").otherwise("mature")
    per_seller = (
        daily.join(who, "user_id")
        .join(since, "user_id", "left")
        .groupBy("basket", tenure.alias("tenure"), "user_id")
        .agg(*[F.sum(m).alias(m) for m in measures])
    )
    total = per_seller.groupBy("basket", "tenure").agg(
        F.count("user_id").alias("sellers"),
        *[F.sum(m).alias(m) for m in measures],
    )
    n, c = F.col("n"), F.col("cleared")
    return total.select(
        "basket", "tenure", n.alias("clicks"),
        (safe_ratio(n, F.col("sellers")) / days).alias("daily_clicks_per_seller"),
        safe_ratio(F.col("plus"), n).alias("plus_rate"),
        safe_ratio(F.col("multi"), n).alias("multi_item_rate"),
        safe_ratio(c, n).alias("clear_rate"),
        *[safe_ratio(F.col(x), c).alias(f"{x}_clear_rate") for x in names],
    )


def amount_roundness_rates(
    counts: DataFrame, master: DataFrame, start, end, countries: Sequence[str],
    whole_unit_countries: Sequence[str] = (), excluded_categories: Sequence[str] = (),
) -> DataFrame:
    """Shares of whole, quarter and irregular line amounts by basket type."""
    day = F.col("charged_at").cast("date")
    clicks = counts.filter(day.between(as_date(start), as_date(end))).select(
        "user_id", "payment_id", basket_type().alias("basket")
    )
    lines = master.filter(
        one_of(F.col("country"), countries) & ~one_of(F.col("category"), excluded_categories)
    ).select(F.col("seller_id").alias("user_id"), "payment_id", "line_amount", "country")
    joined = clicks.join(lines, ["user_id", "payment_id"])
    x = F.col("line_amount")
    no_fractions = one_of(F.col("country"), whole_unit_countries)
    all_rows = F.count(F.lit(1))
    return joined.groupBy("basket").agg(
        safe_ratio(count_where(no_fractions | (x % 100 == 0)), all_rows).alias("whole_rate"),
        safe_ratio(
            count_where(~no_fractions & (x % 25 == 0) & (x % 100 != 0)), all_rows
        ).alias("quarter_rate"),
        safe_ratio(count_where(~no_fractions & (x % 25 != 0)), all_rows).alias("irregular_rate"),
    )
