"""First payments from two sources and their reconciliation."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tillscope.functions.dates import as_date, minutes_between
from tillscope.functions.exprs import text_flag
from tillscope.operators.distinct import count_keys
from tillscope.operators.keyed import ascending, first_per_key
from tillscope.operators.ranks import with_share

COMPARED = ("entry_method", "is_card_present", "amount", "currency", "tender")


def units_of_merchants(users: DataFrame) -> DataFrame:
    """Unit rows with the attributes of their merchant; units without a merchant drop out."""
    unit = users.filter(F.col("user_type") == "UNIT").select(
        F.col("user_id").alias("seller_id"), F.col("parent_id").alias("merchant_id")
    )
    merchant = users.filter(F.col("user_type") == "MERCHANT").select(
        F.col("user_id").alias("merchant_id"), "created_date"
    )
    return unit.join(merchant, "merchant_id")


def first_payment_from_fact(
    payments: DataFrame, users: DataFrame, since="2021-07-24", as_of="2021-09-01"
) -> DataFrame:
    """First card payment of each new merchant.

    The date test applies to the winner: a merchant whose first payment is older than `since` is
    dropped, it does not get its next payment instead. The earliest payment is taken per unit
    first, so at most one row per unit reaches the join with the merchants.
    """
    units = units_of_merchants(users).filter(F.col("created_date") >= as_date(since))
    cards = payments.filter(
        (F.col("paid_date") < as_date(as_of))
        & (F.col("is_gpv") == 1)
        & (F.col("is_card_payment") == 1)
    )
    earliest = ascending("paid_at", "payment_id")
    per_unit = first_per_key(cards, ["seller_id"], earliest)
    winner = first_per_key(per_unit.join(units, "seller_id"), ["merchant_id"], earliest)
    return winner.filter(F.col("paid_date") >= as_date(since)).select(
        "merchant_id", "created_date", "paid_at", "payment_id", "entry_method",
        "is_card_present", "amount", "currency", "tender", "reader", "product",
    )


def first_payment_from_log(
    log: DataFrame, users: DataFrame, since="2021-07-24", as_of="2021-09-01"
) -> DataFrame:
    """The same fact from the event log; text booleans become 1/0."""
    merchants = users.filter(
        (F.col("user_type") == "MERCHANT") & (F.col("created_date") >= as_date(since))
    ).select(F.col("user_id").alias("merchant_id"), "created_date")
    day = F.col("recorded_at").cast("date")
    return (
        log.filter((day >= as_date(since)) & (day < as_date(as_of)))
        .join(merchants, "merchant_id")
        .select(
            "merchant_id", "created_date", "recorded_at", "payment_id", "entry_method",
            text_flag(F.col("is_card_present")).alias("is_card_present"),
            "amount", "currency", "tender", "reader",
        )
    )


def _paired(fact: DataFrame, log: DataFrame, cols: Sequence[str]) -> DataFrame:
    """Full outer join on merchant and payment; the log side's columns get the prefix log_."""
    f = fact.select("merchant_id", "payment_id", F.col("paid_at"), *cols,
                    F.lit(True).alias("in_fact"))
    g = log.select("merchant_id", "payment_id", F.col("recorded_at"),
                   *[F.col(c).alias(f"log_{c}") for c in cols], F.lit(True).alias("in_log"))
    return f.join(g, ["merchant_id", "payment_id"], "outer")


def reconcile_sources(
    fact: DataFrame, log: DataFrame, compare: Sequence[str] = COMPARED,
    null_equal: Sequence[str] = ("reader",),
) -> DataFrame:
    """Per day: payments on each side, in both, and agreeing in each attribute.

    Attributes in `null_equal` also agree when both sides are NULL.
    """
    both = _paired(fact, log, [*compare, *null_equal]).withColumn(
        "day", F.coalesce(F.col("paid_at").cast("date"), F.col("recorded_at").cast("date"))
    )
    fact_side = F.col("in_fact")
    flags = {
        "log_count": F.col("in_log"),
        "fact_count": fact_side,
        "overlap_count": fact_side & F.col("in_log"),
    }
    for c in compare:
        flags[f"{c}_overlap"] = fact_side & (F.col(c) == F.col(f"log_{c}"))
    for c in null_equal:
        flags[f"{c}_overlap"] = fact_side & F.col(c).eqNullSafe(F.col(f"log_{c}"))
    return count_keys(both, ["day"], "payment_id", flags)


def source_lag_distribution(fact: DataFrame, log: DataFrame) -> DataFrame:
    """Minutes from fact to log: payments and share of all; NULL lag where one side is missing."""
    lagged = _paired(fact, log, []).withColumn(
        "lag_minutes", minutes_between(F.col("paid_at"), F.col("recorded_at"))
    )
    hist = count_keys(lagged, ["lag_minutes"], "payment_id", {"payments": F.col("in_log")})
    return with_share(hist, "payments", "share")
