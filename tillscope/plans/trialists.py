"""Sellers that tried a product for one day: profile, attachments, contacts, channels."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tillscope.functions.dates import as_date, days_between
from tillscope.functions.exprs import (
    count_where,
    one_of,
    ordered_rules,
    safe_ratio,
    sum_if,
    sum_if_null,
    truth,
)
from tillscope.operators.distinct import count_keys
from tillscope.operators.keyed import ascending
from tillscope.operators.skew import skew_join

TRIALIST, SLOWER, ACTIVE = "trialist churns", "slower churns", "active"


def attachment_sequences(
    placements: DataFrame, adoptions: DataFrame, as_of, product: str = "terminal",
    silent_days: int = 91,
) -> DataFrame:
    """Order of products for sellers that stopped on day one; a seller has few products."""
    stopped = placements.filter(
        (F.col("product") == product)
        & (F.col("latest_payment_date") < F.date_sub(as_date(as_of), silent_days))
        & (days_between(F.col("first_product_date"), F.col("latest_payment_date")) == 0)
    ).select("seller_id")
    mine = Window.partitionBy("seller_id")
    order = mine.orderBy(*ascending("net_new_date", "product"))
    ranked = (
        adoptions.join(stopped, "seller_id", "left_semi")
        .withColumn("rn", F.row_number().over(order))
        .withColumn(
            "term_rn", F.sum(F.when(F.col("product") == product, F.col("rn"))).over(mine)
        )
    )
    rn, term = F.col("rn"), F.col("term_rn")
    seen = {
        "total": F.lit(True),
        "product_then_other": (term == 1) & (rn > 1),
        "other_then_product": (term > 1) & (rn > 1),
        "other_product_other": (term > 1) & (rn > term),
    }
    counts = count_keys(ranked, [], "seller_id", seen)
    rates = [safe_ratio(F.col(n), F.col("total")).alias(f"{n}_rate") for n in seen if n != "total"]
    return counts.select("*", *rates)


def trialist_stats(
    placements: DataFrame, sellers: DataFrame, funnel: DataFrame, facts: DataFrame, as_of,
    silent_days: int = 91, basic_readers: Sequence[str] = ("reader_1", "reader_2"),
    group: str = "pure", product: str = "terminal",
) -> DataFrame:
    """One row per placement of a seller group and product: churn type, flags, total and first-day counts and volumes.

    Conditional sums without a matching row stay NULL; later steps test them for NULL.
    """
    placements = placements.filter(
        (F.col("seller_group") == group) & (F.col("product") == product)
    )
    first, last = F.col("first_product_date"), F.col("latest_payment_date")
    silent = last < F.date_sub(as_date(as_of), silent_days)
    lag = days_between(first, last)
    churn = ordered_rules([
        (silent & (lag == 0), TRIALIST), (silent & (lag > 0), SLOWER), (~silent, ACTIVE),
    ])
    present = F.col("card_presence") == "CP"
    basic = one_of(F.col("reader"), basic_readers)
    day_one = F.col("report_date") == first
    n, net_n = F.col("trx"), F.col("trx_net")
    gross, net = F.col("volume_gross"), F.col("volume_net")
    sums = facts.join(placements, ["seller_id", "product"]).groupBy(*placements.columns).agg(
        F.sum(net_n).alias("total_trx"),
        F.sum(net).alias("total_volume"),
        sum_if_null(present, net_n).alias("cp_trx"),
        sum_if_null(present, net).alias("cp_volume"),
        sum_if_null(basic, net_n).alias("basic_trx"),
        sum_if_null(basic, net).alias("basic_volume"),
        sum_if_null(day_one, n).alias("first_day_trx"),
        sum_if_null(day_one, gross).alias("first_day_volume"),
        sum_if_null(day_one, net_n).alias("first_day_trx_net"),
        sum_if_null(day_one, net).alias("first_day_volume_net"),
        sum_if_null(day_one & present, n).alias("first_day_cp_trx"),
        sum_if_null(day_one & present, gross).alias("first_day_cp_volume"),
        sum_if_null(day_one & basic, n).alias("first_day_basic_trx"),
        sum_if_null(day_one & basic, gross).alias("first_day_basic_volume"),
    )
    who = sellers.select("seller_id", "category", "business_type", "country",
                         "source_application", "channel", "is_frozen", "is_deactivated")
    steps = funnel.select("seller_id", "bank_linked_date", "hardware_order_date")
    return (
        sums.join(who, "seller_id", "left")
        .join(steps, "seller_id", "left")
        .select(
            churn.alias("churn_type"), "placement_id", "seller_id", "first_product_date",
            "category", "business_type", "country", "source_application", "channel",
            lag.alias("days_before_churn"),
            truth((F.col("is_frozen") == 1) | (F.col("is_deactivated") == 1)).alias(
                "is_fraud_suspect"
            ),
            truth(F.col("bank_linked_date") <= first).alias("is_bank_linked"),
            truth(F.col("hardware_order_date") <= first).alias("is_hardware_ordered"),
            *[c for c in sums.columns if c not in placements.columns],
        )
    )


def pay_type(test_volume: int = 100) -> Column:
    """Test or real payment of a trialist, NULL for the other types."""
    trial = F.col("churn_type") == TRIALIST
    test = (F.col("first_day_volume") <= test_volume) & (F.col("first_day_trx") <= 1)
    return ordered_rules(
        [(trial & test, "test pay"), (~trial, F.lit(None).cast("string"))], default="non-test pay"
    )


def _refund_rate(kept: Column, gross: Column) -> Column:
    return F.lit(1.0) - safe_ratio(kept, gross)


def _kept(total: str, first_day_net: str) -> Column:
    """Net value to compare with the first day: all of it for a trialist, else the first day."""
    return F.when(F.col("churn_type") == TRIALIST, F.col(total)).otherwise(F.col(first_day_net))


def trialist_profile(stats: DataFrame, test_volume: int = 100) -> DataFrame:
    """Counts, rates, annualised volume and first-day measures per churn and pay type.

    `stats` has one row per placement, so distinct seller counts are row counts.
    """
    sellers = F.count("placement_id")
    flags = {
        "fraud": F.col("is_fraud_suspect"), "bank_linked": F.col("is_bank_linked"),
        "hardware_ordered": F.col("is_hardware_ordered"),
        "first_day_cp": F.col("first_day_cp_trx").isNotNull(),
        "first_day_basic": F.col("first_day_basic_trx").isNotNull(),
    }
    span = F.col("days_before_churn") + 1
    valid = ~F.col("is_fraud_suspect")
    volume, trx = F.sum("first_day_volume"), F.sum("first_day_trx")
    valid_volume = sum_if(valid, F.col("first_day_volume"))
    valid_trx = sum_if(valid, F.col("first_day_trx"))
    yearly = {
        m: F.round(F.sum(F.col(f"total_{m}") / span * 365), 2) for m in ("volume", "trx")
    }
    return stats.groupBy("churn_type", pay_type(test_volume).alias("pay_type")).agg(
        safe_ratio(F.sum("days_before_churn"), F.count("days_before_churn")).alias(
            "avg_days_before_churn"
        ),
        sellers.alias("sellers"),
        *[count_where(p).alias(f"{n}_sellers") for n, p in flags.items()],
        *[safe_ratio(count_where(p), sellers).alias(f"{n}_rate") for n, p in flags.items()],
        *[safe_ratio(y, sellers).alias(f"annualized_{m}_per_seller") for m, y in yearly.items()],
        safe_ratio(F.sum("total_volume"), F.sum("total_trx")).alias("ticket_size"),
        safe_ratio(volume, sellers).alias("first_day_volume_per_seller"),
        safe_ratio(trx, sellers).alias("first_day_trx_per_seller"),
        safe_ratio(volume, trx).alias("first_day_ticket_size"),
        _refund_rate(F.sum(_kept("total_volume", "first_day_volume_net")), volume).alias(
            "first_day_refund_rate_volume"
        ),
        _refund_rate(F.sum(_kept("total_trx", "first_day_trx_net")), trx).alias(
            "first_day_refund_rate_trx"
        ),
        safe_ratio(valid_volume, count_where(valid)).alias("first_day_volume_per_valid_seller"),
        safe_ratio(valid_trx, count_where(valid)).alias("first_day_trx_per_valid_seller"),
        safe_ratio(valid_volume, valid_trx).alias("first_day_valid_ticket_size"),
    )


def trialist_by_category(stats: DataFrame, test_volume: int = 100) -> DataFrame:
    sellers = F.count("placement_id")
    volume, trx = F.sum("first_day_volume"), F.sum("first_day_trx")
    return stats.groupBy(
        "churn_type", pay_type(test_volume).alias("pay_type"), "category", "is_bank_linked"
    ).agg(
        sellers.alias("sellers"),
        safe_ratio(count_where(F.col("is_fraud_suspect")), sellers).alias("fraud_rate"),
        safe_ratio(volume, sellers).alias("first_day_volume_per_seller"),
        _refund_rate(F.sum(_kept("total_volume", "first_day_volume_net")), volume).alias(
            "first_day_refund_rate_volume"
        ),
        safe_ratio(volume, trx).alias("first_day_ticket_size"),
    )


def trialist_referrals(
    stats: DataFrame, referrals: DataFrame, test_volume: int = 100
) -> DataFrame:
    """Referees among the placements and what they kept of their first day."""
    referee = referrals.select(F.col("referee_id").alias("seller_id")).distinct().withColumn(
        "referee_id", F.col("seller_id")
    )
    joined = stats.join(referee, "seller_id", "left")
    is_referee = F.col("referee_id").isNotNull()
    referees = F.count_distinct("referee_id")
    volume = sum_if(is_referee, F.col("first_day_volume"))
    kept = sum_if(is_referee, _kept("total_volume", "first_day_volume_net"))
    return joined.groupBy("churn_type", pay_type(test_volume).alias("pay_type")).agg(
        referees.alias("referees"),
        F.count("placement_id").alias("sellers"),
        safe_ratio(volume, referees).alias("first_day_volume_per_referee"),
        _refund_rate(kept, volume).alias("first_day_refund_rate_referee"),
    )


def trialist_contacts(stats: DataFrame, contacts: DataFrame, days: int = 7) -> DataFrame:
    """Each placement with its support contacts of the first `days` days; none keeps one row.

    Contacts are the large side and may be skewed, so they drive the join; placements without
    a contact are added afterwards.
    """
    extra = ["contact_id", "product", "issue_category", "issue_bucket", "issue", "macro_label"]
    first = F.col("first_product_date")
    hits = skew_join(
        contacts.select("seller_id", "created_date", *extra), stats, ["seller_id"]
    ).filter(F.col("created_date").between(first, F.date_add(first, days)))
    found = hits.select(*stats.columns, *extra)
    silent = stats.join(found.select("placement_id").distinct(), "placement_id", "left_anti")
    return found.unionByName(silent.select(*stats.columns), allowMissingColumns=True)


def trialist_contact_reasons(contacts: DataFrame, test_volume: int = 100) -> DataFrame:
    """Suspected-fraud placements per contact reason."""
    used = contacts.filter(F.col("is_fraud_suspect") & F.col("issue_bucket").isNotNull())
    return count_keys(
        used.withColumn("pay_type", pay_type(test_volume)),
        ["churn_type", "pay_type", "issue_bucket", "macro_label"], "placement_id",
        {"sellers": F.lit(True)},
    ).orderBy(F.col("pay_type").asc_nulls_last(), F.col("sellers").desc())


def trialist_channels(
    stats: DataFrame, attributions: DataFrame, countries: Sequence[str]
) -> DataFrame:
    """Fractional conversions by channel, attributions without sub-channel only.

    Attributions are summed per seller first and weighted with the seller's placements.
    """
    per_seller = (
        attributions.filter(one_of(F.col("country"), countries) & F.col("sub_channel").isNull())
        .groupBy("seller_id", "channel", "sub_channel", "offer_channel")
        .agg(F.sum("fraction").alias("fraction"))
    )
    placed = stats.groupBy("seller_id").agg(F.count(F.lit(1)).alias("placements"))
    return (
        per_seller.join(placed, "seller_id")
        .groupBy("channel", "sub_channel", "offer_channel")
        .agg(F.sum(F.col("fraction") * F.col("placements")).alias("sellers"))
    )
