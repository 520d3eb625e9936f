"""Trailing volume: mixes, shares, threshold filters and active keys."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tillscope.functions.dates import as_date, trailing
from tillscope.functions.exprs import one_of, safe_ratio, sum_if
from tillscope.operators.hierarchy import roll_up, to_merchant

CUSTOM_PRODUCTS = ("terminal", "pos")
READERS = tuple(f"reader_{i}" for i in range(1, 8))


def is_custom(products: Sequence[str] = CUSTOM_PRODUCTS) -> Column:
    """A payment keyed in by amount on one of the counter products."""
    return one_of(F.col("product"), products) & (F.col("is_itemized") == 0)


def trailing_share_filter(
    payments: DataFrame, as_of, products: Sequence[str] = CUSTOM_PRODUCTS, days: int = 91,
    min_amount: int = 100, min_share: float = 0.5,
) -> DataFrame:
    """Sellers with a qualifying payment whose qualifying share of trailing volume is large.

    Population and totals come from one pass: a seller is in the population when any row of the
    window qualifies.
    """
    window = payments.filter(
        (F.col("is_gpv") == 1) & trailing(F.col("paid_date"), as_of, days, closed=False)
    )
    custom = is_custom(products)
    return (
        window.groupBy("seller_id")
        .agg(
            F.max(F.when(custom & (F.col("amount") > min_amount), 1).otherwise(0)).alias("_in"),
            F.sum("amount").alias("volume"),
            sum_if(custom, F.col("amount")).alias("custom_volume"),
        )
        .filter(F.col("_in") == 1)
        .withColumn("custom_rate", safe_ratio(F.col("custom_volume"), F.col("volume")))
        .filter(F.col("custom_rate") > min_share)
        .drop("_in")
    )


def recent_active_keys(
    revenue: DataFrame, as_of, product: str = "terminal", days: int = 30
) -> DataFrame:
    """Sellers with product volume in the last `days` days."""
    return (
        revenue.filter(
            (F.col("product") == product)
            & (F.col("report_date") >= F.date_sub(as_date(as_of), days))
        )
        .select("seller_id")
        .distinct()
    )


def qualifying_sellers(
    payments: DataFrame, users: DataFrame, products: Sequence[str] = CUSTOM_PRODUCTS,
    min_amount: int = 100,
) -> DataFrame:
    """Merchants with any qualifying payment of any unit ever; NULL if a unit is unknown."""
    units = payments.filter(is_custom(products) & (F.col("amount") > min_amount)).select("unit_id").distinct()
    return to_merchant(units, users, "unit_id", "seller_id", limit=None).select("seller_id").distinct()


def mix_measures(readers: Sequence[str] = READERS) -> dict[str, Column]:
    """Conditions of the volume mix, by output name."""
    counter = one_of(F.col("product"), CUSTOM_PRODUCTS)
    present = F.col("is_card_present") == 1
    out = {
        "custom": counter & (F.col("is_itemized") == 0),
        "item": counter & (F.col("is_itemized") == 1),
        "invoice": F.col("product") == "invoice",
        "virtual": F.col("product") == "virtual",
        "online": F.col("product") == "online",
        "present": present,
    }
    for reader in readers:
        out[reader] = present & (F.col("reader") == reader)
    return out


def trailing_mix(
    payments: DataFrame, users: DataFrame, population: DataFrame, in_window: Column,
    measures: Mapping[str, Column], suffix: str,
) -> DataFrame:
    """Volume by rule and mean ticket of the population's payments inside the window.

    Payments are aggregated before they meet the population, so a large merchant is one row there.
    """
    amount = F.col("amount")
    sums = {f"{n}_{suffix}": (sum_if(p, amount), F.sum) for n, p in measures.items()}
    total = roll_up(
        payments.filter((F.col("is_gpv") == 1) & in_window), users, "unit_id", [],
        {f"volume_{suffix}": (F.sum(amount), F.sum), **sums, "_n": (F.count(amount), F.sum)},
        kind=None,
    )
    ticket = safe_ratio(F.col(f"volume_{suffix}"), F.col("_n"))
    chosen = total.join(population, "seller_id", "left_semi")
    return chosen.withColumn(f"ticket_{suffix}", ticket).drop("_n")


def trailing_91d_mix(
    payments: DataFrame, users: DataFrame, population: DataFrame, as_of, days: int = 91
) -> DataFrame:
    return trailing_mix(
        payments, users, population, trailing(F.col("paid_date"), as_of, days, closed=False),
        mix_measures(), "91d",
    )


def trailing_91d_mix_prior_year(
    payments: DataFrame, users: DataFrame, population: DataFrame, as_of, days: int = 91,
    shift: int = 365,
) -> DataFrame:
    """The same window one year (365 days) earlier, both bounds inclusive, without readers."""
    return trailing_mix(
        payments, users, population, trailing(F.col("paid_date"), as_of, days, shift),
        mix_measures(()), "91d_52w",
    )


def mix_with_prior_year(
    payments: DataFrame, users: DataFrame, population: DataFrame, as_of, days: int = 91,
    shift: int = 365,
) -> DataFrame:
    """The current mix with the prior-year mix beside it (left join), from one scan.

    Both windows are conditional sums over the rows of either window. A seller without a current
    payment has no row; one without a prior payment has NULL prior columns.
    """
    day, amount = F.col("paid_date"), F.col("amount")
    now = trailing(day, as_of, days, closed=False)
    then = trailing(day, as_of, days, shift)
    sums, out = {"_now": (F.count(F.when(now, 1)), F.sum)}, []
    for inside, measures, suffix in (
        (now, mix_measures(), "91d"), (then, mix_measures(()), "91d_52w"),
    ):
        in_amount = F.when(inside, amount)
        volume, n = f"volume_{suffix}", f"_n_{suffix}"
        sums |= {volume: (F.sum(in_amount), F.sum), n: (F.count(in_amount), F.sum)}
        sums |= {f"{m}_{suffix}": (sum_if(inside & p, amount), F.sum) for m, p in measures.items()}
        seen = F.col(n) > 0
        out.append(F.col(volume))
        out += [F.when(seen, F.col(f"{m}_{suffix}")).alias(f"{m}_{suffix}") for m in measures]
        out.append(safe_ratio(F.col(volume), F.col(n)).alias(f"ticket_{suffix}"))
    total = roll_up(
        payments.filter((F.col("is_gpv") == 1) & (now | then)), users, "unit_id", [], sums,
        kind=None,
    )
    return total.filter(F.col("_now") > 0).join(population, "seller_id", "left_semi").select("seller_id", *out)


def seller_trailing_volumes(
    tags: DataFrame, funnel: DataFrame, revenue: DataFrame, as_of, product: str = "terminal",
    windows: Sequence[int] = (91, 30), category: str = "Processing",
) -> DataFrame:
    """Tagged sellers with total and product volume in each trailing window."""
    day, net = F.col("report_date"), F.col("volume_net")
    sums = []
    for n in windows:
        inside = trailing(day, as_of, n)
        sums.append(sum_if(inside, net).alias(f"volume_{n}d"))
    for n in windows:
        inside = trailing(day, as_of, n) & (F.col("product") == product)
        sums.append(sum_if(inside, net).alias(f"product_volume_{n}d"))
    totals = revenue.filter(F.col("category") == category).groupBy("seller_id").agg(*sums)
    return (
        tags.join(funnel.select("seller_id", F.col("category").alias("business_category")),
                  "seller_id")
        .join(totals, "seller_id")
    )


def exclusive_large_sellers(
    volumes: DataFrame, funnel: DataFrame, revenue: DataFrame, as_of,
    countries: Sequence[str] | None = ("US",), min_volume: int = 6_250_000,
    category: str = "Processing",
) -> DataFrame:
    """Large sellers with all trailing volume in one product; other-category volume by product."""
    large = volumes.filter(
        (F.col("volume_91d") > min_volume)
        & (F.col("product_volume_30d") > 0)
        & (F.col("volume_91d") == F.col("product_volume_91d"))
    )
    who = funnel.select("seller_id", "country", "activation_date")
    if countries is not None:
        who = who.filter(one_of(F.col("country"), countries))
    other = revenue.filter(F.col("category") != category).groupBy("seller_id", "product").agg(
        sum_if(trailing(F.col("report_date"), as_of, 91), F.col("volume_net")).alias(
            "other_volume_91d"
        )
    )
    return (
        large.join(who, "seller_id")
        .join(other, "seller_id")
        .withColumn("days_since_activation", F.datediff(as_date(as_of), "activation_date"))
        .drop("country", "activation_date")
    )


def product_share(
    revenue: DataFrame, products: Sequence[str] = CUSTOM_PRODUCTS, category: str = "Processing"
) -> DataFrame:
    """All-time volume and share of named products per seller."""
    gross = F.col("volume_gross")
    sums = [sum_if(F.col("product") == p, gross).alias(f"{p}_volume") for p in products]
    totals = revenue.groupBy("seller_id").agg(
        *sums, sum_if(F.col("category") == category, gross).alias("volume")
    )
    shares = [safe_ratio(F.col(f"{p}_volume"), F.col("volume")).alias(f"{p}_share")
              for p in products]
    return totals.select("*", *shares)
