"""Monthly product volume and the share held by the largest sellers."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tillscope.functions.dates import as_date, month_start
from tillscope.functions.exprs import safe_ratio, sum_if
from tillscope.operators.ranges import attach_scalar
from tillscope.operators.ranks import value_at_rank
from tillscope.session import staged


def monthly_product_volume(
    facts: DataFrame, sellers: DataFrame, since, product: str = "terminal"
) -> DataFrame:
    """Seller months of one product: revenue after fees, volume, payments, first product date.

    The first date looks at all history, the months only at `since` and later; both come from
    one aggregation to seller months.
    """
    start = month_start(as_date(since))
    months = (
        facts.filter(F.col("product") == product)
        .groupBy("seller_id", month_start(F.col("report_date")).alias("month"))
        .agg(
            F.min("report_date").alias("_first"),
            F.sum(F.col("revenue") - F.col("fee")).alias("adjusted_revenue"),
            F.sum("gpv_net").alias("volume_net"),
            F.sum("trx_net").alias("trx"),
        )
    )
    first = months.groupBy("seller_id").agg(F.min("_first").alias("first_product_date"))
    return (
        months.filter(F.col("month") >= start)
        .join(first, "seller_id")
        .join(sellers.select("seller_id", "country"), "seller_id")
        .select("seller_id", "first_product_date", "month", "country", "adjusted_revenue",
                "volume_net", "trx")
    )


def top_share(totals: DataFrame, value: str, fraction: float = 0.2) -> DataFrame:
    """Share of `value` held by rows at or above the value ranked round(fraction × n).

    The rank is at least 1, so small inputs still have a threshold. The totals are read several
    times (borders, counts, sums) and are stored once.
    """
    totals = staged(totals)
    rank = totals.agg(
        F.greatest(F.lit(1), F.round(F.count(F.lit(1)) * fraction).cast("long")).alias("r")
    )
    limit = value_at_rank(totals, value, rank)
    return attach_scalar(totals, limit, "_limit").agg(
        safe_ratio(
            sum_if(F.col(value) >= F.col("_limit"), F.col(value)), F.sum(value)
        ).alias("top_share")
    )


def top_fraction_share(monthly: DataFrame, year: int, fraction: float = 0.2) -> DataFrame:
    month = F.col("month")
    totals = (
        monthly.filter(
            (month >= as_date(f"{year}-01-01")) & (month < as_date(f"{year + 1}-01-01"))
        )
        .groupBy("seller_id")
        .agg(F.sum("volume_net").alias("volume_net"))
    )
    return top_share(totals, "volume_net", fraction)
