"""Adoption windows and gap-based churn flags."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tillscope.functions.dates import as_date, days_between, months_between, null_to_never
from tillscope.functions.exprs import flag, sum_if
from tillscope.operators.hierarchy import merchant_flags, roll_up
from tillscope.operators.timeline import trailing_sum_at
from tillscope.session import staged

ADOPTION_DAYS = (7, 14, 21, 28, 35)
GAP_DAYS = tuple(range(7, 92, 7))
PRODUCTS = ("terminal", "pos", "virtual", "invoice", "online")


def adoption_windows(
    payments: DataFrame, users: DataFrame, activated: DataFrame,
    windows: Sequence[int] = ADOPTION_DAYS, year_days: int = 365, test_limit: int = 100,
    unit: int = 10_000,
) -> DataFrame:
    """Payments of a merchant's units and started units of money within n days of activation.

    Days are counted without a lower bound, so payments before activation count as well. The
    facts are first reduced to unit, day, product and presence, which bounds what one unit can
    send to the rollup.
    """
    real = F.col("amount") > test_limit
    units = F.ceil(F.col("amount") / unit)
    daily = roll_up(
        payments.filter(F.col("is_gpv") == 1), users, "unit_id",
        ["paid_date", "product", "is_card_present"],
        {
            "at": (F.min("paid_at"), F.min),
            "real_at": (F.min(F.when(real, F.col("paid_at"))), F.min),
            "n": (F.count(F.lit(1)), F.sum),
            "u": (F.sum(units), F.sum),
            "real_n": (F.count(F.when(real, 1)), F.sum),
            "real_u": (F.sum(F.when(real, units).otherwise(0)), F.sum),
        },
        targets=activated,
    )
    joined = daily.join(activated, "seller_id").withColumn(
        "_age", days_between(F.col("activated_date"), F.col("paid_date"))
    )
    age = F.col("_age")
    aggs = [F.min("at").alias("first_pmt_at"), F.min("real_at").alias("first_non_test_pmt_at")]
    for prefix, n, u in (("", "n", "u"), ("non_test_", "real_n", "real_u")):
        aggs += [sum_if(age < d, F.col(n)).alias(f"{prefix}pmt_{d}d") for d in windows]
        aggs += [sum_if(age < d, F.col(u)).alias(f"{prefix}amount_{d}d") for d in windows]
    in_year = age < year_days
    splits = {p: F.col("product") == p for p in PRODUCTS}
    splits |= {"cp": F.col("is_card_present") == 1, "cnp": F.col("is_card_present") == 0}
    aggs += [sum_if(in_year & p, F.col("real_u")).alias(f"{n}_nva") for n, p in splits.items()]
    return joined.groupBy(*activated.columns).agg(*aggs)


def active_day_grid(
    daily: DataFrame, users: DataFrame, year: int, until, country: str | None = None
) -> DataFrame:
    """Merchant-days of merchants with payments in the year, from its start to `until`.

    The daily rows are one per (unit, day). A merchant whose active units have several categories
    has its days once per category, with the highest deactivation flag of those units.
    """
    start, stop = as_date(f"{year}-01-01"), as_date(f"{year + 1}-01-01")
    day = F.col("paid_date")
    per_day = roll_up(
        daily.filter((day >= start) & (day <= as_date(until))), users, "unit_id", ["paid_date"],
        {"pmt": (F.sum("gpv_count"), F.sum)},
    )
    in_year = daily.filter((day >= start) & (day < stop)).groupBy("unit_id").agg(
        F.sum("gpv_count").alias("_n")
    )
    who = users if country is None else users.filter(F.col("country") == country)
    active = merchant_flags(who, in_year, "unit_id", ["category"], ["is_deactivated"])
    return per_day.join(active.filter(F.col("_n") > 0), "seller_id").select(
        "seller_id", "category", "is_deactivated", "paid_date", "pmt"
    )


def gap_churn_flags(grid: DataFrame, year: int, gaps: Sequence[int] = GAP_DAYS) -> DataFrame:
    """One flag per gap: 0 when the seller is active again in less than that many days.

    The next active day is a lead over rows that are unique per merchant, category and day, which
    replaces the later-than self join. Sister units were merged before, so a day of one unit
    closes the gap of another.
    """
    w = Window.partitionBy("seller_id", "category").orderBy("paid_date")
    gap = F.datediff(null_to_never(F.lead("paid_date").over(w)), F.col("paid_date"))
    start, stop = as_date(f"{year}-01-01"), as_date(f"{year + 1}-01-01")
    return (
        grid.withColumn("_gap", gap)
        .filter((F.col("paid_date") >= start) & (F.col("paid_date") < stop))
        .select(*grid.columns, *[flag(~(F.col("_gap") < n)).alias(f"churn_{n}d") for n in gaps])
    )


def gap_churn_validated(
    flags: DataFrame, lifetime: DataFrame, payments: DataFrame, users: DataFrame, year: int
) -> DataFrame:
    """Days with any flag: false positives, trialists, and the year's volume by product.

    The source restricts the volumes to merchants of the grid; the final join does that here.
    """
    marks = [c for c in flags.columns if c.startswith("churn_")]
    some = flags.filter(sum(F.col(c) for c in marks) > 0)
    life = lifetime.select("seller_id", "first_date", "last_date")
    checked = some.join(life, "seller_id", "left").select(
        *flags.columns,
        flag(F.col("last_date") > F.col("paid_date")).alias("false_positive"),
        flag(F.col("first_date") == F.col("last_date")).alias("trialist_churn"),
    )
    day = F.col("paid_date")
    splits = {p: F.col("product") == p for p in PRODUCTS}
    splits |= {"cp": F.col("is_card_present") == 1, "cnp": F.col("is_card_present") == 0}
    in_year = (day >= as_date(f"{year}-01-01")) & (day < as_date(f"{year + 1}-01-01"))
    volumes = roll_up(
        payments.filter((F.col("is_gpv") == 1) & in_year), users, "unit_id", [],
        {f"{n}_volume": (sum_if(p, F.col("amount")), F.sum) for n, p in splits.items()},
    )
    return checked.join(volumes, "seller_id", "left")


def gap_churn_run_rate(
    validated: DataFrame, lifetime: DataFrame, revenue: DataFrame, days: int = 91
) -> DataFrame:
    """Adds tenure in months and the volume of the `days` before each flagged day."""
    validated = staged(validated)
    rate = trailing_sum_at(
        revenue, validated, "seller_id", "report_date", "paid_date", "volume_gross", days,
        "run_rate",
    )
    tenure = months_between(F.col("_first"), F.col("paid_date"))
    return (
        validated.join(
            lifetime.select("seller_id", F.col("first_date").alias("_first")), "seller_id", "left"
        )
        .withColumn("tenure_months", tenure)
        .drop("_first")
        .join(rate, ["seller_id", "paid_date"], "left")
    )
