"""Yearly activity shape per seller and the seasonality tag."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tillscope.functions.dates import add_months, as_date, month_start, months_between
from tillscope.functions.exprs import flag, ordered_rules, truth


def monthly_activity(
    daily: DataFrame, sellers: DataFrame, lifetime: DataFrame, as_of, mature_days: int = 456
) -> DataFrame:
    """Seller months of sellers old enough to show a yearly pattern.

    Daily rows are summed to months before the attributes are joined. The account state is the
    state at run time, not at the month.
    """
    old = lifetime.filter(F.col("first_date") <= F.date_sub(as_date(as_of), mature_days)).select(
        "seller_id"
    )
    months = daily.groupBy("seller_id", month_start(F.col("paid_date")).alias("month")).agg(
        F.sum("payment_count").alias("pmt"),
        F.sum("cnp_count").alias("cnp_pmt"),
        F.sum("amount").alias("volume"),
        F.sum("cnp_amount").alias("cnp_volume"),
    )
    live = flag((F.col("is_frozen") == 0) & (F.col("is_deactivated") == 0))
    who = sellers.select("seller_id", "country", live.alias("is_active_account"))
    return months.join(old, "seller_id", "left_semi").join(who, "seller_id")


def yearly_shape(months: DataFrame) -> DataFrame:
    """Active months, first, last and median month of each year."""
    year = months.groupBy(
        "seller_id", "country", "is_active_account", F.year("month").alias("year")
    ).agg(
        F.sum("pmt").alias("yearly_pmt"),
        F.sum("cnp_pmt").alias("yearly_cnp_pmt"),
        F.sum("volume").alias("yearly_volume"),
        F.sum("cnp_volume").alias("yearly_cnp_volume"),
        F.count("month").alias("active_months"),
        F.min("month").alias("min_month"),
        F.max("month").alias("max_month"),
    )
    low, high, mid = F.col("min_month"), F.col("max_month"), F.col("median_month")
    return (
        year.withColumn("duration", months_between(low, high) + 1)
        .withColumn("median_month", add_months(low, F.floor(F.col("duration") / 2).cast("int")))
        .withColumn("min_to_median", months_between(low, mid))
        .withColumn("median_to_max", months_between(mid, high))
    )


def repetition(years: DataFrame, half: int = 3) -> DataFrame:
    """Adds compactness of the year and the shape of the last two years."""
    w = Window.partitionBy("seller_id").orderBy("year")
    compact = (
        (F.col("active_months") == F.col("duration"))
        & (F.col("min_to_median") < half)
        & (F.col("median_to_max") < half)
    )
    out = years.withColumn("is_compact", truth(compact))
    for name, source in (("compact", "is_compact"), ("median", "median_month"),
                         ("duration", "duration")):
        out = out.withColumn(f"last_{name}", F.lag(source, 1).over(w))
        out = out.withColumn(f"last_two_{name}", F.lag(source, 2).over(w))
    return out


def seasonality_tag(years: DataFrame, as_of, test_volume: int = 100) -> DataFrame:
    """Tag per seller on each of its year rows; a seller has one row per year, so the partition
    windows are bounded by the calendar. The rules are ordered."""
    all_years = Window.partitionBy("seller_id")

    def over(agg):
        return agg.over(all_years)

    n = over(F.count(F.lit(1)))
    span = months_between(over(F.min("min_month")), over(F.max("max_month")))
    busy = over(F.sum(flag(F.col("active_months") >= 10)))
    compact = over(F.count(F.when(F.col("is_compact"), 1)))
    steady_median = over(F.stddev_samp(F.month("median_month"))) <= 2
    steady_length = over(F.stddev_samp("duration")) <= 2
    tag = ordered_rules([
        (over(F.sum("yearly_volume")) <= test_volume, "test payment"),
        (over(F.sum("active_months")) == 1, "single month"),
        (span < 12, "single year, multi months"),
        ((n > 1) & (busy >= n * 0.5), "multi year, all year"),
        ((n > 1) & (compact >= n * 0.5) & steady_median & steady_length, "multi year, seasonal"),
    ], default="multi year, casual")
    recent = add_months(month_start(as_date(as_of)), -3)
    return repetition(years).select(
        "seller_id", "country", "is_active_account", "year", "yearly_pmt", "yearly_cnp_pmt",
        "yearly_volume", "yearly_cnp_volume", "active_months", "min_month", "max_month",
        "duration", "median_month", "min_to_median", "median_to_max",
        tag.alias("business_type"),
        flag(over(F.max("max_month")) >= recent).alias("is_active"),
    )
