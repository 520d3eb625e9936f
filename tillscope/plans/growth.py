"""Growth accounting: active, retained, new, reactivated, switched, churned."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tillscope.functions.dates import add_months, as_date, month_start
from tillscope.functions.exprs import one_of, sum_if_null, truth
from tillscope.operators.distinct import count_keys
from tillscope.operators.ranges import scd2_lookup


def monthly_volumes(
    revenue: DataFrame, parties: DataFrame, product: Column, others: Column, since
) -> DataFrame:
    """Net volume per seller and month, of the product and of the others, from one pass.

    A side without rows is NULL. `since` counts from the first day of its month.
    """
    day, net = F.col("report_date"), F.col("volume_net")
    return (
        revenue.filter((product | others) & (day >= month_start(as_date(since))))
        .groupBy("seller_id", month_start(day).alias("month"))
        .agg(sum_if_null(product, net).alias("own"), sum_if_null(others, net).alias("other"))
        .join(parties.select("seller_id", "country"), "seller_id")
    )


def at_lags(df: DataFrame, lags: Sequence[int], shift, values: Sequence[str]) -> DataFrame:
    """Each row once per lag, its period moved forward and its values in columns of that lag.

    `shift(lag)` is the moved period as (column, name). One scan serves all lags.
    """
    copies = []
    for lag in lags:
        period, name = shift(lag)
        cols = [period.alias(name)]
        for v in values:
            for k in lags:
                cols.append((F.col(v) if k == lag else F.lit(None)).alias(f"{v}{k}"))
        copies.append(F.struct(*cols))
    rest = [c for c in df.columns if c not in values and c != shift(0)[1]]
    return df.select(*rest, F.explode(F.array(*copies)).alias("_at")).select(*rest, "_at.*")


def period_presence(monthly: DataFrame, lags: Sequence[int] = (0, 1, 2)) -> DataFrame:
    """Amounts of the product (own0, own1, …) and of the others (other0, …) at each month lag.

    Each lag is the same row with its month moved forward; one group-by replaces the chain of
    full outer joins, whose rows meet in a group-by anyway.
    """
    moved = at_lags(
        monthly, lags, lambda k: (add_months(F.col("month"), k), "month"), ["own", "other"]
    )
    amounts = [f"{s}{lag}" for s in ("own", "other") for lag in lags]
    return moved.groupBy("seller_id", "country", "month").agg(
        *[F.sum(a).alias(a) for a in amounts]
    )


def period_presence_joined(monthly: DataFrame, lags: Sequence[int] = (0, 1, 2)) -> DataFrame:
    """The literal chain of full outer joins keyed to the product's current month.

    Kept for data where a seller-month has several countries and the chain fans out; tests show
    that both forms agree otherwise.
    """
    sources = {
        side: monthly.filter(F.col(side).isNotNull()).select(
            "seller_id", "month", "country", F.col(side).alias("amount")
        )
        for side in ("own", "other")
    }
    chain = sources["own"].toDF("k0", "m0", "c0", "own0")
    parts = [("own", lag) for lag in lags if lag] + [("other", lag) for lag in lags]
    keys, months, countries = [F.col("k0")], [F.col("m0")], [F.col("c0")]
    for i, (side, lag) in enumerate(parts, start=1):
        part = sources[side].toDF(f"k{i}", f"m{i}", f"c{i}", f"{side}{lag}")
        chain = chain.join(
            part,
            (F.col("k0") == F.col(f"k{i}"))
            & (F.col(f"m{i}") == add_months(F.col("m0"), -lag)),
            "outer",
        )
        keys.append(F.col(f"k{i}"))
        months.append(add_months(F.col(f"m{i}"), lag))
        countries.append(F.col(f"c{i}"))
    amounts = [f"{s}{lag}" for s in ("own", "other") for lag in lags]
    return chain.groupBy(
        F.coalesce(*keys).alias("seller_id"), F.coalesce(*countries).alias("country"),
        F.coalesce(*months).alias("month"),
    ).agg(*[F.sum(a).alias(a) for a in amounts])


def growth_accounting_monthly(
    revenue: DataFrame, sellers: DataFrame, first_activity: DataFrame, segments: DataFrame,
    product: str = "terminal", category: str = "Processing", load_since="2018-10-01",
    report_since="2019-01-01", joined: bool = False,
) -> DataFrame:
    """Monthly states by country, category and segment; the flags are independent counts.

    New-seller flags belong to months with current activity (of the product or of others). Where
    such a month has no product activity, the reference keeps the flagged row apart from the
    lagged ones, so those cannot see the current volume of other products.
    """
    is_product = F.col("product") == product
    monthly = monthly_volumes(
        revenue, sellers, is_product, ~is_product & (F.col("category") == category), load_since
    )
    build = period_presence_joined if joined else period_presence
    news = first_activity.filter(is_product).select(
        F.col("seller_id").alias("_new_seller"),
        month_start(F.col("net_new_date")).alias("_new_month"), "net_new_flag", "existing_flag",
    )
    # the months are compared as a range, so the join keeps the partitioning by seller, which
    # the joins to seller attributes and segments use as well
    same_month = F.col("_new_month").between(F.col("month"), F.col("month"))
    state = (
        build(monthly)
        .filter(F.col("month") >= as_date(report_since))
        .join(news, (F.col("seller_id") == F.col("_new_seller")) & same_month, "left")
        .drop("_new_seller", "_new_month")
    )
    t0, t1, n0 = (F.col(c).isNotNull() for c in ("own0", "own1", "other0"))
    here = t0 | n0
    is_new = truth((F.col("net_new_flag") == 1) & here)
    is_existing = truth((F.col("existing_flag") == 1) & here)
    unflagged = ~(
        here & (F.col("net_new_flag").isNotNull() | F.col("existing_flag").isNotNull())
    )
    flags = {
        "t0_active": t0,
        "t1_active": t1,
        "net_new": is_new,
        "net_new_existing": is_existing,
        "retained": t0 & t1,
        "reactivated": t0 & ~t1 & unflagged,
        "switched": ~t0 & t1 & n0 & unflagged,
        "true_churn": ~t0 & t1 & ~(n0 & unflagged),
    }
    placed = state.join(sellers.select("seller_id", F.col("category")), "seller_id")
    month_end = F.last_day("month")
    placed = scd2_lookup(placed, segments, "seller_id", month_end, ["segment"])
    return count_keys(placed, ["month", "country", "category", "segment"], "seller_id", flags)


def lagged_cohorts(cohorts: DataFrame, days: int = 28) -> DataFrame:
    """Each (seller, currency, product, category, date) with its amount now and `days` earlier.

    A full outer self join at a fixed lag, as two copies of each row and one group-by: rows are
    unique per key and date, so current attributes win over the lagged ones by coalesce.
    """
    keys = ["seller_id", "currency", "product", "product_category", "report_date"]
    attrs = ["country", "mcc", "segment"]
    moved = at_lags(
        cohorts.select(*keys, *attrs, "amount"), (0, 1),
        lambda k: (F.date_add("report_date", k * days), "report_date"), [*attrs, "amount"],
    )
    values = [f"{v}{k}" for k in (0, 1) for v in (*attrs, "amount")]
    return (
        moved.groupBy(*keys)
        .agg(*[F.max(v).alias(v) for v in values])
        .select(
            *keys, *[F.coalesce(f"{a}0", f"{a}1").alias(a) for a in attrs],
            F.col("amount0").alias("t0_amount"), F.col("amount1").alias("t1_amount"),
        )
    )


def growth_accounting_trailing28(
    cohorts: DataFrame, first_activity: DataFrame, product: str = "terminal", days: int = 28,
    load_since="2020-10-01", report_since="2021-01-01",
) -> DataFrame:
    """The same states on trailing amounts, one report date against `days` earlier."""
    used = cohorts.filter(
        (F.col("report_date") >= as_date(load_since))
        & one_of(F.col("product"), ["ALL", product])
    )
    base = lagged_cohorts(used, days).filter(F.col("report_date") >= as_date(report_since))
    total = base.filter(F.col("product") == "ALL").select(
        "seller_id", "currency", "report_date", "country", "mcc", "segment",
        F.col("t0_amount").alias("all_amount"),
    )
    own = base.filter(F.col("product") == product).select(
        "seller_id", "currency", "report_date", "t0_amount", "t1_amount",
        F.col("seller_id").alias("own_id"),
    )
    news = first_activity.filter(F.col("product") == product).select(
        F.col("seller_id").alias("own_id"), F.col("net_new_date").alias("report_date"),
        "net_new_flag", "existing_flag",
    )
    state = total.join(own, ["seller_id", "currency", "report_date"], "left").join(
        news, ["own_id", "report_date"], "left"
    )
    t0, t1 = F.col("t0_amount") > 0, F.col("t1_amount") > 0
    no_t0 = F.coalesce(F.col("t0_amount"), F.lit(0)) <= 0
    no_t1 = F.coalesce(F.col("t1_amount"), F.lit(0)) <= 0
    other = F.col("all_amount") > 0
    no_other = F.coalesce(F.col("all_amount"), F.lit(0)) <= 0
    flags = {
        "t0_active": t0,
        "t1_active": t1,
        "net_new": F.col("net_new_flag") == 1,
        "net_new_existing": F.col("existing_flag") == 1,
        "retained": t0 & t1,
        "reactivated": t0 & no_t1 & F.col("net_new_flag").isNull()
        & F.col("existing_flag").isNull(),
        "switched": no_t0 & t1 & other,
        "true_churn": no_t0 & t1 & no_other,
    }
    return count_keys(
        state, ["report_date", "currency", "country", "mcc", "segment"], "own_id", flags
    )
