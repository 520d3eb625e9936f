"""Logical tables of the data model, derived from the order / line / event tables of a folder.

The pipelines only see the logical tables, so a warehouse that already stores them can pass its
own DataFrames instead. Everything is lazy; money is whole minor units (BIGINT), so that sums do
not depend on the order of addition.
"""

from __future__ import annotations

from functools import cached_property

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tillscope.operators.keyed import ascending, first_per_key
from tillscope.sources.io import read_table

AS_OF = "2001-08-01"
EVENTS_AS_OF = "2024-01-31"
#: Ids of units beside those of sellers.
UNIT_BASE = 1_000_000_000

# Fixed values of the stand-in: texts an event can carry, chosen by its number.
EVENT_TEXTS = [
    "us_referrals",
    "Share: Facebook post",
    "share twitter",
    "Mail link",
    "Checklist Action Item: Refer A Friend",
    "Settings Navigation: Referrals",
    "Global Navigation: Referrals",
    "Settings Referrals: Email Share",
    "Settings: Referrals",
    "Onboard: Activation Flow Referrals",
    "Activation Referral Button",
    "Help Flow: Referral",
    "Referral Button",
    "Reports",
    "Review Prompt: Rate Now",
    "Applet Selected",
]
SAAS_NAMES = [
    "payroll", "appointments", "gift cards", "marketing", "instant deposit", "team management",
    "loyalty", "online store", "retail", "restaurants", "loans", "other",
]
# Yearly volume tiers in minor units.
TIERS = [(10_000_000, "Nano"), (23_500_000, "Micro"), (66_100_000, "SMB"),
         (109_000_000, "Mid-Market")]


def cents(expr: str) -> str:
    return f"cast(floor(({expr}) * 100 + 0.5) as bigint)"


def pick(number: str, values: list[str]) -> str:
    """Text that maps 0, 1, … to the given values: one lookup in a literal array."""
    return f"element_at(array({', '.join(repr(v) for v in values)}), cast({number} as int) + 1)"


def computed_once(df: DataFrame, name: str, expr: str) -> DataFrame:
    """Adds a derived column that later filters cannot inline.

    Catalyst pushes a filter on a derived column down by repeating its expression, here a JSON
    parse or a long CASE, many times per row. A one-element explode stops that.
    """
    return df.select("*", F.explode(F.array(F.expr(expr))).alias(name))


class Standin:
    """Logical tables over one folder of Parquet tables."""

    def __init__(self, spark: SparkSession, root: str):
        self.spark = spark
        self.root = root

    def raw(self, name: str) -> DataFrame:
        return read_table(self.spark, self.root, name)

    @cached_property
    def countries(self) -> DataFrame:
        """One row per country; Spark's own size check decides how it is joined."""
        return self.raw("nation")

    # -- payments ---------------------------------------------------------------------------
    @cached_property
    def payments(self) -> DataFrame:
        return self.raw("orders").selectExpr(
            "o_orderkey as payment_id",
            "o_custkey as seller_id",
            "o_orderdate + make_dt_interval(0, 0, 0, o_orderkey % 86400) as paid_at",
            "cast(o_orderdate as date) as paid_date",
            f"{cents('o_totalprice')} as amount",
            "case o_orderpriority when '1-URGENT' then 'terminal' when '2-HIGH' then 'pos'"
            " when '3-MEDIUM' then 'virtual' when '4-NOT SPECIFIED' then 'invoice'"
            " else 'online' end as product",
            "case when o_orderkey % 8 = 0 then null else concat('reader_', o_orderkey % 8) end"
            " as reader",
            "case when o_orderkey % 8 <> 0 and o_orderstatus <> 'O' then 1 else 0 end"
            " as is_card_present",
            "cast(o_orderkey % 2 as int) as is_itemized",
            "case when o_orderstatus = 'P' then 1 else 0 end as is_refunded",
            "case when o_orderkey % 10 <> 0 then 1 else 0 end as is_gpv",
            "case when o_orderkey % 7 <> 0 then 1 else 0 end as is_card_payment",
            "case o_orderkey % 3 when 0 then 'DEBIT' when 1 then 'CREDIT' end as tender",
            "case when o_custkey % 5 = 0 then 'EUR' else 'USD' end as currency",
            "o_orderstatus as entry_method",
        )

    @cached_property
    def lifetime(self) -> DataFrame:
        return self.payments.groupBy("seller_id").agg(
            F.min("paid_at").alias("first_at"),
            F.max("paid_at").alias("last_at"),
            F.min("paid_date").alias("first_date"),
            F.max("paid_date").alias("last_date"),
            F.count(F.lit(1)).alias("payment_count"),
        )

    @cached_property
    def daily_payments(self) -> DataFrame:
        return self.payments.groupBy("seller_id", "paid_date").agg(
            F.count(F.lit(1)).alias("payment_count"),
            F.sum(F.col("is_card_payment").cast("long")).alias("card_count"),
            F.sum(F.col("is_gpv").cast("long")).alias("gpv_count"),
            F.sum((1 - F.col("is_card_present")).cast("long")).alias("cnp_count"),
            F.sum("amount").alias("amount"),
            F.sum(F.when(F.col("is_card_present") == 0, F.col("amount")).otherwise(0)).alias(
                "cnp_amount"
            ),
        )

    @cached_property
    def product_daily(self) -> DataFrame:
        """Gross and net volume by seller, product, presence, reader and day."""
        net = F.col("is_refunded") == 0
        return self.payments.groupBy(
            "seller_id",
            "product",
            F.when(F.col("is_card_present") == 1, "CP").otherwise("CNP").alias("card_presence"),
            "reader",
            F.col("paid_date").alias("report_date"),
        ).agg(
            F.sum("amount").alias("volume_gross"),
            F.sum(F.when(net, F.col("amount")).otherwise(0)).alias("volume_net"),
            F.count(F.lit(1)).alias("trx"),
            F.count(F.when(net, 1)).alias("trx_net"),
        )

    @cached_property
    def revenue_summary(self) -> DataFrame:
        net = F.col("is_refunded") == 0
        return (
            self.payments.groupBy("seller_id", "product", F.col("paid_date").alias("report_date"))
            .agg(
                F.sum("amount").alias("volume_gross"),
                F.sum(F.when(net, F.col("amount")).otherwise(0)).alias("volume_net"),
                F.count(F.lit(1)).alias("volume_count"),
            )
            .withColumn(
                "category",
                F.when(F.col("product") == "online", "Other").otherwise("Processing"),
            )
        )

    # -- parties ----------------------------------------------------------------------------
    @cached_property
    def sellers(self) -> DataFrame:
        customer = self.raw("customer").join(
            self.countries, F.col("c_nationkey") == F.col("n_nationkey"), "left"
        )
        return customer.selectExpr(
            "c_custkey as seller_id",
            "c_mktsegment as category",
            "n_name as country",
            f"{pick('c_custkey % 3', ['en', 'es', 'fr'])} as language",
            "concat('type_', c_custkey % 4) as business_type",
            f"{pick('c_custkey % 4', ['web', 'ios', 'android', 'pos'])} as source_application",
            f"{pick('c_custkey % 3', ['ios', 'android', 'other'])} as device_os",
            f"{pick('c_custkey % 5', ['search', 'social', 'direct', 'partner', 'mail'])}"
            " as channel",
            "case when c_acctbal < 0 then 1 else 0 end as is_frozen",
            "case when c_acctbal < -500 then 1 else 0 end as is_deactivated",
            "case when c_custkey % 50 = 49 then 1 else 0 end as is_deleted",
            "c_custkey % 20 <> 19 as is_active",
            "cast(1 + c_custkey % 3 as int) as num_units",
            "case when c_custkey % 7 = 0 then null else c_custkey % 2 = 0 end"
            " as is_business_seller",
        )

    @cached_property
    def users(self) -> DataFrame:
        """Units and their merchants in one table: three units per merchant."""
        base = self.sellers
        units = base.selectExpr(
            "seller_id as user_id", "'UNIT' as user_type",
            "-(seller_id div 3) - 1 as parent_id", "category", "country", "language",
            "is_frozen", "is_deactivated", "is_deleted", "is_active",
            "date_add(date'1995-01-01', cast(seller_id % 400 as int)) as created_date",
            "case when seller_id % 13 = 5 then 'partner' else 'seller' end as source_user_type",
        )
        # a merchant has the attributes of its first unit
        merchants = base.filter("seller_id % 3 = 0").selectExpr(
            "-(seller_id div 3) - 1 as user_id", "'MERCHANT' as user_type",
            "-(seller_id div 3) - 1 as parent_id", "category", "country", "language",
            "is_frozen", "is_deactivated", "is_deleted", "is_active",
            "date_add(date'1995-01-01', cast(seller_id % 400 as int)) as created_date",
            "case when seller_id % 13 = 5 then 'partner' else 'seller' end as source_user_type",
        )
        return units.unionByName(merchants)

    @cached_property
    def places(self) -> DataFrame:
        """Sellers as merchants with three units each. Some units have another category than their
        merchant, and one unit carries its deactivation flag."""
        base = self.sellers
        merchants = base.selectExpr(
            "seller_id as user_id", "'MERCHANT' as user_type", "seller_id as parent_id", "category",
            "country", "is_deactivated",
        )
        units = base.withColumn("j", F.explode(F.expr("array(0, 1, 2)"))).selectExpr(
            f"{UNIT_BASE} + seller_id * 3 + j as user_id", "'UNIT' as user_type",
            "seller_id as parent_id",
            "case when j = 2 and seller_id % 11 = 0 then 'OTHER' else category end as category",
            "country", "case when j = seller_id % 3 then is_deactivated else 0 end as is_deactivated",
        )
        return merchants.unionByName(units)

    @cached_property
    def unit_payments(self) -> DataFrame:
        """Payments of units instead of sellers."""
        unit = F.lit(UNIT_BASE) + F.col("seller_id") * 3 + F.col("payment_id") % 3
        return self.payments.withColumn("unit_id", unit).drop("seller_id")

    @cached_property
    def unit_daily(self) -> DataFrame:
        return self.unit_payments.groupBy("unit_id", "paid_date").agg(
            F.sum(F.col("is_gpv").cast("long")).alias("gpv_count")
        )

    @cached_property
    def unit_card_payments(self) -> DataFrame:
        unit = F.lit(UNIT_BASE) + F.col("seller_id") * 3 + F.col("payment_id") % 3
        return self.card_payments.withColumn("unit_id", unit).drop("seller_id")

    @cached_property
    def unit_event_log(self) -> DataFrame:
        """The event log with users that are units or merchants."""
        user = "case when event_id % 4 < 3 then {} + seller_id * 3 + event_id % 4 else seller_id end"
        return self.event_log.withColumn(
            "user_id", F.expr(f"cast({user.format(UNIT_BASE)} as string)")
        ).drop("seller_id")

    @cached_property
    def merchant_signups(self) -> DataFrame:
        """Activation of the merchants of `users`: that of their first unit."""
        return self.signups.filter("seller_id % 3 = 0").selectExpr(
            "-(seller_id div 3) - 1 as merchant_id", "activation_date"
        )

    @cached_property
    def merchant_lifetime(self) -> DataFrame:
        units = self.users.filter("user_type = 'UNIT'").select(
            F.col("user_id").alias("seller_id"), "parent_id"
        )
        return self.lifetime.join(units, "seller_id").groupBy(
            F.col("parent_id").alias("merchant_id")
        ).agg(F.min("first_date").alias("first_date"), F.max("last_date").alias("last_date"))

    @cached_property
    def first_payment_log(self) -> DataFrame:
        """A second source for first payments: written later, with some differing fields."""
        units = self.users.filter("user_type = 'UNIT'").select(
            F.col("user_id").alias("seller_id"), F.col("parent_id").alias("merchant_id")
        )
        cards = self.payments.filter("is_card_payment = 1").join(units, "seller_id")
        return first_per_key(cards, ["merchant_id"], ascending("paid_at", "payment_id")).selectExpr(
            "merchant_id", "payment_id",
            "paid_at + make_dt_interval(0, 0, payment_id % 7, 0) as recorded_at",
            "case when payment_id % 13 = 0 then 'UNKNOWN' when is_card_present = 1 then 'TRUE'"
            " else 'FALSE' end as is_card_present",
            "entry_method",
            "amount + case when payment_id % 5 = 0 then 1 else 0 end as amount",
            "currency", "tender",
            "case when payment_id % 6 = 0 then null else reader end as reader",
        )

    @cached_property
    def signups(self) -> DataFrame:
        """Dates on the way from sign-up to first payment; sentinel for "never"."""
        first = "coalesce(first_date, date'1995-06-01')"
        never = "date'9999-09-09'"
        return (
            self.sellers.select("seller_id")
            .join(self.lifetime.select("seller_id", "first_date"), "seller_id", "left")
            .selectExpr(
                "seller_id",
                f"date_sub({first}, cast(10 + seller_id % 20 as int)) as signup_date",
                f"case when seller_id % 17 = 0 then {never} else"
                f" date_sub({first}, cast(seller_id % 9 as int)) end as activation_date",
                f"case when seller_id % 9 = 0 then {never} else"
                f" date_add({first}, cast(seller_id % 20 as int) - 10) end as bank_linked_date",
                f"case when seller_id % 8 = 0 then {never} else"
                f" date_add({first}, cast(seller_id % 40 as int) - 20) end"
                " as hardware_order_date",
                f"case when seller_id % 19 = 0 then {never} else"
                f" date_sub({first}, cast(seller_id % 5 as int)) end as onboarded_date",
                f"case when seller_id % 23 = 0 then {never} else"
                f" date_sub({first}, cast(seller_id % 7 as int)) end as first_app_date",
            )
        )

    @cached_property
    def referrals(self) -> DataFrame:
        totals = self.payments.groupBy("seller_id").agg(
            F.min("paid_at").alias("action_at"), F.sum("amount").alias("total")
        )
        # everybody was referred by one of a hundred sellers, nobody by themselves
        return totals.filter("seller_id <> seller_id % 100").selectExpr(
            "seller_id % 100 as referrer_id",
            "seller_id as referee_id",
            "action_at",
            "case when seller_id % 6 = 0 then null else total end as referee_amount",
        )

    # -- histories --------------------------------------------------------------------------
    @cached_property
    def segment_history(self) -> DataFrame:
        """Yearly volume tier per seller, equal neighbours merged, last range open."""
        yearly = self.payments.groupBy("seller_id", F.year("paid_date").alias("year")).agg(
            F.sum("amount").alias("amount")
        )
        tier = F.when(F.col("amount").isNull(), "Inactive")
        for limit, name in TIERS:
            tier = tier.when(F.col("amount") < limit, name)
        by_year = Window.partitionBy("seller_id").orderBy("year")
        by_begin = Window.partitionBy("seller_id").orderBy("effective_begin")
        following = F.coalesce(F.lead("year").over(by_year), F.lit(2002))
        # a year without volume opens an inactive range; later ones would only extend it
        no_amount = F.lit(None).cast("long").alias("amount")
        empty = F.struct((F.col("year") + 1).alias("year"), no_amount)
        rows = F.array_compact(F.array(
            F.struct("year", "amount"), F.when(F.col("_next") > F.col("year") + 1, empty)
        ))
        changed = (
            yearly.withColumn("_next", following)
            .select("seller_id", F.explode(rows).alias("_row"))
            .select("seller_id", "_row.*")
            .withColumn("sub_segment", tier.otherwise("Enterprise"))
            .withColumn("_before", F.lag("sub_segment").over(by_year))
            .filter(F.col("_before").isNull() | (F.col("_before") != F.col("sub_segment")))
        )
        return changed.select(
            "seller_id",
            F.lit("USD").alias("currency"),
            F.when(F.col("sub_segment") == "Nano", "Micro")
            .otherwise(F.col("sub_segment"))
            .alias("segment"),
            "sub_segment",
            F.make_date("year", F.lit(1), F.lit(1)).alias("effective_begin"),
        ).withColumn(
            "effective_end",
            F.coalesce(
                F.date_sub(F.lead("effective_begin").over(by_begin), 1),
                F.lit("9999-12-31").cast("date"),
            ),
        )

    @cached_property
    def payment_adoptions(self) -> DataFrame:
        """First and last activity per seller and payment product."""
        first = self.payments.groupBy("seller_id", "product").agg(
            F.min("paid_date").alias("first_date"), F.max("paid_date").alias("last_date")
        )
        start = F.min("first_date").over(Window.partitionBy("seller_id"))
        return first.withColumn("_start", start).select(
            "seller_id", "product", F.lit("Processing").alias("category"),
            "first_date", "last_date", F.col("first_date").alias("net_new_date"),
            F.when(F.col("first_date") == F.col("_start"), 1).alias("net_new_flag"),
            F.when(F.col("first_date") > F.col("_start"), 1).alias("existing_flag"),
        )

    @cached_property
    def software_adoptions(self) -> DataFrame:
        """First and last activity per seller and software product."""
        lines = self.raw("lineitem").select(
            "l_orderkey", "l_partkey", F.col("l_shipdate").cast("date").alias("d")
        )
        brand = self.raw("part").selectExpr(
            "p_partkey", "cast(substring(p_brand, 7) as int) % 12 as b"
        )
        used = (
            lines.join(brand, F.col("l_partkey") == F.col("p_partkey"))
            .groupBy("l_orderkey", "b")
            .agg(F.min("d").alias("d0"), F.max("d").alias("d1"))
            .join(
                self.raw("orders").select("o_orderkey", F.col("o_custkey").alias("seller_id")),
                F.col("l_orderkey") == F.col("o_orderkey"),
            )
            .groupBy("seller_id", "b")
            .agg(F.min("d0").alias("first_date"), F.max("d1").alias("last_date"))
        )
        starts = self.payments.groupBy("seller_id").agg(F.min("paid_date").alias("_start"))
        return (
            used.join(starts, "seller_id", "left")
            .withColumn("category", F.when(F.col("b") == 10, "Capital").otherwise("SaaS"))
            .select(
                "seller_id", F.expr(pick("b", SAAS_NAMES)).alias("product"), "category",
                "first_date", "last_date",
                F.when(
                    (F.col("category") == "SaaS") & (F.col("seller_id") % 13 == 0),
                    F.lit("9999-12-31").cast("date"),
                ).otherwise(F.col("first_date")).alias("net_new_date"),
                F.when(F.col("first_date") == F.col("_start"), 1).alias("net_new_flag"),
                F.when(F.col("first_date") > F.col("_start"), 1).alias("existing_flag"),
            )
        )

    @cached_property
    def adoptions(self) -> DataFrame:
        return self.payment_adoptions.unionByName(self.software_adoptions)

    @cached_property
    def product_history(self) -> DataFrame:
        return self.adoptions.selectExpr(
            "seller_id", "product", "category", "first_date as effective_begin",
            "case when last_date >= date'2001-01-01' then date'9999-12-31' else last_date end"
            " as effective_end",
        )

    @cached_property
    def rolling_cohort(self) -> DataFrame:
        """28-day trailing amounts on a grid of report dates 28 days apart."""
        start = F.lit("1995-01-01").cast("date")
        steps = F.floor(F.datediff("paid_date", start) / 28) + 1
        per = self.payments.withColumn("report_date", F.date_add(start, (steps * 28).cast("int")))
        # ALL and terminal rows from one aggregation
        sums = per.groupBy("seller_id", "report_date").agg(
            F.sum("amount").alias("total"),
            F.sum(F.when(F.col("product") == "terminal", F.col("amount"))).alias("terminal"),
        )
        long = sums.select(
            "seller_id", "report_date", F.expr("stack(2, 'ALL', total, 'terminal', terminal)")
            .alias("product", "amount"),
        ).filter(F.col("amount").isNotNull())
        return long.join(
            self.sellers.select("seller_id", "country", "category"), "seller_id"
        ).selectExpr(
            "seller_id", "'USD' as currency", "product", "'Processing' as product_category",
            "report_date", "country", "category as mcc",
            "case when amount > 20000000 then 'large' else 'small' end as segment",
            "case when amount > 0 then 'active' end as cohort", "amount",
        )

    # -- fee and revenue facts -------------------------------------------------------------
    @cached_property
    def line_facts(self) -> DataFrame:
        """Order lines with their seller: volume, revenue and fee per line."""
        lines = self.raw("lineitem").selectExpr(
            "l_orderkey", "cast(l_shipdate as date) as report_date", "l_linestatus",
            f"{cents('l_extendedprice')} as gpv_gross",
            f"{cents('l_extendedprice * (1 - l_discount)')} as gpv_net",
            f"{cents('l_extendedprice * l_discount')} as revenue",
            f"{cents('l_extendedprice * l_tax')} as fee",
            "case when l_returnflag = 'R' then 0 else 1 end as trx_net",
        )
        keys = self.raw("orders").selectExpr(
            "o_orderkey", "o_custkey as seller_id",
            "case when o_orderpriority = '1-URGENT' then 'terminal' else 'other' end as product",
        )
        return lines.join(keys, F.col("l_orderkey") == F.col("o_orderkey")).selectExpr(
            "seller_id", "product", "report_date",
            "case when l_linestatus = 'F' then 'CP' else 'CNP' end as card_presence",
            "gpv_gross", "gpv_net", "revenue", "fee", "trx_net",
        )

    @cached_property
    def fee_facts(self) -> DataFrame:
        """Fees by seller and day, from a table of its own: not all lines bear one, and some are
        booked a day later than their revenue."""
        lines = self.raw("lineitem").filter("l_linenumber % 4 <> 0").selectExpr(
            "l_orderkey", "date_add(cast(l_shipdate as date), l_linenumber % 2) as report_date",
            f"{cents('l_extendedprice * l_tax')} as fee",
        )
        keys = self.raw("orders").selectExpr("o_orderkey", "o_custkey as seller_id")
        return lines.join(keys, F.col("l_orderkey") == F.col("o_orderkey")).select(
            "seller_id", "report_date", "fee"
        )

    @cached_property
    def account_history(self) -> DataFrame:
        return self.sellers.selectExpr(
            "seller_id", "cast(seller_id % 3 as int) as total_times_unfrozen",
            "cast(seller_id % 5 as int) * is_deactivated as total_times_deactivated",
            "seller_id % 21 = 0 as is_cbd_merchant",
        )

    @cached_property
    def currency_segments(self) -> DataFrame:
        """Segment histories of sellers in two currencies."""
        euro = self.segment_history.filter("seller_id % 4 = 1").withColumns({
            "currency": F.lit("EUR"), "segment": F.lit("SMB"), "sub_segment": F.lit("SMB"),
        })
        return self.segment_history.unionByName(euro)

    @cached_property
    def merchant_summary(self) -> DataFrame:
        """First payment days, with the sentinel for some sellers that have not paid."""
        return self.lifetime.selectExpr(
            "seller_id",
            "case when seller_id % 6 = 0 then date'9999-09-09' else first_date end as first_date",
        )

    # -- events -----------------------------------------------------------------------------
    @cached_property
    def ev(self) -> DataFrame:
        log = self.raw("events").withColumnRenamed("user_id", "seller_id")
        return computed_once(log, "k", "cast(get_json_object(props, '$.k') as int)")

    @cached_property
    def event_log(self) -> DataFrame:
        return self.ev.selectExpr(
            "case when k = 0 then null when event_id % 5 = 0"
            " then cast(-(seller_id div 3) - 1 as string) else cast(seller_id as string) end as user_id",
            f"{pick('event_id % 4', ['onboard', 'dashboard', 'app_android', 'app_ios'])} as app",
            "case event_type when 'view' then 'View' when 'click' then 'Click' when 'error'"
            " then 'Action' when 'purchase' then 'Tap' else 'Link open' end as name",
            f"{pick('k % 16', EVENT_TEXTS)} as text",
            "ts as recorded_at", "event_id", "seller_id", "props",
        )

    @cached_property
    def click_text(self) -> DataFrame:
        m = "cast(floor(value / 5) as int)"
        cart = f"concat('{{custom: ', k % 3, ', items: ', k % 5, ', total: ', {m}, '}}')"
        clicks = self.ev.filter("event_type <> 'purchase'")
        return computed_once(
            clicks, "description",
            f"case when event_type = 'click' then concat('Keypad: Tap Charge Button: ', {m})"
            " when event_type = 'view' and k % 3 = 0"
            f" then concat('Keypad: Tap Show Cart: ', {cart})"
            " when event_type = 'view' and k % 3 = 2 and k % 2 = 0"
            " then 'Keypad: Add Custom Amount to Cart: (null)'"
            f" when event_type = 'view' then concat('Keypad: Add Custom Amount to Cart: ', {m})"
            f" when event_type = 'error' and k % 4 = 0"
            f" then concat('Keypad: Clear Single Amount: ', {m})"
            f" when event_type = 'error' and k % 4 = 1"
            f" then concat('Keypad: Clear Cart Confirm: ', {cart})"
            f" when event_type = 'error' and k % 4 = 2 then concat('Cart: Clear Cart: ', {cart})"
            " when event_type = 'error' then 'Keypad: Tap Backspace'"
            " else 'Help: opened' end",
        ).select(
            "event_id", F.col("seller_id").alias("user_id"), F.col("ts").alias("recorded_at"),
            "description",
        )

    @cached_property
    def counter_payments(self) -> DataFrame:
        """Payments of the event users, for the click-to-payment pipelines."""
        return self.ev.filter("event_type = 'purchase'").selectExpr(
            "event_id as payment_id", "seller_id", "ts as paid_at",
            "cast(floor(value / 5) as bigint) + k % 3 as amount",
            "cast(k % 3 as bigint) as tip", "1 as is_gpv",
            "case k % 4 when 0 then 'terminal' when 1 then 'pos' when 2 then 'online'"
            " else null end as product",
            "concat('method_', k % 3) as entry_method",
        )

    @cached_property
    def counter_lines(self) -> DataFrame:
        return self.ev.filter("event_type = 'purchase'").select(
            F.col("event_id").alias("bill_id"), "k", "ts",
            F.explode(F.expr("sequence(0, k % 3)")).alias("i"), "value",
        ).selectExpr(
            "bill_id", "ts as completed_at",
            "case (k + i) % 3 when 0 then 'Custom Amount' when 1 then 'UNKNOWN'"
            " else 'catalog item' end as name",
            "1 as quantity",
            "cast(floor(value) as bigint) * 25 + case when i > 0 then k else 0 end as amount",
        )

    @cached_property
    def touchpoints(self) -> DataFrame:
        names = ["onboard_web", "onboard_app", "dashboard", "app_android", "app_ios"]
        return self.ev.selectExpr(
            "seller_id", f"{pick('k % 5', names)} as channel",
            "ts - interval 29 years as action_at", "event_id",
        )

    @cached_property
    def support_cases(self) -> DataFrame:
        return self.ev.filter("event_type = 'error'").selectExpr(
            "event_id as case_id", "seller_id", "ts as created_at", "k % 25 as queue_id",
        )

    @cached_property
    def case_labels(self) -> DataFrame:
        return self.ev.filter("event_type = 'error'").selectExpr(
            "event_id as case_id",
            "case when k % 10 = 9 then null when value < 30 then 'referrals'"
            " when value < 70 then 'payments'"
            " else 'hardware' end as issue_bucket",
            "concat('macro_', k % 3) as macro_label",
        )

    @cached_property
    def surveys(self) -> DataFrame:
        return self.ev.filter("event_type = 'error'").selectExpr(
            "event_id as case_id", "case when k % 2 = 0 then k % 11 end as score",
            "cast(1 + event_id % 2 as int) as rank",
        )

    @cached_property
    def scored_replies(self) -> DataFrame:
        """Survey replies with the date as text and three possible links to a seller."""
        return self.ev.filter("event_type = 'signup'").selectExpr(
            "event_id as reply_id", "seller_id as contact_id", "k % 11 as score",
            "date_format(ts, 'yyyy-MM-dd HH:mm') as replied_text", "ts as replied_at",
            "case when k % 3 = 0 then event_id else seller_id end as link_id", "k",
        )

    @cached_property
    def reply_opportunities(self) -> DataFrame:
        return self.ev.filter("event_type = 'signup'").selectExpr(
            "event_id as opportunity_id", "case when k % 6 = 0 then -(seller_id div 3) - 1 end as merchant_id"
        )

    @cached_property
    def reply_activities(self) -> DataFrame:
        return self.ev.filter("event_type = 'signup'").selectExpr(
            "event_id as task_id", "case when k % 9 = 0 then -((seller_id + 1) div 3) - 1 end as merchant_id"
        )

    @cached_property
    def queues(self) -> DataFrame:
        return self.raw("nation").selectExpr(
            "n_nationkey as queue_id", "concat('org_', n_regionkey) as organization"
        )

    @cached_property
    def beta_starts(self) -> DataFrame:
        return self.raw("labels").selectExpr(
            "doc_id as seller_id", "quality + 2 * toxic as feature_id",
            "date_add(date'1996-01-01', cast(doc_id % 300 as int)) as started_date",
        )

    @cached_property
    def beta_programs(self) -> DataFrame:
        return self.raw("region").selectExpr("r_regionkey as feature_id", "r_name as program")

    @cached_property
    def community_events(self) -> DataFrame:
        return self.raw("conversations").selectExpr(
            "conv_id % 150 + case when role = 'assistant' then 1000 else 0 end as seller_id",
            "conv_id as thread_id", "turn",
            "timestamp_ntz'2024-01-01 00:00:00' + make_dt_interval(0, 0, conv_id, 0)"
            " + make_dt_interval(0, turn, 0, 0) as created_at",
            "case when role = 'system' then 'thread_viewed'"
            " when role = 'user' and turn <= 1 then 'thread_authored'"
            " when role = 'user' then 'comment_authored'"
            " when turn % 3 = 2 then 'best_answer_authored'"
            " when turn % 3 = 0 then 'marked_best_answer'"
            " else 'comment_authored' end as event_type",
        )

    # -- operations -------------------------------------------------------------------------
    @cached_property
    def balance_changes(self) -> DataFrame:
        kinds = ["campaign", "partner", "system_referral", "manual_referral", "other", "rebate"]
        return self.raw("lineitem").selectExpr(
            "l_orderkey as balance_id", "cast(l_shipdate as date) as changed_date",
            "case l_returnflag when 'A' then 'Grant' when 'R' then 'Use' else 'Refund' end"
            " as action",
            f"{pick('l_linenumber % 6', kinds)} as change_type",
            "case l_partkey % 4 when 0 then 'account_management' when 1 then 'customer_support'"
            " when 2 then 'growth' end as product_tag",
            f"{pick('l_suppkey % 3', ['USD', 'CAD', 'GBP'])} as currency",
            "case l_suppkey % 3 when 0 then 1.0D when 1 then 0.75D else 1.25D end as to_usd",
            "case when l_suppkey % 10 = 9 then 'other' else 'free_processing' end"
            " as balance_type",
            f"{cents('l_extendedprice')} as amount",
            f"{cents('l_extendedprice * l_tax')} as contra_revenue",
        )

    @cached_property
    def employees(self) -> DataFrame:
        return self.payments.selectExpr(
            "seller_id as merchant_id", "payment_id as row_id",
            "case when payment_id % 11 = 0 then null else payment_id div 2 end as person_id",
            "paid_at as created_at", "is_refunded = 0 as is_active",
            "case when payment_id % 9 = 0 then paid_at end as deleted_at",
        )

    @cached_property
    def locations(self) -> DataFrame:
        return self.payments.filter("product = 'pos'").selectExpr(
            "seller_id as merchant_id", "payment_id as location_id", "paid_at as created_at",
            "is_refunded = 0 as is_active",
        )

    @cached_property
    def deposits(self) -> DataFrame:
        return self.payments.selectExpr(
            "payment_id as deposit_id", "seller_id", "paid_at as attempted_at", "amount",
            "1 - is_refunded as is_successful",
        )

    @cached_property
    def card_payments(self) -> DataFrame:
        """One row per payment line with the part as the card."""
        return self.raw("lineitem").select("l_orderkey", "l_partkey").join(
            self.payments.select("payment_id", "seller_id", "paid_at", "paid_date", "is_gpv"),
            F.col("l_orderkey") == F.col("payment_id"),
        ).selectExpr(
            "payment_id", "seller_id", "paid_at", "paid_date", "is_gpv",
            "case when l_partkey % 20 = 0 then null else l_partkey % 40 end as card_id",
            "l_partkey as line_part",
        )

    def _lines_with_seller(self, flag: str, cols: list[str]) -> DataFrame:
        lines = self.raw("lineitem").filter(F.col("l_returnflag") == flag)
        keys = self.raw("orders").select("o_orderkey", F.col("o_custkey").alias("seller_id"))
        return lines.join(keys, F.col("l_orderkey") == F.col("o_orderkey")).selectExpr(*cols)

    @cached_property
    def risk_cases(self) -> DataFrame:
        groups = ["compliance", "chargebacks", "takeover", "fraud", "finance", "credit"]
        return self._lines_with_seller("R", [
            "seller_id", "(l_orderkey * 8 + l_linenumber) * 100000 + l_suppkey as case_id",
            "cast(l_shipdate as date) as created_date",
            f"{pick('l_suppkey % 6', groups)} as case_group",
            "concat('type_', l_linenumber) as case_type",
            "case when l_suppkey % 4 = 0 then 'review_requeue' else"
            " concat('route_', l_suppkey % 4) end as subroute",
            "cast(l_linenumber % 2 as int) as deactivated",
            "cast(l_suppkey % 2 as int) as frozen",
        ])

    @cached_property
    def chargebacks(self) -> DataFrame:
        return self._lines_with_seller("R", [
            "seller_id", "cast(l_shipdate as date) as chargeback_date",
            "case l_suppkey % 7 when 0 then 'fake_account' when 1 then 'gone_bad'"
            " when 2 then 'takeover' when 3 then 'buyer_fraud' when 4 then 'credit_risk'"
            " when 5 then 'inline' end as taxonomy",
        ])

    @cached_property
    def contacts(self) -> DataFrame:
        return self._lines_with_seller("N", [
            "seller_id", "(l_orderkey * 8 + l_linenumber) * 100000 + l_suppkey as contact_id",
            "cast(l_shipdate as date) as created_date",
            "case l_linenumber % 4 when 0 then 'billing' when 1 then 'device'"
            " when 2 then 'payout' end as issue_bucket",
            "concat('macro_', l_suppkey % 3) as macro_label",
            "concat('product_', l_suppkey % 5) as product",
            "case when l_linenumber % 3 > 0 then concat('category_', l_linenumber % 3) end"
            " as issue_category",
            "concat('issue_', l_linenumber) as issue",
        ])

    @cached_property
    def query_log(self) -> DataFrame:
        return self.raw("pages").selectExpr(
            "page_id as query_id", "html as query_text",
            "case when page_id % 7 = 0 then 'reporting' else concat('user_', page_id % 7) end"
            " as user_name",
            "concat('tag_', page_id % 5) as query_tag",
            "concat('cluster_', page_id % 3) as cluster",
            "timestamp_ntz'2023-01-01 00:00:00' + make_dt_interval(0, page_id * 5, 0, 0)"
            " as started_at",
        )

    @cached_property
    def hardware_lines(self) -> DataFrame:
        return self.raw("lineitem").selectExpr(
            "l_orderkey as order_user_id", "l_partkey as sku",
            "cast(l_shipdate as date) as completed_date",
            "case when l_linestatus = 'F' then 'complete' else 'open' end as state",
        )

    @cached_property
    def hardware_owners(self) -> DataFrame:
        return self.raw("orders").selectExpr(
            "o_orderkey as order_user_id", "o_custkey as seller_id"
        )

    @cached_property
    def hardware_products(self) -> DataFrame:
        return self.raw("part").selectExpr("p_partkey as sku", "p_name as product")

    @cached_property
    def device_touches(self) -> DataFrame:
        return self.touchpoints.selectExpr(
            "seller_id", "cast(action_at as date) as created_date",
            "case when channel = 'dashboard' then 'counter stand' else 'small ring' end"
            " as product",
        )

    @cached_property
    def sales_book(self) -> DataFrame:
        return self.payments.selectExpr(
            "seller_id", "payment_id as entry_id",
            "concat(year(paid_date), ' Q', quarter(paid_date)) as quarter",
            "cast(payment_id % 25 as int) as owner_id",
            "case when payment_id % 25 = 3 then null else concat('owner_', payment_id % 25) end"
            " as owner_name",
            f"case when payment_id % 4 = 3 then null else"
            f" {pick('payment_id % 4', ['core', 'growth', 'excluded'])} end as program",
            "case when payment_id % 2 = 0 then 'Treatment' else 'Control' end as arm",
        )

    @cached_property
    def closed_deals(self) -> DataFrame:
        kinds = ["Sales", "Strat", "Enterprise", "Field Sales", "Other"]
        return self.payments.filter("product = 'online'").selectExpr(
            "payment_id as deal_id", "paid_date as close_date",
            f"{pick('payment_id % 5', kinds)} as sales_segment",
        )

    @cached_property
    def deal_accounts(self) -> DataFrame:
        return self.payments.select(F.col("payment_id").alias("deal_id"), "seller_id")

    @cached_property
    def placements(self) -> DataFrame:
        """One row per seller and product they adopted: the unit of the trialist pipelines."""
        number = (
            "case product when 'terminal' then 0 when 'pos' then 1 when 'virtual' then 2"
            " when 'invoice' then 3 else 4 end"
        )
        return self.payments.groupBy("seller_id", "product").agg(
            F.min("paid_date").alias("first_product_date"),
            F.max("paid_date").alias("latest_payment_date"),
        ).selectExpr(
            f"seller_id * 10 + {number} as placement_id", "seller_id", "product",
            "first_product_date", "latest_payment_date",
            "case when seller_id % 4 = 3 then 'mixed' else 'pure' end as seller_group",
        )

    @cached_property
    def attributions(self) -> DataFrame:
        names = ["search", "social", "direct", "partner", "mail"]
        return self.ev.filter("event_type = 'signup'").selectExpr(
            "seller_id", f"{pick('k % 5', names)} as channel",
            "case when k % 2 = 0 then 'brand' end as sub_channel",
            "concat('offer_', k % 3) as offer_channel",
            "concat('NATION_', k % 25) as country",
            "(1 + k % 4) * 0.25D as fraction",
        )

    # -- sources of single pipelines ---------------------------------------------------------
    @cached_property
    def intents(self) -> DataFrame:
        """Intent rows: several per seller, one for each product it started with."""
        who = self.sellers.select("seller_id", "country", "source_application", "device_os")
        return (
            self.payment_adoptions.select("seller_id", "product", "first_date")
            .join(who, "seller_id")
            .join(self.signups, "seller_id")
            .selectExpr(
                "seller_id", "signup_date", "source_application", "country", "device_os",
                "activation_date", "bank_linked_date", "onboarded_date", "first_app_date",
                "product as intent_value", "product as payment_product",
                "first_date as first_payment_date",
                "case when product in ('terminal', 'pos', 'virtual') then 'primary'"
                " else 'secondary' end as signal",
            )
        )

    @cached_property
    def page_clicks(self) -> DataFrame:
        return self.ev.selectExpr(
            "seller_id", "ts as recorded_at",
            "case when event_type in ('signup', 'click') then 'Signup' else 'Browse' end"
            " as action",
            "case when k % 4 = 3 then 'page_viewed' else 'reader_option_selected' end"
            " as description",
            "concat('option_', k % 7) as detail",
        )

    @cached_property
    def shop_daily(self) -> DataFrame:
        """Daily activity of suppliers (negative ids), which sell all year round."""
        return self.raw("lineitem").selectExpr(
            "-(l_suppkey + 1) as seller_id", "cast(l_shipdate as date) as paid_date",
            f"{cents('l_extendedprice')} as cents", "l_linestatus",
        ).groupBy("seller_id", "paid_date").agg(
            F.count(F.lit(1)).alias("payment_count"),
            F.count(F.when(F.col("l_linestatus") == "O", 1)).alias("cnp_count"),
            F.sum("cents").alias("amount"),
            F.sum(F.when(F.col("l_linestatus") == "O", F.col("cents")).otherwise(0)).alias(
                "cnp_amount"
            ),
        )

    @cached_property
    def all_daily(self) -> DataFrame:
        cols = ["seller_id", "paid_date", "payment_count", "cnp_count", "amount", "cnp_amount"]
        return self.daily_payments.select(*cols).unionByName(self.shop_daily.select(*cols))

    @cached_property
    def all_lifetime(self) -> DataFrame:
        return self.all_daily.groupBy("seller_id").agg(F.min("paid_date").alias("first_date"))

    @cached_property
    def all_sellers(self) -> DataFrame:
        shops = self.raw("supplier").join(
            self.countries, F.col("s_nationkey") == F.col("n_nationkey"), "left"
        ).selectExpr(
            "-(s_suppkey + 1) as seller_id", "n_name as country",
            "case when s_acctbal < 0 then 1 else 0 end as is_frozen", "0 as is_deactivated",
        )
        return self.sellers.select("seller_id", "country", "is_frozen", "is_deactivated"
                                   ).unionByName(shops)
