"""Pipelines on hand-made rows: one case per semantic trap."""

import datetime as dt
import random

import pytest
from pyspark.sql import functions as F

from tillscope.operators import ranges
from tillscope.plans import clicks, events, first_payments, gaps, growth, ledger, moments, pareto, persona, risk
from tillscope.plans import seasonality, segments, trialists
from tillscope.sources.standin import Standin

DAY = dt.date
ROOT = "/root/testdata/sf0.001"


def rows(df):
    return sorted(map(tuple, df.collect()), key=lambda r: tuple((v is None, str(v)) for v in r))


def ts(text):
    return dt.datetime.fromisoformat(text)


# -- first payments ---------------------------------------------------------------------------
def test_winner_before_the_cut_off_drops_the_merchant(spark):
    users = spark.createDataFrame(
        [(1, "UNIT", -1, DAY(2021, 8, 1)), (2, "UNIT", -2, DAY(2021, 8, 1)),
         (-1, "MERCHANT", -1, DAY(2021, 8, 1)), (-2, "MERCHANT", -2, DAY(2021, 8, 1))],
        "user_id long, user_type string, parent_id long, created_date date")
    cols = ("payment_id long, seller_id long, paid_at timestamp_ntz, is_gpv int, is_card_payment int, "
            "entry_method string, is_card_present int, amount long, currency string, tender string, "
            "reader string, product string")
    pay = lambda i, s, t: (i, s, ts(t), 1, 1, "x", 1, 5, "USD", "D", None, "terminal")
    df = spark.createDataFrame([
        pay(1, 1, "2021-07-01 10:00:00"), pay(2, 1, "2021-08-02 10:00:00"),
        pay(4, 2, "2021-08-02 10:00:00"), pay(3, 2, "2021-08-02 10:00:00")], cols
    ).withColumn("paid_date", F.col("paid_at").cast("date"))
    got = first_payments.first_payment_from_fact(df, users)
    assert [(r.merchant_id, r.payment_id) for r in got.collect()] == [(-2, 3)]


def test_reconcile_counts_one_sided_null_attributes(spark):
    base = "merchant_id long, payment_id long, {} timestamp_ntz, entry_method string, is_card_present int, amount long, currency string, tender string, reader string"
    f = spark.createDataFrame([(1, 1, ts("2021-01-01"), "a", 1, 5, "USD", None, None),
                               (2, 2, ts("2021-01-01"), "a", 1, 5, "USD", "D", None)], base.format("paid_at"))
    g = spark.createDataFrame([(1, 1, ts("2021-01-01 00:02:00"), "a", 0, 5, "USD", None, None),
                               (3, 3, ts("2021-01-01"), "a", 1, 5, "USD", "D", "r")], base.format("recorded_at"))
    r = first_payments.reconcile_sources(f, g).first()
    assert (r.log_count, r.fact_count, r.overlap_count) == (2, 2, 1)
    assert (r.entry_method_overlap, r.is_card_present_overlap, r.tender_overlap) == (1, 0, 0)
    assert r.reader_overlap == 2  # matched NULLs and the fact row without partner
    lags = {r.lag_minutes: (r.payments, r.share) for r in first_payments.source_lag_distribution(f, g).collect()}
    assert lags == {2: (1, 0.5), None: (1, 0.5)}


# -- growth -----------------------------------------------------------------------------------
@pytest.mark.parametrize("seed", range(3))
def test_group_form_equals_the_outer_join_chain(spark, seed):
    rnd = random.Random(seed)
    data = {(rnd.randint(1, 8), rnd.randint(1, 9)) for _ in range(60)}
    rowset = [(k, DAY(2020, m, 1), f"c{k % 2}", rnd.choice([None, 5, 7]), rnd.choice([3, 4])) for k, m in data]
    df = spark.createDataFrame(rowset, "seller_id int, month date, country string, own long, other long")
    a, b = growth.period_presence(df), growth.period_presence_joined(df)
    assert rows(a.select(sorted(a.columns))) == rows(b.select(sorted(b.columns)))


def _growth(spark, sales, flags, joined=False):
    rev = spark.createDataFrame(
        [(s, p, DAY(2020, m, 9), 10, "Processing") for s, p, m in sales],
        "seller_id int, product string, report_date date, volume_net long, category string")
    who = spark.createDataFrame([(s, "US", "food") for s in range(1, 9)], "seller_id int, country string, category string")
    first = spark.createDataFrame(flags, "seller_id int, product string, net_new_date date, net_new_flag int, existing_flag int")
    seg = spark.createDataFrame([(1, "Micro", DAY(2020, 1, 1), DAY(9999, 12, 31))],
                                "seller_id int, segment string, effective_begin date, effective_end date")
    out = growth.growth_accounting_monthly(rev, who, first, seg, load_since="2020-01-01",
                                           report_since="2020-01-01", joined=joined)
    return {(r.month.month, r.segment): r for r in out.collect()}


@pytest.mark.parametrize("joined", [False, True])
def test_growth_states(spark, joined):
    flags = [(2, "terminal", DAY(2020, 3, 2), 1, None), (3, "terminal", DAY(2020, 1, 2), None, 1)]
    sales = [(2, "terminal", 3),                                # new in March
             (3, "terminal", 1), (3, "terminal", 3),            # back in March after a gap
             (4, "terminal", 2), (4, "pos", 3),                 # switched in March
             (5, "terminal", 2),                                # churned in March
             (6, "terminal", 2), (6, "terminal", 3)]            # retained
    r = _growth(spark, sales, flags, joined)[(3, None)]
    assert (r.t0_active, r.t1_active, r.net_new, r.retained) == (3, 3, 1, 1)
    assert (r.reactivated, r.switched, r.true_churn) == (1, 1, 1)


def test_trailing_states_and_lag(spark):
    cols = "seller_id int, currency string, product string, product_category string, report_date date, country string, mcc string, segment string, cohort string, amount long"
    row = lambda s, p, d, a: (s, "USD", p, "Processing", d, "US", "m", "s", "x", a)
    d0, d1 = DAY(2021, 1, 1), DAY(2021, 1, 29)
    data = [row(1, "ALL", d0, 9), row(1, "terminal", d0, 9), row(1, "ALL", d1, 9), row(1, "terminal", d1, 9),
            row(2, "ALL", d0, 9), row(2, "terminal", d0, 9), row(2, "ALL", d1, 4),
            row(3, "ALL", d0, 9), row(3, "terminal", d0, 9)]
    first = spark.createDataFrame([], "seller_id int, product string, net_new_date date, net_new_flag int, existing_flag int")
    got = {r.report_date: r for r in growth.growth_accounting_trailing28(spark.createDataFrame(data, cols), first).collect()}
    r = got[d1]
    assert (r.t0_active, r.t1_active, r.retained, r.switched, r.true_churn) == (1, 3, 1, 1, 1)
    assert got[d0].reactivated == 3


# -- gaps -------------------------------------------------------------------------------------
def test_gap_flags_at_the_borders(spark):
    d = DAY(2019, 1, 1)
    days = [d, d + dt.timedelta(6), d + dt.timedelta(13), d + dt.timedelta(103), d + dt.timedelta(194)]
    df = spark.createDataFrame([(1, "c", 0, x, 1) for x in days],
                               "seller_id int, category string, is_deactivated int, paid_date date, pmt long")
    got = {r.paid_date: r for r in gaps.gap_churn_flags(df, 2019).collect()}
    assert [got[x].churn_7d for x in days] == [0, 1, 1, 1, 1]
    assert [got[x].churn_91d for x in days] == [0, 0, 0, 1, 1]
    marks = [f"churn_{n}d" for n in gaps.GAP_DAYS]
    for r in got.values():
        flags = [r[m] for m in marks]
        assert flags == sorted(flags, reverse=True)


# -- ledger -----------------------------------------------------------------------------------
def _pairs_form(spark, df):
    df.createOrReplaceTempView("bc")
    return spark.sql("""
        select sum(case when a.action = 'Use' then 1 else 0 end) uses, 0 - sum(a.amount) used
        from bc a join bc b on a.balance_id = b.balance_id
        where a.action in ('Use', 'Refund') and b.action = 'Grant'""").first()


def test_ledger_nulls_and_fanout(spark):
    d = DAY(2021, 2, 3)
    cols = "balance_id int, changed_date date, action string, change_type string, product_tag string, currency string, to_usd double, balance_type string, amount long, contra_revenue long"
    row = lambda b, a, t, tag, n: (b, d, a, t, tag, "USD", 1.0, "free_processing", n, 1)
    df = spark.createDataFrame([
        row(1, "Grant", "manual_referral", None, 10), row(1, "Use", None, None, -4), row(1, "Refund", None, None, 1),
        row(2, "Grant", "manual_referral", "growth", 20), row(2, "Grant", "campaign", None, 30), row(2, "Use", None, None, -5),
        row(3, "Use", None, None, -7), row(4, "Grant", "rebate", "x", 5)], cols)
    got = {r.category: r for r in ledger.grant_vs_usage(df, "2021-01-01").collect()}
    assert set(got) == {None, "customer_support", "campaign", "x"}
    assert (got[None].granted_amount, got[None].uses, got[None].used_amount) == (10, 1, 3)
    assert (got["campaign"].uses, got["customer_support"].used_amount) == (1, 5)
    assert got["x"].uses is None
    total = _pairs_form(spark, df)
    assert sum(r.uses or 0 for r in got.values()) == total.uses
    assert sum(r.used_amount or 0 for r in got.values()) == total.used


# -- clicks -----------------------------------------------------------------------------------
def _click(i, t, text):
    return (i, 1, ts(t), text)


def _parsed(spark, data):
    return events.parse_click_text(spark.createDataFrame(
        data, "event_id long, user_id long, recorded_at timestamp_ntz, description string"))


def test_click_text_classes(spark):
    t = "2024-01-01 00:00:00"
    data = [_click(1, t, "Keypad: Tap Charge Button: 12"), _click(2, t, "Keypad: Add Custom Amount to Cart: (null)"),
            _click(3, t, "Keypad: Tap Show Cart: { custom: 1,  items: 2, total: 30 }"), _click(4, t, "Cart: Clear Cart: {custom: 1, items: 2}"),
            _click(5, t, "Keypad: Tap Backspace"), _click(6, t, "Help"), _click(7, t, "Keypad: Clear Cart Confirm: {custom: 0, items: 9, total: 1}")]
    got = {r.event_id: (r.family, r.amount, r.custom_count, r.item_count) for r in _parsed(spark, data).collect()}
    assert got == {
        1: ("Keypad: Tap Charge Button", 12, None, None), 2: ("Keypad: Add Custom Amount to Cart", None, None, None),
        3: ("Keypad: Tap Show Cart", 30, 1, 2), 4: ("Cart: Clear Cart", None, 1, 2),
        5: ("Cart: Tap Backspace", None, None, None), 7: ("Keypad: Clear Cart Confirm", 1, 0, 9)}


def test_payment_at_next_click_and_lookback_window(spark):
    data = [_click(1, "2024-01-01 10:00:00", "Keypad: Tap Charge Button: 5"), _click(2, "2024-01-01 10:10:00", "Keypad: Tap Charge Button: 5"),
            _click(3, "2024-01-01 10:20:00", "Keypad: Tap Charge Button: 8"),
            _click(4, "2024-01-01 10:15:00", "Keypad: Clear Single Amount: 3"), _click(5, "2024-01-01 10:15:01", "Keypad: Clear Single Amount: 4"),
            _click(6, "2024-01-01 10:19:00", "Keypad: Tap Backspace"), _click(7, "2024-01-01 10:19:30", "Keypad: Add Custom Amount to Cart: 2")]
    parsed = _parsed(spark, data)
    cols = "payment_id long, seller_id long, paid_at timestamp_ntz, amount long, tip long, product string, entry_method string, name string"
    master = spark.createDataFrame([
        (10, 1, ts("2024-01-01 10:10:00"), 6, 1, None, "m", "UNKNOWN"), (11, 1, ts("2024-01-01 10:11:00"), 9, 1, "pos", "m", "item"),
        (12, 1, ts("2024-01-01 10:12:00"), 5, 0, "pos", "m", "item")], cols)
    match = clicks.click_payment_match(parsed, master)
    assert rows(match.select("event_id", "payment_id", "match_rank")) == [(1, 10, 1), (2, 10, 1), (2, 12, 2), (3, None, 1)]
    got = {r.event_id: r for r in clicks.lookback_event_counts(match, parsed).collect()}
    r = got[3]
    # exactly five minutes before is outside; the backspace has no amount and ranks behind
    assert (r.clear_count, r.last_cleared_amount, r.last_clear_event) == (2, 4, "Keypad: Clear Single Amount")
    assert (r.last_cleared_at, r.plus_count) == (ts("2024-01-01 10:19:00"), 1)
    assert got[1].clear_count is None and got[1].plus_count == 0


# -- risk -------------------------------------------------------------------------------------
def test_last_case_window_and_ties(spark):
    sold = DAY(2021, 6, 30)
    churned = spark.createDataFrame([(1, sold), (2, sold)], "seller_id int, last_sale date")
    case = lambda s, i, d, g="fraud", r="x": (s, i, d, g, f"t{i}", r, 0, 0)
    cases = spark.createDataFrame([
        case(1, 1, sold - dt.timedelta(30)), case(1, 2, sold + dt.timedelta(30)), case(1, 3, sold + dt.timedelta(30), "finance"),
        case(1, 4, sold + dt.timedelta(31)), case(2, 5, sold - dt.timedelta(31)), case(1, 6, sold, "fraud", "a_requeue")],
        "seller_id int, case_id int, created_date date, case_group string, case_type string, subroute string, deactivated int, frozen int")
    (near,) = risk.last_cases(cases, churned, risk.case_kinds()).collect()
    assert (near.seller_id, near.case_count_any, near.last_case_type_any) == (1, 4, "t3")
    assert (near.case_count_risk, near.last_case_type_risk) == (2, "t2")
    every = {r.case_id: r for r in risk.case_rows(cases, churned).collect()}
    assert len(every) == 6  # each case once, also those outside the window
    assert every[2].case_count_any == 4 and every[3].case_count_any == 4 and every[4].case_count_any is None


# -- seasonality ------------------------------------------------------------------------------
def test_every_seasonality_tag(spark):
    def months(seller, keys, amount=500):
        return [(seller, DAY(y, m, 3), 1, 0, amount, 0) for y, m in keys]

    data = (months(1, [(2018, 1), (2018, 2)], 10) + months(2, [(2018, 1)]) + months(3, [(2018, 1), (2018, 6)])
            + months(4, [(y, m) for y in (2017, 2018) for m in range(1, 12)])
            + months(5, [(y, m) for y in (2016, 2017, 2018) for m in (6, 7)])
            + months(6, [(2016, 1), (2016, 9), (2018, 4), (2018, 12)])
            + months(7, [(2016, 12), (2017, 1), (2017, 12), (2018, 1)]))
    daily = spark.createDataFrame(data, "seller_id int, paid_date date, payment_count long, cnp_count long, amount long, cnp_amount long")
    who = spark.createDataFrame([(i, "US", 0, 0) for i in range(1, 8)], "seller_id int, country string, is_frozen int, is_deactivated int")
    life = daily.groupBy("seller_id").agg(F.min("paid_date").alias("first_date"))
    shape = seasonality.yearly_shape(seasonality.monthly_activity(daily, who, life, "2021-01-01"))
    got = {r.seller_id: r.business_type for r in seasonality.seasonality_tag(shape, "2021-01-01").collect()}
    assert got == {1: "test payment", 2: "single month", 3: "single year, multi months", 4: "multi year, all year",
                   5: "multi year, seasonal", 6: "multi year, casual", 7: "multi year, casual"}


# -- rules ------------------------------------------------------------------------------------
def test_unknown_segment_is_not_in_no_list(spark):
    df = spark.createDataFrame(
        [(1, "mature active", "pure custom", None, None), (2, "mature active", "pure custom", "Nano", None),
         (3, "mature active", "pure other", "SMB", -0.5), (4, "other churn", None, None, None),
         (5, "mature active", "pure custom", "Nano", -0.1)],
        "k int, activity_status string, product_mix string, sub_segment string, volume_yoy double")
    got = {r.k: r.label for r in df.select("k", segments.label_rules().alias("label")).collect()}
    assert got == {1: None, 2: "High Growth", 3: "Graduate Active", 4: "Churn", 5: "Diminishing Active"}


def test_top_share_small_inputs(spark):
    df = spark.createDataFrame([(1, 10), (2, 30)], "k int, v long")
    assert pareto.top_share(df, "v").first()[0] == 0.75


def test_pay_type_rules(spark):
    df = spark.createDataFrame([(1, "trialist churns", 1, 1), (2, "trialist churns", 101, 1), (3, "active", 1, 1), (4, "trialist churns", None, None)],
                               "k int, churn_type string, first_day_volume long, first_day_trx long")
    got = {r.k: r.p for r in df.select("k", trialists.pay_type().alias("p")).collect()}
    assert got == {1: "test pay", 2: "non-test pay", 3: None, 4: "non-test pay"}


def test_running_customers_by_day_equal_running_rows(spark):
    spine = spark.createDataFrame([(1, ts("2021-01-01"), DAY(2021, 1, 1))], "seller_id int, first_payment_at timestamp_ntz, activation_date date")
    pays = spark.createDataFrame(
        [(1, c, DAY(2021, 1, d), 1) for c, d in [(5, 1), (5, 1), (None, 1), (6, 2), (5, 2), (None, 3)]],
        "unit_id int, card_id int, paid_date date, is_gpv int")
    users = spark.createDataFrame([(1, "UNIT", 1)], "user_id int, user_type string, parent_id int")
    got = moments.cumulative_customers(spine, pays, users, "2021-01-01")
    assert rows(got.select("paid_date", "cum_customers", "cum_payments")) == [
        (DAY(2021, 1, 1), 2, 3), (DAY(2021, 1, 2), 3, 5), (DAY(2021, 1, 3), 3, 6)]


# -- invariants on the stand-in data ----------------------------------------------------------
def test_segment_ranges_do_not_overlap(spark):
    h = Standin(spark, ROOT).segment_history
    a, b = h.alias("a"), h.alias("b")
    clash = a.join(b, (F.col("a.seller_id") == F.col("b.seller_id"))
                   & (F.col("a.effective_begin") < F.col("b.effective_begin"))
                   & (F.col("a.effective_end") >= F.col("b.effective_begin")))
    assert clash.count() == 0


def test_active_is_new_plus_retained_plus_reactivated(spark):
    from tillscope.plans.registry import QUERIES
    bad = QUERIES["growth_accounting_monthly"](spark, ROOT).filter(
        "t0_active < retained + reactivated or t1_active != retained + switched + true_churn")
    assert bad.count() == 0


def test_manager_nps_links_units_and_merchants(spark):
    from tillscope.plans.moments import manager_nps

    replies = spark.createDataFrame(
        [(1, 9, 71, "2024-01-01"), (2, 10, 72, "2024-01-02"), (3, 9, 11, "2024-01-03"), (4, 9, 500, "2024-01-04"), (5, 9, 99, "2024-01-05")],
        "reply_id long, score int, link_id long, replied_at string")
    opportunities = spark.createDataFrame([(71, 500)], "opportunity_id long, merchant_id long")
    activities = spark.createDataFrame([(72, 500)], "task_id long, merchant_id long")
    users = spark.createDataFrame([(11, "UNIT", 500), (500, "MERCHANT", None)], "user_id long, user_type string, parent_id long")
    got = manager_nps(replies, opportunities, activities, users).collect()
    assert {r.id: r.seller_id for r in got} == {"1": 500, "2": 500, "3": 500, "4": 500, "5": None}


def sources_read(df):
    """How often the plan reads rows that a test has made."""
    return df._jdf.queryExecution().optimizedPlan().toString().count("LogicalRDD")


def test_product_usage_reads_its_sources_once(spark):
    who = spark.createDataFrame([(1,), (2,), (3,)], "seller_id long")
    day = lambda n: dt.date(2020, 1, n)
    rows = [(1, "payroll", "SaaS", day(3)), (1, "loyalty", "SaaS", day(3)), (1, "loyalty", "SaaS", day(9)), (1, "instant deposit", "SaaS", day(5)),
            (2, "other", "SaaS", day(4)), (2, "marketing", "SaaS", dt.date(9999, 12, 31)), (2, "pos", "Processing", day(2)),
            (2, "terminal", "Processing", day(2)), (3, "pos", "Processing", None), (9, "payroll", "SaaS", day(1))]
    used = spark.createDataFrame(rows, "seller_id long, product string, category string, net_new_date date")
    saas, paid = persona.persona_saas_usage(who, used), persona.persona_payment_products(who, used)
    got = {r.seller_id: r for r in saas.collect()}
    assert sorted(got) == [1, 2]
    assert (got[1].first_saas_product, got[1].first_saas_date, got[1].loyalty_date, got[1].deposit_date) == ("payroll", day(3), day(9), day(5))
    assert (got[2].first_saas_product, got[2].other_saas_date, got[2].marketing_date) == ("other", day(4), None)
    assert [(r.seller_id, r.first_pmt_product, r.term_date, r.pos_date) for r in paid.collect()] == [(2, "terminal", day(2), day(2))]
    assert sources_read(saas) == sources_read(paid) == 2


def test_spells_read_active_days_once(spark):
    active = spark.createDataFrame([(1, dt.date(2020, 3, 1), dt.date(2020, 1, 1))], "k long, d date, f date")
    got = ranges.uncovered_spells(active, "k", "d", "f", dt.date(2020, 12, 31), 91)
    assert sorted(tuple(r) for r in got.collect()) == [(1, dt.date(2020, 1, 1), dt.date(2020, 2, 29)), (1, dt.date(2020, 5, 31), dt.date(2020, 12, 31))]
    assert sources_read(got) == 1


def test_running_customers_join_stored_sellers(spark):
    spine = spark.createDataFrame([(1, dt.datetime(2021, 1, 2), dt.date(2021, 1, 1))], "seller_id long, first_payment_at timestamp_ntz, activation_date date")
    cards = spark.createDataFrame([(7, 5, dt.date(2021, 1, 3), 1)], "unit_id long, card_id long, paid_date date, is_gpv int")
    users = spark.createDataFrame([(7, "UNIT", 1)], "user_id long, user_type string, parent_id long")
    got = moments.cumulative_customers(spine, cards, users, "2021-01-01")
    assert [tuple(r) for r in got.collect()] == [(1, dt.date(2021, 1, 3), 1, 1, 1)]
    assert sources_read(got) == 2
