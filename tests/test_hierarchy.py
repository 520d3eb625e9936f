"""Facts of units at their merchants: sister units merged before windows and rules."""

import datetime as dt

import pytest
from pyspark.sql import functions as F

from tillscope.operators import hierarchy
from tillscope.plans import gaps, moments, persona, trailing

D0 = dt.date(1999, 3, 1)
USERS = [(1, "MERCHANT", 1, "A", "US", 0), (11, "UNIT", 1, "A", "US", 0), (12, "UNIT", 1, "A", "US", 1), (13, "UNIT", 1, "B", "US", 0),
         (2, "MERCHANT", 2, "A", "US", 0), (21, "UNIT", 2, "A", "US", 0)]


def day(n):
    return D0 + dt.timedelta(n)


def at(n):
    return dt.datetime.combine(day(n), dt.time(12))


@pytest.fixture(scope="module")
def users(spark):
    return spark.createDataFrame(USERS, "user_id long, user_type string, parent_id long, category string, country string, is_deactivated int")


def rows(df):
    return sorted(map(tuple, df.collect()), key=repr)


def test_roll_up_merges_units_and_drops_unknown_ones(spark, users):
    facts = spark.createDataFrame([(11, "x", 1), (11, "x", 2), (12, "x", 5), (21, "y", 7), (99, "x", 9), (None, "x", 9)], "unit_id long, d string, v int")
    measures = {"n": (F.count("*"), F.sum), "low": (F.min("v"), F.min), "high": (F.max("v"), F.max)}
    got = hierarchy.roll_up(facts, users, "unit_id", ["d"], measures)
    assert rows(got) == [(1, "x", 3, 1, 5), (2, "y", 1, 7, 7)]
    only = spark.createDataFrame([(2,), (2,)], "seller_id long")
    assert rows(hierarchy.roll_up(facts, users, "unit_id", ["d"], measures, targets=only)) == [(2, "y", 1, 7, 7)]


def test_facts_of_few_targets_are_reduced_before_they_are_grouped(spark):
    facts = spark.createDataFrame([(1,), (2,), (2,), (3,), (None,)], "k long")
    targets = spark.range(1, 3).toDF("k")
    got = hierarchy.only_targets(facts.groupBy("k").agg(F.count("*").alias("n")), targets, "k")
    assert rows(got) == [(1, 1), (2, 2)]
    plan = got._jdf.queryExecution().optimizedPlan().toString()
    assert plan.index("Aggregate") < plan.index("Join LeftSemi")


def test_lookup_finds_merchants_and_keeps_unknown_users(spark, users):
    df = spark.createDataFrame([(1, "a"), (12, "b"), (None, "c"), (99, "d")], "user long, id string")
    assert rows(hierarchy.to_merchant(df, users, "user").select("id", "merchant_id")) == [("a", 1), ("b", 1), ("c", None), ("d", None)]


def test_gap_is_closed_by_a_sister_unit(spark, users):
    """Unit 11 pays on days 0 and 40, its sister on day 20: no gap of 28 days at the merchant."""
    daily = spark.createDataFrame([(11, day(0), 1), (12, day(20), 2), (11, day(40), 1), (21, day(0), 1), (21, day(40), 1)],
                                  "unit_id long, paid_date date, gpv_count long")
    grid = gaps.active_day_grid(daily, users, 1999, "2000-05-01")
    assert rows(grid) == [(1, "A", 1, day(n), c) for n, c in ((0, 1), (20, 2), (40, 1))] + [(2, "A", 0, day(n), 1) for n in (0, 40)]
    flags = {(r.seller_id, r.paid_date): (r.churn_14d, r.churn_28d, r.churn_42d) for r in gaps.gap_churn_flags(grid, 1999).collect()}
    assert flags[1, day(0)] == (1, 0, 0) and flags[1, day(20)] == (1, 0, 0) and flags[2, day(0)] == (1, 1, 0)


def test_merchant_with_units_of_two_categories_has_its_days_twice(spark, users):
    daily = spark.createDataFrame([(11, day(0), 1), (13, day(3), 1)], "unit_id long, paid_date date, gpv_count long")
    got = rows(gaps.active_day_grid(daily, users, 1999, "2000-05-01"))
    assert got == [(1, c, 0, day(n), 1) for c in "AB" for n in (0, 3)]


def test_mix_and_ticket_of_all_units(spark, users):
    pay = spark.createDataFrame(
        [(11, 300, 1, "pos", 0, 1, "reader_1", day(0)), (12, 100, 1, "invoice", 1, 0, None, day(1)), (99, 500, 1, "pos", 0, 1, None, day(1))],
        "unit_id long, amount long, is_gpv int, product string, is_itemized int, is_card_present int, reader string, paid_date date")
    population = trailing.qualifying_sellers(pay, users)
    assert rows(population) == [(1,), (None,)]
    got = trailing.trailing_91d_mix(pay, users, population, day(2)).collect()
    assert [(r.seller_id, r.volume_91d, r.custom_91d, r.invoice_91d, r.ticket_91d) for r in got] == [(1, 400, 300, 100, 200.0)]


def test_a_card_at_two_units_is_one_customer_and_a_repeat_card(spark, users):
    cards = spark.createDataFrame([(11, 1, "c", day(0), 1), (12, 2, "c", day(2), 1), (12, 3, "d", day(2), 1)],
                                  "unit_id long, payment_id long, card_id string, paid_date date, is_gpv int")
    spine = spark.createDataFrame([(1, at(0), dt.date(1998, 1, 1))], "seller_id long, first_payment_at timestamp_ntz, activation_date date")
    got = moments.cumulative_customers(spine, cards, users, "1999-01-01")
    assert rows(got) == [(1, day(0), 0, 1, 1), (1, day(2), 2, 2, 3)]
    who = spark.createDataFrame([(1,), (2,)], "seller_id long")
    assert rows(persona.persona_repeat_cards(who, cards, users, "1999-01-01")) == [(1, 2, 1), (2, 0, 0)]


def test_prompts_of_merchants_are_found(spark, users):
    log = spark.createDataFrame([("1", "t", at(0), 5), ("11", "t", at(1), 6), (None, "t", at(2), 7)], "user_id string, text string, recorded_at timestamp_ntz, event_id long")
    assert rows(moments.prompt_click(log, users, "t").select("seller_id", "id")) == [(1, "5"), (1, "6"), (None, "7")]


def test_shared_scans_give_the_moments_of_the_single_ones(spark, users):
    posts = spark.createDataFrame(
        [("a", 1, "thread_authored", at(0), 1), ("b", 1, "comment_authored", at(1), 2), ("b", 1, "best_answer_authored", at(2), 3),
         ("b", 1, "marked_best_answer", at(3), 4), ("c", 2, "comment_authored", at(0), 1), ("c", 2, "viewed", at(-1), 0), ("d", 3, "viewed", at(0), 1),
         ("e", 4, "best_answer_authored", at(0), 1), ("f", None, "comment_authored", at(0), 1)],
        "seller_id string, thread_id int, event_type string, created_at timestamp_ntz, turn int")
    single = moments.stack_moments({"any_post": moments.any_post(posts), "thread_opener": moments.thread_opener(posts),
                                    "commenter": moments.commenter(posts), "best_answer": moments.best_answer(posts)})
    assert rows(moments.community_moments(posts).filter("id is not null")) == rows(single.filter("id is not null"))
    log = spark.createDataFrame([("1", "t", "Action", "ios", at(0), 5), ("11", "s", "Action", "ios", at(1), 6), ("12", "s", "View", "ios", at(1), 7), (None, "t", "View", "x", at(2), 8)],
                                "user_id string, text string, name string, app string, recorded_at timestamp_ntz, event_id long")
    for show in ("s", "t"):
        single = moments.stack_moments({"prompt_click": moments.prompt_click(log, users, "t"),
                                        "prompt_show": moments.prompt_show(moments.prompt_show_raw(log, show, "ios", "1999-01-01"), users)})
        assert rows(moments.prompt_moments(log, users, "t", show, "ios", "1999-01-01")) == rows(single)


def test_moment_all_reads_each_source_once(spark):
    """Scans of the event table: one for each logical table that the journey reads from it."""
    from tillscope.plans.registry import moment_all
    from tillscope.sources.standin import Standin

    plan = moment_all(Standin(spark, "/root/testdata/sf0.001"))._jdf.queryExecution().optimizedPlan().toString()
    prompts = [line for line in plan.split("\n") if "Review Prompt: Rate Now" in line and "Filter" in line]
    assert len(prompts) == 1
