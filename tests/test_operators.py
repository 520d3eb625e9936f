"""Operators against brute force on small frames, with their NULL, tie and border cases."""

import datetime as dt
import random

import pytest
from pyspark.sql import functions as F

from tillscope.functions.dates import as_date
from tillscope.operators import distinct, keyed, ranges, ranks, sets, skew, timeline

T0 = dt.datetime(2024, 1, 1)
D0 = dt.date(2021, 1, 1)


def at(minutes):
    return T0 + dt.timedelta(minutes=minutes)


def rows(df):
    return sorted(map(tuple, df.collect()), key=lambda r: tuple((v is None, str(v)) for v in r))


# -- keyed ------------------------------------------------------------------------------------
def test_first_ties_and_nulls(spark):
    df = spark.createDataFrame(
        [("a", None, 1), ("a", 5, 3), ("a", 5, 2), ("b", None, 9)], "k string, t int, id int")
    assert rows(keyed.first_per_key(df, ["k"], keyed.ascending("t", "id"))) == [("a", 5, 2), ("b", None, 9)]
    assert rows(keyed.latest_per_key(df, ["k"], "t", ["id"])) == [("a", 5, 3), ("b", None, 9)]
    assert rows(keyed.nth_per_key(df, ["k"], keyed.ascending("t", "id"), 2)) == [("a", 5, 3)]


def test_rank_keeps_ties(spark):
    df = spark.createDataFrame([("a", 1, "x"), ("a", 1, "y"), ("a", 2, "z")], "k string, t int, p string")
    assert rows(keyed.ranked_first(df, ["k"], keyed.ascending("t"))) == [("a", 1, "x"), ("a", 1, "y")]


def test_nth_value_keeps_every_key(spark):
    df = spark.createDataFrame([("a", 1, 1), ("a", 2, 2), ("b", 7, 3)], "k string, t int, id int")
    assert rows(keyed.nth_value(df, "k", "t", ["id"], 2, "ts")) == [("a", 2), ("b", None)]


# -- distinct ---------------------------------------------------------------------------------
def test_count_keys_equals_distinct_counts(spark):
    rnd = random.Random(1)
    data = [(rnd.choice("xyz"), rnd.choice([None, 1, 2, 3]), rnd.randint(0, 9)) for _ in range(200)]
    df = spark.createDataFrame(data, "g string, k int, v int")
    got = distinct.count_keys(df, ["g"], "k", {"low": F.col("v") < 2, "all": F.lit(True)})
    want = df.groupBy("g").agg(
        F.countDistinct(F.when(F.col("v") < 2, F.col("k"))).alias("low"), F.countDistinct("k").alias("all"))
    assert rows(got) == rows(want)


# -- sets -------------------------------------------------------------------------------------
@pytest.mark.parametrize("members, expected", [
    ([(1,)], [(2,)]), ([(1,), (None,)], []), ([], [(1,), (2,), (None,)]),
])
def test_not_in_null_rules(spark, members, expected):
    df = spark.createDataFrame([(1,), (2,), (None,)], "k int")
    keys = spark.createDataFrame(members, "k int")
    assert rows(sets.drop_members(df, keys, "k")) == sorted(expected, key=lambda r: (r[0] is None, str(r[0])))
    df.createOrReplaceTempView("probe_rows")
    keys.createOrReplaceTempView("key_rows")
    sql = spark.sql("select k from probe_rows where k not in (select k from key_rows)")
    assert rows(sets.drop_members(df, keys, "k")) == rows(sql)


def test_membership_and_outer(spark):
    df = spark.createDataFrame([(1,), (2,)], "k int")
    keys = spark.createDataFrame([(1,), (1,), (None,)], "k int")
    assert rows(sets.with_membership(df, keys, "k", "m")) == [(1, True), (2, False)]
    a = spark.createDataFrame([(1, None, 5), (2, "c", 6)], "k int, c string, x int")
    b = spark.createDataFrame([(1, None, 7), (3, "c", 8)], "k int, c string, y int")
    got = sets.outer_by_keys({"a": a, "b": b}, ["k", "c"], {"a": ["x"], "b": ["y"]})
    # NULL categories of both sides share a row, as after the regrouping of an outer join
    assert rows(got.select("k", "c", "x", "y")) == [(1, None, 5, 7), (2, "c", 6, None), (3, "c", None, 8)]


# -- ranges -----------------------------------------------------------------------------------
def test_scd2_bounds_gaps_and_open_end(spark):
    day = dt.date
    hist = spark.createDataFrame(
        [(1, "A", day(2021, 1, 1), day(2021, 1, 31)), (1, "B", day(2021, 3, 1), day(9999, 12, 31))],
        "k int, seg string, effective_begin date, effective_end date")
    probe = spark.createDataFrame(
        [(1, day(2021, 1, 1)), (1, day(2021, 1, 31)), (1, day(2021, 2, 1)), (1, day(2030, 1, 1)), (1, None)],
        "k int, d date")
    got = {r.d: r.seg for r in ranges.scd2_lookup(probe, hist, "k", F.col("d"), ["seg"]).collect()}
    assert got == {day(2021, 1, 1): "A", day(2021, 1, 31): "A", day(2021, 2, 1): None,
                   day(2030, 1, 1): "B", None: None}


def test_calendar_fill_skips_empty_spans(spark):
    df = spark.createDataFrame([(1, D0, D0 + dt.timedelta(2)), (2, D0, D0 - dt.timedelta(1))],
                               "k int, a date, b date")
    got = rows(ranges.calendar_fill(df, F.col("a"), F.col("b"), "d").select("k", "d"))
    assert got == [(1, D0 + dt.timedelta(i)) for i in range(3)]


@pytest.mark.parametrize("seed", range(4))
def test_uncovered_spells_equal_the_day_calendar(spark, seed):
    rnd, window, end = random.Random(seed), 5, D0 + dt.timedelta(60)
    data = []
    for k in range(6):
        days = sorted(rnd.sample(range(0, 58), rnd.randint(1, 9)))
        first = D0 + dt.timedelta(max(0, days[0] - (k % 2) * 3))
        data += [(k, D0 + dt.timedelta(d), first) for d in days]
    df = spark.createDataFrame(data, "k int, d date, f date")
    want = []
    for k in {r[0] for r in data}:
        covered = {r[1] + dt.timedelta(i) for r in data if r[0] == k for i in range(window)}
        first = min(r[2] for r in data if r[0] == k)
        free = [first + dt.timedelta(i) for i in range((end - first).days + 1)
                if first + dt.timedelta(i) not in covered]
        for d in free:
            if want and want[-1][0] == k and want[-1][2] == d - dt.timedelta(1):
                want[-1] = (k, want[-1][1], d)
            else:
                want.append((k, d, d))
    got = ranges.uncovered_spells(df, "k", "d", "f", as_date(end), window)
    assert rows(got.select("k", "spell_start", "spell_end")) == sorted(want)


# -- ranks ------------------------------------------------------------------------------------
@pytest.mark.parametrize("values", [[5, 5, 5, 1], [1], list(range(500)), [3] * 50 + list(range(20)),
                                    [-2, -1, 0, 1, None]])
def test_value_at_rank_is_exact(spark, values):
    df = spark.createDataFrame([(v,) for v in values], "v int")
    ordered = sorted((v for v in values if v is not None), reverse=True)
    for r in {1, len(ordered), max(1, round(0.2 * len(ordered)))}:
        rank = spark.range(1).select(F.lit(r).cast("long").alias("r"))
        for limit in (1, 100, 10**6):
            assert [x[0] for x in ranks.value_at_rank(df, "v", rank, limit).collect()] == [ordered[r - 1]]


def test_value_at_rank_beyond_the_rows_is_none(spark):
    df = spark.createDataFrame([(2**60 + i,) for i in range(9)] + [(None,)], "v long")
    for r, want in ((0, []), (1, [2**60 + 8]), (9, [2**60]), (10, [])):
        rank = spark.range(1).select(F.lit(r).cast("long").alias("r"))
        assert [x[0] for x in ranks.value_at_rank(df, "v", rank, 2).collect()] == want


def test_share_sums_to_one(spark):
    df = spark.createDataFrame([(1,), (3,), (4,)], "v int")
    assert sum(r.s for r in ranks.with_share(df, "v", "s").collect()) == pytest.approx(1.0)


# -- timeline ---------------------------------------------------------------------------------
def _brute_interval(clicks, pays):
    out = set()
    for k in {c[0] for c in clicks}:
        mine = sorted(c[1:] for c in clicks if c[0] == k)
        for i, (t, cid) in enumerate(mine):
            nxt = mine[i + 1][0] if i + 1 < len(mine) else dt.datetime(9999, 1, 1)
            out |= {(cid, p[2]) for p in pays if p[0] == k and t <= p[1] <= nxt}
    return out


def _brute_lookback(clicks, others):
    out = set()
    for k in {c[0] for c in clicks}:
        mine = sorted(c[1:] for c in clicks if c[0] == k)
        for i, (t, cid) in enumerate(mine):
            prev = mine[i - 1][0] if i else dt.datetime(1900, 1, 1)
            out |= {(cid, p[2]) for p in others if p[0] == k and prev <= p[1] <= t}
    return out


@pytest.mark.parametrize("seed", range(6))
@pytest.mark.parametrize("limit", [4, 1000])
def test_matches_equal_brute_force(spark, seed, limit):
    """Equal instants, slice borders, keys with only one side, a key with most rows."""
    rnd = random.Random(seed)
    key = lambda: rnd.choice([1, 1, 1, 2, 3])
    clicks = [(key(), at(30 * rnd.randint(0, 40)), i) for i in range(40)]
    others = [(key() if rnd.random() < 0.9 else 9, at(30 * rnd.randint(-3, 45)), 100 + i) for i in range(60)]
    a = spark.createDataFrame(clicks, "k int, c_at timestamp_ntz, cid int")
    b = spark.createDataFrame(others, "k int, p_at timestamp_ntz, pid int")
    near = timeline.with_neighbours(a, "k", "c_at", "cid", limit=limit)
    got = timeline.interval_match(near, b, "k", "c_at", "next_at", "p_at", ["cid"], limit)
    pairs = [(r.cid, r.pid) for r in got.collect()]
    assert len(pairs) == len(set(pairs)) and set(pairs) == _brute_interval(clicks, others)
    back = timeline.lookback_match(near, b, "k", "c_at", "last_at", "p_at", ["cid"], limit)
    pairs = [(r.cid, r.pid) for r in back.collect()]
    assert len(pairs) == len(set(pairs)) and set(pairs) == _brute_lookback(clicks, others)


def test_neighbours_cross_slices(spark):
    df = spark.createDataFrame([(1, at(0), 1), (1, at(10), 2), (1, at(200), 3)], "k int, t timestamp_ntz, id int")
    got = {r.id: (r.last_at, r.next_at) for r in timeline.with_neighbours(df, "k", "t", "id").collect()}
    assert got == {1: (None, at(10)), 2: (at(0), at(200)), 3: (at(10), None)}


def test_one_hot_hour_runs_in_slices(spark):
    """All events of a key lie in one hour, most in one minute: slices keep the limit, results are exact."""
    rnd = random.Random(2)
    times = [T0 + dt.timedelta(seconds=rnd.randint(0, 3599), microseconds=rnd.randint(0, 999_999)) for _ in range(200)]
    times += [T0 + dt.timedelta(minutes=30, microseconds=rnd.randint(0, 59_999_999)) for _ in range(400)]
    df = spark.createDataFrame([(1, t, i) for i, t in enumerate(times)], "k int, t timestamp_ntz, id int")
    sizes = [r["count"] for r in timeline.slices(df, "k", "t", 50).groupBy("_slice").count().collect()]
    assert sum(sizes) == 600 and max(sizes) <= 110 and len(sizes) >= 8
    ordered = sorted((t, i) for i, t in enumerate(times))
    want = {i: (ordered[n - 1][0] if n else None, ordered[n + 1][0] if n < 599 else None) for n, (t, i) in enumerate(ordered)}
    got = timeline.with_neighbours(df, "k", "t", "id", limit=50).collect()
    assert {r.id: (r.last_at, r.next_at) for r in got} == want


@pytest.mark.parametrize("limit", [2, 1000])
def test_asof_keeps_rows_without_key_or_anchor(spark, limit):
    probes = spark.createDataFrame([(1, at(5), "a"), (1, at(0), "b"), (None, at(5), "c"), (1, None, "d"), (2, at(9), "e"), (1, at(70), "f")],
                                   "k int, t timestamp_ntz, id string")
    marks = spark.createDataFrame([(1, at(1), 10), (1, at(5), 11), (None, at(1), 12), (3, at(1), 13)], "k int, m timestamp_ntz, mid int")
    got = timeline.asof(probes, marks, "k", "t", "m", ["mid"], limit=limit, outer=True)
    assert {r.id: r.mid for r in got.collect()} == {"a": 11, "b": None, "c": None, "d": None, "e": None, "f": 11}
    inner = timeline.asof(probes, marks, "k", "t", "m", ["mid"], limit=limit)
    assert {r.id: r.mid for r in inner.collect()} == {"a": 11, "f": 11}


def test_trailing_sum_has_closed_bounds(spark):
    day = lambda n: D0 + dt.timedelta(n)
    facts = spark.createDataFrame([(1, day(0), 5), (1, day(1), 7), (1, day(91), 11), (1, day(91), 1)],
                                  "k int, f date, v int")
    anchors = spark.createDataFrame([(1, day(91)), (1, day(92)), (1, day(93)), (2, day(5))], "k int, a date")
    got = timeline.trailing_sum_at(facts, anchors, "k", "f", "a", "v", 91, "s")
    assert rows(got) == [(1, day(91), 24), (1, day(92), 19), (1, day(93), 12), (2, day(5), None)]


# -- skew -------------------------------------------------------------------------------------
@pytest.mark.parametrize("how", ["inner", "left", "left_semi"])
def test_skew_join_equals_join(spark, how):
    rnd = random.Random(3)
    facts = spark.createDataFrame(
        [(7 if rnd.random() < 0.5 else rnd.randint(0, 400), i) for i in range(2000)] + [(None, -1)], "k int, v int")
    other = spark.createDataFrame([(k, k * 10) for k in range(0, 400, 2)] + [(7, 1), (7, 2)], "k int, w int")
    assert rows(skew.skew_join(facts, other, ["k"], how)) == rows(facts.join(other, "k", how))


def test_heavy_keys_have_enough_salts(spark):
    df = spark.createDataFrame([(1,)] * 60 + [(None,)] * 30 + [(i,) for i in range(2, 42)], "k int")
    for few in (100, 1):
        heavy, is_few = skew.heavy_keys(df, ["k"], 25, few)
        assert rows(heavy) == [(1, 3), (None, 2)] and is_few == (few > 1)
    assert skew.heavy_keys(df, ["k"], 60) == (None, True)


@pytest.mark.parametrize("how", ["inner", "left", "left_semi"])
@pytest.mark.parametrize("limit", [1, 40, 10_000])
def test_skew_join_with_heavy_and_null_keys_equals_join(spark, how, limit):
    """One key with 60 % of the rows, one just above the limit, many NULLs, repeated other rows."""
    facts = spark.createDataFrame(
        [(7, i) for i in range(600)] + [(8, i) for i in range(45)] + [(None, i) for i in range(200)]
        + [(i, i) for i in range(100, 255)], "k int, v int")
    other = spark.createDataFrame([(7, 1), (7, 2), (8, 3), (None, 4), (120, 5), (900, 6)], "k int, w int")
    assert rows(skew.skew_join(facts, other, ["k"], how, limit=limit)) == rows(facts.join(other, "k", how))


def test_outer_lookup_deals_null_and_heavy_keys(spark):
    """No task of the join gets much more than the limit, with broadcasts off."""
    facts = spark.createDataFrame([(None, i) for i in range(2000)] + [(1, i) for i in range(2000)], "k int, v int")
    names = spark.createDataFrame([(1, "a"), (2, "b")], "k int, name string")
    spark.conf.set("spark.sql.adaptive.enabled", "false")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        got = skew.outer_lookup(facts, names, "k", limit=100)
        sizes = [r["count"] for r in got.groupBy(F.spark_partition_id().alias("p")).count().collect()]
        assert "SortMergeJoin" in got._jdf.queryExecution().executedPlan().toString()
        assert rows(got) == rows(facts.join(names, "k", "left"))
    finally:
        spark.conf.set("spark.sql.adaptive.enabled", "true")
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")
    assert sum(sizes) == 4000 and max(sizes) < 1500


def test_hot_rows_are_spread(spark):
    facts = spark.createDataFrame([(1, i) for i in range(3000)], "k int, v int")
    other = spark.createDataFrame([(1, 5)], "k int, w int")
    spark.conf.set("spark.sql.adaptive.enabled", "false")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        joined = skew.skew_join(facts, other, ["k"], limit=100)
        sizes = [r["count"] for r in joined.groupBy(F.spark_partition_id()).count().collect()]
    finally:
        spark.conf.set("spark.sql.adaptive.enabled", "true")
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")
    assert sum(sizes) == 3000 and len(sizes) > 1 and max(sizes) < 3000


def test_not_first_rows(spark):
    df = spark.createDataFrame([(1, 5, 1), (1, 5, 2), (1, 9, 3), (2, 1, 4)], "k int, t int, id int")
    assert rows(skew.not_first_rows(df, "k", "t", "id")) == [(1, 5, 2), (1, 9, 3)]
