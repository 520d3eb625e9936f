"""Moments of a seller's journey: uniform (seller_id, ts, id) tables.

Every function returns the same three columns (ts TIMESTAMP_NTZ, id STRING), so moments can be
stacked under a name column.
"""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tillscope.functions.dates import NEVER, as_date, days_between
from tillscope.functions.exprs import count_where, min_if, one_of
from tillscope.operators.keyed import (
    ascending,
    first_per_key,
    nth_per_key,
    nth_value,
    top_per_key,
)
from tillscope.operators.hierarchy import links, roll_up, to_merchant
from tillscope.operators.skew import not_first_rows, outer_lookup, skew_join
from tillscope.operators.timeline import running_by_day
from tillscope.session import staged

# Event types that author something in a thread.
AUTHORED = ("thread_authored", "comment_authored", "best_answer_authored", "marked_best_answer")


def _moment(seller: Column, ts: Column, ident: Column) -> list[Column]:
    return [
        seller.alias("seller_id"), ts.cast("timestamp_ntz").alias("ts"),
        ident.cast("string").alias("id"),
    ]


def stack_moments(moments: Mapping[str, DataFrame]) -> DataFrame:
    """All moments in one table with their name."""
    out = None
    for name, df in moments.items():
        part = df.select(F.lit(name).alias("moment"), "seller_id", "ts", "id")
        out = part if out is None else out.unionByName(part)
    return out


def tag_moments(df: DataFrame, rules: Mapping[str, tuple[Column, Column, Column, Column]]) -> DataFrame:
    """Several moments from one pass: each row gives one row per rule that it meets. A rule is its
    condition, the seller, the instant and the id."""
    hits = [
        F.when(test, F.struct(F.lit(name).alias("moment"), *_moment(seller, ts, ident)))
        for name, (test, seller, ts, ident) in rules.items()
    ]
    return df.select(F.explode(F.array_compact(F.array(*hits))).alias("_m")).select("_m.*")


# -- community ------------------------------------------------------------------------------
def community_moments(posts: DataFrame) -> DataFrame:
    """The four moments of the community from one scan: each post meets the first authoring event of
    its thread once."""
    at = F.struct(F.col("created_at").alias("a"), F.col("turn").alias("t"))
    first = _authored(posts).groupBy("thread_id").agg(F.min(at).alias("_first"))
    kind = F.col("event_type")
    seen = staged(
        skew_join(posts.select("seller_id", "thread_id", "event_type", "created_at", "turn"), first, ["thread_id"], "left")
        .select(
            "seller_id", "thread_id", "created_at",
            F.when(one_of(kind, AUTHORED), kind).alias("kind"), (at > F.col("_first")).alias("later"),
        )
    )
    who, ts, ident = F.col("seller_id"), F.col("created_at"), F.col("thread_id")
    kind, later = F.col("kind"), F.col("later")
    tagged = tag_moments(seen, {
        "any_post": (F.lit(True), who, ts, ident),
        "thread_opener": (one_of(kind, AUTHORED[:2]) & ~later, who, ts, ident),
        "commenter": ((kind == AUTHORED[1]) & later, who, ts, ident),
    })
    best = seen.filter(one_of(kind, AUTHORED[2:]) & later).groupBy("seller_id", "thread_id").agg(
        F.min("created_at").alias("created_at")
    )
    return tagged.unionByName(stack_moments({"best_answer": any_post(best)}))


def any_post(posts: DataFrame) -> DataFrame:
    return posts.select(*_moment(F.col("seller_id"), F.col("created_at"), F.col("thread_id")))


def _authored(posts: DataFrame) -> DataFrame:
    return posts.filter(one_of(F.col("event_type"), AUTHORED))


def thread_opener(posts: DataFrame) -> DataFrame:
    """First authoring event of each thread, if it is a thread or a comment."""
    first = first_per_key(_authored(posts), ["thread_id"], ascending("created_at", "turn"))
    return any_post(first.filter(one_of(F.col("event_type"), AUTHORED[:2])))


def commenter(posts: DataFrame) -> DataFrame:
    """Comments that are not the first authoring event of their thread."""
    later = not_first_rows(_authored(posts), "thread_id", "created_at", "turn")
    return any_post(later.filter(F.col("event_type") == AUTHORED[1]))


def best_answer(posts: DataFrame) -> DataFrame:
    """First best-answer event per seller and thread, the opener excluded."""
    later = not_first_rows(_authored(posts), "thread_id", "created_at", "turn")
    return any_post(
        later.filter(one_of(F.col("event_type"), AUTHORED[2:]))
        .groupBy("seller_id", "thread_id")
        .agg(F.min("created_at").alias("created_at"))
    )


# -- scores ---------------------------------------------------------------------------------
def survey_score(replies: DataFrame, minimum: int = 6, seconds: str = ":00") -> DataFrame:
    """Replies with a high score; the instant is text without seconds."""
    at = F.concat("replied_text", F.lit(seconds)).cast("timestamp_ntz")
    return replies.filter(F.col("score") >= minimum).select(
        *_moment(F.col("contact_id"), at, F.col("reply_id"))
    )


def brand_nps(replies: DataFrame, minimum: int = 9) -> DataFrame:
    return survey_score(replies, minimum, seconds="")


def manager_nps(
    replies: DataFrame, opportunities: DataFrame, activities: DataFrame, users: DataFrame,
    minimum: int = 9,
) -> DataFrame:
    """The seller is the first known of opportunity, activity and the reply's own link."""
    op = opportunities.select(F.col("opportunity_id").alias("link_id"),
                              F.col("merchant_id").alias("op_seller"))
    act = activities.select(F.col("task_id").alias("link_id"),
                            F.col("merchant_id").alias("act_seller"))
    linked = (
        replies.filter(F.col("score") >= minimum)
        .join(op, "link_id", "left")
        .join(act, "link_id", "left")
        .withColumn("user_id", F.coalesce("op_seller", "act_seller", "link_id"))
    )
    return to_merchant(linked, users, "user_id").select(
        *_moment(F.col("merchant_id"), F.col("replied_at"), F.col("reply_id"))
    )


def reply_moments(
    replies: DataFrame, opportunities: DataFrame, activities: DataFrame, users: DataFrame,
    good: int = 6, best: int = 9,
) -> DataFrame:
    """The three score moments from one scan; only the best replies look up their seller."""
    score = F.col("score")
    top = score >= best
    op = opportunities.select(F.col("opportunity_id").alias("_link"),
                              F.col("merchant_id").alias("op_seller"))
    act = activities.select(F.col("task_id").alias("_link"),
                            F.col("merchant_id").alias("act_seller"))
    rows = replies.filter(score >= min(good, best)).withColumn("_link", F.when(top, F.col("link_id")))
    linked = outer_lookup(outer_lookup(rows, op, "_link", None), act, "_link", None).withColumn(
        "_user", F.when(top, F.coalesce("op_seller", "act_seller", "link_id"))
    )
    text, ident = F.col("replied_text"), F.col("reply_id")
    return tag_moments(to_merchant(linked, users, "_user", limit=None), {
        "survey_score": (score >= good, F.col("contact_id"),
                         F.concat(text, F.lit(":00")).cast("timestamp_ntz"), ident),
        "brand_nps": (top, F.col("contact_id"), text.cast("timestamp_ntz"), ident),
        "manager_nps": (top, F.col("merchant_id"), F.col("replied_at"), ident),
    })


def support_csat(
    cases: DataFrame, surveys: DataFrame, queues: DataFrame, users: DataFrame, organization: str,
    minimum: int = 6,
) -> DataFrame:
    """Well-rated cases of one organisation; only the best survey row of a case counts.

    Both dimension tests sit in the final filter of the source, so these joins are inner.
    """
    rated = surveys.filter((F.col("rank") == 1) & (F.col("score") >= minimum)).select("case_id")
    asked = queues.filter(F.col("organization") == organization).select("queue_id")
    good = cases.join(rated, "case_id").join(asked, "queue_id")
    return to_merchant(good, users, "seller_id").select(
        *_moment(F.col("merchant_id"), F.col("created_at"), F.col("case_id"))
    )


# -- product and prompts --------------------------------------------------------------------
def beta_start(starts: DataFrame, programs: DataFrame) -> DataFrame:
    return starts.join(programs.select("feature_id"), "feature_id").select(
        *_moment(F.col("seller_id"), F.col("started_date"), F.concat("seller_id", "feature_id"))
    )


def prompt_click(log: DataFrame, users: DataFrame, text: str) -> DataFrame:
    hits = log.filter(F.col("text") == text).withColumn("user", F.col("user_id").cast("long"))
    return to_merchant(hits, users, "user").select(
        *_moment(F.col("merchant_id"), F.col("recorded_at"), F.col("event_id"))
    )


def prompt_show_raw(log: DataFrame, text: str, app: str, since) -> DataFrame:
    """Prompt-shown events still keyed by the user."""
    return log.filter(
        (F.col("name") == "Action") & (F.col("text") == text) & (F.col("app") == app)
        & (F.col("recorded_at").cast("date") >= as_date(since))
    ).select("user_id", F.col("recorded_at").alias("ts"), F.col("event_id").alias("id"))


def prompt_show(raw: DataFrame, users: DataFrame) -> DataFrame:
    """The same events keyed by merchant."""
    keyed = raw.withColumn("user", F.col("user_id").cast("long"))
    return to_merchant(keyed, users, "user").select(
        *_moment(F.col("merchant_id"), F.col("ts"), F.col("id"))
    )


def prompt_moments(
    log: DataFrame, users: DataFrame, click_text: str, show_text: str, app: str, since
) -> DataFrame:
    """Both prompt moments from one scan of the log and one lookup of its users."""
    click = F.col("text") == click_text
    show = (
        (F.col("name") == "Action") & (F.col("text") == show_text) & (F.col("app") == app)
        & (F.col("recorded_at").cast("date") >= as_date(since))
    )
    hits = log.filter(click | show).withColumn("user", F.col("user_id").cast("long"))
    each = (F.col("merchant_id"), F.col("recorded_at"), F.col("event_id"))
    return tag_moments(
        to_merchant(hits, users, "user"),
        {"prompt_click": (click, *each), "prompt_show": (show, *each)},
    )


def segment_upgrade(
    segments: DataFrame, low: str = "Micro",
    higher: Sequence[str] = ("SMB", "Mid-Market", "Enterprise"),
) -> DataFrame:
    """Begin of the first range in the lowest segment that is followed by a higher one."""
    w = Window.partitionBy("seller_id", "currency").orderBy("effective_begin")
    begin = F.col("effective_begin")
    grown = (
        segments.withColumn("_next", F.lead("segment").over(w))
        .filter((F.col("segment") == low) & one_of(F.col("_next"), higher))
        .groupBy("seller_id")
        .agg(F.min("effective_begin").alias("effective_begin"))
    )
    return grown.select(*_moment(F.col("seller_id"), begin, F.concat("seller_id", begin)))


# -- customers ------------------------------------------------------------------------------
def cumulative_customers(
    spine: DataFrame, card_payments: DataFrame, users: DataFrame, since
) -> DataFrame:
    """Per merchant and day: customers and payments of its units so far, at the day's last payment.

    A card that pays at several units of a merchant is one customer.

    A customer counts on the day of its first payment (payments without a card share one), so
    running totals over daily sums give the same numbers as running over single payments, and
    the per-seller window is bounded by the calendar. A seller with several spine rows has its
    payments repeated once per row, as in the reference.
    """
    start = as_date(since).cast("timestamp_ntz")
    who = staged(
        spine.filter(
            (F.col("first_payment_at") >= start) & (F.col("activation_date") != F.lit(NEVER))
        )
        .groupBy("seller_id")
        .agg(F.count(F.lit(1)).alias("_times"), F.min("first_payment_at").alias("_first"))
    )
    per_card_day = roll_up(
        card_payments.filter((F.col("paid_date") >= as_date(since)) & (F.col("is_gpv") == 1)),
        users, "unit_id", ["card_id", "paid_date"], {"n": (F.count(F.lit(1)), F.sum)},
    )
    # a card has one row per day, so its window is bounded by the calendar as well
    card_start = F.min("paid_date").over(Window.partitionBy("seller_id", "card_id"))
    daily = (
        per_card_day.withColumn("_start", card_start)
        .groupBy("seller_id", "paid_date")
        .agg(
            F.sum("n").alias("payments"),
            count_where(F.col("_start") == F.col("paid_date")).alias("customers"),
        )
    )
    running = running_by_day(daily, "seller_id", "paid_date", ["customers", "payments"])
    return running.join(who, "seller_id").select(
        "seller_id",
        "paid_date",
        days_between(F.col("_first"), F.col("paid_date")).alias("days_to_payment"),
        F.col("customers").alias("cum_customers"),
        (F.col("payments") * F.col("_times")).alias("cum_payments"),
    )


def _first_day(cumulative: DataFrame, reached: Column) -> DataFrame:
    day = F.col("day")
    first = cumulative.filter(reached).groupBy("seller_id").agg(F.min("paid_date").alias("day"))
    return first.select(*_moment(F.col("seller_id"), day, F.concat("seller_id", day)))


def customer_milestone(cumulative: DataFrame, more_than: int = 350) -> DataFrame:
    return _first_day(cumulative, F.col("cum_customers") > more_than)


def repeat_milestone(cumulative: DataFrame, more_than: float = 0.27) -> DataFrame:
    repeats = F.col("cum_payments") - F.col("cum_customers")
    return _first_day(cumulative, repeats / F.col("cum_payments") > more_than)


def customer_moments(
    cumulative: DataFrame, customers: int = 350, repeats: float = 0.27
) -> DataFrame:
    """Both milestones from one pass over the running counts."""
    again = (F.col("cum_payments") - F.col("cum_customers")) / F.col("cum_payments")
    days = cumulative.groupBy("seller_id").agg(
        min_if(F.col("cum_customers") > customers, F.col("paid_date")).alias("many"),
        min_if(again > repeats, F.col("paid_date")).alias("loyal"),
    )
    seller, many, loyal = F.col("seller_id"), F.col("many"), F.col("loyal")
    return tag_moments(days, {
        "customer_milestone": (many.isNotNull(), seller, many, F.concat(seller, many)),
        "repeat_milestone": (loyal.isNotNull(), seller, loyal, F.concat(seller, loyal)),
    })


# -- growth of the business -----------------------------------------------------------------
def second_child(children: DataFrame, item: str, unique: str, n: int = 2) -> DataFrame:
    """Instant of the n-th child with an id; every merchant is kept, NULL if it has fewer."""
    nth = nth_value(
        children.filter(F.col(item).isNotNull()), "merchant_id", "created_at", [unique], n, "ts"
    )
    return nth.select(
        *_moment(F.col("merchant_id"), F.col("ts"), F.concat("merchant_id", "ts"))
    )


def other_hardware(
    orders: DataFrame, owners: DataFrame, products: DataFrame, touches: DataFrame,
    users: DataFrame, basic: str,
) -> DataFrame:
    """First device that is not a basic one, from orders and touchpoints; NULL if none.

    Orders are reduced to one row per buyer before the owner lookup.
    """
    other = ~F.col("product").ilike(f"%{basic}%")
    bought = (
        orders.filter(F.col("state") == "complete")
        .join(products, "sku", "left")
        .groupBy("order_user_id")
        .agg(min_if(other, F.col("completed_date")).alias("at"))
        .join(owners, "order_user_id")
        .select("seller_id", "at")
    )
    touched = touches.groupBy("seller_id").agg(min_if(other, F.col("created_date")).alias("at"))
    both = bought.unionByName(touched).groupBy("seller_id").agg(F.min("at").alias("at"))
    per_merchant = both.join(links(users, "seller_id", "merchant_id"), "seller_id").groupBy("merchant_id").agg(
        F.min("at").alias("at")
    )
    return per_merchant.select(
        *_moment(F.col("merchant_id"), F.col("at"), F.concat("merchant_id", "at"))
    )


def product_attach(adoptions: DataFrame, core: Sequence[str] = ("pos", "terminal")) -> DataFrame:
    """First product outside the core set, for sellers that use the core set."""
    is_core = one_of(F.col("product"), core)
    first = adoptions.groupBy("seller_id").agg(
        min_if(~is_core, F.col("first_date")).alias("at"),
        F.max(F.when(is_core, 1)).alias("_core"),
    )
    at = F.col("at")
    return first.filter(at.isNotNull() & F.col("_core").isNotNull()).select(
        *_moment(F.col("seller_id"), at, F.concat("seller_id", at))
    )


def second_deposit(deposits: DataFrame, users: DataFrame, more_than: int = 100) -> DataFrame:
    """Second successful deposit over an amount, per merchant."""
    good = deposits.filter((F.col("is_successful") == 1) & (F.col("amount") > more_than))
    order = ascending("attempted_at", "deposit_id")
    # a merchant's second deposit is among the first two of one of its units
    per_unit = top_per_key(good, ["seller_id"], order, 2)
    nth = nth_per_key(
        to_merchant(per_unit, users, "seller_id", limit=None), ["merchant_id"], order, 2
    )
    at = F.col("attempted_at")
    return nth.select(*_moment(F.col("merchant_id"), at, F.concat("merchant_id", at)))
