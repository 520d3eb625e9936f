"""Every named query: a pipeline on the stand-in tables with its stand-in parameters.

Function defaults are the reference's parameters; the values below fit the test data's time span
and code lists. All queries read whole tables.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tillscope.functions.dates import as_date
from tillscope.operators.ranges import calendar_fill
from tillscope.plans import (
    churn_model,
    clicks,
    cohorts,
    events,
    first_payments,
    gaps,
    growth,
    ledger,
    moments,
    pareto,
    persona,
    referrals,
    risk,
    seasonality,
    segments,
    trailing,
    trialists,
)
from tillscope.session import scratch, staged
from tillscope.sources import store
from tillscope.sources.standin import AS_OF, EVENTS_AS_OF, Standin

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}

COUNTRIES = [f"NATION_{i}" for i in range(20)]
# app-selected detail by its number in the stand-in log
APP_DETAILS = {"invoice": "15", "trx": "31", "reports": "47", "balance": "63",
               "customers": "79", "items": "95", "settings": "7", "support": "8"}


def register(build: Callable[[Standin], DataFrame]) -> Callable[[Standin], DataFrame]:
    """Adds `build` under its own name."""
    QUERIES[build.__name__] = lambda spark, root: build(Standin(spark, root))
    return build


# -- first payments ---------------------------------------------------------------------------
@register
def first_payment_from_fact(t):
    return first_payments.first_payment_from_fact(t.payments, t.users, "1995-01-20", AS_OF)


@register
def first_payment_from_log(t):
    return first_payments.first_payment_from_log(
        t.first_payment_log, t.users, "1995-01-20", AS_OF
    )


@register
def reconcile_sources(t):
    return first_payments.reconcile_sources(first_payment_from_fact(t), first_payment_from_log(t))


@register
def source_lag_distribution(t):
    return first_payments.source_lag_distribution(
        first_payment_from_fact(t), first_payment_from_log(t)
    )


# -- churn model ------------------------------------------------------------------------------
@register
def scoring_population(t):
    return churn_model.scoring_population(
        t.users, t.merchant_lifetime, "1995-05-15", COUNTRIES, ["en", "es"]
    )


@register
def training_population(t):
    return churn_model.training_population(
        t.daily_payments, t.users, t.line_facts, t.fee_facts, "1995-07-01", countries=None, min_payments=1,
        min_weeks_active=0.05,
    )


# -- cohorts ----------------------------------------------------------------------------------
@register
def cohort_churn_milestones(t):
    return cohorts.cohort_churn_milestones(
        t.sellers, t.lifetime, t.daily_payments, t.currency_segments, t.line_facts, 1995, AS_OF,
        countries=None,
    )


@register
def churn_spells(t):
    cohort = cohorts.cohort_of_year(t.sellers, t.lifetime, 1995, None)
    end = t.daily_payments.agg(F.max("paid_date")).scalar()
    return cohorts.churn_calendar(cohort, t.daily_payments, end, 91)


@register
def calendar_grid(t):
    """Dense seller days of the year's cohort, counted per month."""
    cohort = cohorts.cohort_of_year(t.sellers, t.lifetime, 1995, None)
    days = calendar_fill(cohort, F.col("first_date"), F.col("last_date"), "day")
    return days.groupBy(F.trunc("day", "MM").alias("month")).agg(
        F.count(F.lit(1)).alias("seller_days")
    )


# -- trailing volume --------------------------------------------------------------------------
@register
def trailing_share_filter(t):
    return trailing.trailing_share_filter(t.payments, AS_OF)


@register
def recent_active_keys(t):
    return trailing.recent_active_keys(t.revenue_summary, AS_OF)


@register
def qualifying_sellers(t):
    return trailing.qualifying_sellers(t.unit_payments, t.places)


@register
def trailing_91d_mix(t):
    return trailing.trailing_91d_mix(t.unit_payments, t.places, qualifying_sellers(t), AS_OF)


@register
def trailing_91d_mix_prior_year(t):
    return trailing.trailing_91d_mix_prior_year(t.unit_payments, t.places, qualifying_sellers(t), AS_OF)


@register
def mix_with_prior_year(t):
    return trailing.mix_with_prior_year(t.unit_payments, t.places, qualifying_sellers(t), AS_OF)


@register
def seller_tags(t):
    return segments.seller_tags(
        t.sellers, t.sales_book, t.closed_deals, t.deal_accounts, AS_OF,
        excluded_programs=["excluded"], excluded_owners=["owner_7"],
    )


@register
def seller_trailing_volumes(t):
    return trailing.seller_trailing_volumes(seller_tags(t), t.sellers, t.revenue_summary, AS_OF)


@register
def exclusive_large_sellers(t):
    funnel = t.sellers.join(t.signups, "seller_id")
    return trailing.exclusive_large_sellers(
        seller_trailing_volumes(t), funnel, t.revenue_summary, AS_OF, countries=None,
        min_volume=1_000_000,
    )


@register
def product_share(t):
    return trailing.product_share(t.revenue_summary)


# -- event families and logs ------------------------------------------------------------------
@register
def event_table_schema(t):
    return events.event_table(t.event_log)


@register
def classify_onboard_web(t):
    return events.classify_family(t.event_log, "onboard web")


@register
def classify_dashboard(t):
    return events.classify_family(t.event_log, "dashboard")


@register
def classify_onboard_app(t):
    return events.classify_family(t.event_log, "onboard app")


@register
def classify_app(t):
    return events.classify_family(t.event_log, "app")


@register
def option_click_conversion(t):
    return events.option_click_conversion(
        t.page_clicks, t.merchant_summary, EVENTS_AS_OF, "Signup", "reader_option_selected",
    )


@register
def log_text_search(t):
    return events.log_text_search(t.query_log, "user_3", "charset", "2023-01-10")


@register
def log_usage_rollup(t):
    return events.log_usage_rollup(t.query_log, "<nav", "2023-12-01")


@register
def parse_click_text(t):
    return events.parse_click_text(t.click_text)


# -- clicks and payments ----------------------------------------------------------------------
@register
def itemized_payment_master(t):
    return clicks.itemized_payment_master(
        t.counter_payments, t.counter_lines, t.sellers, "2024-01-02"
    )


@register
def click_payment_match(t):
    return clicks.click_payment_match(parse_click_text(t), itemized_payment_master(t))


@register
def lookback_event_counts(t):
    return clicks.lookback_event_counts(click_payment_match(t), parse_click_text(t), 1440)


@register
def click_behaviour_rates(t):
    return clicks.click_behaviour_rates(
        lookback_event_counts(t), t.users, t.merchant_signups, "2024-01-05", "2024-01-25", COUNTRIES,
        new_days=10_450, days=21,
    )


@register
def amount_roundness_rates(t):
    return clicks.amount_roundness_rates(
        lookback_event_counts(t), itemized_payment_master(t), "2024-01-02", "2024-01-30",
        COUNTRIES, ["NATION_7"], ["BUILDING"],
    )


# -- gaps -------------------------------------------------------------------------------------
@register
def adoption_windows(t):
    date = F.col("activation_date")
    activated = (
        t.signups.filter((date >= as_date("1995-01-01")) & (date < as_date("1996-01-01")))
        .join(t.sellers.select("seller_id", "category", "num_units"), "seller_id")
        .select("seller_id", date.alias("activated_date"), "num_units", "category")
    )
    return gaps.adoption_windows(t.unit_payments, t.places, activated)


@register
def active_day_grid(t):
    return gaps.active_day_grid(t.unit_daily, t.places, 1999, "2000-05-01")


@register
def gap_churn_flags(t):
    return gaps.gap_churn_flags(active_day_grid(t), 1999)


@register
def gap_churn_validated(t):
    return gaps.gap_churn_validated(
        gap_churn_flags(t), t.lifetime, t.unit_payments, t.places, 1999
    )


@register
def gap_churn_run_rate(t):
    return gaps.gap_churn_run_rate(gap_churn_validated(t), t.lifetime, t.revenue_summary)


# -- ledger and growth ------------------------------------------------------------------------
@register
def grant_vs_usage(t):
    return ledger.grant_vs_usage(t.balance_changes, "1996-01-01")


@register
def growth_accounting_monthly(t):
    return growth.growth_accounting_monthly(
        t.revenue_summary, t.sellers, t.payment_adoptions, t.segment_history,
        load_since="1995-10-15", report_since="1996-01-01",
    )


@register
def growth_accounting_trailing28(t):
    return growth.growth_accounting_trailing28(
        t.rolling_cohort, t.payment_adoptions, load_since="1995-10-01",
        report_since="1996-01-01",
    )


# -- referrals --------------------------------------------------------------------------------
@register
def cases_by_pair(t):
    return referrals.cases_by_pair(t.referrals, t.support_cases, t.case_labels, "1995-02-01")


@register
def cases_per_pair(t):
    return referrals.cases_per_pair(cases_by_pair(t))


@register
def referral_spine(t):
    return referrals.referral_spine(t.sellers, t.signups, t.lifetime, t.referrals)


@register
def exposure_referral_rates(t):
    return referrals.exposure_referral_rates(referral_spine(t), t.touchpoints, "1995-03-01")


@register
def referral_quality_by_point(t):
    return referrals.referral_quality_by_point(referral_spine(t))


# -- moments ----------------------------------------------------------------------------------
@register
def moment_any_post(t):
    return moments.any_post(t.community_events)


@register
def moment_thread_opener(t):
    return moments.thread_opener(t.community_events)


@register
def moment_commenter(t):
    return moments.commenter(t.community_events)


@register
def moment_best_answer(t):
    return moments.best_answer(t.community_events)


@register
def moment_survey_score(t):
    return moments.survey_score(t.scored_replies)


@register
def moment_brand_nps(t):
    return moments.brand_nps(t.scored_replies)


@register
def moment_manager_nps(t):
    return moments.manager_nps(
        t.scored_replies, t.reply_opportunities, t.reply_activities, t.users
    )


@register
def moment_support_csat(t):
    return moments.support_csat(t.support_cases, t.surveys, t.queues, t.users, "org_1")


@register
def moment_beta(t):
    return moments.beta_start(t.beta_starts, t.beta_programs)


@register
def moment_prompt_click(t):
    return moments.prompt_click(t.event_log, t.users, "Review Prompt: Rate Now")


@register
def moment_prompt_show_raw(t):
    return moments.prompt_show_raw(t.event_log, "Reports", "app_ios", "2024-01-03")


@register
def moment_prompt_show(t):
    return moments.prompt_show(moment_prompt_show_raw(t), t.users)


@register
def moment_segment_upgrade(t):
    return moments.segment_upgrade(t.segment_history)


@register
def cumulative_customers(t):
    return moments.cumulative_customers(
        referral_spine(t), t.unit_card_payments, t.places, "1995-01-15"
    )


@register
def moment_customer_milestone(t):
    return moments.customer_milestone(cumulative_customers(t), 20)


@register
def moment_repeat_milestone(t):
    return moments.repeat_milestone(cumulative_customers(t))


@register
def moment_second_employee(t):
    return moments.second_child(t.employees, "person_id", "row_id")


@register
def moment_second_location(t):
    return moments.second_child(t.locations, "location_id", "location_id")


@register
def moment_other_hardware(t):
    return moments.other_hardware(
        t.hardware_lines, t.hardware_owners, t.hardware_products, t.device_touches, t.users,
        "ring",
    )


@register
def moment_product_attach(t):
    return moments.product_attach(t.adoptions)


@register
def moment_second_deposit(t):
    return moments.second_deposit(t.deposits, t.users, 10_000_000)


@register
def moment_all(t):
    """The journey: all moments stacked. Sources with several moments are read once for all of them."""
    steps = (
        moment_support_csat, moment_beta, moment_segment_upgrade, moment_second_employee,
        moment_second_location, moment_other_hardware, moment_product_attach,
        moment_second_deposit,
    )
    shared = (
        moments.community_moments(t.community_events),
        moments.reply_moments(
            t.scored_replies, t.reply_opportunities, t.reply_activities, t.users
        ),
        moments.prompt_moments(
            t.event_log, t.users, "Review Prompt: Rate Now", "Reports", "app_ios", "2024-01-03"
        ),
        moments.customer_moments(cumulative_customers(t), 20),
    )
    out = moments.stack_moments({f.__name__.removeprefix("moment_"): f(t) for f in steps})
    for part in shared:
        out = out.unionByName(part)
    return out


# -- segments ---------------------------------------------------------------------------------
@register
def seller_features(t):
    population = staged(qualifying_sellers(t))
    mix = trailing.mix_with_prior_year(t.unit_payments, t.places, population, AS_OF)
    return segments.seller_features(
        population, t.lifetime, t.sellers, mix, t.revenue_summary, AS_OF
    )


@register
def seller_features_plus(t):
    return segments.seller_features_plus(
        seller_features(t), t.product_history, t.employees, t.locations, t.segment_history,
        t.sellers,
    )


@register
def mix_bands(t):
    return segments.mix_bands(
        seller_features_plus(t), t.segment_history, AS_OF, young_days=800,
        in_person=["FURNITURE", "HOUSEHOLD"], remote=["BUILDING"],
    )


@register
def segment_label(t):
    return segments.segment_label(mix_bands(t), t.sellers)


# -- stored tables ----------------------------------------------------------------------------
@register
def stored_monthly_volume(t):
    """A table that is replaced twice; readers see the last one."""
    base, rows = scratch(t.spark), monthly_product_volume(t)
    store.replace(rows.limit(0), base)
    return store.replace(rows, base)


@register
def stored_prompt_show(t):
    """The prompt events, stored by user and then replaced by a query that reads them."""
    base = scratch(t.spark)
    store.replace(moment_prompt_show_raw(t), base)
    return store.replace_by(t.spark, base, lambda raw: moments.prompt_show(raw, t.users))


@register
def stored_event_families(t):
    """The event table filled by one insert per family; a repeated insert adds nothing."""
    base = scratch(t.spark)
    families = {"onboard web": classify_onboard_web, "dashboard": classify_dashboard,
                "onboard app": classify_onboard_app, "app": classify_app}
    for name, family in families.items():
        store.append(family(t), base, name)
    return store.append(classify_dashboard(t), base, "dashboard")


# -- risk -------------------------------------------------------------------------------------
@register
def exclusive_churned_sellers(t):
    return risk.exclusive_churned_sellers(t.revenue_summary, t.sellers, AS_OF, "2001-01-01")


def _unit_created(t):
    return t.users.filter("user_type = 'UNIT'").select(
        F.col("user_id").alias("seller_id"), "created_date"
    )


@register
def churned_with_risk_history(t):
    return risk.churned_with_risk_history(
        staged(exclusive_churned_sellers(t)), _unit_created(t), t.payment_adoptions, t.segment_history,
        t.risk_cases, t.chargebacks, "2001-01-01", days=120,
    )


@register
def churned_case_rows(t):
    return risk.case_rows(t.risk_cases, staged(exclusive_churned_sellers(t)), days=120)


# -- seasonality and concentration ------------------------------------------------------------
def _years(t):
    months = seasonality.monthly_activity(t.all_daily, t.all_sellers, t.all_lifetime, AS_OF)
    return seasonality.yearly_shape(months)


@register
def seasonality_tag(t):
    return seasonality.seasonality_tag(_years(t), AS_OF)


@register
def seasonal_repetition(t):
    return seasonality.repetition(_years(t))


@register
def monthly_product_volume(t):
    return pareto.monthly_product_volume(t.line_facts, t.sellers, "1996-03-20")


@register
def top_fraction_share(t):
    return pareto.top_fraction_share(monthly_product_volume(t), 2000)


# -- persona ----------------------------------------------------------------------------------
@register
def persona_targets(t):
    return persona.persona_targets(
        t.intents, t.revenue_summary, "1994-12-15", "1996-01-01", "primary",
        small_unit_country="NATION_7", min_small_unit=50_000_000, min_volume=20_000_000,
    )


@register
def persona_attributes(t):
    return persona.persona_attributes(
        persona_targets(t), t.sellers, t.signups, t.referrals, t.account_history
    )


@register
def persona_payment_summary(t):
    return persona.persona_payment_summary(staged(persona_attributes(t)), t.payments, "1995-06-01")


@register
def persona_highest_segment(t):
    return persona.persona_highest_segment(persona_payment_summary(t), t.segment_history)


@register
def persona_repeat_cards(t):
    return persona.persona_repeat_cards(
        staged(persona_attributes(t)), t.unit_card_payments, t.places, "1995-06-01"
    )


@register
def persona_saas_usage(t):
    return persona.persona_saas_usage(staged(persona_attributes(t)), t.software_adoptions)


@register
def persona_payment_products(t):
    return persona.persona_payment_products(staged(persona_attributes(t)), t.payment_adoptions)


@register
def persona_employees(t):
    return persona.persona_employees(t.employees)


@register
def persona_app_visits(t):
    return persona.persona_app_visits(
        staged(persona_attributes(t)), t.unit_event_log, t.places, "2024-01-02", "Applet Selected", APP_DETAILS
    )


@register
def persona_final(t):
    # the attribute table is read by every other table: stored once
    base = staged(persona_attributes(t))
    return persona.persona_final(
        base,
        persona.persona_repeat_cards(base, t.unit_card_payments, t.places, "1995-06-01"),
        persona.persona_highest_segment(base, t.segment_history),
        persona.persona_employees(t.employees),
        persona.persona_payment_summary(base, t.payments, "1995-06-01"),
        persona.persona_saas_usage(base, t.software_adoptions),
        persona.persona_payment_products(base, t.payment_adoptions),
        persona.persona_app_visits(
            base, t.unit_event_log, t.places, "2024-01-02", "Applet Selected", APP_DETAILS
        ),
    )


# -- trialists --------------------------------------------------------------------------------
@register
def attachment_sequences(t):
    return trialists.attachment_sequences(t.placements, t.adoptions, AS_OF)


@register
def trialist_stats(t):
    return trialists.trialist_stats(t.placements, t.sellers, t.signups, t.product_daily, AS_OF)


@register
def trialist_profile(t):
    return trialists.trialist_profile(trialist_stats(t), 2_000_000)


@register
def trialist_by_category(t):
    return trialists.trialist_by_category(trialist_stats(t), 2_000_000)


@register
def trialist_referrals(t):
    return trialists.trialist_referrals(trialist_stats(t), t.referrals, 2_000_000)


@register
def trialist_contacts(t):
    return trialists.trialist_contacts(staged(trialist_stats(t)), t.contacts)


@register
def trialist_contact_reasons(t):
    return trialists.trialist_contact_reasons(trialist_contacts(t), 2_000_000)


@register
def trialist_channels(t):
    return trialists.trialist_channels(trialist_stats(t), t.attributions, COUNTRIES)
