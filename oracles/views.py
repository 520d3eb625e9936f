"""DuckDB text of the logical tables, written independently of the Spark side."""

from __future__ import annotations

VIEWS: dict[str, tuple[tuple[str, ...], str]] = {}


def view(name: str, needs: str, sql: str) -> None:
    VIEWS[name] = (tuple(needs.split()), sql)


def query(needs: str, sql: str) -> str:
    """Full statement: the needed views in dependency order, then the query.

    `sql` may start with its own WITH list.
    """
    order: list[str] = []

    def visit(name: str) -> None:
        for dep in VIEWS[name][0]:
            visit(dep)
        if name not in order:
            order.append(name)

    for name in needs.split():
        visit(name)
    head = ",\n".join(f"{n} AS ({VIEWS[n][1]})" for n in order)
    body = sql.strip()
    if body[:5].lower() == "with ":
        return f"WITH {head},\n{body[5:]}"
    return f"WITH {head}\n{body}"


def _list(values: str) -> str:
    return "[" + ", ".join(f"'{v}'" for v in values.split("|")) + "]"


view("payments", "", """
SELECT o_orderkey AS payment_id, o_custkey AS seller_id,
  o_orderdate + to_seconds(o_orderkey % 86400) AS paid_at, CAST(o_orderdate AS DATE) AS paid_date,
  CAST(floor(o_totalprice * 100 + 0.5) AS BIGINT) AS amount,
  CASE o_orderpriority WHEN '1-URGENT' THEN 'terminal' WHEN '2-HIGH' THEN 'pos'
    WHEN '3-MEDIUM' THEN 'virtual' WHEN '4-NOT SPECIFIED' THEN 'invoice' ELSE 'online' END AS product,
  CASE WHEN o_orderkey % 8 = 0 THEN NULL ELSE 'reader_' || (o_orderkey % 8) END AS reader,
  CASE WHEN o_orderkey % 8 <> 0 AND o_orderstatus <> 'O' THEN 1 ELSE 0 END AS is_card_present,
  CAST(o_orderkey % 2 AS INT) AS is_itemized,
  CASE WHEN o_orderstatus = 'P' THEN 1 ELSE 0 END AS is_refunded,
  CASE WHEN o_orderkey % 10 <> 0 THEN 1 ELSE 0 END AS is_gpv,
  CASE WHEN o_orderkey % 7 <> 0 THEN 1 ELSE 0 END AS is_card_payment,
  CASE o_orderkey % 3 WHEN 0 THEN 'DEBIT' WHEN 1 THEN 'CREDIT' END AS tender,
  CASE WHEN o_custkey % 5 = 0 THEN 'EUR' ELSE 'USD' END AS currency,
  o_orderstatus AS entry_method
FROM orders""")
view("lifetime", "payments", """
SELECT seller_id, min(paid_at) AS first_at, max(paid_at) AS last_at, min(paid_date) AS first_date,
  max(paid_date) AS last_date, count(*) AS payment_count FROM payments GROUP BY 1""")
view("daily_payments", "payments", """
SELECT seller_id, paid_date, count(*) AS payment_count,
  CAST(sum(is_card_payment) AS BIGINT) AS card_count, CAST(sum(is_gpv) AS BIGINT) AS gpv_count,
  CAST(sum(1 - is_card_present) AS BIGINT) AS cnp_count, CAST(sum(amount) AS BIGINT) AS amount,
  CAST(sum(CASE WHEN is_card_present = 0 THEN amount ELSE 0 END) AS BIGINT) AS cnp_amount
FROM payments GROUP BY 1, 2""")
view("product_daily", "payments", """
SELECT seller_id, product, CASE WHEN is_card_present = 1 THEN 'CP' ELSE 'CNP' END AS card_presence,
  reader, paid_date AS report_date, CAST(sum(amount) AS BIGINT) AS volume_gross,
  CAST(sum(CASE WHEN is_refunded = 0 THEN amount ELSE 0 END) AS BIGINT) AS volume_net,
  count(*) AS trx, count(CASE WHEN is_refunded = 0 THEN 1 END) AS trx_net
FROM payments GROUP BY 1, 2, 3, 4, 5""")
view("revenue_summary", "payments", """
SELECT seller_id, product, paid_date AS report_date, CAST(sum(amount) AS BIGINT) AS volume_gross,
  CAST(sum(CASE WHEN is_refunded = 0 THEN amount ELSE 0 END) AS BIGINT) AS volume_net,
  count(*) AS volume_count,
  CASE WHEN product = 'online' THEN 'Other' ELSE 'Processing' END AS category
FROM payments GROUP BY 1, 2, 3""")
view("sellers", "", """
SELECT c_custkey AS seller_id, c_mktsegment AS category, n_name AS country,
  ['en', 'es', 'fr'][c_custkey % 3 + 1] AS language, 'type_' || (c_custkey % 4) AS business_type,
  ['web', 'ios', 'android', 'pos'][c_custkey % 4 + 1] AS source_application,
  ['ios', 'android', 'other'][c_custkey % 3 + 1] AS device_os,
  ['search', 'social', 'direct', 'partner', 'mail'][c_custkey % 5 + 1] AS channel,
  CASE WHEN c_acctbal < 0 THEN 1 ELSE 0 END AS is_frozen,
  CASE WHEN c_acctbal < -500 THEN 1 ELSE 0 END AS is_deactivated,
  CASE WHEN c_custkey % 50 = 49 THEN 1 ELSE 0 END AS is_deleted,
  c_custkey % 20 <> 19 AS is_active, CAST(1 + c_custkey % 3 AS INT) AS num_units,
  CASE WHEN c_custkey % 7 = 0 THEN NULL ELSE c_custkey % 2 = 0 END AS is_business_seller
FROM customer LEFT JOIN nation ON c_nationkey = n_nationkey""")
view("users", "sellers", """
SELECT seller_id AS user_id, 'UNIT' AS user_type, -(seller_id // 3) - 1 AS parent_id, category,
  country, language, is_frozen, is_deactivated, is_deleted, is_active,
  DATE '1995-01-01' + CAST(seller_id % 400 AS INT) AS created_date,
  if(seller_id % 13 = 5, 'partner', 'seller') AS source_user_type FROM sellers
UNION ALL
SELECT -(seller_id // 3) - 1, 'MERCHANT', -(seller_id // 3) - 1, category, country, language,
  is_frozen, is_deactivated, is_deleted, is_active,
  DATE '1995-01-01' + CAST(seller_id % 400 AS INT), if(seller_id % 13 = 5, 'partner', 'seller') FROM sellers WHERE seller_id % 3 = 0""")
view("places", "sellers", """
SELECT seller_id AS user_id, 'MERCHANT' AS user_type, seller_id AS parent_id, category, country, is_deactivated FROM sellers
UNION ALL
SELECT 1000000000 + seller_id * 3 + j, 'UNIT', seller_id, CASE WHEN j = 2 AND seller_id % 11 = 0 THEN 'OTHER' ELSE category END,
  country, CASE WHEN j = seller_id % 3 THEN is_deactivated ELSE 0 END FROM sellers CROSS JOIN range(3) AS u(j)""")
view("unit_payments", "payments", """
SELECT 1000000000 + seller_id * 3 + payment_id % 3 AS unit_id, * EXCLUDE (seller_id) FROM payments""")
view("merchant_payments", "unit_payments places", """
SELECT parent_id AS seller_id, p.* FROM unit_payments p JOIN places ON user_id = unit_id AND user_type = 'UNIT'""")
view("merchant_signups", "signups", """
SELECT -(seller_id // 3) - 1 AS merchant_id, activation_date FROM signups WHERE seller_id % 3 = 0""")
view("signups", "sellers lifetime", """
SELECT seller_id, f - CAST(10 + seller_id % 20 AS INT) AS signup_date,
  CASE WHEN seller_id % 17 = 0 THEN DATE '9999-09-09' ELSE f - CAST(seller_id % 9 AS INT) END AS activation_date,
  CASE WHEN seller_id % 9 = 0 THEN DATE '9999-09-09' ELSE f + CAST(seller_id % 20 - 10 AS INT) END AS bank_linked_date,
  CASE WHEN seller_id % 8 = 0 THEN DATE '9999-09-09' ELSE f + CAST(seller_id % 40 - 20 AS INT) END AS hardware_order_date,
  CASE WHEN seller_id % 19 = 0 THEN DATE '9999-09-09' ELSE f - CAST(seller_id % 5 AS INT) END AS onboarded_date,
  CASE WHEN seller_id % 23 = 0 THEN DATE '9999-09-09' ELSE f - CAST(seller_id % 7 AS INT) END AS first_app_date
FROM (SELECT s.seller_id, coalesce(l.first_date, DATE '1995-06-01') AS f
      FROM sellers s LEFT JOIN lifetime l USING (seller_id))""")
view("referrals", "payments", """
SELECT seller_id % 100 AS referrer_id, seller_id AS referee_id, min(paid_at) AS action_at,
  CASE WHEN seller_id % 6 = 0 THEN NULL ELSE CAST(sum(amount) AS BIGINT) END AS referee_amount
FROM payments WHERE seller_id <> seller_id % 100 GROUP BY seller_id""")
view("segment_history", "payments", """
SELECT seller_id, 'USD' AS currency,
  CASE WHEN sub_segment = 'Nano' THEN 'Micro' ELSE sub_segment END AS segment, sub_segment,
  make_date(year, 1, 1) AS effective_begin,
  coalesce(make_date(lead(year) OVER (PARTITION BY seller_id ORDER BY year), 1, 1) - 1,
    DATE '9999-12-31') AS effective_end
FROM (SELECT *, lag(sub_segment) OVER (PARTITION BY seller_id ORDER BY year) AS prev FROM (
  SELECT g.seller_id, g.year, CASE WHEN t IS NULL THEN 'Inactive' WHEN t < 10000000 THEN 'Nano'
    WHEN t < 23500000 THEN 'Micro' WHEN t < 66100000 THEN 'SMB'
    WHEN t < 109000000 THEN 'Mid-Market' ELSE 'Enterprise' END AS sub_segment
  FROM (SELECT seller_id, unnest(range(min(year(paid_date)), 2002)) AS year FROM payments GROUP BY 1) g
  LEFT JOIN (SELECT seller_id, year(paid_date) AS year, sum(amount) AS t FROM payments GROUP BY 1, 2) y
    ON g.seller_id = y.seller_id AND g.year = y.year))
WHERE prev IS NULL OR prev <> sub_segment""")
view("adoptions", "payments", """
SELECT seller_id, product, category, first_date, last_date,
  CASE WHEN category = 'SaaS' AND seller_id % 13 = 0 THEN DATE '9999-12-31' ELSE first_date END AS net_new_date,
  CASE WHEN first_date = start THEN 1 END AS net_new_flag,
  CASE WHEN first_date > start THEN 1 END AS existing_flag
FROM (SELECT *, min(CASE WHEN category = 'Processing' THEN first_date END) OVER (PARTITION BY seller_id) AS start
  FROM (SELECT seller_id, product, 'Processing' AS category, min(paid_date) AS first_date, max(paid_date) AS last_date
    FROM payments GROUP BY 1, 2
    UNION ALL
    SELECT o_custkey, ['payroll', 'appointments', 'gift cards', 'marketing', 'instant deposit', 'team management',
      'loyalty', 'online store', 'retail', 'restaurants', 'loans', 'other'][b + 1],
      CASE WHEN b = 10 THEN 'Capital' ELSE 'SaaS' END, min(CAST(l_shipdate AS DATE)), max(CAST(l_shipdate AS DATE))
    FROM lineitem JOIN orders ON l_orderkey = o_orderkey
    JOIN (SELECT p_partkey, CAST(substr(p_brand, 7) AS INT) % 12 AS b FROM part) ON l_partkey = p_partkey
    GROUP BY o_custkey, b))""")
view("product_history", "adoptions", """
SELECT seller_id, product, category, first_date AS effective_begin,
  CASE WHEN last_date >= DATE '2001-01-01' THEN DATE '9999-12-31' ELSE last_date END AS effective_end
FROM adoptions""")
view("rolling_cohort", "payments sellers", """
SELECT seller_id, 'USD' AS currency, product, 'Processing' AS product_category, report_date, country,
  category AS mcc, CASE WHEN amount > 20000000 THEN 'large' ELSE 'small' END AS segment,
  CASE WHEN amount > 0 THEN 'active' END AS cohort, amount
FROM (SELECT seller_id, 'ALL' AS product, DATE '1995-01-01' + CAST(28 * (floor((paid_date - DATE '1995-01-01') / 28) + 1) AS INT) AS report_date,
    CAST(sum(amount) AS BIGINT) AS amount FROM payments GROUP BY 1, 2, 3
  UNION ALL
  SELECT seller_id, 'terminal', DATE '1995-01-01' + CAST(28 * (floor((paid_date - DATE '1995-01-01') / 28) + 1) AS INT),
    CAST(sum(amount) AS BIGINT) FROM payments WHERE product = 'terminal' GROUP BY 1, 2, 3)
JOIN (SELECT seller_id, country, category FROM sellers) USING (seller_id)""")
view("line_facts", "", """
SELECT o_custkey AS seller_id, CASE WHEN o_orderpriority = '1-URGENT' THEN 'terminal' ELSE 'other' END AS product,
  CAST(l_shipdate AS DATE) AS report_date, CASE WHEN l_linestatus = 'F' THEN 'CP' ELSE 'CNP' END AS card_presence,
  CAST(floor(l_extendedprice * 100 + 0.5) AS BIGINT) AS gpv_gross,
  CAST(floor(l_extendedprice * (1 - l_discount) * 100 + 0.5) AS BIGINT) AS gpv_net,
  CAST(floor(l_extendedprice * l_discount * 100 + 0.5) AS BIGINT) AS revenue,
  CAST(floor(l_extendedprice * l_tax * 100 + 0.5) AS BIGINT) AS fee,
  CASE WHEN l_returnflag = 'R' THEN 0 ELSE 1 END AS trx_net
FROM lineitem JOIN orders ON l_orderkey = o_orderkey""")
view("ev", "", """
SELECT event_id, user_id AS seller_id, ts, event_type, value,
  CAST(regexp_extract(props, '"k": *([0-9]+)', 1) AS INT) AS k, props FROM events""")
view("event_log", "ev", """
SELECT CASE WHEN k = 0 THEN NULL WHEN event_id % 5 = 0 THEN CAST(-(seller_id // 3) - 1 AS VARCHAR)
    ELSE CAST(seller_id AS VARCHAR) END AS user_id,
  ['onboard', 'dashboard', 'app_android', 'app_ios'][event_id % 4 + 1] AS app,
  CASE event_type WHEN 'view' THEN 'View' WHEN 'click' THEN 'Click' WHEN 'error' THEN 'Action'
    WHEN 'purchase' THEN 'Tap' ELSE 'Link open' END AS name,
  ['us_referrals', 'Share: Facebook post', 'share twitter', 'Mail link', 'Checklist Action Item: Refer A Friend',
   'Settings Navigation: Referrals', 'Global Navigation: Referrals', 'Settings Referrals: Email Share',
   'Settings: Referrals', 'Onboard: Activation Flow Referrals', 'Activation Referral Button', 'Help Flow: Referral',
   'Referral Button', 'Reports', 'Review Prompt: Rate Now', 'Applet Selected'][k % 16 + 1] AS text,
  ts AS recorded_at, event_id, seller_id, k FROM ev""")
view("click_text", "ev", """
SELECT event_id, seller_id AS user_id, ts AS recorded_at,
  CASE event_type WHEN 'click' THEN 'Keypad: Tap Charge Button: ' || m
    WHEN 'view' THEN CASE WHEN k % 3 = 0 THEN 'Keypad: Tap Show Cart: ' || cart
      WHEN k % 3 = 2 AND k % 2 = 0 THEN 'Keypad: Add Custom Amount to Cart: (null)'
      ELSE 'Keypad: Add Custom Amount to Cart: ' || m END
    WHEN 'error' THEN CASE k % 4 WHEN 0 THEN 'Keypad: Clear Single Amount: ' || m
      WHEN 1 THEN 'Keypad: Clear Cart Confirm: ' || cart WHEN 2 THEN 'Cart: Clear Cart: ' || cart
      ELSE 'Keypad: Tap Backspace' END
    ELSE 'Help: opened' END AS description
FROM (SELECT *, CAST(floor(value / 5) AS INT) AS m,
  '{custom: ' || (k % 3) || ', items: ' || (k % 5) || ', total: ' || CAST(floor(value / 5) AS INT) || '}' AS cart
  FROM ev WHERE event_type <> 'purchase')""")
view("counter_payments", "ev", """
SELECT event_id AS payment_id, seller_id, ts AS paid_at, CAST(floor(value / 5) AS BIGINT) + k % 3 AS amount,
  CAST(k % 3 AS BIGINT) AS tip, 1 AS is_gpv,
  CASE k % 4 WHEN 0 THEN 'terminal' WHEN 1 THEN 'pos' WHEN 2 THEN 'online' END AS product,
  'method_' || (k % 3) AS entry_method FROM ev WHERE event_type = 'purchase'""")
view("counter_lines", "ev", """
SELECT event_id AS bill_id, ts AS completed_at,
  CASE (k + i) % 3 WHEN 0 THEN 'Custom Amount' WHEN 1 THEN 'UNKNOWN' ELSE 'catalog item' END AS name,
  1 AS quantity, CAST(floor(value) AS BIGINT) * 25 + CASE WHEN i > 0 THEN k ELSE 0 END AS amount
FROM (SELECT *, unnest(range(0, k % 3 + 1)) AS i FROM ev WHERE event_type = 'purchase')""")
view("touchpoints", "ev", """
SELECT seller_id, ['onboard_web', 'onboard_app', 'dashboard', 'app_android', 'app_ios'][k % 5 + 1] AS channel,
  ts - INTERVAL 29 YEAR AS action_at, event_id FROM ev""")
view("support_cases", "ev", """
SELECT event_id AS case_id, seller_id, ts AS created_at, k % 25 AS queue_id FROM ev WHERE event_type = 'error'""")
view("case_labels", "ev", """
SELECT event_id AS case_id, CASE WHEN k % 10 = 9 THEN NULL WHEN value < 30 THEN 'referrals' WHEN value < 70 THEN 'payments' ELSE 'hardware' END AS issue_bucket,
  'macro_' || (k % 3) AS macro_label FROM ev WHERE event_type = 'error'""")
view("surveys", "ev", """
SELECT event_id AS case_id, CASE WHEN k % 2 = 0 THEN k % 11 END AS score, CAST(1 + event_id % 2 AS INT) AS rank FROM ev
WHERE event_type = 'error'""")
view("scored_replies", "ev", """
SELECT event_id AS reply_id, seller_id AS contact_id, k % 11 AS score,
  strftime(ts, '%Y-%m-%d %H:%M') AS replied_text, ts AS replied_at,
  CASE WHEN k % 3 = 0 THEN event_id ELSE seller_id END AS link_id, k FROM ev WHERE event_type = 'signup'""")
view("reply_opportunities", "ev", """
SELECT event_id AS opportunity_id, CASE WHEN k % 6 = 0 THEN -(seller_id // 3) - 1 END AS merchant_id FROM ev WHERE event_type = 'signup'""")
view("reply_activities", "ev", """
SELECT event_id AS task_id, CASE WHEN k % 9 = 0 THEN -((seller_id + 1) // 3) - 1 END AS merchant_id FROM ev WHERE event_type = 'signup'""")
view("queues", "", "SELECT n_nationkey AS queue_id, 'org_' || n_regionkey AS organization FROM nation")
view("beta_starts", "", """
SELECT doc_id AS seller_id, quality + 2 * toxic AS feature_id,
  DATE '1996-01-01' + CAST(doc_id % 300 AS INT) AS started_date FROM labels""")
view("beta_programs", "", "SELECT r_regionkey AS feature_id, r_name AS program FROM region")
view("community_events", "", """
SELECT conv_id % 150 + CASE WHEN role = 'assistant' THEN 1000 ELSE 0 END AS seller_id, conv_id AS thread_id, turn,
  TIMESTAMP '2024-01-01 00:00:00' + to_minutes(conv_id) + to_hours(turn) AS created_at,
  CASE WHEN role = 'system' THEN 'thread_viewed' WHEN role = 'user' AND turn <= 1 THEN 'thread_authored'
    WHEN role = 'user' THEN 'comment_authored' WHEN turn % 3 = 2 THEN 'best_answer_authored'
    WHEN turn % 3 = 0 THEN 'marked_best_answer' ELSE 'comment_authored' END AS event_type
FROM conversations""")
view("balance_changes", "", """
SELECT l_orderkey AS balance_id, CAST(l_shipdate AS DATE) AS changed_date,
  CASE l_returnflag WHEN 'A' THEN 'Grant' WHEN 'R' THEN 'Use' ELSE 'Refund' END AS action,
  ['campaign', 'partner', 'system_referral', 'manual_referral', 'other', 'rebate'][l_linenumber % 6 + 1] AS change_type,
  CASE l_partkey % 4 WHEN 0 THEN 'account_management' WHEN 1 THEN 'customer_support' WHEN 2 THEN 'growth' END AS product_tag,
  ['USD', 'CAD', 'GBP'][l_suppkey % 3 + 1] AS currency,
  CAST(CASE l_suppkey % 3 WHEN 0 THEN 1.0 WHEN 1 THEN 0.75 ELSE 1.25 END AS DOUBLE) AS to_usd,
  CASE WHEN l_suppkey % 10 = 9 THEN 'other' ELSE 'free_processing' END AS balance_type,
  CAST(floor(l_extendedprice * 100 + 0.5) AS BIGINT) AS amount,
  CAST(floor(l_extendedprice * l_tax * 100 + 0.5) AS BIGINT) AS contra_revenue
FROM lineitem""")
view("employees", "payments", """
SELECT seller_id AS merchant_id, payment_id AS row_id,
  CASE WHEN payment_id % 11 = 0 THEN NULL ELSE payment_id // 2 END AS person_id, paid_at AS created_at,
  is_refunded = 0 AS is_active, CASE WHEN payment_id % 9 = 0 THEN paid_at END AS deleted_at FROM payments""")
view("locations", "payments", """
SELECT seller_id AS merchant_id, payment_id AS location_id, paid_at AS created_at, is_refunded = 0 AS is_active
FROM payments WHERE product = 'pos'""")
view("deposits", "payments", """
SELECT payment_id AS deposit_id, seller_id, paid_at AS attempted_at, amount, 1 - is_refunded AS is_successful FROM payments""")
view("card_payments", "payments", """
SELECT payment_id, seller_id, paid_at, paid_date, is_gpv,
  CASE WHEN l_partkey % 20 = 0 THEN NULL ELSE l_partkey % 40 END AS card_id, l_partkey AS line_part
FROM lineitem JOIN payments ON l_orderkey = payment_id""")
view("risk_cases", "", """
SELECT o_custkey AS seller_id, (l_orderkey * 8 + l_linenumber) * 100000 + l_suppkey AS case_id,
  CAST(l_shipdate AS DATE) AS created_date,
  ['compliance', 'chargebacks', 'takeover', 'fraud', 'finance', 'credit'][l_suppkey % 6 + 1] AS case_group,
  'type_' || l_linenumber AS case_type,
  CASE WHEN l_suppkey % 4 = 0 THEN 'review_requeue' ELSE 'route_' || (l_suppkey % 4) END AS subroute,
  CAST(l_linenumber % 2 AS INT) AS deactivated, CAST(l_suppkey % 2 AS INT) AS frozen
FROM lineitem JOIN orders ON l_orderkey = o_orderkey WHERE l_returnflag = 'R'""")
view("chargebacks", "", """
SELECT o_custkey AS seller_id, CAST(l_shipdate AS DATE) AS chargeback_date,
  CASE l_suppkey % 7 WHEN 0 THEN 'fake_account' WHEN 1 THEN 'gone_bad' WHEN 2 THEN 'takeover'
    WHEN 3 THEN 'buyer_fraud' WHEN 4 THEN 'credit_risk' WHEN 5 THEN 'inline' END AS taxonomy
FROM lineitem JOIN orders ON l_orderkey = o_orderkey WHERE l_returnflag = 'R'""")
view("contacts", "", """
SELECT o_custkey AS seller_id, (l_orderkey * 8 + l_linenumber) * 100000 + l_suppkey AS contact_id,
  CAST(l_shipdate AS DATE) AS created_date,
  CASE l_linenumber % 4 WHEN 0 THEN 'billing' WHEN 1 THEN 'device' WHEN 2 THEN 'payout' END AS issue_bucket,
  'macro_' || (l_suppkey % 3) AS macro_label, 'product_' || (l_suppkey % 5) AS product,
  CASE WHEN l_linenumber % 3 > 0 THEN 'category_' || (l_linenumber % 3) END AS issue_category, 'issue_' || l_linenumber AS issue
FROM lineitem JOIN orders ON l_orderkey = o_orderkey WHERE l_returnflag = 'N'""")
view("query_log", "", """
SELECT page_id AS query_id, html AS query_text,
  CASE WHEN page_id % 7 = 0 THEN 'reporting' ELSE 'user_' || (page_id % 7) END AS user_name,
  'tag_' || (page_id % 5) AS query_tag, 'cluster_' || (page_id % 3) AS cluster,
  TIMESTAMP '2023-01-01 00:00:00' + to_hours(page_id * 5) AS started_at FROM pages""")
view("hardware_lines", "", """
SELECT l_orderkey AS order_user_id, l_partkey AS sku, CAST(l_shipdate AS DATE) AS completed_date,
  CASE WHEN l_linestatus = 'F' THEN 'complete' ELSE 'open' END AS state FROM lineitem""")
view("device_touches", "touchpoints", """
SELECT seller_id, CAST(action_at AS DATE) AS created_date,
  CASE WHEN channel = 'dashboard' THEN 'counter stand' ELSE 'small ring' END AS product FROM touchpoints""")
view("sales_book", "payments", """
SELECT seller_id, payment_id AS entry_id, year(paid_date) || ' Q' || quarter(paid_date) AS quarter,
  CAST(payment_id % 25 AS INT) AS owner_id,
  CASE WHEN payment_id % 25 = 3 THEN NULL ELSE 'owner_' || (payment_id % 25) END AS owner_name,
  CASE payment_id % 4 WHEN 0 THEN 'core' WHEN 1 THEN 'growth' WHEN 2 THEN 'excluded' END AS program,
  CASE WHEN payment_id % 2 = 0 THEN 'Treatment' ELSE 'Control' END AS arm FROM payments""")
view("closed_deals", "payments", """
SELECT payment_id AS deal_id, paid_date AS close_date,
  ['Sales', 'Strat', 'Enterprise', 'Field Sales', 'Other'][payment_id % 5 + 1] AS sales_segment
FROM payments WHERE product = 'online'""")
view("placements", "payments", """
SELECT seller_id * 10 + CASE product WHEN 'terminal' THEN 0 WHEN 'pos' THEN 1 WHEN 'virtual' THEN 2
  WHEN 'invoice' THEN 3 ELSE 4 END AS placement_id, seller_id, product,
  min(paid_date) AS first_product_date, max(paid_date) AS latest_payment_date, if(seller_id % 4 = 3, 'mixed', 'pure') AS seller_group
FROM payments GROUP BY seller_id, product""")
view("attributions", "ev", """
SELECT seller_id, ['search', 'social', 'direct', 'partner', 'mail'][k % 5 + 1] AS channel,
  CASE WHEN k % 2 = 0 THEN 'brand' END AS sub_channel, 'offer_' || (k % 3) AS offer_channel,
  'NATION_' || (k % 25) AS country, CAST((1 + k % 4) * 0.25 AS DOUBLE) AS fraction
FROM ev WHERE event_type = 'signup'""")

view("merchant_lifetime", "lifetime users", """
SELECT parent_id AS merchant_id, min(first_date) AS first_date, max(last_date) AS last_date
FROM lifetime JOIN users ON seller_id = user_id AND user_type = 'UNIT' GROUP BY 1""")
view("first_payment_log", "payments users", """
SELECT parent_id AS merchant_id, payment_id, paid_at + to_minutes(payment_id % 7) AS recorded_at,
  CASE WHEN payment_id % 13 = 0 THEN 'UNKNOWN' WHEN is_card_present = 1 THEN 'TRUE' ELSE 'FALSE' END AS is_card_present,
  entry_method, amount + CASE WHEN payment_id % 5 = 0 THEN 1 ELSE 0 END AS amount, currency, tender,
  CASE WHEN payment_id % 6 = 0 THEN NULL ELSE reader END AS reader
FROM payments JOIN users ON seller_id = user_id AND user_type = 'UNIT' WHERE is_card_payment = 1
QUALIFY row_number() OVER (PARTITION BY parent_id ORDER BY paid_at, payment_id) = 1""")

view("intents", "adoptions sellers signups", """
SELECT a.seller_id, signup_date, source_application, country, device_os, activation_date, bank_linked_date,
  onboarded_date, first_app_date, product AS intent_value, product AS payment_product,
  first_date AS first_payment_date,
  CASE WHEN product IN ('terminal', 'pos', 'virtual') THEN 'primary' ELSE 'secondary' END AS signal
FROM adoptions a JOIN sellers s ON a.seller_id = s.seller_id JOIN signups g ON a.seller_id = g.seller_id
WHERE a.category = 'Processing'""")
view("page_clicks", "ev", """
SELECT seller_id, ts AS recorded_at, CASE WHEN event_type IN ('signup', 'click') THEN 'Signup' ELSE 'Browse' END AS action,
  CASE WHEN k % 4 = 3 THEN 'page_viewed' ELSE 'reader_option_selected' END AS description,
  'option_' || (k % 7) AS detail FROM ev""")
view("all_daily", "daily_payments", """
SELECT seller_id, paid_date, payment_count, cnp_count, amount, cnp_amount FROM daily_payments
UNION ALL
SELECT -(l_suppkey + 1), CAST(l_shipdate AS DATE), count(*), count(*) FILTER (l_linestatus = 'O'),
  CAST(sum(floor(l_extendedprice * 100 + 0.5)) AS BIGINT),
  CAST(sum(CASE WHEN l_linestatus = 'O' THEN floor(l_extendedprice * 100 + 0.5) ELSE 0 END) AS BIGINT)
FROM lineitem GROUP BY 1, 2""")
view("all_sellers", "sellers", """
SELECT seller_id, country, is_frozen, is_deactivated FROM sellers
UNION ALL
SELECT -(s_suppkey + 1), n_name, CASE WHEN s_acctbal < 0 THEN 1 ELSE 0 END, 0
FROM supplier LEFT JOIN nation ON s_nationkey = n_nationkey""")

view("merchant_cards", "card_payments places", """
SELECT parent_id AS seller_id, payment_id, card_id, paid_date, is_gpv
FROM (SELECT 1000000000 + seller_id * 3 + payment_id % 3 AS unit_id, * EXCLUDE (seller_id) FROM card_payments)
JOIN places ON user_id = unit_id AND user_type = 'UNIT'""")
view("merchant_log", "event_log places", """
SELECT parent_id AS seller_id, e.* EXCLUDE (seller_id, user_id)
FROM (SELECT *, CASE WHEN event_id % 4 < 3 THEN 1000000000 + seller_id * 3 + event_id % 4 ELSE seller_id END AS place_id FROM event_log) e
JOIN places p ON p.user_id = place_id""")
view("fee_facts", "", """
SELECT o_custkey AS seller_id, l_shipdate::DATE + (l_linenumber % 2)::INT AS report_date,
  floor(l_extendedprice * l_tax * 100 + 0.5)::BIGINT AS fee
FROM lineitem JOIN orders ON l_orderkey = o_orderkey WHERE l_linenumber % 4 <> 0""")
view("account_history", "sellers", """
SELECT seller_id, (seller_id % 3)::INT AS total_times_unfrozen, (seller_id % 5)::INT * is_deactivated AS total_times_deactivated,
  seller_id % 21 = 0 AS is_cbd_merchant FROM sellers""")
view("currency_segments", "segment_history", """
FROM segment_history UNION ALL
SELECT seller_id, 'EUR', 'SMB', 'SMB', effective_begin, effective_end FROM segment_history WHERE seller_id % 4 = 1""")
view("merchant_summary", "lifetime", """
SELECT seller_id, if(seller_id % 6 = 0, DATE '9999-09-09', first_date) AS first_date FROM lifetime""")
