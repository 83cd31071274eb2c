"""DuckDB SQL for every registered query: the correctness oracle.

Each query states the report's definition directly - one join, then one aggregation with
COUNT(DISTINCT ...) - not the way the Spark operators plan it, so the comparison also checks
the rewrites (orders pre-aggregated per session, SUM(flag) for distinct counts, ...).
``VIEWS`` defines the web-shop views over the raw test tables, the same derivation as
``cartwheel.sources.testviews``. Money is summed as DECIMAL and reported as DOUBLE; ratios
are DOUBLE / DOUBLE, the same operations as on the Spark side.
"""

from __future__ import annotations

from cartwheel.plans import params as P

ITEM_KEY = ("concat_ws('-', CAST(l_orderkey AS VARCHAR), CAST(l_linenumber AS VARCHAR), "
            "CAST(l_partkey AS VARCHAR), CAST(l_suppkey AS VARCHAR))")

VIEWS = f"""
ev AS (
  SELECT event_id, user_id, event_type, value,
         user_id * 100 + day(ts) AS sid,
         CAST(json_extract_string(props, '$.k') AS INTEGER) AS k,
         ts + (12 * (day(ts) - 1)) * INTERVAL '1' DAY AS ts
  FROM events),
website_sessions AS (
  SELECT sid AS website_session_id, created_at, user_id,
         CAST(k0 % 2 AS INTEGER) AS is_repeat_session,
         lower(CASE k0 % 4 WHEN 0 THEN 'gsearch' WHEN 1 THEN 'GSearch' WHEN 2 THEN 'bsearch' END) AS utm_source,
         CASE k0 % 3 WHEN 0 THEN 'nonbrand' WHEN 1 THEN 'brand' ELSE 'pilot' END AS utm_campaign,
         CAST(NULL AS VARCHAR) AS utm_content,
         CASE WHEN k0 < 50 THEN 'mobile' ELSE 'desktop' END AS device_type,
         CASE k0 % 5 WHEN 0 THEN NULL WHEN 1 THEN 'https://brand.example'
              ELSE 'https://www.gsearch.com' END AS http_referer
  FROM (SELECT sid, min(ts) AS created_at, min(user_id) AS user_id, arg_min(k, event_id) AS k0
        FROM ev GROUP BY sid) s),
website_pageviews AS (
  SELECT event_id AS website_pageview_id, ts AS created_at, sid AS website_session_id,
         CASE event_type
           WHEN 'view' THEN CASE WHEN event_id % 2 = 1 THEN '/lander-1' ELSE '/home' END
           WHEN 'click' THEN '/products'
           WHEN 'signup' THEN '/cart'
           WHEN 'error' THEN CASE WHEN event_id % 2 = 1 THEN '/billing-2' ELSE '/billing' END
           WHEN 'purchase' THEN '/thank-you-for-your-order' END AS pageview_url
  FROM ev),
web_orders AS (
  SELECT event_id AS order_id, ts AS created_at, sid AS website_session_id,
         CAST(value AS DECIMAL(18,2)) AS price_usd
  FROM ev WHERE event_type = 'purchase'),
products AS (SELECT p_partkey AS product_id, p_name AS product_name FROM part),
order_items AS (
  SELECT {ITEM_KEY} AS order_item_id, l_orderkey AS order_id, l_partkey AS product_id,
         CAST(l_extendedprice AS DECIMAL(18,2)) AS price_usd
  FROM lineitem),
order_item_refunds AS (
  SELECT {ITEM_KEY} AS order_item_refund_id, {ITEM_KEY} AS order_item_id, l_orderkey AS order_id,
         CAST(l_extendedprice AS DECIMAL(18,2)) AS refund_amount_usd
  FROM lineitem WHERE l_returnflag = 'R'),
shop_orders AS (
  SELECT o.o_orderkey AS order_id, o.o_orderdate AS created_at, p.primary_product_id,
         CAST(o.o_totalprice AS DECIMAL(18,2)) AS price_usd
  FROM orders o JOIN (SELECT l_orderkey, min(l_partkey) AS primary_product_id
                      FROM lineitem GROUP BY l_orderkey) p ON o.o_orderkey = p.l_orderkey)
"""


def with_views(body: str, extra_ctes: str = "") -> str:
    ctes = VIEWS.strip()
    if extra_ctes:
        ctes += ",\n" + extra_ctes.strip()
    return f"WITH {ctes}\n{body.strip()}"


def _d(expr: str) -> str:
    return f"CAST({expr} AS DOUBLE)"


def _guarded(num: str, den: str) -> str:
    """Ratio that is 0 when the denominator is 0."""
    return f"CASE WHEN {den} = 0 THEN 0 ELSE {_d(num)} / {_d(den)} END"


def _unguarded(num: str, den: str) -> str:
    """Ratio that is NULL when the denominator is 0."""
    return f"{_d(num)} / {_d(f'NULLIF({den}, 0)')}"


def _ts(value: str) -> str:
    return f"TIMESTAMP '{value}'"


# Session-grain conversion: one statement over sessions LEFT JOIN orders.
_SESS = "COUNT(DISTINCT s.website_session_id)"
_ORD = "COUNT(o.order_id)"
_REV = "SUM(o.price_usd)"
_SESSION_JOIN = "FROM website_sessions s LEFT JOIN web_orders o USING (website_session_id)"


def _by_campaign(name: str, orders_name: str, rate_name: str, cols: list[str], order: str) -> str:
    exprs = {
        name: f"s.utm_campaign AS {name}",
        "total_sessions": f"{_SESS} AS total_sessions",
        orders_name: f"{_ORD} AS {orders_name}",
        "total_revenue": f"{_d(_REV)} AS total_revenue",
        "conversion_rate": f"{_guarded(_ORD, _SESS)} AS conversion_rate",
        rate_name: f"{_guarded(_REV, _ORD)} AS {rate_name}",
    }
    select = ",\n       ".join(exprs[c] for c in cols)
    return with_views(f"SELECT {select}\n{_SESSION_JOIN}\nGROUP BY s.utm_campaign\nORDER BY {order}")


# Page-view grain: one statement over page views LEFT JOIN orders.
_P_SESS = "COUNT(DISTINCT v.website_session_id)"
_P_ORD = "COUNT(DISTINCT o.order_id)"
_PAGE_JOIN = "FROM website_pageviews v LEFT JOIN web_orders o USING (website_session_id)"


def _by_page(cols: list[str], order: str) -> str:
    exprs = {
        "pageview_url": "v.pageview_url",
        "total_orders": f"{_P_ORD} AS total_orders",
        "total_revenue": f"{_d(_REV)} AS total_revenue",
        "total_sessions": f"{_P_SESS} AS total_sessions",
        "conversion_rate": f"{_guarded(_P_ORD, _P_SESS)} AS conversion_rate",
        "average_order_value": f"{_guarded(_REV, _P_ORD)} AS average_order_value",
    }
    select = ",\n       ".join(exprs[c] for c in cols)
    return with_views(f"SELECT {select}\n{_PAGE_JOIN}\nGROUP BY v.pageview_url\nORDER BY {order}")


def _product_lines(order: str) -> str:
    return with_views(f"""
SELECT i.product_id, p.product_name, COUNT(i.order_id) AS total_orders,
       {_d('SUM(i.price_usd)')} AS total_revenue
FROM order_items i JOIN products p USING (product_id)
GROUP BY i.product_id, p.product_name
ORDER BY {order}""")


def _month(expr: str, fmt: str = "%Y-%m") -> str:
    return f"strftime({expr}, '{fmt}')"


def _sessions_with_orders(where: str, dims: list[str], session_name: str) -> str:
    """Sessions per (month, dims); orders of those sessions per (order month, dims) as a
    correlated count, 0 when there are none."""
    dim_sel = "".join(f", {d}" for d in dims)
    dim_match = "".join(f" AND x.{d} = t.{d}" for d in dims)
    return with_views(f"""
SELECT t.month{''.join(f', t.{d}' for d in dims)}, t.{session_name},
       COALESCE((SELECT COUNT(o.order_id)
                 FROM web_orders o JOIN website_sessions x USING (website_session_id)
                 WHERE {where.replace('s.', 'x.')} AND {_month('o.created_at')} = t.month{dim_match}), 0)
         AS total_orders
FROM (SELECT {_month('s.created_at')} AS month{''.join(f', s.{d}' for d in dims)},
             COUNT(s.website_session_id) AS {session_name}
      FROM website_sessions s WHERE {where}
      GROUP BY ALL) t
ORDER BY t.month{''.join(f', t.{d}' for d in dims)}""")


def _nonbrand(alias: str, not_like: str) -> str:
    return (f"{alias}.utm_source = '{P.GSEARCH}' AND {alias}.utm_campaign LIKE '{P.NONBRAND_LIKE}' "
            f"AND {alias}.http_referer NOT LIKE '{not_like}'")


def _conversion_by_month(extra_dims: str, where: str, order: str, limit: str = "") -> str:
    dist_o = "COUNT(DISTINCT o.order_id)"
    return with_views(f"""
SELECT {_month('s.created_at', '%Y-%m-01')} AS month{extra_dims},
       {_SESS} AS total_sessions, {dist_o} AS total_orders,
       ({_unguarded(dist_o, _SESS)}) * 100 AS conversion_rate
{_SESSION_JOIN}
WHERE {where}
GROUP BY ALL
ORDER BY {order}{limit}""")


# Funnel URLs and the names of the page flags, session flags and counts.
_STEPS = [
    ("/home", "homepage", "saw_homepage", None),
    ("/lander-1", "custom_lander", "saw_custom_lander", None),
    ("/products", "products_page", "product_made_it", "to_products"),
    ("/the-original-mr-fuzzy", "mrfuzzy_page", "mrfuzzy_made_it", "to_mrfuzzy"),
    ("/cart", "cart_page", "cart_made_it", "to_cart"),
    ("/shipping", "shipping_page", "shipping_made_it", "to_shipping"),
    ("/billing", "billing_page", "billing_made_it", "to_billing"),
    ("/thank-you-for-your-order", "thankyou_page", "thankyou_made_it", "to_thankyou"),
]
_CHOSEN = f"""
chosen AS (
  SELECT website_session_id FROM website_sessions
  WHERE utm_source = '{P.GSEARCH}' AND utm_campaign = '{P.NONBRAND}'
    AND created_at > {_ts(P.FUNNEL_WINDOW[0])} AND created_at < {_ts(P.FUNNEL_WINDOW[1])})
"""
_FLAGS = _CHOSEN.strip() + """,
flags AS (
  SELECT c.website_session_id, """ + ",\n         ".join(
    f"COALESCE(MAX(CAST(v.pageview_url = '{url}' AS INTEGER)), 0) AS {sflag}" for url, _, sflag, _ in _STEPS) + """
  FROM chosen c LEFT JOIN website_pageviews v USING (website_session_id)
  GROUP BY c.website_session_id)
"""
_COUNTS = _FLAGS.strip() + """,
counts AS (
  SELECT CASE WHEN saw_homepage = 1 THEN 'saw_homepage'
              WHEN saw_custom_lander = 1 THEN 'saw_custom_lander'
              ELSE 'uh oh... check logic' END AS segment,
         COUNT(*) AS sessions, """ + ",\n         ".join(
    f"COUNT(*) FILTER (WHERE {sflag} = 1) AS {cname}" for _, _, sflag, cname in _STEPS if cname) + """
  FROM flags GROUP BY 1)
"""
_RATES = [("lander_click_rt", "to_products", "sessions"), ("products_click_rt", "to_mrfuzzy", "to_products"),
          ("mrfuzzy_click_rt", "to_cart", "to_mrfuzzy"), ("cart_click_rt", "to_shipping", "to_cart"),
          ("shipping_click_rt", "to_billing", "to_shipping"), ("billing_click_rt", "to_thankyou", "to_billing")]

_VARIANT = f"""
seen AS (
  SELECT website_session_id, pageview_url FROM website_pageviews
  WHERE pageview_url IN ('/billing', '/billing-2')
    AND created_at > {_ts(P.BILLING_WINDOW[0])} AND created_at < {_ts(P.BILLING_WINDOW[1])}),
per_version AS (
  SELECT v.pageview_url AS billing_version_seen, COUNT(DISTINCT v.website_session_id) AS sessions,
         {_unguarded('SUM(o.price_usd)', 'COUNT(DISTINCT v.website_session_id)')} AS revenue_per_billing_page_seen
  FROM seen v LEFT JOIN web_orders o USING (website_session_id)
  GROUP BY 1)
"""

REPORT_SQL: dict[str, str] = {
    "traffic_channel": _by_campaign(
        "traffic_source", "total_orders", "average_order_value",
        ["traffic_source", "total_sessions", "total_orders", "conversion_rate", "total_revenue",
         "average_order_value"], "total_revenue DESC, conversion_rate DESC"),
    "campaign_analysis": _by_campaign(
        "campaign_name", "total_conversions", "revenue_per_conversion",
        ["campaign_name", "total_sessions", "total_conversions", "total_revenue", "conversion_rate",
         "revenue_per_conversion"], "total_revenue DESC, conversion_rate DESC"),
    "traffic_effectiveness": _by_campaign(
        "traffic_source", "total_conversions", "revenue_per_conversion",
        ["traffic_source", "total_sessions", "total_conversions", "conversion_rate", "total_revenue",
         "revenue_per_conversion"], "conversion_rate DESC, revenue_per_conversion DESC"),
    "most_viewed_pages": with_views(
        "SELECT pageview_url, COUNT(*) AS total_views FROM website_pageviews GROUP BY 1 ORDER BY 2 DESC, 1"),
    "least_viewed_pages": with_views(
        "SELECT pageview_url, COUNT(*) AS total_views FROM website_pageviews GROUP BY 1 ORDER BY 2, 1"),
    "page_order_effect": _by_page(
        ["pageview_url", "total_orders", "total_revenue", "total_sessions", "conversion_rate",
         "average_order_value"], "conversion_rate DESC, total_revenue DESC"),
    "top_converting_pages": _by_page(
        ["pageview_url", "total_sessions", "total_orders", "conversion_rate", "total_revenue"],
        "conversion_rate DESC, total_orders DESC"),
    "poor_pages": _by_page(
        ["pageview_url", "total_sessions", "total_orders", "conversion_rate", "total_revenue"],
        "conversion_rate, total_orders"),
    "sales_by_day_hour": with_views(f"""
SELECT {_month('created_at', '%Y-%m-%d')} AS order_date, CAST(hour(created_at) AS INTEGER) AS order_hour,
       COUNT(order_id) AS total_orders, {_d('SUM(price_usd)')} AS total_revenue
FROM web_orders GROUP BY ALL ORDER BY total_revenue DESC, total_orders DESC"""),
    "top_products": _product_lines("total_orders DESC, total_revenue DESC"),
    "least_selling_products": _product_lines("total_orders, total_revenue"),
    "product_refunds": with_views(f"""
SELECT i.product_id, p.product_name, COUNT(r.order_item_refund_id) AS total_refunds,
       {_d('SUM(r.refund_amount_usd)')} AS total_refund_amount
FROM order_item_refunds r
  JOIN order_items i USING (order_item_id)
  JOIN products p ON p.product_id = i.product_id
GROUP BY i.product_id, p.product_name
ORDER BY total_refunds DESC, total_refund_amount DESC"""),
    "gsearch_monthly": _sessions_with_orders(f"s.utm_source = '{P.GSEARCH}'", [], "G_sessions"),
    "brand_nonbrand_monthly": _sessions_with_orders(
        "s.utm_campaign IN (" + ", ".join(f"'{c}'" for c in P.BRAND_CAMPAIGNS) + ")",
        ["utm_campaign"], "total_sessions"),
    "gsearch_sessions_monthly": with_views(f"""
SELECT {_month('created_at')} AS month, COUNT(*) AS total_sessions
FROM website_sessions WHERE utm_source = '{P.GSEARCH}' GROUP BY 1 ORDER BY 1"""),
    "orders_monthly": with_views(f"""
SELECT {_month('created_at')} AS month, COUNT(*) AS total_orders FROM web_orders GROUP BY 1 ORDER BY 1"""),
    "gsearch_campaign_monthly": with_views(f"""
SELECT {_month('created_at')} AS month, utm_campaign, COUNT(*) AS total_sessions
FROM website_sessions WHERE utm_source = '{P.GSEARCH}' GROUP BY ALL ORDER BY 1, 2"""),
    "nonbrand_sessions_device": with_views(f"""
SELECT {_month('s.created_at', '%Y-%m-01')} AS month, s.device_type,
       COUNT(s.website_session_id) AS total_sessions
FROM website_sessions s WHERE {_nonbrand('s', P.SESSIONS_REFERER_NOT_LIKE)}
GROUP BY ALL ORDER BY 1, 2 LIMIT {P.REPORT_LIMIT}"""),
    "nonbrand_orders_device": with_views(f"""
SELECT {_month('o.created_at', '%Y-%m-01')} AS month, s.device_type, COUNT(o.order_id) AS total_orders
FROM web_orders o JOIN website_sessions s USING (website_session_id)
WHERE {_nonbrand('s', P.ORDERS_REFERER_NOT_LIKE)}
GROUP BY ALL ORDER BY 1, 2 LIMIT {P.REPORT_LIMIT}"""),
    "nonbrand_device_by_month_name": with_views(f"""
SELECT CAST(year(s.created_at) AS INTEGER) AS year, strftime(s.created_at, '%B') AS month_name,
       s.device_type, {_SESS} AS Month_wise_sessions, {_ORD} AS no_of_orders, s.utm_source
{_SESSION_JOIN}
WHERE s.utm_campaign = '{P.NONBRAND}'
GROUP BY ALL ORDER BY month_name, year, device_type, utm_source LIMIT {P.REPORT_LIMIT}"""),
    "channel_monthly_conversion": _conversion_by_month(
        ", s.utm_source AS channel", "s.utm_source IS NOT NULL", "month, channel",
        f" LIMIT {P.REPORT_LIMIT}"),
    "monthly_conversion_window": _conversion_by_month(
        "", f"s.created_at BETWEEN {_ts(P.CONVERSION_WINDOW[0])} AND {_ts(P.CONVERSION_WINDOW[1])}",
        "month"),
    "sessions_by_referer": with_views(f"""
SELECT * FROM website_sessions WHERE http_referer = '{P.REFERER.lower()}'"""),
    "product_success": with_views(f"""
SELECT p.product_name, {_d('round(SUM(o.price_usd), 1)')} AS total_revenue,
       {_d('round(SUM(r.refund_amount_usd), 1)')} AS total_refund_amount
FROM order_item_refunds r
  JOIN shop_orders o USING (order_id)
  JOIN products p ON p.product_id = o.primary_product_id
GROUP BY p.product_name"""),
    "funnel_pageviews": with_views("""
SELECT c.website_session_id, v.pageview_url, """ + ",\n       ".join(
        f"COALESCE(CAST(v.pageview_url = '{url}' AS INTEGER), 0) AS {pflag}" for url, pflag, _, _ in _STEPS) + """
FROM chosen c LEFT JOIN website_pageviews v USING (website_session_id)
ORDER BY c.website_session_id, v.created_at""", _CHOSEN),
    "funnel_sessions": with_views("SELECT * FROM flags", _FLAGS),
    "funnel_counts": with_views("SELECT * FROM counts", _COUNTS),
    "funnel_click_rates": with_views("SELECT segment, " + ", ".join(
        f"{_unguarded(num, den)} AS {name}" for name, num, den in _RATES) + " FROM counts", _COUNTS),
    "funnel_report": with_views("SELECT *, " + ", ".join(
        f"{_unguarded(num, den)} AS {name}" for name, num, den in _RATES) + " FROM counts", _COUNTS),
    "billing_pages": with_views(f"""
SELECT v.website_session_id, v.pageview_url AS billing_version_seen, o.order_id,
       {_d('o.price_usd')} AS price_usd
FROM seen v LEFT JOIN web_orders o USING (website_session_id)""", _VARIANT),
    "revenue_per_billing_page": with_views("SELECT * FROM per_version", _VARIANT),
    "billing_session_count": with_views(
        "SELECT COUNT(website_session_id) AS billing_session_last_mon FROM seen", _VARIANT),
    "billing_lift": with_views("""
SELECT base AS base_revenue_per_session, variant AS variant_revenue_per_session,
       views AS billing_page_views, variant - base AS lift_per_session,
       (variant - base) * views AS revenue_impact
FROM (SELECT MAX(revenue_per_billing_page_seen) FILTER (WHERE billing_version_seen = '/billing') AS base,
             MAX(revenue_per_billing_page_seen) FILTER (WHERE billing_version_seen = '/billing-2') AS variant
      FROM per_version) r,
     (SELECT COUNT(*) AS views FROM seen) n""", _VARIANT),
}
