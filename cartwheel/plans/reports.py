"""The reference's reports (R-01 .. R-32) as configurations of the operators.

Every function takes the table dict of ``cartwheel.sources.testviews.shop_tables`` (or of
``read_shop_tables``) and returns a lazy DataFrame with the reference's output columns.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from cartwheel.functions.semantics import MONTH, MONTH_START, month_name, period_key, ratio
from cartwheel.operators import abtest, funnel
from cartwheel.operators.conversion import conversion_measures
from cartwheel.operators.pages import count_report
from cartwheel.operators.sales import product_refunds, product_sales, product_success, sales_by_day_hour
from cartwheel.operators.trends import (
    filter_sessions, order_counts_by_session_dims, period_trend, sessions_and_orders_trend, time_range,
)
from cartwheel.plans import params as P

Tables = dict[str, DataFrame]



def _proven(t: Tables, table: str, key: str) -> bool:
    """Whether ``key`` is proven unique in a table; without a proof reports count distinct values."""
    return getattr(t, "unique_key", lambda name: None)(table) == key


def _session_measures(t: Tables, dims, **options) -> DataFrame:
    """conversion_measures of sessions and orders, by what is proven of their keys."""
    return conversion_measures(t["website_sessions"], t["orders"], dims, orders_unique=_proven(t, "orders", "order_id"),
                               facts_unique_per_key=_proven(t, "website_sessions", "website_session_id"), **options)

# ------------------------------------------------------------------ traffic (R-01 .. R-03)


def _campaign_measures(t: Tables, dim_name: str) -> DataFrame:
    m = _session_measures(t, [(dim_name, F.col("utm_campaign"))])
    return m.select(
        dim_name, "total_sessions", F.col("total_orders").alias("total_conversions"), "total_revenue",
        ratio("total_orders", "total_sessions", 0.0).alias("conversion_rate"),
        ratio("total_revenue", "total_orders", 0.0).alias("revenue_per_conversion"))


def traffic_channel(t: Tables) -> DataFrame:
    """R-01: per campaign, sessions, orders, conversion, revenue and average order value; by revenue, conversion."""
    m = _session_measures(t, [("traffic_source", F.col("utm_campaign"))])
    return m.select(
        "traffic_source", "total_sessions", "total_orders",
        ratio("total_orders", "total_sessions", 0.0).alias("conversion_rate"),
        "total_revenue",
        ratio("total_revenue", "total_orders", 0.0).alias("average_order_value"),
    ).orderBy(F.desc("total_revenue"), F.desc("conversion_rate"))


def campaign_analysis(t: Tables) -> DataFrame:
    """R-02: per campaign, sessions, conversions, revenue, conversion rate, revenue per conversion."""
    return (_campaign_measures(t, "campaign_name")
            .select("campaign_name", "total_sessions", "total_conversions", "total_revenue",
                    "conversion_rate", "revenue_per_conversion")
            .orderBy(F.desc("total_revenue"), F.desc("conversion_rate")))


def traffic_effectiveness(t: Tables) -> DataFrame:
    """R-03: as R-02, ordered by conversion rate, then revenue per conversion."""
    return (_campaign_measures(t, "traffic_source")
            .select("traffic_source", "total_sessions", "total_conversions", "conversion_rate",
                    "total_revenue", "revenue_per_conversion")
            .orderBy(F.desc("conversion_rate"), F.desc("revenue_per_conversion")))

# ------------------------------------------------------------------ pages (R-04 .. R-08)


def most_viewed_pages(t: Tables) -> DataFrame:
    """R-04: views per URL, most viewed first."""
    return count_report(t["website_pageviews"], ["pageview_url"])


def least_viewed_pages(t: Tables) -> DataFrame:
    """R-05: views per URL, least viewed first."""
    return count_report(t["website_pageviews"], ["pageview_url"], ascending=True)


def _page_measures(t: Tables) -> DataFrame:
    m = conversion_measures(t["website_pageviews"], t["orders"], ["pageview_url"],
                            facts_unique_per_key=False, orders_unique=_proven(t, "orders", "order_id"), distinct_orders=True)
    return m.select("*", ratio("total_orders", "total_sessions", 0.0).alias("conversion_rate"))


def page_order_effect(t: Tables) -> DataFrame:
    """R-06: per URL, distinct orders, revenue (fan-out kept), distinct sessions, conversion, average order value."""
    return (_page_measures(t)
            .select("pageview_url", "total_orders", "total_revenue", "total_sessions", "conversion_rate",
                    ratio("total_revenue", "total_orders", 0.0).alias("average_order_value"))
            .orderBy(F.desc("conversion_rate"), F.desc("total_revenue")))


def top_converting_pages(t: Tables) -> DataFrame:
    """R-07: per URL, sessions, orders, conversion and revenue; best converting first."""
    return (_page_measures(t)
            .select("pageview_url", "total_sessions", "total_orders", "conversion_rate", "total_revenue")
            .orderBy(F.desc("conversion_rate"), F.desc("total_orders")))


def poor_pages(t: Tables) -> DataFrame:
    """R-08: as R-07, worst converting first."""
    return (_page_measures(t)
            .select("pageview_url", "total_sessions", "total_orders", "conversion_rate", "total_revenue")
            .orderBy(F.asc("conversion_rate"), F.asc("total_orders")))

# ------------------------------------------------------------------ sales (R-09 .. R-12, R-24)


def sales_by_time(t: Tables) -> DataFrame:
    """R-09: orders and revenue per calendar day and hour; busiest first."""
    return sales_by_day_hour(t["orders"]).orderBy(F.desc("total_revenue"), F.desc("total_orders"))


def top_products(t: Tables) -> DataFrame:
    """R-10: order lines and revenue per product; best selling first."""
    return (product_sales(t["products"], t["order_items"])
            .orderBy(F.desc("total_orders"), F.desc("total_revenue")))


def least_selling_products(t: Tables) -> DataFrame:
    """R-11: as R-10, least selling first."""
    return (product_sales(t["products"], t["order_items"])
            .orderBy(F.asc("total_orders"), F.asc("total_revenue")))


def most_refunded_products(t: Tables) -> DataFrame:
    """R-12: refunds and refunded amount per product; most refunded first."""
    return (product_refunds(t["order_item_refunds"], t["order_items"], t["products"])
            .orderBy(F.desc("total_refunds"), F.desc("total_refund_amount")))


def product_success_report(t: Tables) -> DataFrame:
    """R-24: revenue and refunds (rounded to 1) per primary product of refunded orders."""
    return product_success(t["shop_orders"], t["order_item_refunds"], t["products"])

# ------------------------------------------------------------------ trends (R-13 .. R-23)


def _src(value: str):
    return F.col("utm_source") == value


def gsearch_monthly(t: Tables) -> DataFrame:
    """R-13: gsearch sessions per month with the orders of those sessions per order month."""
    return (sessions_and_orders_trend(t["website_sessions"], t["orders"], MONTH,
                                      where=_src(P.GSEARCH), session_name="G_sessions")
            .orderBy("month"))


def brand_nonbrand_monthly(t: Tables) -> DataFrame:
    """R-14: as R-13 for the brand and nonbrand campaigns, per campaign."""
    return (sessions_and_orders_trend(t["website_sessions"], t["orders"], MONTH, dims=["utm_campaign"],
                                      where=F.col("utm_campaign").isin(list(P.BRAND_CAMPAIGNS)))
            .orderBy("month", "utm_campaign"))


def gsearch_sessions_monthly(t: Tables) -> DataFrame:
    """R-15: gsearch sessions per month."""
    return (period_trend(t["website_sessions"], "created_at", MONTH, where=_src(P.GSEARCH),
                         name="total_sessions").orderBy("month"))


def orders_monthly(t: Tables) -> DataFrame:
    """R-16: orders per month."""
    return period_trend(t["orders"], "created_at", MONTH, name="total_orders").orderBy("month")


def gsearch_campaign_monthly(t: Tables) -> DataFrame:
    """R-17: gsearch sessions per month and campaign."""
    return (period_trend(t["website_sessions"], "created_at", MONTH, dims=["utm_campaign"],
                         where=_src(P.GSEARCH), name="total_sessions")
            .orderBy("month", "utm_campaign"))


def _nonbrand_filter(referer_not_like: str):
    return (_src(P.GSEARCH) & F.col("utm_campaign").like(P.NONBRAND_LIKE)
            & ~F.col("http_referer").like(referer_not_like))


def nonbrand_sessions_device(t: Tables) -> DataFrame:
    """R-18: gsearch nonbrand sessions per month start and device (referer not like '%brand%')."""
    return (period_trend(t["website_sessions"], "created_at", MONTH_START, dims=["device_type"],
                         where=_nonbrand_filter(P.SESSIONS_REFERER_NOT_LIKE),
                         count_col="website_session_id", name="total_sessions")
            .orderBy("month", "device_type").limit(P.REPORT_LIMIT))


def nonbrand_orders_device(t: Tables) -> DataFrame:
    """R-19: orders of gsearch nonbrand sessions per order month start and device."""
    return (order_counts_by_session_dims(t["orders"], t["website_sessions"], MONTH_START, dims=["device_type"],
                                         where=_nonbrand_filter(P.ORDERS_REFERER_NOT_LIKE))
            .orderBy("month", "device_type").limit(P.REPORT_LIMIT))


def nonbrand_device_by_month_name(t: Tables) -> DataFrame:
    """R-20: nonbrand sessions and orders per year, month name, device and source."""
    m = _session_measures(
        t, [("year", F.year("created_at").cast("int")), ("month_name", month_name("created_at")),
         "device_type", "utm_source"],
        where=F.col("utm_campaign") == P.NONBRAND)
    return (m.select("year", "month_name", "device_type",
                     F.col("total_sessions").alias("Month_wise_sessions"),
                     F.col("total_orders").alias("no_of_orders"), "utm_source")
            .orderBy("month_name", "year", "device_type", "utm_source")
            .offset(0).limit(P.REPORT_LIMIT))


def _monthly_conversion(t: Tables, dims, where) -> DataFrame:
    m = _session_measures(t, dims, where=where, distinct_orders=True)
    names = [d if isinstance(d, str) else d[0] for d in dims]
    return m.select(*names, "total_sessions", "total_orders",
                    (ratio("total_orders", "total_sessions") * 100).alias("conversion_rate"))


def channel_monthly_conversion(t: Tables) -> DataFrame:
    """R-21: per month start and source, sessions, distinct orders and conversion in percent."""
    m = _monthly_conversion(t, [("month", period_key("created_at", MONTH_START)),
                                ("channel", F.col("utm_source"))], F.col("utm_source").isNotNull())
    return m.orderBy("month", "channel").limit(P.REPORT_LIMIT)


def monthly_conversion_window(t: Tables) -> DataFrame:
    """R-22: per month start inside a closed date window, sessions, orders and conversion in percent."""
    start, end = P.CONVERSION_WINDOW
    m = _monthly_conversion(t, [("month", period_key("created_at", MONTH_START))],
                            time_range(t["website_sessions"], start, end, closed=True))
    return m.orderBy("month")


def sessions_by_referer(t: Tables) -> DataFrame:
    """R-23: all sessions with one referer."""
    return filter_sessions(t["website_sessions"], "http_referer", P.REFERER)

# ------------------------------------------------------------------ funnel (R-25 .. R-28)


def _funnel_where(sessions: DataFrame):
    return (_src(P.GSEARCH) & (F.col("utm_campaign") == P.NONBRAND)
            & time_range(sessions, *P.FUNNEL_WINDOW))


def _funnel(t: Tables, rows) -> DataFrame:
    return rows(t["website_sessions"], t["website_pageviews"], _funnel_where(t["website_sessions"]),
                sessions_unique=_proven(t, "website_sessions", "website_session_id"))


def funnel_pageviews(t: Tables) -> DataFrame:
    """R-25: page views of the chosen sessions with one 0/1 flag per funnel step."""
    return _funnel(t, funnel.funnel_pageviews)


def funnel_sessions(t: Tables) -> DataFrame:
    """R-26: per chosen session, whether it reached each funnel step."""
    return _funnel(t, funnel.funnel_sessions)


def funnel_counts(t: Tables) -> DataFrame:
    """R-27: sessions per landing segment and how many reached each step."""
    return funnel.funnel_counts(funnel_sessions(t))


def funnel_click_rates(t: Tables) -> DataFrame:
    """R-28: per segment, each step's sessions over the previous step's."""
    return funnel.funnel_rates(funnel_counts(t))


def funnel_report(t: Tables) -> tuple[DataFrame, DataFrame]:
    """Counts and click rates from one stored table of session flags (the temp table read twice by
    the reference)."""
    counts = funnel_counts(t)
    return counts, funnel.funnel_rates(counts)


def funnel_report_rows(t: Tables) -> DataFrame:
    """Counts and click rates side by side, from one materialisation (``funnel_report``)."""
    counts, rates = funnel_report(t)
    return counts.join(rates, "segment")

# ------------------------------------------------------------------ A/B billing test (R-29 .. R-32)


def billing_pages(t: Tables) -> DataFrame:
    """R-29: billing-page views in the test window with the orders of their sessions."""
    return abtest.page_variant_views(t["website_pageviews"], t["orders"], abtest.BILLING_URLS, *P.BILLING_WINDOW)


def revenue_per_billing_page(t: Tables) -> DataFrame:
    """R-30: per billing page, sessions and revenue per session."""
    return abtest.revenue_per_view(t["website_pageviews"], t["orders"], abtest.BILLING_URLS, *P.BILLING_WINDOW)


def billing_session_count(t: Tables) -> DataFrame:
    """R-31: number of billing-page views in the test window."""
    return abtest.variant_view_count(t["website_pageviews"], abtest.BILLING_URLS, *P.BILLING_WINDOW)


def billing_lift(t: Tables) -> DataFrame:
    """R-32: revenue per session of both pages, lift, views and lift x views."""
    base, variant = abtest.BILLING_URLS
    return abtest.variant_lift(t["website_pageviews"], t["orders"], base, variant, *P.BILLING_WINDOW)


REPORTS = {
    "traffic_channel": traffic_channel,
    "campaign_analysis": campaign_analysis,
    "traffic_effectiveness": traffic_effectiveness,
    "most_viewed_pages": most_viewed_pages,
    "least_viewed_pages": least_viewed_pages,
    "page_order_effect": page_order_effect,
    "top_converting_pages": top_converting_pages,
    "poor_pages": poor_pages,
    "sales_by_day_hour": sales_by_time,
    "top_products": top_products,
    "least_selling_products": least_selling_products,
    "product_refunds": most_refunded_products,
    "gsearch_monthly": gsearch_monthly,
    "brand_nonbrand_monthly": brand_nonbrand_monthly,
    "gsearch_sessions_monthly": gsearch_sessions_monthly,
    "orders_monthly": orders_monthly,
    "gsearch_campaign_monthly": gsearch_campaign_monthly,
    "nonbrand_sessions_device": nonbrand_sessions_device,
    "nonbrand_orders_device": nonbrand_orders_device,
    "nonbrand_device_by_month_name": nonbrand_device_by_month_name,
    "channel_monthly_conversion": channel_monthly_conversion,
    "monthly_conversion_window": monthly_conversion_window,
    "sessions_by_referer": sessions_by_referer,
    "product_success": product_success_report,
    "funnel_pageviews": funnel_pageviews,
    "funnel_sessions": funnel_sessions,
    "funnel_counts": funnel_counts,
    "funnel_click_rates": funnel_click_rates,
    "funnel_report": funnel_report_rows,
    "billing_pages": billing_pages,
    "revenue_per_billing_page": revenue_per_billing_page,
    "billing_session_count": billing_session_count,
    "billing_lift": billing_lift,
}
