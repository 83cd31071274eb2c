"""Page-variant (A/B) test: who saw which variant, revenue per session, lift and impact."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from cartwheel.functions.semantics import ratio
from cartwheel.operators.conversion import SESSION_KEY, session_order_stats
from cartwheel.operators.joins import materialize_bounded
from cartwheel.operators.trends import time_range

# The billing-page test of the reference.
BILLING_URLS = ("/billing", "/billing-2")


def _variant_views(pageviews: DataFrame, urls: Sequence[str], start: str, end: str) -> DataFrame:
    """Views of the variant URLs strictly between ``start`` and ``end``."""
    return pageviews.where(F.col("pageview_url").isin(list(urls)) & time_range(pageviews, start, end))


def _with_orders_of_views(views: DataFrame, orders: DataFrame, key: str) -> tuple[DataFrame, DataFrame]:
    """(materialised views, orders of the sessions in them).

    The views of a test window are few: they are checkpointed once and, when counted under
    the bound, their session ids are broadcast, so the order table is cut to those sessions
    without being shuffled.
    """
    v, fits = materialize_bounded(views)
    ids = v.where(F.col(key).isNotNull()).select(key)
    return v, orders.join(F.broadcast(ids) if fits else ids, key, "left_semi")


def page_variant_views(pageviews: DataFrame, orders: DataFrame, urls: Sequence[str],
                       start: str, end: str, *, key: str = SESSION_KEY) -> DataFrame:
    """One row per variant view and order of its session (views without orders kept)."""
    v, o = _with_orders_of_views(
        _variant_views(pageviews, urls, start, end).select(
            key, F.col("pageview_url").alias("billing_version_seen")), orders, key)
    return (v.join(o.select(key, "order_id", "price_usd"), key, "left")
            .select(key, "billing_version_seen", "order_id",
                    F.col("price_usd").cast("double").alias("price_usd")))


def _variant_sessions(pageviews: DataFrame, orders: DataFrame, urls: Sequence[str], start: str,
                      end: str, key: str) -> DataFrame:
    """(variant, session, views, session revenue): views pre-aggregated before the join."""
    v, o = _with_orders_of_views(
        _variant_views(pageviews, urls, start, end)
        .groupBy(F.col("pageview_url").alias("billing_version_seen"), key)
        .agg(F.count(F.col(key)).alias("n_views")), orders, key)
    return v.join(session_order_stats(o, key=key).select(key, "revenue"), key, "left")


def revenue_per_view(pageviews: DataFrame, orders: DataFrame, urls: Sequence[str], start: str,
                     end: str, *, key: str = SESSION_KEY) -> DataFrame:
    """Per variant: distinct sessions and ``SUM(price) / COUNT(DISTINCT session)`` over the
    view x order rows (a session's revenue counts once per view of the variant)."""
    per = _variant_sessions(pageviews, orders, urls, start, end, key)
    agg = per.groupBy("billing_version_seen").agg(
        F.count(F.col(key)).alias("sessions"),
        F.sum(F.col("revenue") * F.col("n_views")).alias("revenue"))
    return agg.select("billing_version_seen", "sessions",
                      ratio("revenue", "sessions").alias("revenue_per_billing_page_seen"))


def variant_view_count(pageviews: DataFrame, urls: Sequence[str], start: str, end: str, *,
                       key: str = SESSION_KEY) -> DataFrame:
    """``COUNT(website_session_id)`` of the variant views: views, not distinct sessions."""
    return (_variant_views(pageviews, urls, start, end)
            .agg(F.count(F.col(key)).alias("billing_session_last_mon")))


def variant_lift(pageviews: DataFrame, orders: DataFrame, base: str, variant: str, start: str,
                 end: str, *, count_urls: Sequence[str] | None = None,
                 key: str = SESSION_KEY) -> DataFrame:
    """One row: revenue per session of ``base`` and ``variant``, the lift (variant - base),
    the number of views of ``count_urls`` (default both pages) and lift x views.

    Everything comes from one pass over the variant views; no join of one-row results.
    """
    count_urls = tuple(count_urls or (base, variant))
    urls = tuple(dict.fromkeys((base, variant, *count_urls)))
    per = _variant_sessions(pageviews, orders, urls, start, end, key)
    per_version = per.groupBy("billing_version_seen").agg(
        F.count(F.col(key)).alias("sessions"),
        F.sum(F.col("revenue") * F.col("n_views")).alias("revenue"),
        F.sum("n_views").alias("views"))
    rpv = ratio("revenue", "sessions")
    version = F.col("billing_version_seen")
    out = per_version.agg(
        F.max(F.when(version == base, rpv)).alias("base_revenue_per_session"),
        F.max(F.when(version == variant, rpv)).alias("variant_revenue_per_session"),
        F.coalesce(F.sum(F.when(version.isin(list(count_urls)), F.col("views"))), F.lit(0))
        .cast("bigint").alias("billing_page_views"),
    )
    lift = F.col("variant_revenue_per_session") - F.col("base_revenue_per_session")
    return out.select("*", lift.alias("lift_per_session"),
                      (lift * F.col("billing_page_views")).alias("revenue_impact"))
