"""Landing-page conversion funnel: page flags, session flags, step counts, click rates."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from cartwheel.functions.semantics import flag, ratio
from cartwheel.operators.conversion import SESSION_KEY
from cartwheel.operators.joins import takes_at_most
from cartwheel.scratch import shared_table


@dataclass(frozen=True)
class FunnelSpec:
    """Names and URLs of a funnel. ``steps``: (url, page flag, session flag), in page order;
    ``segments``: (session flag, label), first match wins; ``counts``: (session flag, count
    name); ``rates``: (rate name, numerator count, denominator count)."""
    steps: tuple[tuple[str, str, str], ...]
    segments: tuple[tuple[str, str], ...]
    default_segment: str
    counts: tuple[tuple[str, str], ...]
    rates: tuple[tuple[str, str, str], ...]


# The landing-page funnel of the reference report.
LANDING_FUNNEL = FunnelSpec(
    steps=(
        ("/home", "homepage", "saw_homepage"),
        ("/lander-1", "custom_lander", "saw_custom_lander"),
        ("/products", "products_page", "product_made_it"),
        ("/the-original-mr-fuzzy", "mrfuzzy_page", "mrfuzzy_made_it"),
        ("/cart", "cart_page", "cart_made_it"),
        ("/shipping", "shipping_page", "shipping_made_it"),
        ("/billing", "billing_page", "billing_made_it"),
        ("/thank-you-for-your-order", "thankyou_page", "thankyou_made_it"),
    ),
    segments=(("saw_homepage", "saw_homepage"), ("saw_custom_lander", "saw_custom_lander")),
    default_segment="uh oh... check logic",
    counts=(
        ("product_made_it", "to_products"),
        ("mrfuzzy_made_it", "to_mrfuzzy"),
        ("cart_made_it", "to_cart"),
        ("shipping_made_it", "to_shipping"),
        ("billing_made_it", "to_billing"),
        ("thankyou_made_it", "to_thankyou"),
    ),
    rates=(
        ("lander_click_rt", "to_products", "sessions"),
        ("products_click_rt", "to_mrfuzzy", "to_products"),
        ("mrfuzzy_click_rt", "to_cart", "to_mrfuzzy"),
        ("cart_click_rt", "to_shipping", "to_cart"),
        ("shipping_click_rt", "to_billing", "to_shipping"),
        ("billing_click_rt", "to_thankyou", "to_billing"),
    ),
)


def _page_flags(spec: FunnelSpec) -> list[Column]:
    url = F.col("pageview_url")
    return [flag(url == step_url).alias(page_flag) for step_url, page_flag, _ in spec.steps]


def views_of(chosen: DataFrame, pageviews: DataFrame, spec: FunnelSpec = LANDING_FUNNEL, *, key: str = SESSION_KEY) -> DataFrame:
    """The page views of the stored session ids ``chosen``, with flags.

    The ids are broadcast when measured under ``MAX_BROADCAST_BYTES``, so that page views are cut
    without being shuffled.
    """
    views = pageviews.select(key, "pageview_url", F.col("created_at").alias("viewed_at"))
    views = views.join(F.broadcast(chosen) if takes_at_most(chosen) else chosen, key, "left_semi")
    return views.select(key, "pageview_url", "viewed_at", *_page_flags(spec))


def _chosen(sessions: DataFrame, pageviews: DataFrame, where: Column, spec: FunnelSpec, key: str) -> tuple[DataFrame, DataFrame]:
    """(ids of the chosen sessions, their page views with flags), each stored once for all
    statements of the funnel in a scope."""
    s = shared_table(sessions.where(where).select(key), "funnel-sessions")
    return s, shared_table(views_of(s, pageviews, spec, key=key), "funnel-views")


def funnel_pageviews(sessions: DataFrame, pageviews: DataFrame, where: Column,
                     spec: FunnelSpec = LANDING_FUNNEL, *, key: str = SESSION_KEY,
                     sessions_unique: bool = True) -> DataFrame:
    """One row per page view of the chosen sessions with a 0/1 flag per funnel step,
    ordered by session and view time. A session without views gives one all-zero row.

    Where the session id is not unique, a view stands once for each of its session's rows."""
    s, views = _chosen(sessions, pageviews, where, spec, key)
    names = [page_flag for _, page_flag, _ in spec.steps]
    if sessions_unique:  # views need no join: they are those of the chosen sessions already
        bare = s.join(views.select(key).distinct(), key, "left_anti")
        rows = views.unionByName(bare, allowMissingColumns=True)
    else:
        rows = s.join(views, key, "left")
    return (rows.orderBy(F.col(key), F.col("viewed_at"))
            .select(key, "pageview_url", *[F.coalesce(F.col(n), F.lit(0)).alias(n) for n in names]))


def funnel_sessions(sessions: DataFrame, pageviews: DataFrame, where: Column,
                    spec: FunnelSpec = LANDING_FUNNEL, *, key: str = SESSION_KEY,
                    sessions_unique: bool = True) -> DataFrame:
    """One row per chosen session: 1 when the session ever reached each step.

    The views of the chosen sessions are reduced to one row per session with a partial
    aggregation, then attached to the sessions; stored once for all statements of the funnel.
    """
    s, views = _chosen(sessions, pageviews, where, spec, key)
    per_session = views.groupBy(key).agg(*[
        F.max(page_flag).alias(session_flag) for _, page_flag, session_flag in spec.steps])
    names = [session_flag for _, _, session_flag in spec.steps]
    rows = (s if sessions_unique else s.distinct()).join(per_session, key, "left")
    return shared_table(rows.select(key, *[F.coalesce(F.col(n), F.lit(0)).alias(n) for n in names]), "funnel-flags")


def segment_column(spec: FunnelSpec = LANDING_FUNNEL) -> Column:
    seg = None
    for session_flag, label in spec.segments:
        cond = F.col(session_flag) == 1
        seg = F.when(cond, F.lit(label)) if seg is None else seg.when(cond, F.lit(label))
    return seg.otherwise(F.lit(spec.default_segment))


def funnel_counts(flags: DataFrame, spec: FunnelSpec = LANDING_FUNNEL, *,
                  key: str = SESSION_KEY) -> DataFrame:
    """Sessions per segment and how many reached each step.

    ``flags`` has one row per session, so ``COUNT(DISTINCT CASE WHEN f = 1 THEN id END)``
    equals ``SUM(f)`` over rows with an id: one aggregation without an ``Expand`` per
    distinct count.
    """
    has_id = F.col(key).isNotNull()
    return flags.groupBy(segment_column(spec).alias("segment")).agg(
        F.count(F.col(key)).alias("sessions"),
        *[F.coalesce(F.sum(F.when(has_id, F.col(session_flag))), F.lit(0)).cast("bigint").alias(name)
          for session_flag, name in spec.counts])


def funnel_rates(counts: DataFrame, spec: FunnelSpec = LANDING_FUNNEL) -> DataFrame:
    """Each step's sessions divided by the previous step's; NULL when the previous is 0."""
    return counts.select("segment", *[ratio(num, den).alias(name) for name, num, den in spec.rates])
