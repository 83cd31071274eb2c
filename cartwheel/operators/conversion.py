"""Session -> order conversion measures (traffic, campaign, page and channel reports).

Plan shape, whatever the dimensions:

1. ``orders`` is reduced to one row per session (count, distinct count, revenue) with a
   map-side partial aggregation, so a session with very many orders never reaches a join as
   raw rows.
2. The facts (sessions or page views) are reduced to one row per (dimensions, session),
   carrying how many fact rows were merged (``n_rows``). Session tables with a unique id skip
   this step.
3. The two are joined one-to-one on the session id and aggregated by the dimensions (again
   partial + final).

This reproduces the reference's join-then-aggregate results exactly, including its revenue
fan-out (a session that viewed a URL twice counts its orders' revenue twice), without the
``Expand`` of several ``COUNT(DISTINCT)`` in one group and without shuffling raw order rows
per fact row. Two keys may be relied on where they are proven (``sources.proof``): with
``orders_unique`` an ``order_id`` belongs to one session, and with ``facts_unique_per_key`` the
session id is unique in the facts. Without the proofs the plan counts distinct values: step 2 runs,
and distinct orders are counted over (dimensions, order) pairs.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from cartwheel.functions.semantics import ratio

SESSION_KEY = "website_session_id"


Dim = str | tuple[str, Column]


def named_dims(dims: Sequence[Dim]) -> tuple[list[Column], list[str]]:
    """Dimensions are column names or ``(name, expression)`` pairs."""
    cols, names = [], []
    for d in dims:
        name, expr = (d, F.col(d)) if isinstance(d, str) else d
        cols.append(expr.alias(name))
        names.append(name)
    return cols, names


def session_order_stats(orders: DataFrame, *, key: str = SESSION_KEY,
                        distinct_orders: bool = False) -> DataFrame:
    """One row per session: ``n_orders`` (non-null order ids), ``revenue`` and, if asked,
    ``n_distinct_orders``."""
    aggs = [F.count("order_id").alias("n_orders"), F.sum("price_usd").alias("revenue")]
    if distinct_orders:
        aggs.append(F.count_distinct("order_id").alias("n_distinct_orders"))
    return orders.groupBy(key).agg(*aggs)


def conversion_measures(facts: DataFrame, orders: DataFrame, dims: Sequence[Dim], *,
                        key: str = SESSION_KEY, where: Column | None = None,
                        facts_unique_per_key: bool = True, orders_unique: bool = True,
                        distinct_orders: bool = False, dedupe_revenue: bool = False) -> DataFrame:
    """``facts LEFT JOIN orders USING (key)`` aggregated by ``dims``.

    Output: the dimension columns, ``total_sessions`` (distinct sessions), ``total_orders``
    (``COUNT(order_id)``, or ``COUNT(DISTINCT order_id)`` with ``distinct_orders``) and
    ``total_revenue`` (``SUM(price_usd)``, NULL for a group without orders). With
    ``dedupe_revenue`` the revenue of a session counts once per group instead of once per
    joined fact row.
    """
    dim_cols, dim_names = named_dims(dims)
    f = facts if where is None else facts.where(where)
    projected = f.select(*dim_cols, F.col(key))
    if facts_unique_per_key:
        grain = projected.withColumn("n_rows", F.lit(1).cast("bigint"))
    else:
        grain = projected.groupBy(*dim_names, key).agg(F.count(F.lit(1)).alias("n_rows"))
    stats = session_order_stats(orders, key=key, distinct_orders=distinct_orders and orders_unique)
    joined = grain.join(stats, key, "left")
    if distinct_orders and not orders_unique:
        measures = _measures(joined, dim_names, key, F.lit(0), _revenue(facts_unique_per_key or dedupe_revenue))
        return _with_distinct_orders(measures.drop("total_orders"), grain, orders, dim_names, key)
    if distinct_orders:
        order_count = F.coalesce(F.col("n_distinct_orders"), F.lit(0))
    elif facts_unique_per_key:
        order_count = F.coalesce(F.col("n_orders"), F.lit(0))
    else:
        order_count = F.coalesce(F.col("n_orders"), F.lit(0)) * F.col("n_rows")
    return _measures(joined, dim_names, key, order_count, _revenue(facts_unique_per_key or dedupe_revenue))


def _revenue(once: bool) -> Column:
    return F.col("revenue") if once else F.col("revenue") * F.col("n_rows")


def _measures(joined: DataFrame, dim_names: Sequence[str], key: str, order_count: Column, revenue: Column) -> DataFrame:
    return joined.groupBy(*dim_names).agg(
        F.count(F.col(key)).alias("total_sessions"),  # COUNT(DISTINCT key): NULL ids excluded
        F.sum(order_count).cast("bigint").alias("total_orders"),
        F.sum(revenue).cast("double").alias("total_revenue"),
    )


def _with_distinct_orders(measures: DataFrame, grain: DataFrame, orders: DataFrame, dim_names: Sequence[str],
                          key: str) -> DataFrame:
    """``total_orders`` as ``COUNT(DISTINCT order_id)`` where one order id may be in many sessions:
    distinct (dimensions, order) pairs, reduced in the tasks before they are shuffled."""
    pairs = orders.where(F.col("order_id").isNotNull()).select(key, "order_id").distinct()
    per = (grain.select(*dim_names, key).join(pairs, key).select(*dim_names, "order_id").distinct()
           .groupBy(*(F.col(d).alias(f"_{i}") for i, d in enumerate(dim_names))).agg(F.count(F.lit(1)).alias("_orders")))
    same = [F.col(d).eqNullSafe(F.col(f"_{i}")) for i, d in enumerate(dim_names)]
    out = measures.join(per, same, "left")
    return out.select(*dim_names, "total_sessions", F.coalesce("_orders", F.lit(0)).cast("bigint").alias("total_orders"), "total_revenue")


def conversion_report(facts: DataFrame, orders: DataFrame, dims: Sequence[Dim], *,
                      key: str = SESSION_KEY, where: Column | None = None,
                      facts_unique_per_key: bool = True, distinct_orders: bool = False,
                      dedupe_revenue: bool = False, ratio_scale: float = 1.0,
                      on_zero: float | None = 0.0, order_by: Sequence[Column] = ()) -> DataFrame:
    """``conversion_measures`` plus ``conversion_rate`` (orders / sessions x ``ratio_scale``)
    and ``average_order_value`` (revenue / orders); a zero denominator gives ``on_zero``
    (0 for the guarded reports, None for the unguarded ones)."""
    m = conversion_measures(facts, orders, dims, key=key, where=where,
                            facts_unique_per_key=facts_unique_per_key,
                            distinct_orders=distinct_orders, dedupe_revenue=dedupe_revenue)
    rate = ratio("total_orders", "total_sessions", on_zero)
    out = m.select("*", (rate * F.lit(float(ratio_scale)) if ratio_scale != 1 else rate).alias("conversion_rate"),
                   ratio("total_revenue", "total_orders", on_zero).alias("average_order_value"))
    return out.orderBy(*order_by) if order_by else out
