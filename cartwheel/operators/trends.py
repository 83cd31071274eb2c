"""Period trends: counts per period key (and dimensions), alone or with orders attached."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from cartwheel.functions.semantics import MONTH, period_key
from cartwheel.operators.conversion import SESSION_KEY, Dim, named_dims


def ts_literal(value: str) -> Column:
    """A zone-less timestamp literal (``'2012-08-31'`` is midnight, as in MySQL)."""
    return F.lit(value).cast("timestamp_ntz")


PARTITION_MONTH = "created_month"


def time_range(df: DataFrame, start: str, end: str, *, column: str = "created_at",
               closed: bool = False) -> Column:
    """``start < column < end`` (``closed``: ``BETWEEN start AND end``) on zone-less times.

    When ``df`` is a table written by ``ingest_csv(partition_by_month=True)`` the same range is
    also stated on its ``created_month`` folders, so Spark skips the folders outside it.
    """
    ts = F.col(column)
    lo, hi = ts_literal(start), ts_literal(end)
    cond = ts.between(lo, hi) if closed else (ts > lo) & (ts < hi)
    if column == "created_at" and PARTITION_MONTH in df.columns:
        month = F.col(PARTITION_MONTH)
        cond = cond & (month >= F.lit(start[:7])) & (month <= F.lit(end[:7]))
    return cond


def period_trend(df: DataFrame, ts: str, fmt: str = MONTH, *, dims: Sequence[Dim] = (),
                 where: Column | None = None, count_col: str | None = None,
                 name: str = "total", period_name: str = "month") -> DataFrame:
    """``GROUP BY date_format(ts, fmt), dims`` with ``COUNT(count_col)`` (``COUNT(*)`` if None)."""
    f = df if where is None else df.where(where)
    cols, names = named_dims([(period_name, period_key(ts, fmt)), *dims])
    measure = F.count(F.lit(1)) if count_col is None else F.count(F.col(count_col))
    extra = [] if count_col is None or count_col in names else [F.col(count_col)]
    return f.select(*cols, *extra).groupBy(*names).agg(measure.alias(name))


def order_counts_by_session_dims(orders: DataFrame, sessions: DataFrame, fmt: str = MONTH, *,
                                 dims: Sequence[str] = (), where: Column | None = None,
                                 name: str = "total_orders", key: str = SESSION_KEY,
                                 period_name: str = "month") -> DataFrame:
    """``COUNT(order_id)`` per (order period, session dims) over ``orders JOIN sessions``.

    Orders are first reduced to one row per (session, order period) with a partial
    aggregation, so the join sees at most one row per session and period however many
    orders a session has; the filtered sessions contribute only the key and the dimensions.
    """
    per = (orders.select(key, period_key("created_at", fmt).alias(period_name), "order_id")
           .groupBy(key, period_name).agg(F.count("order_id").alias("_n")))
    s = sessions if where is None else sessions.where(where)
    s = s.select(F.col(key), *[F.col(c) for c in dims if c != key])
    return (per.join(s, key, "inner").groupBy(period_name, *dims)
            .agg(F.sum("_n").cast("bigint").alias(name)))


def sessions_and_orders_trend(sessions: DataFrame, orders: DataFrame, fmt: str = MONTH, *,
                              dims: Sequence[str] = (), where: Column | None = None,
                              session_name: str = "total_sessions",
                              order_name: str = "total_orders", key: str = SESSION_KEY,
                              period_name: str = "month") -> DataFrame:
    """Sessions per (period, dims) left-joined to orders of those sessions per
    (order period, dims); missing order counts are 0.

    The session period comes from the session time and the order period from the order time;
    periods that have orders but no sessions are dropped by the left join, as in the
    reference.
    """
    s = period_trend(sessions, "created_at", fmt, dims=dims, where=where, count_col=key,
                     name=session_name, period_name=period_name)
    o = order_counts_by_session_dims(orders, sessions, fmt, dims=dims, where=where, name=order_name,
                                     key=key, period_name=period_name)
    keys = [period_name, *dims]
    return (s.join(o, keys, "left")
            .select(*keys, session_name, F.coalesce(F.col(order_name), F.lit(0)).alias(order_name)))


def filter_sessions(sessions: DataFrame, column: str, value: str) -> DataFrame:
    """Sessions whose ``column`` equals ``value`` (case-insensitive: the stored dimension
    columns are lower-case, so the literal is lowered and the filter reaches the scan)."""
    found = sessions.where(F.col(column) == F.lit(value.lower()))
    return found.drop(PARTITION_MONTH)  # a folder name, not a column of the table
