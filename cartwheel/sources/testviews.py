"""The web-shop tables and cleaning inputs, derived from the driver's test tables.

The reference's own input files are not public, so FIXTURES.md §2 defines views over
``/root/testdata``: one session per user and day of ``events``, its page views, purchases as
orders, ``part`` as products, ``lineitem`` as order items and refunds. Event times are
stretched to 13 months so monthly reports have more than one period. The DuckDB text of the
same views is in ``cartwheel.plans.oracle``.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator, Mapping

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from cartwheel.functions.semantics import money
from cartwheel.sources.shop import normalise_dimensions


_READS: dict[tuple[int, str], DataFrame] = {}


def _read(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """``spark.read.parquet`` of a test table, defined once per session (the inputs are
    read-only, so the file listing and schema inference need not be repeated)."""
    path = f"{sf_dir.rstrip('/')}/{name}.parquet"
    key = (id(spark), path)
    df = _READS.get(key)
    if df is None or df.sparkSession is not spark:
        df = _READS[key] = spark.read.parquet(path)
    return df


class LazyTables(Mapping):
    """Table name -> DataFrame, each defined on first use and then reused.

    Defining a DataFrame costs a file listing and an analysis on the driver; a report that
    reads two tables should not pay for seven.
    """

    def __init__(self, builders: dict[str, Callable[[], DataFrame]], unique_key: Callable[[str], str | None] = lambda name: None):
        self._builders = builders
        self._built: dict[str, DataFrame] = {}
        self._unique_key = unique_key
        self._keys: dict[str, str | None] = {}

    def __getitem__(self, name: str) -> DataFrame:
        if name not in self._built:
            self._built[name] = self._builders[name]()
        return self._built[name]

    def unique_key(self, name: str) -> str | None:
        """The column proven unique in a table, looked up on first use; None without a proof."""
        if name not in self._keys:
            self._keys[name] = self._unique_key(name)
        return self._keys[name]

    def __iter__(self) -> Iterator[str]:
        return iter(self._builders)

    def __len__(self) -> int:
        return len(self._builders)


def events(spark: SparkSession, sf_dir: str) -> DataFrame:
    """``events`` with session id ``sid``, the integer ``k`` of ``props`` and stretched time."""
    ev = _read(spark, sf_dir, "events")
    return ev.select(
        "event_id", "user_id", "event_type", "value",
        (F.col("user_id") * 100 + F.dayofmonth("ts")).alias("sid"),
        F.get_json_object("props", "$.k").cast("int").alias("k"),
        F.expr("ts + make_dt_interval(12 * (day(ts) - 1))").alias("ts"),
    )


def website_sessions(spark: SparkSession, sf_dir: str) -> DataFrame:
    ev = events(spark, sf_dir)
    s = ev.groupBy("sid").agg(
        F.min("ts").alias("created_at"),
        F.min("user_id").alias("user_id"),
        F.min_by("k", "event_id").alias("k0"),
    )
    k0 = F.col("k0")
    df = s.select(
        F.col("sid").alias("website_session_id"),
        "created_at",
        "user_id",
        (k0 % 2).cast("int").alias("is_repeat_session"),
        F.when(k0 % 4 == 0, "gsearch").when(k0 % 4 == 1, "GSearch").when(k0 % 4 == 2, "bsearch")
        .alias("utm_source"),
        F.when(k0 % 3 == 0, "nonbrand").when(k0 % 3 == 1, "brand").otherwise("pilot")
        .alias("utm_campaign"),
        F.lit(None).cast("string").alias("utm_content"),
        F.when(k0 < 50, "mobile").otherwise("desktop").alias("device_type"),
        F.when(k0 % 5 == 0, F.lit(None)).when(k0 % 5 == 1, "https://brand.example")
        .otherwise("https://www.gsearch.com").alias("http_referer"),
    )
    return normalise_dimensions(df, "website_sessions")


def website_pageviews(spark: SparkSession, sf_dir: str) -> DataFrame:
    ev = events(spark, sf_dir)
    odd = F.col("event_id") % 2 == 1
    url = (F.when(F.col("event_type") == "view", F.when(odd, "/lander-1").otherwise("/home"))
           .when(F.col("event_type") == "click", "/products")
           .when(F.col("event_type") == "signup", "/cart")
           .when(F.col("event_type") == "error", F.when(odd, "/billing-2").otherwise("/billing"))
           .when(F.col("event_type") == "purchase", "/thank-you-for-your-order"))
    df = ev.select(
        F.col("event_id").alias("website_pageview_id"),
        F.col("ts").alias("created_at"),
        F.col("sid").alias("website_session_id"),
        url.alias("pageview_url"),
    )
    return normalise_dimensions(df, "website_pageviews")


def web_orders(spark: SparkSession, sf_dir: str) -> DataFrame:
    ev = events(spark, sf_dir)
    return ev.where(F.col("event_type") == "purchase").select(
        F.col("event_id").alias("order_id"),
        F.col("ts").alias("created_at"),
        F.col("sid").alias("website_session_id"),
        money("value").alias("price_usd"),
    )


def products(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _read(spark, sf_dir, "part").select(
        F.col("p_partkey").alias("product_id"), F.col("p_name").alias("product_name"))


def _item_key() -> F.Column:
    return F.concat_ws("-", *[F.col(c).cast("string") for c in
                              ("l_orderkey", "l_linenumber", "l_partkey", "l_suppkey")])


def order_items(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _read(spark, sf_dir, "lineitem").select(
        _item_key().alias("order_item_id"),
        F.col("l_orderkey").alias("order_id"),
        F.col("l_partkey").alias("product_id"),
        money("l_extendedprice").alias("price_usd"),
    )


def order_item_refunds(spark: SparkSession, sf_dir: str) -> DataFrame:
    li = _read(spark, sf_dir, "lineitem").where(F.col("l_returnflag") == "R")
    return li.select(
        _item_key().alias("order_item_refund_id"),
        _item_key().alias("order_item_id"),
        F.col("l_orderkey").alias("order_id"),
        money("l_extendedprice").alias("refund_amount_usd"),
    )


def shop_orders(spark: SparkSession, sf_dir: str) -> DataFrame:
    """TPC-H orders with a primary product (smallest part key of the order's lines)."""
    primary = (_read(spark, sf_dir, "lineitem").groupBy("l_orderkey")
               .agg(F.min("l_partkey").alias("primary_product_id")))
    o = _read(spark, sf_dir, "orders")
    return o.join(primary, o.o_orderkey == primary.l_orderkey).select(
        F.col("o_orderkey").alias("order_id"),
        F.col("o_orderdate").alias("created_at"),
        "primary_product_id",
        money("o_totalprice").alias("price_usd"),
    )


# Unique by construction: sessions are grouped by their id, an order is one event of one session.
VIEW_KEYS = {"website_sessions": "website_session_id", "orders": "order_id"}


def shop_tables(spark: SparkSession, sf_dir: str) -> Mapping[str, DataFrame]:
    """All web-shop tables, each defined when a report first asks for it."""
    return LazyTables({
        "website_sessions": lambda: website_sessions(spark, sf_dir),
        "website_pageviews": lambda: website_pageviews(spark, sf_dir),
        "orders": lambda: web_orders(spark, sf_dir),
        "products": lambda: products(spark, sf_dir),
        "order_items": lambda: order_items(spark, sf_dir),
        "order_item_refunds": lambda: order_item_refunds(spark, sf_dir),
        "shop_orders": lambda: shop_orders(spark, sf_dir),
    }, VIEW_KEYS.get)


# ---------------------------------------------------------------- cleaning inputs

def register(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A company-register-like table with missing values of every kind (FIXTURES.md §2).

    text 0-30 % missing (``o_orderpriority``), numeric missing (``c_acctbal``), datetime
    missing (``o_orderdate``), a date held as text with bad values (``reg_date``), and a
    column missing in more than 30 % of rows (``label_quality``).
    """
    o = _read(spark, sf_dir, "orders")
    c = _read(spark, sf_dir, "customer")
    lab = _read(spark, sf_dir, "labels")
    j = (o.join(c, o.o_custkey == c.c_custkey, "left")
         .join(lab, o.o_orderkey == lab.doc_id, "left"))
    missing_date = F.col("o_orderkey") % 11 == 0
    return j.select(
        "o_orderkey", "o_custkey", "o_orderstatus", "o_totalprice",
        F.when(missing_date, F.lit(None)).otherwise(F.col("o_orderdate")).alias("o_orderdate"),
        F.when(F.col("o_orderpriority") == "4-NOT SPECIFIED", F.lit(None))
        .otherwise(F.col("o_orderpriority")).alias("o_orderpriority"),
        "c_mktsegment",
        F.when(F.col("c_acctbal") < 0, F.lit(None)).otherwise(F.col("c_acctbal")).alias("c_acctbal"),
        F.col("quality").alias("label_quality"),
        F.when(F.col("o_orderkey") % 17 == 0, F.lit("n/a"))
        .when(missing_date, F.lit(None))
        .otherwise(F.date_format("o_orderdate", "yyyy-MM-dd")).alias("reg_date"),
    )


def doc_labels(spark: SparkSession, sf_dir: str) -> DataFrame:
    """``documents`` left-joined to ``labels``: quality and toxic are mostly missing."""
    d = _read(spark, sf_dir, "documents")
    lab = _read(spark, sf_dir, "labels")
    return d.join(lab, "doc_id", "left")


def documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _read(spark, sf_dir, "documents")


def event_values(spark: SparkSession, sf_dir: str) -> DataFrame:
    """``events`` as read: ``value`` has a long tail (the outlier input)."""
    return _read(spark, sf_dir, "events")
