"""Hot keys (a third of all rows on one session / URL / group) give the results counted
by hand over every fact row and order."""

import random
from datetime import datetime, timedelta
from decimal import Decimal

from pyspark.sql import functions as F

from cartwheel.operators import impute
from cartwheel.operators.conversion import conversion_measures
from cartwheel.sources.schemas import ORDERS, WEBSITE_PAGEVIEWS, WEBSITE_SESSIONS

T0 = datetime(2024, 3, 1)


def _fixture(spark):
    rnd = random.Random(7)
    sess = [(s, T0, s, 0, "gsearch", rnd.choice(["brand", "nonbrand"]), None, "mobile", None)
            for s in range(1, 301)]
    pv = []
    for i in range(3000):
        sid = 1 if i % 3 == 0 else rnd.randint(2, 300)        # session 1: a third of the views
        url = "/home" if i % 3 != 1 else rnd.choice(["/cart", "/products", "/billing"])
        pv.append((i, T0 + timedelta(seconds=i), sid, url))
    orders = [(10_000 + i, T0, 1 if i < 40 else rnd.randint(2, 300), None, Decimal(rnd.randint(100, 9999)) / 100)
              for i in range(120)]
    return (spark.createDataFrame(sess, WEBSITE_SESSIONS), spark.createDataFrame(pv, WEBSITE_PAGEVIEWS),
            spark.createDataFrame(orders, ORDERS))


def _expected(facts, orders, dim):
    """Measures by hand: every fact row meets every order of its session."""
    per_session = {}
    for o in orders:
        per_session.setdefault(o["website_session_id"], []).append(o)
    groups = {}
    for f in facts:
        g = groups.setdefault(f[dim], {"sessions": set(), "orders": [], "money": Decimal(0)})
        g["sessions"].add(f["website_session_id"])
        for o in per_session.get(f["website_session_id"], []):
            g["orders"].append(o["order_id"])
            g["money"] += o["price_usd"]
    return groups


def test_pages_with_hot_session_and_url(spark):
    _, pv, o = _fixture(spark)
    want = _expected(pv.collect(), o.collect(), "pageview_url")
    got = conversion_measures(pv, o, ["pageview_url"], facts_unique_per_key=False, distinct_orders=True).collect()
    assert {r["pageview_url"]: (r["total_sessions"], r["total_orders"], r["total_revenue"]) for r in got} == {
        url: (len(g["sessions"]), len(set(g["orders"])), float(g["money"])) for url, g in want.items()}


def test_sessions_with_hot_session(spark):
    s, _, o = _fixture(spark)
    want = _expected(s.collect(), o.collect(), "utm_campaign")
    got = conversion_measures(s, o, ["utm_campaign"]).collect()
    assert {r["utm_campaign"]: (r["total_sessions"], r["total_orders"], r["total_revenue"]) for r in got} == {
        name: (len(g["sessions"]), len(g["orders"]), float(g["money"])) for name, g in want.items()}


def test_group_mean_with_hot_group(spark):
    rows = [("hot" if i % 3 else f"k{i % 50}", None if i % 7 == 0 else T0 + timedelta(days=i))
            for i in range(3000)]
    df = spark.createDataFrame(rows, "key string, d timestamp_ntz").repartition(8)
    out = impute.impute_group_mean_datetime(df, "d", "key")
    assert out.count() == 3000 and out.where(F.col("d").isNull()).count() == 0
    means = {r["key"]: r["_mean"] for r in impute.group_mean_datetime(df, "d", "key").collect()}
    hot = [T0 + timedelta(days=i) for i in range(3000) if i % 3 and i % 7]
    micros = sum((t - datetime(1970, 1, 1)) // timedelta(microseconds=1) for t in hot) // len(hot)
    assert means["hot"] == datetime(1970, 1, 1) + timedelta(microseconds=micros)
