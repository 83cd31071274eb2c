"""Keys proven at ingest, refused tables, and reports on tables without a proof."""

import json
import os
import random
from datetime import datetime
from decimal import Decimal

import pytest

from cartwheel.operators.conversion import conversion_measures
from cartwheel.plans import reports
from cartwheel.sources.proof import MANIFEST, fingerprint, proven_key, recount
from cartwheel.sources.schemas import ORDERS, WEBSITE_PAGEVIEWS, WEBSITE_SESSIONS
from cartwheel.sources.shop import ingest_csv, read_shop_tables

HEAD = "website_pageview_id,created_at,website_session_id,pageview_url\n"
T0 = datetime(2024, 3, 1)


def _csv(folder, rows, name="pv.csv"):
    path = folder / name
    path.write_text(HEAD + "".join(f"{i},2012-03-19 10:00:00,7,/home\n" for i in rows))
    return str(path)


def test_an_ingested_table_carries_its_proof(spark, tmp_path):
    out = str(tmp_path / "shop" / "website_pageviews")
    ingest_csv(spark, "website_pageviews", _csv(tmp_path, range(30)), out, partition_by_month=True)
    assert proven_key(spark, out) == "website_pageview_id" and recount(spark, out)
    assert read_shop_tables(spark, str(tmp_path / "shop")).unique_key("website_pageviews") == "website_pageview_id"
    with open(os.path.join(out, MANIFEST)) as f:
        assert json.load(f)["rows"] == 30
    assert spark.read.parquet(out).count() == 30
    assert os.listdir(tmp_path / "shop") == ["website_pageviews"]


def test_a_refused_table_is_never_readable(spark, tmp_path):
    shop = tmp_path / "shop"
    out = str(shop / "website_pageviews")
    repeated = _csv(tmp_path, [1, 2, 2], "bad.csv")
    with pytest.raises(ValueError, match="website_pageview_id is repeated"):
        ingest_csv(spark, "website_pageviews", repeated, out)
    assert not os.path.exists(out) and os.listdir(shop) == []
    ingest_csv(spark, "website_pageviews", _csv(tmp_path, range(5)), out)
    with pytest.raises(ValueError, match="left as it was"):
        ingest_csv(spark, "website_pageviews", repeated, out)
    assert spark.read.parquet(out).count() == 5 and proven_key(spark, out) == "website_pageview_id"
    ingest_csv(spark, "website_pageviews", _csv(tmp_path, range(9)), out)
    assert spark.read.parquet(out).count() == 9 and os.listdir(shop) == ["website_pageviews"]


def test_a_failed_swap_puts_the_old_table_back(spark, tmp_path, monkeypatch):
    from cartwheel.sources import proof
    out = str(tmp_path / "shop" / "website_pageviews")
    ingest_csv(spark, "website_pageviews", _csv(tmp_path, range(5)), out)
    rename = proof._Files.rename

    def failing(self, old, new):
        if "_staged-" in old:
            raise OSError("lost")
        rename(self, old, new)

    monkeypatch.setattr(proof._Files, "rename", failing)
    with pytest.raises(OSError, match="lost"):
        ingest_csv(spark, "website_pageviews", _csv(tmp_path, range(9)), out)
    assert spark.read.parquet(out).count() == 5 and os.listdir(tmp_path / "shop") == ["website_pageviews"]


def test_changed_files_have_no_proof(spark, tmp_path):
    out = str(tmp_path / "t")
    ingest_csv(spark, "website_pageviews", _csv(tmp_path, range(5)), out)
    spark.read.parquet(out).limit(1).write.mode("append").parquet(out)
    assert proven_key(spark, out) is None and not recount(spark, out)
    assert proven_key(spark, str(tmp_path / "missing")) is None


def test_fingerprint_ignores_order_and_sees_changes(spark):
    rows = [(i, str(i % 3), None if i % 5 else 1.5) for i in range(100)]
    schema = "a long, b string, c double"
    one = fingerprint(spark.createDataFrame(rows, schema))
    assert fingerprint(spark.createDataFrame(rows[::-1], schema).repartition(7)) == one
    assert fingerprint(spark.createDataFrame(rows[1:] + rows[:1] * 2, schema)) != one
    assert fingerprint(spark.createDataFrame([(0, "1", 1.5), *rows[1:]], schema)) != one


def _tables(spark, rnd):
    """Sessions repeated, orders repeated within and across sessions."""
    campaigns = ["nonbrand", "brand", None]
    sessions = [(rnd.randint(1, 25), datetime(2024, rnd.randint(1, 4), 5), 1, 0, "gsearch", rnd.choice(campaigns), None, "mobile", None)
                for _ in range(60)]
    sessions.append((None, T0, 1, 0, "gsearch", "brand", None, "mobile", None))
    orders = [(rnd.randint(1, 30), T0, rnd.randint(1, 30), None, Decimal(rnd.randint(100, 9999)) / 100) for _ in range(60)]
    views = [(i, datetime(2024, 2, 1, 0, i % 60), rnd.randint(1, 25), rnd.choice(["/home", "/lander-1", "/products", "/cart"])) for i in range(120)]
    return {"website_sessions": spark.createDataFrame(sessions, WEBSITE_SESSIONS), "orders": spark.createDataFrame(orders, ORDERS),
            "website_pageviews": spark.createDataFrame(views, WEBSITE_PAGEVIEWS)}


def _direct(spark, t, dim, facts):
    for name in (facts, "orders"):
        t[name].createOrReplaceTempView(f"proof_{name}")
    return spark.sql(f"""
        SELECT f.{dim}, COUNT(DISTINCT f.website_session_id), COUNT(DISTINCT o.order_id), SUM(o.price_usd)
        FROM proof_{facts} f LEFT JOIN proof_orders o ON f.website_session_id = o.website_session_id GROUP BY 1""").collect()


@pytest.mark.parametrize("facts, dim", [("website_sessions", "utm_campaign"), ("website_pageviews", "pageview_url")])
def test_without_proofs_distinct_values_are_counted(spark, facts, dim):
    for seed in range(3):
        t = _tables(spark, random.Random(seed))
        got = conversion_measures(t[facts], t["orders"], [dim], facts_unique_per_key=False, orders_unique=False, distinct_orders=True)
        want = {r[0]: (r[1], r[2], None if r[3] is None else float(r[3])) for r in _direct(spark, t, dim, facts)}
        assert {r[dim]: (r["total_sessions"], r["total_orders"], r["total_revenue"]) for r in got.collect()} == want


def test_reports_on_tables_without_a_proof(spark):
    """A plain dict proves nothing: the reports give what the distinct counts say."""
    t = _tables(spark, random.Random(11))
    want = {r[0]: r[1] for r in _direct(spark, t, "utm_campaign", "website_sessions")}
    assert {r["traffic_source"]: r["total_sessions"] for r in reports.traffic_channel(t).collect()} == want
    orders = {r[0]: r[2] for r in _direct(spark, t, "pageview_url", "website_pageviews")}
    assert {r["pageview_url"]: r["total_orders"] for r in reports.page_order_effect(t).collect()} == orders
    t["website_sessions"].createOrReplaceTempView("proof_s")
    months = spark.sql("""SELECT date_format(created_at, 'yyyy-MM-01'), COUNT(DISTINCT website_session_id) FROM proof_s
                          WHERE utm_source IS NOT NULL GROUP BY 1""").collect()
    assert {r["month"]: r["total_sessions"] for r in reports.channel_monthly_conversion(t).collect()} == {r[0]: r[1] for r in months}


def test_funnel_of_repeated_sessions(spark):
    from pyspark.sql import functions as F

    from cartwheel.operators import funnel
    t = _tables(spark, random.Random(12))
    args = (t["website_sessions"], t["website_pageviews"], F.lit(True))
    flags = funnel.funnel_sessions(*args, sessions_unique=False)
    assert flags.count() == flags.select("website_session_id").distinct().count()
    s, v = t["website_sessions"], t["website_pageviews"]
    assert funnel.funnel_pageviews(*args, sessions_unique=False).count() == s.join(v, "website_session_id", "left").count()
