"""Trap rows for the report operators (FIXTURES.md §3)."""

from datetime import datetime
from decimal import Decimal

from pyspark.sql import functions as F

from cartwheel.operators import abtest, funnel
from cartwheel.operators.conversion import conversion_measures
from cartwheel.operators.pages import count_report
from cartwheel.operators.sales import product_success
from cartwheel.plans import reports
from cartwheel.sources.schemas import ORDERS, WEBSITE_PAGEVIEWS, WEBSITE_SESSIONS
from cartwheel.sources.shop import duplicate_keys, normalise_dimensions

T0 = datetime(2024, 7, 1, 12, 0)


def sessions(spark, rows):
    full = [(sid, T0, 1, 0, src, camp, None, "desktop", ref) for sid, src, camp, ref in rows]
    return normalise_dimensions(spark.createDataFrame(full, WEBSITE_SESSIONS), "website_sessions")


def orders(spark, rows):
    return spark.createDataFrame([(oid, T0, sid, None, Decimal(p)) for oid, sid, p in rows], ORDERS)


def pageviews(spark, rows):
    return spark.createDataFrame([(i, T0, sid, url) for i, (sid, url) in enumerate(rows)], WEBSITE_PAGEVIEWS)


def test_letter_case_is_one_group(spark):
    s = sessions(spark, [(1, "gsearch", "a", None), (2, "GSearch", "a", None), (3, "Gsearch", "a", None)])
    out = s.groupBy("utm_source").count().collect()
    assert [(r[0], r[1]) for r in out] == [("gsearch", 3)]


def test_guarded_zero_and_null_revenue(spark):
    s = sessions(spark, [(1, "g", "quiet", None), (2, "g", "busy", None)])
    o = orders(spark, [(10, 2, "5.00"), (11, 2, "7.00")])
    t = {"website_sessions": s, "orders": o}
    rows = {r["campaign_name"]: r for r in reports.campaign_analysis(t).collect()}
    assert rows["quiet"]["total_conversions"] == 0
    assert rows["quiet"]["total_revenue"] is None                     # M4
    assert rows["quiet"]["conversion_rate"] == 0.0                    # M3
    assert rows["quiet"]["revenue_per_conversion"] == 0.0
    assert rows["busy"]["total_revenue"] == 12.0 and rows["busy"]["revenue_per_conversion"] == 6.0
    # NULL revenue sorts last under DESC (M5)
    assert [r["campaign_name"] for r in reports.campaign_analysis(t).collect()] == ["busy", "quiet"]


def test_page_revenue_fan_out_and_dedupe(spark):
    pv = pageviews(spark, [(1, "/home"), (1, "/home")])
    o = orders(spark, [(10, 1, "10.00")])
    fan = conversion_measures(pv, o, ["pageview_url"], facts_unique_per_key=False, distinct_orders=True).first()
    assert (fan["total_orders"], fan["total_sessions"], fan["total_revenue"]) == (1, 1, 20.0)
    once = conversion_measures(pv, o, ["pageview_url"], facts_unique_per_key=False,
                               distinct_orders=True, dedupe_revenue=True).first()
    assert once["total_revenue"] == 10.0


def test_product_success_fan_out(spark):
    o = spark.createDataFrame([(1, T0, 7, Decimal("10.00"))],
                              "order_id long, created_at timestamp_ntz, primary_product_id long, price_usd decimal(18,2)")
    r = spark.createDataFrame([("a", "i1", 1, Decimal("3.00")), ("b", "i2", 1, Decimal("4.00"))],
                              "order_item_refund_id string, order_item_id string, order_id long, refund_amount_usd decimal(18,2)")
    p = spark.createDataFrame([(7, "fuzzy")], "product_id long, product_name string")
    row = product_success(o, r, p).first()
    assert (row["product_name"], row["total_revenue"], row["total_refund_amount"]) == ("fuzzy", 20.0, 7.0)


def test_not_like_drops_null_referer(spark):
    s = sessions(spark, [(1, "gsearch", "nonbrand", None), (2, "gsearch", "nonbrand", "https://x.com")])
    t = {"website_sessions": s}
    out = reports.nonbrand_sessions_device(t).collect()
    assert [r["total_sessions"] for r in out] == [1]


def _flags(spark, views):
    s = sessions(spark, [(1, "gsearch", "nonbrand", None), (2, "gsearch", "nonbrand", None),
                         (3, "gsearch", "nonbrand", None)])
    pv = pageviews(spark, views)
    return funnel.funnel_sessions(s, pv, F.lit(True))


def test_funnel_segments_and_missing_views(spark):
    flags = _flags(spark, [(1, "/home"), (1, "/lander-1"), (1, "/products"), (2, "/lander-1")])
    counts = {r["segment"]: r for r in funnel.funnel_counts(flags).collect()}
    assert counts["saw_homepage"]["sessions"] == 1                # both landers: home wins
    assert counts["saw_homepage"]["to_products"] == 1
    assert counts["saw_custom_lander"]["sessions"] == 1
    assert counts["uh oh... check logic"]["sessions"] == 1        # session 3 has no views
    rates = {r["segment"]: r for r in funnel.funnel_rates(funnel.funnel_counts(flags)).collect()}
    assert rates["saw_homepage"]["lander_click_rt"] == 1.0
    assert rates["saw_homepage"]["mrfuzzy_click_rt"] is None      # 0 / 0 -> NULL, no error (M2)


def test_funnel_pageviews_keeps_session_without_views(spark):
    s = sessions(spark, [(1, "gsearch", "nonbrand", None)])
    pv = pageviews(spark, [(2, "/home")])
    rows = funnel.funnel_pageviews(s, pv, F.lit(True)).collect()
    assert len(rows) == 1 and rows[0]["pageview_url"] is None and rows[0]["homepage"] == 0


def test_billing_lift_counts_views(spark):
    pv = spark.createDataFrame(
        [(1, datetime(2024, 9, 20), 1, "/billing"), (2, datetime(2024, 9, 20), 1, "/billing"),
         (3, datetime(2024, 9, 21), 2, "/billing-2"), (4, datetime(2024, 12, 1), 3, "/billing-2")],
        WEBSITE_PAGEVIEWS)
    o = orders(spark, [(10, 1, "5.00"), (11, 2, "9.00")])
    per = {r[0]: r for r in abtest.revenue_per_view(pv, o, abtest.BILLING_URLS, "2024-09-10", "2024-11-10").collect()}
    assert per["/billing"]["sessions"] == 1 and per["/billing"]["revenue_per_billing_page_seen"] == 10.0
    lift = abtest.variant_lift(pv, o, "/billing", "/billing-2", "2024-09-10", "2024-11-10").first()
    assert lift["billing_page_views"] == 3
    assert lift["lift_per_session"] == -1.0 and lift["revenue_impact"] == -3.0
    assert abtest.variant_view_count(pv, abtest.BILLING_URLS, "2024-09-10", "2024-11-10").first()[0] == 3


def test_most_and_least_viewed_same_multiset(spark):
    pv = pageviews(spark, [(1, "/a"), (1, "/b"), (2, "/a")])
    most = count_report(pv, ["pageview_url"]).collect()
    least = count_report(pv, ["pageview_url"], ascending=True).collect()
    assert sorted(map(tuple, most)) == sorted(map(tuple, least))
    assert most[0]["pageview_url"] == "/a" and least[0]["pageview_url"] == "/b"


def test_session_key_unique_in_views(spark):
    from cartwheel.sources.testviews import website_sessions
    assert duplicate_keys(website_sessions(spark, "/root/testdata/sf0.001"), "website_session_id").count() == 0


def test_conversion_report_wrapper(spark):
    from cartwheel.operators.conversion import conversion_report
    s = sessions(spark, [(1, "g", "a", None), (2, "g", "a", None)])
    o = orders(spark, [(10, 2, "5.00")])
    r = conversion_report(s, o, ["utm_campaign"], ratio_scale=100, on_zero=None).first()
    assert (r["total_sessions"], r["total_orders"], r["conversion_rate"], r["average_order_value"]) == (2, 1, 50.0, 5.0)


def test_funnel_properties_on_views(spark):
    from cartwheel.sources.testviews import shop_tables
    t = shop_tables(spark, "/root/testdata/sf0.01")
    flags = reports.funnel_sessions(t)
    counts = reports.funnel_counts(t).collect()
    assert sum(r["sessions"] for r in counts) == flags.count()
    for r in counts:
        for step in ("to_products", "to_mrfuzzy", "to_cart", "to_shipping", "to_billing", "to_thankyou"):
            assert r[step] <= r["sessions"]
    persisted_counts, rates = reports.funnel_report(t)
    assert sorted(map(tuple, persisted_counts.collect())) == sorted(map(tuple, counts))
    assert rates.count() == len(counts)


def test_sql_over_registered_views(spark):
    from cartwheel.sources.shop import register_views
    from cartwheel.sources.testviews import shop_tables
    t = shop_tables(spark, "/root/testdata/sf0.001")
    register_views(spark, {"website_pageviews": t["website_pageviews"]})
    n = spark.sql("SELECT COUNT(*) FROM website_pageviews").first()[0]
    assert n == t["website_pageviews"].count()


def test_time_range_prunes_month_folders(spark, tmp_path):
    from cartwheel.operators.trends import time_range
    pv = pageviews(spark, [(1, "/billing"), (2, "/billing")])
    pv = pv.withColumn("created_month", F.date_format("created_at", "yyyy-MM"))
    out = str(tmp_path / "pv")
    pv.write.partitionBy("created_month").parquet(out)
    back = spark.read.parquet(out)
    q = back.where(time_range(back, "2024-06-19", "2024-07-28"))
    plan = q._jdf.queryExecution().executedPlan().toString()
    assert "PartitionFilters: [isnotnull(created_month" in plan and "2024-06" in plan
    assert q.count() == 2


def test_empty_sessions(spark):
    s = spark.createDataFrame([], WEBSITE_SESSIONS)
    o = spark.createDataFrame([], ORDERS)
    assert conversion_measures(s, o, ["utm_campaign"]).count() == 0
    assert reports.funnel_counts({"website_sessions": s, "website_pageviews": spark.createDataFrame([], WEBSITE_PAGEVIEWS)}).count() == 0


def test_null_session_ids_are_not_sessions(spark):
    pv = spark.createDataFrame([(1, T0, None, "/home"), (2, T0, 5, "/home")], WEBSITE_PAGEVIEWS)
    o = orders(spark, [(10, 5, "3.00")])
    r = conversion_measures(pv, o, ["pageview_url"], facts_unique_per_key=False, distinct_orders=True).first()
    assert (r["total_sessions"], r["total_orders"], r["total_revenue"]) == (1, 1, 3.0)
    flags = spark.createDataFrame([(None, 1, 0, 1, 0, 0, 0, 0, 0), (7, 1, 0, 1, 0, 0, 0, 0, 0)],
                                  "website_session_id long, saw_homepage int, saw_custom_lander int, "
                                  "product_made_it int, mrfuzzy_made_it int, cart_made_it int, "
                                  "shipping_made_it int, billing_made_it int, thankyou_made_it int")
    c = funnel.funnel_counts(flags).first()
    assert (c["sessions"], c["to_products"], c["to_cart"]) == (1, 1, 0)


def test_variant_views_null_session(spark):
    pv = spark.createDataFrame([(1, datetime(2024, 9, 20), None, "/billing"),
                                (2, datetime(2024, 9, 20), 1, "/billing")], WEBSITE_PAGEVIEWS)
    o = orders(spark, [(10, 1, "4.00")])
    r = abtest.revenue_per_view(pv, o, abtest.BILLING_URLS, "2024-09-10", "2024-11-10").first()
    assert (r["sessions"], r["revenue_per_billing_page_seen"]) == (1, 4.0)
    assert abtest.variant_view_count(pv, abtest.BILLING_URLS, "2024-09-10", "2024-11-10").first()[0] == 1


def test_bounded_broadcast(spark):
    from cartwheel.operators.joins import bounded_broadcast
    small = spark.range(10)
    hinted = bounded_broadcast(small, max_bytes=400)
    plan = spark.range(100).join(hinted, "id")._jdf.queryExecution().executedPlan().toString()
    assert "BroadcastHashJoin" in plan
    big = bounded_broadcast(spark.range(11), max_bytes=400)
    plan = spark.range(100).join(big, "id")._jdf.queryExecution().optimizedPlan().toString()
    assert "broadcast" not in plan.lower() and big.count() == 11
