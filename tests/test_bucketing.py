"""Session-bucketed tables: same results, and the session joins shuffle nothing."""

from pyspark.sql import functions as F

from cartwheel.plans import reports
from cartwheel.sources.shop import read_catalog_tables, save_bucketed
from cartwheel.sources.testviews import shop_tables

SF = "/root/testdata/sf0.001"


def _session_exchanges(df):
    df.collect()
    plan = df._jdf.queryExecution().executedPlan().toString()
    return plan.count("Exchange hashpartitioning(website_session_id")


def test_bucketed_reports(spark, tmp_path):
    views = shop_tables(spark, SF)
    tables = {n: views[n] for n in ("website_sessions", "website_pageviews", "orders", "products",
                                     "order_items", "order_item_refunds")}
    tables["orders"] = tables["orders"].withColumn("primary_product_id", F.lit(None).cast("bigint"))
    save_bucketed(tables, 8, prefix="bkt_", location=str(tmp_path))
    t = read_catalog_tables(spark, prefix="bkt_")
    for name in ("traffic_channel", "page_order_effect", "channel_monthly_conversion"):
        got = sorted(map(tuple, reports.REPORTS[name](t).collect()), key=repr)
        want = sorted(map(tuple, reports.REPORTS[name](views).collect()), key=repr)
        assert got == want, name
        assert _session_exchanges(reports.REPORTS[name](t)) == 0, name
        assert _session_exchanges(reports.REPORTS[name](views)) > 0, name
