"""The deployment path: normalised Parquet tables (event tables partitioned by month) read
with ``read_shop_tables``; every report runs and window reports equal the view results."""

from pyspark.sql import functions as F

from cartwheel.plans import reports
from cartwheel.sources.shop import read_shop_tables
from cartwheel.sources.testviews import shop_tables

SF = "/root/testdata/sf0.001"
WINDOW_REPORTS = ["funnel_sessions", "funnel_counts", "billing_pages", "revenue_per_billing_page",
                  "billing_lift", "monthly_conversion_window", "traffic_channel"]


def test_reports_on_partitioned_parquet(spark, tmp_path):
    views = shop_tables(spark, SF)
    base = tmp_path / "shop"
    for name in ("website_sessions", "website_pageviews"):
        (views[name].withColumn("created_month", F.date_format("created_at", "yyyy-MM"))
         .write.partitionBy("created_month").parquet(str(base / name)))
    views["orders"].withColumn("primary_product_id", F.lit(None).cast("bigint")) \
        .write.parquet(str(base / "orders"))
    for name in ("products", "order_items", "order_item_refunds"):
        views[name].write.parquet(str(base / name))
    t = read_shop_tables(spark, str(base))
    for name, fn in reports.REPORTS.items():
        assert fn(t).count() >= 0, name
    for name in WINDOW_REPORTS:
        got = sorted(map(tuple, reports.REPORTS[name](t).collect()), key=repr)
        want = sorted(map(tuple, reports.REPORTS[name](views).collect()), key=repr)
        assert got == want, name
