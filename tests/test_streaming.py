import tempfile

from cartwheel.operators.pages import count_report
from cartwheel.operators.trends import period_trend
from cartwheel.sources.testviews import website_pageviews
from cartwheel.streaming import read_stream, start_report

SF = "/root/testdata/sf0.001"


def test_streamed_reports_equal_batch(spark):
    pv = website_pageviews(spark, SF)
    src = tempfile.mkdtemp(prefix="cartwheel-stream-src-")
    pv.write.mode("overwrite").parquet(src)
    stream = read_stream(spark, src, pv.schema, max_files_per_trigger=1)

    views = start_report(stream, lambda s: count_report(s, ["pageview_url"]), "pv_counts_test")
    monthly = start_report(stream, lambda s: period_trend(s, "created_at", name="total_views"),
                           "pv_monthly_test")
    try:
        views.query.processAllAvailable()
        monthly.query.processAllAvailable()
        got = sorted(tuple(r) for r in spark.table("pv_counts_test").collect())
        want = sorted(tuple(r) for r in count_report(pv, ["pageview_url"]).collect())
        assert got == want
        got = sorted(tuple(r) for r in spark.table("pv_monthly_test").collect())
        want = sorted(tuple(r) for r in period_trend(pv, "created_at", name="total_views").collect())
        assert got == want
    finally:
        views.query.stop()
        monthly.query.stop()


def test_windowed_counts_equal_batch(spark):
    from pyspark.sql import functions as F

    from cartwheel.streaming import windowed_counts
    pv = website_pageviews(spark, SF)
    src = tempfile.mkdtemp(prefix="cartwheel-stream-win-")
    pv.write.mode("overwrite").parquet(src)
    stream = read_stream(spark, src, pv.schema)
    report = start_report(stream, lambda s: windowed_counts(s, "created_at", "7 days", dims=["pageview_url"]),
                          "pv_windows_test")
    try:
        report.query.processAllAvailable()
        got = sorted(tuple(r) for r in spark.table("pv_windows_test").collect())
    finally:
        report.query.stop()
    want = sorted(tuple(r) for r in (
        pv.groupBy(F.window(F.col("created_at").cast("timestamp"), "7 days").alias("w"), "pageview_url").count()
        .select(F.col("w.start").cast("timestamp_ntz"), F.col("w.end").cast("timestamp_ntz"),
                "pageview_url", "count").collect()))
    assert got == want


def test_streamed_report_to_parquet(spark, tmp_path):
    pv = website_pageviews(spark, SF)
    src = str(tmp_path / "src")
    pv.write.parquet(src)
    out = str(tmp_path / "report")
    rep = start_report(read_stream(spark, src, pv.schema), lambda s: count_report(s, ["pageview_url"]),
                       "pv_counts_parquet", output_path=out, checkpoint=str(tmp_path / "ckpt"))
    try:
        rep.query.processAllAvailable()
    finally:
        rep.query.stop()
    got = sorted(tuple(r) for r in spark.read.parquet(out).collect())
    assert got == sorted(tuple(r) for r in count_report(pv, ["pageview_url"]).collect())
