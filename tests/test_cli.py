from cartwheel.__main__ import main


def test_reports_to_parquet(spark, tmp_path):
    assert main(["reports", "--testdata", "/root/testdata/sf0.001", "--only", "orders_monthly",
                 "--out", str(tmp_path)]) == 0
    assert spark.read.parquet(str(tmp_path / "orders_monthly")).count() == 13
    assert main(["reports", "--testdata", "/root/testdata/sf0.001", "--only", "nope"]) == 2


def test_clean_command(spark, tmp_path):
    src = tmp_path / "in.csv"
    rows = ["CAT,CAP,D"] + [f"{'a' if i % 2 else 'b'},{'' if i % 5 == 0 else i},{'x' if i % 4 == 0 else '01-02-2003'}"
                            for i in range(20)]
    src.write_text("\n".join(rows) + "\n")
    out = tmp_path / "out"
    assert main(["clean", str(src), str(out), "--median", "CAP", "--date", "D=dd-MM-yyyy:CAT"]) == 0
    back = spark.read.option("header", True).csv(str(out))
    assert back.count() == 20 and back.where("CAP IS NULL OR D IS NULL").count() == 0


def test_ingest_then_report(spark, tmp_path):
    from cartwheel.plans import reports
    from cartwheel.sources.csv import write_csv
    from cartwheel.sources.shop import read_shop_tables
    from cartwheel.sources.testviews import shop_tables
    views = shop_tables(spark, "/root/testdata/sf0.001")
    csv_dir = tmp_path / "csv"
    for name in ("website_sessions", "website_pageviews"):
        write_csv(views[name], str(csv_dir / f"{name}.csv"))
    write_csv(views["orders"].selectExpr("order_id", "created_at", "website_session_id",
                                         "CAST(NULL AS BIGINT) AS primary_product_id", "price_usd"),
              str(csv_dir / "orders.csv"))
    assert main(["ingest", str(csv_dir), str(tmp_path / "pq"), "--by-month", "--empty-as", "null"]) == 0
    t = read_shop_tables(spark, str(tmp_path / "pq"))
    got = sorted(map(tuple, reports.traffic_channel(t).collect()))
    assert got == sorted(map(tuple, reports.traffic_channel(views).collect()))
