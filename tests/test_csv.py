import os
import tempfile

from pyspark.sql import types as T

from cartwheel.sources.csv import load_csv, load_csv_inferred, write_csv


def _write(text: str) -> str:
    d = tempfile.mkdtemp(prefix="cartwheel-csv-")
    path = os.path.join(d, "t.csv")
    with open(path, "w", newline="") as f:
        f.write(text)
    return path


SCHEMA = T.StructType([T.StructField("id", T.IntegerType()), T.StructField("a", T.StringType()),
                       T.StructField("b", T.StringType())])


def test_mysql_empties(spark):
    path = _write('id,a,b\n1,,x\n2,"",y\n3,NULL,z\n')
    rows = sorted(tuple(r) for r in load_csv(spark, path, SCHEMA, empty_as="mysql").collect())
    assert rows == [(1, "", "x"), (2, "", "y"), (3, None, "z")]
    rows = sorted(tuple(r) for r in load_csv(spark, path, SCHEMA).collect())
    assert rows[0] == (1, None, "x")


def test_crlf_stripped(spark):
    path = _write('id,a,b\r\n1,p,last\r\n')
    assert load_csv(spark, path, SCHEMA).first()["b"] == "last"


def test_inferred_types_and_na_tokens(spark):
    path = _write('n,x,s\n1,1.5,NA\n2,null,"multi\nline"\nNone,n/a,ok\n')
    df = load_csv_inferred(spark, path, multi_line=True)
    types = {f.name: f.dataType.simpleString() for f in df.schema.fields}
    assert types == {"n": "bigint", "x": "double", "s": "string"}
    rows = sorted((tuple(r) for r in df.collect()), key=lambda r: (r[0] is None, r[0] or 0))
    assert rows == [(1, 1.5, None), (2, None, "multi\nline"), (None, None, "ok")]


def test_write_round_trip(spark):
    df = spark.createDataFrame([(1, "a,b", None)], SCHEMA)
    out = os.path.join(tempfile.mkdtemp(prefix="cartwheel-out-"), "o")
    write_csv(df, out)
    back = load_csv(spark, out, SCHEMA).collect()
    assert [tuple(r) for r in back] == [(1, "a,b", None)]


def test_ingest_normalises_and_partitions(spark):
    from cartwheel.sources.shop import ingest_csv
    path = _write("website_pageview_id,created_at,website_session_id,pageview_url\n"
                  "1,2012-03-19 10:00:00,7,/Home\n2,2012-04-02 11:30:00,7,/CART\n")
    out = os.path.join(tempfile.mkdtemp(prefix="cartwheel-ingest-"), "pv")
    ingest_csv(spark, "website_pageviews", path, out, partition_by_month=True)
    back = spark.read.parquet(out)
    rows = sorted((r["pageview_url"], r["created_month"]) for r in back.collect())
    assert rows == [("/cart", "2012-04"), ("/home", "2012-03")]
    pruned = back.where("created_month = '2012-03'")
    assert "PartitionFilters: [isnotnull(created_month" in pruned._jdf.queryExecution().executedPlan().toString()
    assert pruned.count() == 1


def test_timestamps_keep_microseconds(spark):
    from datetime import datetime
    sch = T.StructType([T.StructField("ts", T.TimestampNTZType())])
    df = spark.createDataFrame([(datetime(2012, 3, 19, 10, 0, 0, 123456),)], sch)
    out = os.path.join(tempfile.mkdtemp(prefix="cartwheel-ts-"), "o")
    write_csv(df, out)
    assert load_csv(spark, out, sch).first()["ts"] == datetime(2012, 3, 19, 10, 0, 0, 123456)


def test_mysql_null_word_in_number_column(spark):
    sch = T.StructType([T.StructField("id", T.IntegerType()), T.StructField("n", T.IntegerType()),
                        T.StructField("s", T.StringType())])
    path = _write("id,n,s\n1,NULL,a\n2,,b\n3,7,NULL\n")
    rows = sorted(tuple(r) for r in load_csv(spark, path, sch, empty_as="mysql").collect())
    assert rows == [(1, None, "a"), (2, None, "b"), (3, 7, None)]


def test_load_data_escapes(spark):
    path = _write('id,a,b\r\n1,"NULL",\\N\r\n2,NULL,"\\"q\\""\r\n3,"a,""b""",x\\\\ny\\tz\r\n4,,"\\N"\r\n5,\\,,\r\n')
    rows = sorted(tuple(r) for r in load_csv(spark, path, SCHEMA, empty_as="mysql").collect())
    assert rows == [(1, "NULL", None), (2, None, '"q"'), (3, 'a,"b"', "x\\ny\tz"), (4, "", None), (5, ",", "")]


def test_load_data_refuses_what_it_cannot_hold(spark):
    import pytest
    for line, said in (('x,p,q', "cannot hold x"), ('1,"p,q', "quotes do not fit")):
        with pytest.raises(Exception, match=said):
            load_csv(spark, _write(f"id,a,b\n{line}\n"), SCHEMA, empty_as="mysql").collect()
    with pytest.raises(Exception):
        load_csv(spark, _write("id,a,b\nx,p,q\n"), SCHEMA).collect()


def test_inference_keeps_codes_and_truth_words(spark):
    path = _write("No. staff,code,flag,half,e\n1,1D,True,True,1e3\n2,2F,false,,.5\n3,3d,TRUE,False,inf\n")
    df = load_csv_inferred(spark, path)
    assert [f.dataType.simpleString() for f in df.schema] == ["bigint", "string", "boolean", "string", "double"]
    assert sorted(r["code"] for r in df.collect()) == ["1D", "2F", "3d"]
    assert [r["flag"] for r in df.orderBy("`No. staff`").collect()] == [True, False, True]


def test_dotted_headers_in_profile_operators(spark):
    from cartwheel.operators import impute, outliers, profile
    path = _write("No. staff,a.b\n1,x\n2,x\n3,\n100,y\n")
    df = load_csv_inferred(spark, path)
    assert profile.describe(df).first()["p50"] == 2.5
    assert {r["column"]: r["nunique"] for r in profile.nunique(df).collect()} == {"No. staff": 4, "a.b": 2}
    assert [r[0] for r in profile.modes(df, "a.b").collect()] == ["x"]
    assert profile.value_counts(df, "a.b").first()["count"] == 2
    assert profile.head(df, "No. staff", 1).first()[0] == 1
    assert profile.duplicate_rows(df, "No. staff").first()[0] == 2
    assert profile.drop_duplicates(df, None, "No. staff").count() == 3
    assert outliers.boxplot_stats(df, "No. staff").first()["n_outliers"] == 1
    assert outliers.null_map(df, "No. staff", 2).count() == 2
    assert impute.impute_mode(df, ["a.b"]).where("`a.b` = 'x'").count() == 3
    assert impute.impute_median(df, "No. staff").count() == 4


def test_describe_without_numbers(spark):
    from cartwheel.operators import profile
    df = spark.createDataFrame([("a",)], "s string")
    assert profile.describe(df).count() == 0 and profile.describe_datetime(df).count() == 0


def test_ingest_refuses_repeated_keys(spark):
    import pytest
    from cartwheel.sources.shop import ingest_csv
    path = _write("website_pageview_id,created_at,website_session_id,pageview_url\n"
                  "1,2012-03-19 10:00:00,7,/home\n1,2012-04-02 11:30:00,7,/cart\n")
    with pytest.raises(ValueError, match="website_pageview_id"):
        ingest_csv(spark, "website_pageviews", path, os.path.join(tempfile.mkdtemp(), "pv"))
