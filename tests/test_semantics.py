from datetime import datetime

from pyspark.sql import functions as F

from cartwheel.functions.semantics import (
    MONTH, MONTH_START, half_even, half_even_pct, month_name, period_key, ratio,
)
from cartwheel.operators.trends import ts_literal


def test_ratio_zero_null_and_guarded(spark):
    df = spark.createDataFrame([(1, 0), (3, 2), (None, 2)], "n long, d long")
    rows = df.select(ratio("n", "d").alias("u"), ratio("n", "d", 0.0).alias("g")).collect()
    assert [tuple(r) for r in rows] == [(None, 0.0), (1.5, 1.5), (None, None)]


def test_half_even_pct_ties(spark):
    # 0.5 %, 1.5 %, 2.5 % to 0 decimals -> 0, 2, 2 (M13); 20.15 % to 1 decimal -> 20.2
    df = spark.createDataFrame([(1, 200), (3, 200), (5, 200), (403, 2000)], "p long, w long")
    got = [r[0] for r in df.select(half_even_pct("p", "w", 0)).collect()]
    assert got[:3] == [0.0, 2.0, 2.0]
    assert df.select(half_even_pct("p", "w", 1)).collect()[3][0] == 20.2


def test_half_even_pct_zero_whole(spark):
    df = spark.createDataFrame([(0, 0)], "p long, w long")
    assert df.select(half_even_pct("p", "w")).first()[0] is None


def test_bround_is_half_even(spark):
    df = spark.createDataFrame([(0.5,), (2.5,), (1.5,)], "x double")
    assert [r[0] for r in df.select(half_even("x")).collect()] == [0.0, 2.0, 2.0]


def test_period_keys_and_month_name(spark):
    df = spark.createDataFrame([(datetime(2012, 3, 19, 10, 0),)], "ts timestamp_ntz")
    r = df.select(period_key("ts", MONTH), period_key("ts", MONTH_START), month_name("ts")).first()
    assert tuple(r) == ("2012-03", "2012-03-01", "March")


def test_between_date_string_upper_bound_is_midnight(spark):
    df = spark.createDataFrame([(datetime(2012, 8, 31, 0, 0),), (datetime(2012, 8, 31, 10, 0),)],
                               "ts timestamp_ntz")
    kept = df.where(F.col("ts").between(ts_literal("2012-01-01"), ts_literal("2012-08-31"))).count()
    assert kept == 1


def test_cluster_conf_scales_partitions():
    from cartwheel.session import cluster_conf
    conf = cluster_conf(20 * 2**40, cores=8000)
    assert int(conf["spark.sql.shuffle.partitions"]) == 163841
    assert int(cluster_conf(1 << 20, cores=8)["spark.sql.shuffle.partitions"]) == 24
