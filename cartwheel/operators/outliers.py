"""IQR outliers: bounds, box-plot numbers, filtering, and the missing-value map.

Quartiles are exact (``exact_quantiles``); the bounds then enter the plans as literals, so the
outlier filter is an ordinary range predicate that Parquet can push down.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from cartwheel.operators.joins import bounded_broadcast, materialize_row, materialize_table
from cartwheel.operators.quantiles import INTEGRAL, _q, exact_quantiles, present


def iqr_values(df: DataFrame, column: str, k: float = 1.5, *,
               stats: tuple | None = None) -> dict[str, float | None]:
    """Q1, Q3, IQR and the bounds Q1 - k IQR, Q3 + k IQR as driver values."""
    q1, q3 = exact_quantiles(df, column, [0.25, 0.75], stats=stats)
    if q1 is None:
        return {"q1": None, "q3": None, "iqr": None, "lower_bound": None, "upper_bound": None}
    iqr = q3 - q1
    return {"q1": q1, "q3": q3, "iqr": iqr, "lower_bound": q1 - k * iqr, "upper_bound": q3 + k * iqr}


def iqr_bounds(df: DataFrame, column: str, k: float = 1.5) -> DataFrame:
    """One row: n_values, q1, q3, iqr, lower_bound, upper_bound.

    The count/min/max pass is materialised once and feeds both the quantile search and the
    output row, so the column is not aggregated twice."""
    v = F.when(present(df, column), F.col(_q(column)))
    one = materialize_row(df.agg(F.count(v).alias("n_values"), F.min(v).alias("lo"), F.max(v).alias("hi")))
    row = one.first()
    vals = iqr_values(df, column, k, stats=(row["n_values"], row["lo"], row["hi"]))
    return one.select(
        "n_values", *[F.lit(vals[name]).cast("double").alias(name)
                      for name in ("q1", "q3", "iqr", "lower_bound", "upper_bound")])


def remove_outliers_iqr(df: DataFrame, column: str, k: float = 1.5) -> DataFrame:
    """Rows with ``lower_bound <= column <= upper_bound``; missing values fail the test."""
    vals = iqr_values(df, column, k)
    if vals["q1"] is None:
        return df.where(F.lit(False))
    c = F.col(_q(column))
    return df.where((c >= F.lit(vals["lower_bound"])) & (c <= F.lit(vals["upper_bound"])))


def boxplot_stats(df: DataFrame, column: str, k: float = 1.5) -> DataFrame:
    """The numbers a box plot draws: quartiles, whiskers (most extreme values within the
    bounds) and the number of values outside them. One row."""
    q1, med, q3 = exact_quantiles(df, column, [0.25, 0.5, 0.75])
    if q1 is None:
        q1 = med = q3 = None
        lo = hi = None
    else:
        iqr = q3 - q1
        lo, hi = q1 - k * iqr, q3 + k * iqr
    v = F.when(present(df, column), F.col(_q(column)).cast("double"))
    inside = (v >= F.lit(lo)) & (v <= F.lit(hi))
    return df.agg(
        F.lit(q1).cast("double").alias("q1"),
        F.lit(med).cast("double").alias("median"),
        F.lit(q3).cast("double").alias("q3"),
        F.min(F.when(inside, v)).alias("lower_whisker"),
        F.max(F.when(inside, v)).alias("upper_whisker"),
        F.count_if(v.isNotNull() & ~inside).alias("n_outliers"),
    )


def _integer_key(df: DataFrame, order_key: str) -> Column | None:
    """A key whose ranges are cut in exact integers; None for other types."""
    key, dtype = F.col(_q(order_key)), df.schema[order_key].dataType
    if isinstance(dtype, T.DateType):
        return F.unix_date(key)
    if isinstance(dtype, T.TimestampType):
        return F.unix_micros(key)
    if isinstance(dtype, T.TimestampNTZType):
        return F.expr(f"timestampdiff(MICROSECOND, TIMESTAMP_NTZ'1970-01-01 00:00:00', {_q(order_key)})")
    return key if isinstance(dtype, INTEGRAL) or (isinstance(dtype, T.DecimalType) and dtype.scale == 0) else None


def _rank_bucket(df: DataFrame, order_key: str, buckets: int) -> Column | None:
    """Ranges of about equally many rows of any orderable key; equal keys share one.

    A key's range follows from the number of rows below it: counts per key, sorted by range over
    all tasks, summed up within each task and over the tasks. Only the least key of each range, at
    most ``buckets`` of them, comes to the driver; no row is joined or moved.
    """
    key = F.col(_q(order_key))
    counts = df.where(present(df, order_key)).groupBy(key.alias("k")).agg(F.count(F.lit(1)).alias("n"))
    tasks = int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    placed = counts.repartitionByRange(tasks, "k").sortWithinPartitions("k").withColumn("task", F.spark_partition_id())
    placed = materialize_table(placed, "key-counts")
    in_task = F.sum("n").over(Window.partitionBy("task").orderBy("k")) - F.col("n")
    sums = placed.groupBy("task").agg(F.sum("n").alias("m"))  # a row per task
    sums = sums.select("task", (F.sum("m").over(Window.orderBy("task")) - F.col("m")).alias("before"),
                       F.sum("m").over(Window.partitionBy(F.lit(0))).alias("rows"))
    ranked = placed.withColumn("below", in_task).join(bounded_broadcast(sums), "task")
    place = (F.col("before") + F.col("below")) * F.lit(buckets)
    bucket = ((place - F.pmod(place, F.col("rows"))) / F.col("rows")).cast("bigint")
    least = ranked.groupBy(bucket.alias("b")).agg(F.min("k").alias("k")).orderBy("b").collect()
    out = None
    for r in reversed(least):
        at = key >= F.lit(r["k"])
        out = F.when(at, F.lit(r["b"])) if out is None else out.when(at, F.lit(r["b"]))
    return out if out is None else F.when(present(df, order_key), out)


def null_map(df: DataFrame, order_key: str, buckets: int = 20,
             columns: Sequence[str] | None = None) -> DataFrame:
    """Share of missing cells per column in ``buckets`` ranges of ``order_key``: the numbers behind
    a missing-value heatmap. Ranges of an integer, whole decimal, date or timestamp are equally
    wide; those of any other key (text, fractions) hold about equally many rows.
    Columns: bucket, n_rows, and one share per column; rows without a key have bucket NULL."""
    cols = list(columns) if columns is not None else [c for c in df.columns if c != order_key]
    key = _integer_key(df, order_key)
    if key is None:
        bucket = _rank_bucket(df, order_key, buckets)
        if bucket is None:
            return df.select(F.lit(0).cast("bigint").alias("bucket")).where(F.lit(False))
    else:
        bounds = df.agg(F.min(key).alias("lo"), F.max(key).alias("hi")).first()
        if bounds["lo"] is None:
            return df.select(F.lit(0).cast("bigint").alias("bucket")).where(F.lit(False))
        span = int(bounds["hi"]) - int(bounds["lo"]) + 1
        num = (key.cast("decimal(38,0)") - F.lit(int(bounds["lo"]))) * F.lit(buckets)
        bucket = ((num - F.pmod(num, F.lit(span))) / F.lit(span)).cast("bigint")
    return (df.select(bucket.alias("bucket"),
                      *[F.when(present(df, c), 0).otherwise(1).alias(c) for c in cols])
            .groupBy("bucket")
            .agg(F.count(F.lit(1)).alias("n_rows"), *[F.avg(_q(c)).alias(c) for c in cols]))
