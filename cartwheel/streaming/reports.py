"""Running the report operators on a growing table with Structured Streaming.

The reference's reports are batch queries over static tables. When sessions or page views
arrive continuously, the single-aggregation reports (view counts per URL, sessions or orders
per month and dimension) are the same operators applied to a streaming DataFrame: Spark keeps
the per-group state and re-emits the result each trigger. Nothing here is a new report; it
is a way to keep an existing one current without re-reading history.

* ``read_stream``: a file-source stream with a declared schema (streams cannot infer one).
* ``start_report``: any aggregate report -> ``complete`` output, written per micro-batch by
  ``foreachBatch`` as a whole Parquet table (or to a memory table for tests). State and
  progress live in a checkpoint under ``spark.checkpoint.dir``, so a restarted query, or one
  that lost executors, resumes exactly once.
* ``windowed_counts``: counts per event-time window with a watermark, for appending
  finished periods instead of rewriting the whole table.
"""

from __future__ import annotations

from collections.abc import Callable, Sequence
from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.streaming import StreamingQuery

from cartwheel.session import scratch_path


def read_stream(spark: SparkSession, path: str, schema: T.StructType, *,
                fmt: str = "parquet", max_files_per_trigger: int | None = None) -> DataFrame:
    reader = spark.readStream.schema(schema).format(fmt)
    if max_files_per_trigger:
        reader = reader.option("maxFilesPerTrigger", max_files_per_trigger)
    return reader.load(path)


@dataclass
class StreamedReport:
    query: StreamingQuery
    checkpoint: str
    target: str


def start_report(stream: DataFrame, build: Callable[[DataFrame], DataFrame], name: str, *,
                 output_path: str | None = None, checkpoint: str | None = None,
                 trigger_seconds: float | None = None) -> StreamedReport:
    """Start ``build(stream)`` as a streaming query with complete output.

    With ``output_path`` each micro-batch overwrites that Parquet table with the current
    report; without it the report is the in-memory table ``name`` (tests, notebooks).
    """
    spark = stream.sparkSession
    checkpoint = checkpoint or scratch_path(spark, f"stream-{name}")
    report = build(stream)
    writer = report.writeStream.outputMode("complete").option("checkpointLocation", checkpoint)
    if trigger_seconds:
        writer = writer.trigger(processingTime=f"{trigger_seconds} seconds")
    if output_path:
        def write_batch(batch: DataFrame, _epoch: int) -> None:
            batch.write.mode("overwrite").parquet(output_path)
        query = writer.foreachBatch(write_batch).queryName(name).start()
        target = output_path
    else:
        query = writer.format("memory").queryName(name).start()
        target = name
    return StreamedReport(query, checkpoint, target)


def windowed_counts(stream: DataFrame, ts: str, window: str, *, dims: Sequence[str] = (),
                    watermark: str = "1 day", count_col: str | None = None,
                    name: str = "total") -> DataFrame:
    """Counts per (event-time window, dims); with the watermark, finished windows can be
    emitted once in ``append`` mode and their state dropped."""
    measure = F.count(F.lit(1)) if count_col is None else F.count(F.col(count_col))
    zone_less = isinstance(stream.schema[ts].dataType, T.TimestampNTZType)
    # Watermarks need TIMESTAMP; zone-less times are read in the session time zone and the
    # window bounds converted back, so the output keeps the input's type.
    event = F.col(ts).cast("timestamp") if zone_less else F.col(ts)
    back = (lambda c: c.cast("timestamp_ntz")) if zone_less else (lambda c: c)
    return (stream.withColumn("_event_time", event).withWatermark("_event_time", watermark)
            .groupBy(F.window(F.col("_event_time"), window).alias("window"), *dims)
            .agg(measure.alias(name))
            .select(back(F.col("window.start")).alias("period_start"),
                    back(F.col("window.end")).alias("period_end"), *dims, name))
