"""Helpers shared by the operators of this subpackage."""

from __future__ import annotations

import os
import string
from collections.abc import Iterator
from contextlib import contextmanager

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from cartwheel.session import scratch_path

_ROOT = os.path.dirname(os.path.dirname(os.path.dirname(os.path.abspath(__file__))))


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """One of the given tables; Spark's reader is the only thing that opens the path."""
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def workers_import_package(spark: SparkSession) -> None:
    """Let Python workers import this package from where the driver imported it.

    Needed where the package is not installed (a checkout in local mode). On a cluster,
    install the package or pass it with ``--py-files``; the entry is then unused.
    """
    env = spark.sparkContext.environment
    paths = env.get("PYTHONPATH", "").split(os.pathsep)
    if _ROOT not in paths:
        env["PYTHONPATH"] = os.pathsep.join([_ROOT, *filter(None, paths)])


def materialize(df: DataFrame, name: str) -> DataFrame:
    """Write ``df`` as Parquet in the shared checkpoint folder and read it back.

    Cuts the lineage, survives the loss of executors and keeps a result that several later
    steps read from being computed once per step.
    """
    spark = df.sparkSession
    path = scratch_path(spark, name)
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


@contextmanager
def rows_sent(spark: SparkSession, rows: int) -> Iterator[None]:
    """Inside, jobs send Python workers at most ``rows`` rows at once: a batch of long rows is held
    by the executor and by the worker."""
    name = "spark.sql.execution.arrow.maxRecordsPerBatch"
    before = spark.conf.get(name)
    spark.conf.set(name, str(min(rows, int(before)) if int(before) > 0 else rows))
    try:
        yield
    finally:
        spark.conf.set(name, before)


def ascii_lower(c: Column) -> Column:
    """A-Z to a-z and nothing else."""
    return F.translate(c, string.ascii_uppercase, string.ascii_lowercase)


def write_files(df: DataFrame, column: str, path: str) -> None:
    """Write each row's binary value as a file of its own below ``path``.

    Spark's text writer puts the bytes of a string out as they are, to any Hadoop file system
    and under its commit protocol, so a lost executor leaves no half file. It ends each file
    with one newline, which the formats written here allow for.
    """
    (df.select(F.col(column).cast("string").alias("value"))
     .write.option("maxRecordsPerFile", 1).text(path))


def read_files(spark: SparkSession, path: str) -> DataFrame:
    """path, length, content of the files that write_files left."""
    return spark.read.format("binaryFile").option("pathGlobFilter", "part-*").load(path)
