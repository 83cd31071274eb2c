"""Web-shop tables: loading, letter-case normalisation, key checks."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from cartwheel.sources.csv import load_csv
from cartwheel.sources.proof import duplicate_keys, proven_key, publish  # noqa: F401
from cartwheel.sources.schemas import CASE_INSENSITIVE_COLUMNS, SHOP_SCHEMAS, UNIQUE_KEYS


def normalise_dimensions(df: DataFrame, table: str) -> DataFrame:
    """Lower-case the dimension columns of ``table`` (MySQL compares them case-insensitively).

    Done once at ingest, so report filters are plain equalities on stored values and Parquet
    can skip row groups with them.
    """
    cols = set(CASE_INSENSITIVE_COLUMNS.get(table, ()))
    return df.select(*[(F.lower(F.col(c)).alias(c) if c in cols else F.col(c)) for c in df.columns])


def ingest_csv(spark: SparkSession, table: str, csv_path: str, parquet_path: str, *,
               empty_as: str = "mysql", partition_by_month: bool = False) -> None:
    """CSV export -> normalised Parquet table (read the CSV once, query Parquet after).

    ``partition_by_month`` writes event tables partitioned by ``yyyy-MM`` of ``created_at``
    so date-window reports prune whole folders. A table that repeats its key
    (``schemas.UNIQUE_KEYS``) is refused with a ValueError and never becomes readable; what stood
    at ``parquet_path`` stays. An accepted one carries the proof, by which the reports count one
    row per key instead of ``COUNT(DISTINCT key)``.
    """
    df = normalise_dimensions(load_csv(spark, csv_path, SHOP_SCHEMAS[table], empty_as=empty_as), table)
    writer = df.write
    if partition_by_month and "created_at" in df.columns:
        writer = df.withColumn("created_month", F.date_format("created_at", "yyyy-MM")).write.partitionBy("created_month")
    publish(spark, writer, parquet_path, UNIQUE_KEYS[table], name=table, source=csv_path)


def read_shop_tables(spark: SparkSession, folder: str):
    """Open the normalised Parquet tables written by ``ingest_csv`` (one folder per table).

    Their ``unique_key(name)`` is what the table's manifest proves; a table that came another way,
    or whose files have changed since, has none and is counted by distinct values.
    ``shop_orders`` (orders with their primary product, read by the product-success report)
    is the ``orders`` table itself; the test views only split it because they build web
    orders and shop orders from different test tables.
    """
    from cartwheel.sources.testviews import LazyTables
    base = folder.rstrip("/")
    builders = {name: (lambda n=name: spark.read.parquet(f"{base}/{n}")) for name in SHOP_SCHEMAS}
    tables = LazyTables(builders, lambda name: proven_key(spark, f"{base}/{name}"))
    builders["shop_orders"] = lambda: tables["orders"]
    return tables


def register_views(spark: SparkSession, tables) -> None:
    """Expose the tables to ``spark.sql`` under their names (session-scoped temp views)."""
    for name, df in tables.items():
        df.createOrReplaceTempView(name)


KEY_PROPERTY = "cartwheel.unique_key"
# Tables whose joins and pre-aggregations are keyed on the session id.
SESSION_KEYED = ("website_sessions", "website_pageviews", "orders")


def save_bucketed(tables, buckets: int, *, prefix: str = "", key: str = "website_session_id",
                  location: str | None = None) -> None:
    """Write the session-keyed tables as catalog tables bucketed (and sorted) by ``key``.

    With the same bucket count on sessions, page views and orders, the reports' per-session
    pre-aggregations and their session joins read co-partitioned buckets and shuffle nothing;
    only the final, small per-dimension aggregation moves data. The other tables are written
    as plain catalog tables. Tables go to ``spark.sql.warehouse.dir`` (shared storage on a
    cluster), or below ``location`` as external tables. A proof of a table's key
    (``tables.unique_key``) goes with it as a table property.
    """
    proven = getattr(tables, "unique_key", lambda name: None)
    for name, df in tables.items():
        writer = df.write.mode("overwrite").format("parquet")
        if location:
            writer = writer.option("path", f"{location.rstrip('/')}/{prefix}{name}")
        if name in SESSION_KEYED:
            writer = writer.bucketBy(buckets, key).sortBy(key)
        writer.saveAsTable(f"{prefix}{name}")
        if proven(name):
            df.sparkSession.sql(f"ALTER TABLE `{prefix}{name}` SET TBLPROPERTIES ('{KEY_PROPERTY}' = '{proven(name)}')")


def read_catalog_tables(spark: SparkSession, *, prefix: str = ""):
    """The shop tables from the catalog (bucketed ones keep their bucketing)."""
    from cartwheel.sources.testviews import LazyTables
    names = list(SHOP_SCHEMAS)
    builders = {n: (lambda n=n: spark.table(f"{prefix}{n}")) for n in names}

    def unique_key(name: str) -> str | None:
        found = spark.sql(f"SHOW TBLPROPERTIES `{prefix}{name}`").where(F.col("key") == KEY_PROPERTY).first()
        return found and found["value"]

    tables = LazyTables(builders, unique_key)
    builders["shop_orders"] = lambda: tables["orders"]
    return tables
