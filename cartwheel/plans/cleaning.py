"""The notebook's profile and cleaning steps (P-01 .. P-27) as named queries on the
cleaning inputs of FIXTURES.md §2."""

from __future__ import annotations

from dataclasses import replace

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from cartwheel.operators import impute, outliers, profile
from cartwheel.operators.clean import CleanRules, clean_csv, clean_table
from cartwheel.operators.joins import materialize_table
from cartwheel.session import scratch_path
from cartwheel.sources import testviews as tv
from cartwheel.sources.csv import load_csv, load_csv_inferred, write_csv

# Which register columns play which role in the cleaning run.
REGISTER_KEY = "o_orderkey"
REGISTER_RULES = CleanRules(
    median_columns=("c_acctbal",),
    date_formats={"reg_date": "yyyy-MM-dd"},
    group_mean_keys={"o_orderdate": "o_orderstatus", "reg_date": "o_orderstatus"},
)

# The same rules for the register read back from CSV, where times are text; the share of missing
# o_custkey is zero, so only the rule of columns filled with any text reaches c_mktsegment.
CSV_RULES = replace(REGISTER_RULES, date_formats={"reg_date": "yyyy-MM-dd", "o_orderdate": "yyyy-MM-dd HH:mm:ss.SSSSSS"},
                    with_text=("c_mktsegment", "o_orderdate"))


def _reg(spark: SparkSession, d: str) -> DataFrame:
    return tv.register(spark, d)


def _docs(spark: SparkSession, d: str) -> DataFrame:
    return tv.documents(spark, d)


def _events(spark: SparkSession, d: str) -> DataFrame:
    return tv.event_values(spark, d)


def register_csv_roundtrip(spark: SparkSession, d: str) -> DataFrame:
    """Write the register as CSV (header, no index) below spark.checkpoint.dir and load it
    back into its declared schema (positional binding)."""
    df = _reg(spark, d)
    path = scratch_path(spark, "register-csv")
    write_csv(df, path)
    return load_csv(spark, path, df.schema)


def register_csv_inferred(spark: SparkSession, d: str) -> DataFrame:
    """The same CSV, with a column of codes that look like typed numbers and a dot in its
    name, read pandas-style: NA tokens are missing, column types inferred."""
    df = _reg(spark, d).withColumn("store.code", F.concat((F.col("o_custkey") % 9).cast("string"), F.lit("D")))
    path = scratch_path(spark, "register-csv")
    write_csv(df, path)
    return load_csv_inferred(spark, path)


def _register_without_key(spark: SparkSession, d: str) -> DataFrame:
    """The register as a CSV without its key, in the key's order, read with pandas' row index."""
    path = scratch_path(spark, "register-csv")
    write_csv(_reg(spark, d).orderBy(REGISTER_KEY).drop(REGISTER_KEY), path)
    return load_csv_inferred(spark, path, index="row_no")


def indexed_rows(spark: SparkSession, d: str) -> DataFrame:
    """Head, tail, repeated rows and the missing-value map's ranges of a table whose only order is
    that of its files: row_no, what each row is to them, and its order status."""
    df = materialize_table(_register_without_key(spark, d), "indexed")
    compared = ["o_orderstatus", "o_orderpriority", "c_mktsegment"]
    parts = [profile.head(df, "row_no", 5).withColumn("part", F.lit("head")),
             profile.tail(df, "row_no", 5).withColumn("part", F.lit("tail")),
             profile.duplicate_rows(df.select("row_no", *compared), "row_no").withColumn("part", F.lit("repeated"))]
    rows = [p.select("part", "row_no", "o_orderstatus") for p in parts]
    return rows[0].unionAll(rows[1]).unionAll(rows[2])


def _reg_once(spark: SparkSession, d: str) -> DataFrame:
    """The register (a three-way join) written once, for operators of several passes."""
    return materialize_table(_reg(spark, d), "register")


# The fields of ``csv_mysql``, by customer key modulo 8; None stands for the text.
MYSQL_FIELDS = ("", "NULL", '"NULL"', "\\N", '"a \\"quoted\\" word"', '"doubled "" quote, comma"', "back\\\\slash", None)
MYSQL_SCHEMA = T.StructType([
    T.StructField("c_custkey", T.LongType()), T.StructField("note", T.StringType()),
    T.StructField("c_acctbal", T.DoubleType()), T.StructField("c_name", T.StringType())])


def customer_load_data(spark: SparkSession, d: str) -> DataFrame:
    """Customers written as a server export (every kind of field, CRLF line ends, numbers that
    are empty or NULL) and read by the LOAD DATA rules."""
    key = F.col("c_custkey")
    note = F.lit(None).cast("string")
    for i, text in enumerate(MYSQL_FIELDS):
        note = F.when(key % len(MYSQL_FIELDS) == i, F.col("c_name") if text is None else F.lit(text)).otherwise(note)
    number = F.when(key % 5 == 0, F.lit("")).when(key % 5 == 1, F.lit("NULL")).otherwise(F.col("c_acctbal").cast("string"))
    rows = spark.read.parquet(f"{d}/customer.parquet").select(F.concat_ws(
        ",", key.cast("string"), note, number, F.concat(F.lit('"'), F.col("c_name"), F.lit('"'))).alias("line"))
    path = scratch_path(spark, "customer-export")
    rows.write.option("lineSep", "\r\n").text(path)
    return load_csv(spark, path, MYSQL_SCHEMA, empty_as="mysql", header=False)


def _text_digests(df: DataFrame) -> DataFrame:
    """Documents with a digest in place of their texts."""
    return df.select("doc_id", "source", "lang", "n_chars", F.length("text").cast("bigint").alias("text_chars"),
                     F.sha2(F.col("text").cast("binary"), 256).alias("text_sha256"))


def documents_csv_lines(spark: SparkSession, d: str) -> DataFrame:
    """Documents, whose texts hold newlines, commas and quotes, written as CSV and read
    pandas-style; files are split although records span lines."""
    path = scratch_path(spark, "documents-csv")
    write_csv(_docs(spark, d), path)
    return _text_digests(load_csv_inferred(spark, path))


DOCUMENTS_SCHEMA = T.StructType([
    T.StructField("doc_id", T.LongType()), T.StructField("text", T.StringType()), T.StructField("lang", T.StringType()),
    T.StructField("source", T.StringType()), T.StructField("n_chars", T.LongType())])


def documents_load_data(spark: SparkSession, d: str) -> DataFrame:
    """Documents written as a server export, with escapes and raw newlines inside quotes, and read
    by the LOAD DATA rules."""
    def field(c: str):
        v = F.col(c).cast("string")
        for plain, escaped in (("\\", "\\\\"), ('"', '\\"'), ("\0", "\\0")):
            v = F.replace(v, F.lit(plain), F.lit(escaped))
        return F.coalesce(F.concat(F.lit('"'), v, F.lit('"')), F.lit("\\N"))

    path = scratch_path(spark, "documents-export")
    names = [f.name for f in DOCUMENTS_SCHEMA.fields]
    _docs(spark, d).select(F.concat_ws(",", *map(field, names)).alias("line")).write.option("lineSep", "\r\n").text(path)
    return _text_digests(load_csv(spark, path, DOCUMENTS_SCHEMA, empty_as="mysql", header=False))


def register_cleaned_csv(spark: SparkSession, d: str) -> DataFrame:
    """The notebook end to end: the register as CSV in, the cleaned CSV out, read back."""
    source = scratch_path(spark, "register-csv")
    write_csv(_reg(spark, d), source)
    return clean_csv(spark, source, scratch_path(spark, "cleaned-csv"), CSV_RULES)


CLEANING_QUERIES = {
    "csv_roundtrip": register_csv_roundtrip,
    "csv_inferred": register_csv_inferred,
    "csv_mysql": customer_load_data,
    "csv_quoted_lines": documents_csv_lines,
    "indexed_rows": indexed_rows,
    "indexed_null_map": lambda s, d: outliers.null_map(_register_without_key(s, d), "row_no", 20),
    "csv_mysql_lines": documents_load_data,
    "clean_csv": register_cleaned_csv,
    "table_info": lambda s, d: profile.table_info(_reg(s, d)),
    "table_shape": lambda s, d: profile.table_shape(_reg(s, d)),
    "head_rows": lambda s, d: profile.head(_reg(s, d), REGISTER_KEY, 5),
    "tail_rows": lambda s, d: profile.tail(_reg(s, d), REGISTER_KEY, 5),
    "describe": lambda s, d: profile.describe(_reg_once(s, d)),
    "describe_datetime": lambda s, d: profile.describe_datetime(_reg_once(s, d)),
    "nunique": lambda s, d: profile.nunique(_reg(s, d)),
    "value_counts": lambda s, d: profile.value_counts(_reg(s, d), "o_orderpriority", 10),
    "modes": lambda s, d: profile.modes(_reg(s, d), "c_mktsegment"),
    "null_mask": lambda s, d: profile.null_mask(_reg(s, d)),
    "rows_with_null": lambda s, d: profile.rows_with_null(_reg(s, d), "c_acctbal"),
    "null_counts": lambda s, d: profile.null_counts(_reg(s, d)),
    "null_pct": lambda s, d: profile.null_pct(_reg(s, d), 1),
    "null_pct_whole": lambda s, d: profile.null_pct(_reg(s, d), 0),
    "duplicate_rows": lambda s, d: profile.duplicate_rows(_docs(s, d), "doc_id", ["text", "lang"]),
    "drop_duplicates": lambda s, d: profile.drop_duplicates(_docs(s, d), ["text", "lang"], "doc_id"),
    "drop_duplicate_texts": lambda s, d: profile.drop_duplicates(_docs(s, d).select("text", "lang")),
    "categorical_value_counts": lambda s, d: profile.categorical_value_counts(_reg(s, d)),
    "boxplot_stats": lambda s, d: outliers.boxplot_stats(_events(s, d), "value"),
    "iqr_bounds": lambda s, d: outliers.iqr_bounds(_events(s, d), "value"),
    "remove_outliers_iqr": lambda s, d: outliers.remove_outliers_iqr(_events(s, d), "value"),
    "null_map": lambda s, d: outliers.null_map(_reg(s, d), REGISTER_KEY, 20),
    "null_map_text": lambda s, d: outliers.null_map(_reg_once(s, d), "reg_date", 20),
    "drop_sparse_columns": lambda s, d: impute.drop_sparse_columns(tv.doc_labels(s, d)),
    "imputable_columns": lambda s, d: impute.imputable_report(_reg(s, d)),
    "impute_median": lambda s, d: impute.impute_median(_reg_once(s, d), "c_acctbal"),
    "impute_mean": lambda s, d: impute.impute_mean(_reg_once(s, d), ["c_acctbal", "o_totalprice"]),
    "impute_constant": lambda s, d: impute.impute_constant(_reg(s, d), ["o_orderpriority"]),
    "impute_mode": lambda s, d: impute.impute_mode(_reg_once(s, d), ["o_orderpriority", "c_mktsegment"]),
    "parse_datetime": lambda s, d: impute.parse_datetime(_reg(s, d), "reg_date", "yyyy-MM-dd"),
    "parse_datetime_found": lambda s, d: impute.parse_datetime(_reg(s, d), "reg_date"),
    "impute_group_mean_datetime": lambda s, d: impute.impute_group_mean_datetime(
        _reg_once(s, d), "o_orderdate", "o_orderstatus"),
    "clean_table": lambda s, d: clean_table(_reg_once(s, d), REGISTER_RULES),
}
