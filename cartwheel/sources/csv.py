"""CSV sources and sink.

* ``load_csv``: declared schema, columns by position, header skipped (``LOAD DATA INFILE``).
* ``load_csv_inferred``: pandas-style read, NA tokens to NULL, then per-column type inference
  in a single distributed aggregation (no driver-side sampling of rows).
  Records may span lines in both (``sources.records``); files are split all the same.
* ``write_csv``: header, no row index; a directory of part files written by the executors.
"""

from __future__ import annotations

import csv
import io
from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from cartwheel.operators.joins import materialize_table
from cartwheel.sources.records import BACKSLASH, DOUBLED, CsvLines

# Strings pandas' read_csv treats as missing by default.
PANDAS_NA_TOKENS = (
    "", "#N/A", "#N/A N/A", "#NA", "-1.#IND", "-1.#QNAN", "-NaN", "-nan", "1.#IND", "1.#QNAN",
    "<NA>", "N/A", "NA", "NULL", "NaN", "None", "n/a", "nan", "null",
)


def load_csv(spark: SparkSession, path: str, schema: T.StructType, *,
             empty_as: str = "null", header: bool = True) -> DataFrame:
    r"""Read CSV into a declared schema (positional binding, ``,`` and ``"``).

    ``empty_as='mysql'`` follows ``LOAD DATA`` (see ``load_data``); ``'null'`` keeps Spark's
    rules (empty is NULL, ``""`` inside quotes is a quote) and fails on a value that its
    column's type cannot hold. Lines ending in ``\r\n`` lose the ``\r``. A quoted field may hold
    newlines; one that never closes fails.
    """
    if empty_as == "mysql":
        return load_data(spark, path, schema, header=header)
    if empty_as != "null":
        raise ValueError("empty_as must be 'null' or 'mysql'")
    lines = CsvLines(spark, path, DOUBLED)
    if lines.spans:
        return _parsed(lines.records(header=header), schema, mode="FAILFAST")
    return (spark.read.schema(schema).option("header", header).option("sep", ",")
            .option("quote", '"').option("escape", '"').option("mode", "FAILFAST").csv(path))


def _parsed(records: DataFrame, schema: T.StructType, *, keep: Sequence[str] = (), **options: str) -> DataFrame:
    """The fields of each record, by the rules of Spark's CSV reader; blank lines are none."""
    fields = F.from_csv("record", schema.toDDL(), {"sep": ",", "quote": '"', "escape": '"', "multiLine": "true"} | options)
    return records.where(F.trim("record") != "").select(*keep, fields.alias("r")).select(*keep, "r.*")


# Letters after a backslash that do not stand for themselves.
_ESCAPES = (("0", "\0"), ("b", "\b"), ("n", "\n"), ("r", "\r"), ("t", "\t"), ("Z", "\x1a"))


def _unescaped(c: Column) -> Column:
    def part(x: Column) -> Column:  # holds no escaped backslash
        for letter, char in _ESCAPES:
            x = F.replace(x, F.lit("\\" + letter), F.lit(char))
        return F.replace(x, F.lit("\\"), F.lit(""))

    return F.array_join(F.transform(F.split(c, r"\\\\", -1), part), "\\")


def _load_data_value(raw: Column) -> Column:
    quoted = raw.startswith('"') & raw.endswith('"') & (F.length(raw) >= 2)
    inner = F.replace(F.substring(raw, F.lit(2), F.length(raw) - 2), F.lit('""'), F.lit('"'))
    null = raw.isin("NULL", "\\N", '"\\N"')
    return F.when(~null, _unescaped(F.when(quoted, inner).otherwise(raw)))


def load_data(spark: SparkSession, path: str, schema: T.StructType, *, header: bool = True) -> DataFrame:
    r"""``LOAD DATA ... FIELDS TERMINATED BY ',' ENCLOSED BY '"' LINES TERMINATED BY '\n'``.

    The backslash escapes (the default). An unquoted ``NULL`` and ``\N`` are NULL, a quoted
    ``"NULL"`` is the word, an empty field is the empty string in text columns and NULL in
    others (MySQL's non-strict mode would store 0); missing fields at the end are NULL, extra
    ones are ignored; a blank line is a row whose first field is empty. A quoted field may hold
    newlines. A value that its column cannot hold, quotes that do not fit or never close, and a
    backslash that ends a line outside quotes fail the query instead of loading something else.
    Files are split into tasks whatever their fields hold.
    """
    lines = CsvLines(spark, path, BACKSLASH).records(header=header)
    found = F.regexp_extract_all("line", F.lit("(?s)" + BACKSLASH.field), F.lit(1))
    rows = lines.select(F.concat(F.lit(","), "record").alias("line")).select("line", found.alias("f"))
    # The fields and their commas make up the whole record, or its quotes do not fit.
    whole = F.aggregate("f", F.lit(0), lambda n, x: n + F.length(x) + 1) == F.length("line")
    broken = F.raise_error(F.concat(F.lit("LOAD DATA: quotes do not fit in line: "), F.col("line")))
    rows = rows.select(F.when(whole, F.col("f")).otherwise(broken.cast("array<string>")).alias("f"))
    out = []
    for i, field in enumerate(schema.fields):
        v = _load_data_value(F.get("f", F.lit(i)))
        if not isinstance(field.dataType, T.StringType):
            v = F.when(F.trim(v) != "", v)
            kind = field.dataType.simpleString()
            bad = F.raise_error(F.concat(F.lit(f"LOAD DATA: column {field.name} cannot hold "), v))
            typed = v.try_cast(kind)
            v = F.when(v.isNotNull() & typed.isNull(), bad.cast(kind)).otherwise(typed)
        out.append(v.alias(field.name))
    return rows.select(*out)


# How pandas' read_csv writes truth values, and what it takes for a number
# (unlike Spark's cast, no type letters such as 1D or 2F).
TRUE_WORDS, FALSE_WORDS = ("True", "TRUE", "true"), ("False", "FALSE", "false")
INTEGER = r"^\s*[+-]?[0-9]+\s*$"
NUMBER = r"^\s*[+-]?([0-9]+[.]?[0-9]*([eE][+-]?[0-9]+)?|[.][0-9]+([eE][+-]?[0-9]+)?|(?i:inf|infinity))\s*$"


def _names(header: str) -> list[str]:
    """Column names of a header record; empty and repeated ones as Spark's reader names them."""
    names = next(csv.reader(io.StringIO(header, newline="")))
    folded = [n.lower() for n in names]
    return [f"_c{i}" if not n else f"{n}{i}" if folded.count(n.lower()) > 1 else n for i, n in enumerate(names)]


def load_csv_inferred(spark: SparkSession, path: str, *,
                      na_tokens=PANDAS_NA_TOKENS, multi_line: bool = False, index: str | None = None) -> DataFrame:
    """pandas-like ``read_csv``: NA tokens become NULL, then each column is typed.

    A column becomes ``bigint`` if every present value is written as an integer, else
    ``double`` if every one is a number, ``boolean`` if every row holds a truth word, else it
    stays ``string``. The file is parsed once, into Parquet below ``spark.checkpoint.dir``;
    one aggregation over that tests all columns, and its one row is all that reaches the
    driver. Unlike pandas, an integer column with missing values stays an integer column;
    ``impute.fill_missing`` widens it only when a fractional value is filled in.

    Quoted fields may hold newlines; files are split into tasks all the same, and a quoted field
    that never closes fails. ``multi_line=True`` leaves such files to Spark's own reader, one task
    a file. ``index`` names a column for pandas' row index: 0, 1, ... by file path and place in the
    file, a unique key for the operators that need an order.
    """
    lines = None if multi_line else CsvLines(spark, path, DOUBLED)
    if index and multi_line:
        raise ValueError("an index needs multi_line=False")
    rows = []
    if index:
        names = _names(lines.header())
        records = lines.numbered(header=True, name=index)
        flat = _parsed(records, T.StructType([T.StructField(f"c{i}", T.StringType()) for i in range(len(names))]), keep=[index])
        rows = [index]
    elif lines and lines.spans:
        names = _names(lines.header())
        flat = _parsed(lines.records(header=True), T.StructType([T.StructField(f"c{i}", T.StringType()) for i in range(len(names))]))
    else:
        raw = (spark.read.option("header", True).option("multiLine", multi_line)
               .option("quote", '"').option("escape", '"').option("inferSchema", False).csv(path))
        names = raw.columns
        flat = raw.toDF(*(f"c{i}" for i in range(len(names))))
    texts = [f"c{i}" for i in range(len(names))]
    cleaned = flat.select(*rows, *(F.when(~F.col(c).isin(list(na_tokens)), F.col(c)).alias(c) for c in texts))
    cleaned = materialize_table(cleaned, "csv-text")
    checks = [F.count(F.lit(1)).alias("rows")]
    for c in texts:
        v = F.col(c)
        checks += [
            F.count_if(v.isNotNull() & ~(v.rlike(INTEGER) & F.trim(v).try_cast("bigint").isNotNull())).alias(f"i{c}"),
            F.count_if(v.isNotNull() & ~v.rlike(NUMBER)).alias(f"d{c}"),
            F.count_if(v.isin(*TRUE_WORDS, *FALSE_WORDS)).alias(f"b{c}"),
            F.count(v).alias(f"n{c}"),
        ]
    stats = cleaned.agg(*checks).first()
    out = list(rows)
    for c, name in zip(texts, names):
        v = F.col(c)
        if stats[f"n{c}"] > 0 and stats[f"i{c}"] == 0:
            v = F.trim(v).cast("bigint")
        elif stats[f"n{c}"] > 0 and stats[f"d{c}"] == 0:
            v = F.trim(v).cast("double")
        elif stats["rows"] > 0 and stats[f"b{c}"] == stats["rows"]:
            v = v.isin(*TRUE_WORDS)
        out.append(v.alias(name))
    return cleaned.select(*out)


# Timestamp text written by ``write_csv`` (full microseconds; Spark's default
# keeps milliseconds only and would cut the rest).
TIMESTAMP_TEXT = "yyyy-MM-dd HH:mm:ss.SSSSSS"


def write_csv(df: DataFrame, path: str, *, mode: str = "overwrite") -> None:
    """Write with a header and no row index (``to_csv(index=False)``); timestamps keep their
    microseconds."""
    (df.write.mode(mode).option("header", True).option("quote", '"').option("escape", '"')
     .option("ignoreLeadingWhiteSpace", False).option("ignoreTrailingWhiteSpace", False)
     .option("timestampFormat", TIMESTAMP_TEXT).option("timestampNTZFormat", TIMESTAMP_TEXT)
     .csv(path))
