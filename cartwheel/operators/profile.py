"""Table profile: info, shape, head/tail, describe, distinct and missing counts, value counts,
modes, duplicates.

Whole-table statistics are one aggregation job each, with one output row per column
(``stack`` of a one-row aggregate), never a loop of per-column jobs. pandas' implicit row
index does not exist in Spark, so order-dependent operators take an explicit ``order_key``.
"""

from __future__ import annotations

import math
from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from cartwheel.functions.semantics import half_even_pct
from cartwheel.operators.joins import bounded_broadcast, materialize_row, materialize_table
from cartwheel.operators.quantiles import _q, approx_quantiles, exact_quantiles_multi, present

NUMERIC = (T.ByteType, T.ShortType, T.IntegerType, T.LongType, T.FloatType, T.DoubleType, T.DecimalType)


def _s(text: str) -> str:
    return "'" + text.replace("\\", "\\\\").replace("'", "\\'") + "'"


def missing(df: DataFrame, column: str) -> Column:
    """pandas' ``isna``: NULL, and NaN in floating columns."""
    return ~present(df, column)


def _stack(one_row: DataFrame, entries: Sequence[Sequence[str]], names: Sequence[str]) -> DataFrame:
    """Turn a one-row frame into one row per entry; each entry lists SQL expressions."""
    body = ", ".join(", ".join(e) for e in entries)
    return one_row.selectExpr(f"stack({len(entries)}, {body}) AS ({', '.join(names)})")


def numeric_columns(df: DataFrame) -> list[str]:
    return [f.name for f in df.schema.fields if isinstance(f.dataType, NUMERIC)]


def string_columns(df: DataFrame) -> list[str]:
    return [f.name for f in df.schema.fields if isinstance(f.dataType, T.StringType)]


def table_info(df: DataFrame) -> DataFrame:
    """``df.info()``: column, Spark type and non-missing count, in column order."""
    one = df.agg(*[F.count_if(present(df, c)).alias(f"c{i}") for i, c in enumerate(df.columns)])
    entries = [(str(i), _s(f.name), _s(f.dataType.simpleString()), f"c{i}")
               for i, f in enumerate(df.schema.fields)]
    return _stack(one, entries, ["position", "column", "dtype", "non_null"])


def table_shape(df: DataFrame) -> DataFrame:
    """``df.shape`` as one row (n_rows, n_columns)."""
    return df.agg(F.count(F.lit(1)).alias("n_rows")).select(
        "n_rows", F.lit(len(df.columns)).cast("bigint").alias("n_columns"))


def head(df: DataFrame, order_key: str, n: int = 5) -> DataFrame:
    """First ``n`` rows by ``order_key`` (a top-k: no full sort)."""
    return df.orderBy(F.col(_q(order_key)).asc()).limit(n)


def tail(df: DataFrame, order_key: str, n: int = 5) -> DataFrame:
    """Last ``n`` rows by ``order_key``, in ascending order."""
    return df.orderBy(F.col(_q(order_key)).desc()).limit(n).orderBy(F.col(_q(order_key)).asc())


def describe(df: DataFrame, columns: Sequence[str] | None = None, *, local_limit: int = 100_000,
             approx_accuracy: int | None = None) -> DataFrame:
    """``df.describe()`` for numeric columns: count, mean, std, min, 25 %, 50 %, 75 %, max.

    Moments come from one aggregation over all columns; the quartiles are exact
    (``exact_quantiles_multi``: each narrowing round is one scan for all columns), or
    ``percentile_approx`` estimates when ``approx_accuracy`` is given.
    """
    cols = list(columns) if columns is not None else numeric_columns(df)
    names = ["column", "count", "mean", "std", "min", "p25", "p50", "p75", "max"]
    if not cols:
        kinds = ["string", "bigint", *["double"] * 7]
        return df.sparkSession.createDataFrame([], ", ".join(f"{n} {k}" for n, k in zip(names, kinds)))
    aggs = []
    for i, c in enumerate(cols):
        own = F.when(present(df, c), F.col(_q(c)))
        v = own.cast("double")
        aggs += [F.count(v).alias(f"n{i}"), F.avg(v).alias(f"m{i}"), F.stddev_samp(v).alias(f"s{i}"),
                 F.min(own).alias(f"lo{i}"), F.max(own).alias(f"hi{i}")]
    moments = materialize_row(df.agg(*aggs))
    first = moments.first()
    stats = {c: (first[f"n{i}"], first[f"lo{i}"], first[f"hi{i}"]) for i, c in enumerate(cols)}
    if approx_accuracy:
        quartiles = approx_quantiles(df, cols, [0.25, 0.5, 0.75], accuracy=approx_accuracy)
    else:
        quartiles = exact_quantiles_multi(df, cols, [0.25, 0.5, 0.75], local_limit=local_limit, stats=stats)
    with_q = moments.select("*", *[
        F.lit(q).cast("double").alias(f"q{j}_{i}")
        for i, c in enumerate(cols) for j, q in enumerate(quartiles[c])])
    entries = [(_s(c), f"n{i}", f"m{i}", f"s{i}", f"CAST(lo{i} AS DOUBLE)", f"q0_{i}", f"q1_{i}", f"q2_{i}",
                f"CAST(hi{i} AS DOUBLE)") for i, c in enumerate(cols)]
    return _stack(with_q, entries, names)


EPOCH = "TIMESTAMP_NTZ'1970-01-01 00:00:00'"


def datetime_columns(df: DataFrame) -> list[str]:
    return [f.name for f in df.schema.fields if isinstance(f.dataType, (T.TimestampNTZType, T.TimestampType))]


def describe_datetime(df: DataFrame, columns: Sequence[str] | None = None, *,
                      local_limit: int = 100_000) -> DataFrame:
    """``describe()`` of datetime columns (pandas 2): count, mean, min, 25 %, 50 %, 75 %, max as
    zone-less timestamps. Statistics are taken on microseconds since 1970; the mean is exact
    (decimal sum) and truncated, interpolated quartiles are truncated to the microsecond."""
    cols = list(columns) if columns is not None else datetime_columns(df)
    if not cols:
        return df.sparkSession.createDataFrame([], "column string, count bigint, " + ", ".join(
            f"{n} timestamp_ntz" for n in ("mean", "min", "p25", "p50", "p75", "max")))
    micros = df.select(*[F.expr(f"timestampdiff(MICROSECOND, {EPOCH}, {_q(c)})").alias(c) for c in cols])
    aggs = []
    for i, c in enumerate(cols):
        m = F.col(_q(c))
        aggs += [F.count(m).alias(f"n{i}"), F.sum(m.cast("decimal(38,0)")).alias(f"s{i}"),
                 F.min(m).alias(f"lo{i}"), F.max(m).alias(f"hi{i}")]
    one = materialize_row(micros.agg(*aggs))
    first = one.first()
    stats = {c: (first[f"n{i}"], first[f"lo{i}"], first[f"hi{i}"]) for i, c in enumerate(cols)}
    quartiles = exact_quantiles_multi(micros, cols, [0.25, 0.5, 0.75], local_limit=local_limit, stats=stats)

    def ts(us):
        return F.expr(f"timestampadd(MICROSECOND, CAST({'NULL' if us is None else int(us)} AS BIGINT), {EPOCH})")

    def floor_div(s, n):
        return None if not n else (s - (s % n)) // n

    rows = []
    for i, c in enumerate(cols):
        n, lo, hi = stats[c]
        mean = floor_div(int(first[f"s{i}"]), n) if n else None
        qs = [None if q is None else math.floor(q) for q in quartiles[c]]
        rows.append(F.struct(F.lit(c).alias("column"), F.lit(n).cast("bigint").alias("count"),
                             ts(mean).alias("mean"), ts(lo).alias("min"), ts(qs[0]).alias("p25"),
                             ts(qs[1]).alias("p50"), ts(qs[2]).alias("p75"), ts(hi).alias("max")))
    return one.select(F.explode(F.array(*rows)).alias("r")).select("r.*")


def _fingerprint(df: DataFrame, column: str) -> list[Column]:
    """Two numbers ``a``, ``b`` that tell the values of a column apart.

    The hash is one-to-one on values of up to 8 bytes, so those need no second number. Longer
    ones, texts above all, have 128 bits: two of a trillion texts would share them with a
    probability of 1e-15."""
    kind, v = df.schema[column].dataType, F.col(_q(column))
    if isinstance(kind, (T.FloatType, T.DoubleType)):
        v = v + F.lit(0.0)  # a negative zero equals zero
    if isinstance(kind, (T.MapType, T.VariantType)):
        v = v.cast("string")
    narrow = isinstance(kind, (T.NumericType, T.DatetimeType, T.BooleanType)) and not (
        isinstance(kind, T.DecimalType) and kind.precision > 18)
    return [F.xxhash64(v).alias("a"), (F.lit(0).cast("bigint") if narrow else F.xxhash64(F.lit(1), v)).alias("b")]


def nunique(df: DataFrame, *, rsd: float | None = None) -> DataFrame:
    """Distinct non-missing values per column; ``rsd`` switches to HyperLogLog++ estimates.

    Exact: distinct (column, fingerprint) triples of numbers, made unique in each task before the
    shuffle, are counted per column; no value is turned into text and no text is shuffled.
    """
    if rsd is not None:
        one = df.agg(*[F.approx_count_distinct(F.when(present(df, c), F.col(_q(c))), rsd).alias(f"u{i}")
                       for i, c in enumerate(df.columns)])
        return _stack(one, [(_s(c), f"u{i}") for i, c in enumerate(df.columns)], ["column", "nunique"])
    cells = [F.when(present(df, c), F.struct(F.lit(i).alias("i"), *_fingerprint(df, c))) for i, c in enumerate(df.columns)]
    found = df.select(F.explode(F.array(*cells)).alias("p")).where("p IS NOT NULL").select("p.i", "p.a", "p.b")
    found = found.distinct().groupBy("i").agg(F.count(F.lit(1)).alias("nunique"))
    every = df.sparkSession.createDataFrame([(i, c) for i, c in enumerate(df.columns)], "i int, column string")
    return every.join(found, "i", "left").select("column", F.coalesce("nunique", F.lit(0)).alias("nunique"))


def value_counts(df: DataFrame, column: str, n: int | None = 10) -> DataFrame:
    """Count per value, most frequent first (ties by value), missing values excluded."""
    vc = df.where(present(df, column)).groupBy(_q(column)).agg(F.count(F.lit(1)).alias("count"))
    ordered = vc.orderBy(F.desc("count"), F.asc(_q(column)))
    return ordered if n is None else ordered.limit(n)


def modes(df: DataFrame, column: str) -> DataFrame:
    """All most frequent values (pandas ``mode``), ascending; missing values excluded."""
    vc = df.where(present(df, column)).groupBy(_q(column)).agg(F.count(F.lit(1)).alias("count"))
    vc = materialize_table(vc, "value-counts")  # counted once, read twice
    return vc.where(F.col("count") == vc.agg(F.max("count")).scalar()).select(_q(column)).orderBy(_q(column))


def null_mask(df: DataFrame) -> DataFrame:
    """``df.isna()``: one boolean per cell."""
    return df.select(*[missing(df, c).alias(c) for c in df.columns])


def rows_with_null(df: DataFrame, column: str) -> DataFrame:
    return df.where(missing(df, column))


def _null_count_row(df: DataFrame) -> DataFrame:
    return df.agg(F.count(F.lit(1)).alias("_rows"),
                  *[F.count_if(missing(df, c)).alias(f"z{i}") for i, c in enumerate(df.columns)])


def null_counts(df: DataFrame) -> DataFrame:
    """``df.isna().sum()``: missing values per column, one job."""
    return _stack(_null_count_row(df), [(_s(c), f"z{i}") for i, c in enumerate(df.columns)],
                  ["column", "n_missing"])


def null_pct(df: DataFrame, decimals: int = 1) -> DataFrame:
    """Missing percentage per column, rounded half-to-even to ``decimals`` exactly."""
    one = _null_count_row(df)
    pct = one.select(*[half_even_pct(F.col(f"z{i}"), F.col("_rows"), decimals).alias(f"p{i}")
                       for i in range(len(df.columns))])
    return _stack(pct, [(_s(c), f"p{i}") for i, c in enumerate(df.columns)], ["column", "missing_pct"])


def first_keys(df: DataFrame, subset: Sequence[str], order_key: str) -> DataFrame:
    """Smallest ``order_key`` per distinct ``subset`` value (NULLs equal, as in pandas).

    A partial aggregation: a group of copies holding a third of the table costs one row per
    task before the shuffle.
    """
    return df.groupBy(*map(_q, subset)).agg(F.min(_q(order_key)).alias(order_key)).select(_q(order_key))


def _row_hashes(subset: Sequence[str]) -> list[Column]:
    """Two independent hashes of the compared values (64 + 32 bits)."""
    cols = [F.col(_q(c)) for c in subset]
    return [F.xxhash64(*cols).alias("_h1"), F.hash(*cols).alias("_h2")]


def _duplicate_candidates(df: DataFrame, subset: Sequence[str], order_key: str) -> tuple[DataFrame, DataFrame]:
    """(rows that may have a copy, their hash groups).

    Only the hashes are shuffled to find hash groups with more than one member; rows in
    single-member groups are certainly unique. The groups are checkpointed and measured first;
    small ones are broadcast, so cutting out the candidates moves no full rows (long texts) at
    all. Beyond ``MAX_BROADCAST_BYTES`` the cut is a shuffle join on the hashes.
    """
    hashed = df.select("*", *_row_hashes(subset))
    multi = (hashed.select("_h1", "_h2").groupBy("_h1", "_h2").agg(F.count(F.lit(1)).alias("_n"))
             .where(F.col("_n") > 1).select("_h1", "_h2"))
    multi = bounded_broadcast(multi)
    return hashed.join(multi, ["_h1", "_h2"], "left_semi"), multi


def duplicate_rows(df: DataFrame, order_key: str, subset: Sequence[str] | None = None) -> DataFrame:
    """``df[df.duplicated()]``: rows whose ``subset`` values (default: all but the key) already
    occurred at a smaller ``order_key``. ``order_key`` must be unique.

    Exact: hashes only choose the candidates; among them the values themselves are grouped,
    and the result is a join on the unique key, never on the (possibly hot) values.
    """
    subset = list(subset) if subset is not None else [c for c in df.columns if c != order_key]
    cand, _ = _duplicate_candidates(df, subset, order_key)
    return (cand.join(first_keys(cand, subset, order_key), order_key, "left_anti")
            .select(*map(_q, df.columns)))


def drop_duplicates(df: DataFrame, subset: Sequence[str] | None = None,
                    order_key: str | None = None) -> DataFrame:
    """``df.drop_duplicates()``: one row per distinct ``subset``; with ``order_key`` the first.

    Without a key all columns are compared and any copy is as good as another
    (``dropDuplicates``). With a key: rows without a possible copy (by hash) are kept as
    they are; among the candidates the row with the smallest key per value is kept.
    """
    if order_key is None:
        return df.dropDuplicates(list(subset) if subset else None)
    subset = list(subset) if subset is not None else [c for c in df.columns if c != order_key]
    cand, multi = _duplicate_candidates(df, subset, order_key)
    unique = df.select("*", *_row_hashes(subset)).join(multi, ["_h1", "_h2"], "left_anti")
    firsts = cand.join(first_keys(cand, subset, order_key), order_key, "left_semi")
    return unique.select(*map(_q, df.columns)).unionByName(firsts.select(*map(_q, df.columns)))


def categorical_value_counts(df: DataFrame, columns: Sequence[str] | None = None) -> DataFrame:
    """Value counts of every text column in one pass: (column, value, count), missing excluded."""
    cols = list(columns) if columns is not None else string_columns(df)
    pairs = F.explode(F.array(*[
        F.struct(F.lit(c).alias("column"), F.col(_q(c)).cast("string").alias("value")) for c in cols]))
    return (df.select(pairs.alias("p")).select("p.column", "p.value")
            .where(F.col("value").isNotNull())
            .groupBy("column", "value").agg(F.count(F.lit(1)).alias("count")))
