"""Missing-value handling: choose columns by missing share, fill by rule, parse dates.

Fill values are computed by aggregations whose results are a handful of numbers (a median,
means, modes) or one row per group (group means); they are brought back as literals or by a
join on the group key, never by collecting rows.
"""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from cartwheel.operators.joins import bounded_broadcast
from cartwheel.operators.profile import NUMERIC, null_pct
from cartwheel.operators.quantiles import INTEGRAL, _q, exact_median, present

EPOCH = "TIMESTAMP_NTZ'1970-01-01 00:00:00'"


def missing_pct_map(df: DataFrame, decimals: int = 1) -> dict[str, float]:
    """{column: missing %}; one aggregation job, one small row to the driver."""
    return {r["column"]: r["missing_pct"] for r in null_pct(df, decimals).collect()}


def sparse_columns(pct: Mapping[str, float], threshold: float = 30.0) -> list[str]:
    return [c for c, p in pct.items() if p is not None and p > threshold]


def imputable_columns(pct: Mapping[str, float], lo: float = 0.0, hi: float = 30.0) -> list[str]:
    """Columns with ``lo < missing % < hi`` (exclusive: exactly 30.0 is neither dropped nor
    imputed, and a share that rounds to 0.0 is not imputed)."""
    return [c for c, p in pct.items() if p is not None and lo < p < hi]


def drop_sparse_columns(df: DataFrame, threshold: float = 30.0, decimals: int = 1) -> DataFrame:
    """Drop columns whose rounded missing percentage exceeds ``threshold``."""
    return df.drop(*sparse_columns(missing_pct_map(df, decimals), threshold))


def imputable_report(df: DataFrame, lo: float = 0.0, hi: float = 30.0, decimals: int = 1) -> DataFrame:
    """(column, missing_pct) of the columns ``imputable_columns`` would choose."""
    pct = null_pct(df, decimals)
    return pct.where((F.col("missing_pct") > lo) & (F.col("missing_pct") < hi))


def fill_missing(df: DataFrame, values: Mapping[str, object]) -> DataFrame:
    """Replace missing cells (NULL, and NaN in floating columns) by per-column values.

    An integer column filled with a fractional value (a mean, an interpolated median) becomes
    DOUBLE, as it already is in pandas once it holds a missing value; the value is not cut.
    """
    out = []
    for c in df.columns:
        value = values.get(c)
        if value is None:
            out.append(F.col(_q(c)))
            continue
        dtype = df.schema[c].dataType
        if isinstance(dtype, INTEGRAL) and isinstance(value, float) and not value.is_integer():
            dtype = T.DoubleType()
        out.append(F.when(present(df, c), F.col(_q(c)).cast(dtype))
                   .otherwise(F.lit(value).cast(dtype)).alias(c))
    return df.select(*out)


def impute_median(df: DataFrame, column: str) -> DataFrame:
    """Fill ``column`` with its exact median."""
    return fill_missing(df, {column: exact_median(df, column)})


def impute_mean(df: DataFrame, columns: Sequence[str]) -> DataFrame:
    """Fill each numeric column with its mean (one aggregation for all columns)."""
    cols = [c for c in columns if isinstance(df.schema[c].dataType, NUMERIC)]
    if not cols:
        return df
    row = df.agg(*[F.avg(F.when(present(df, c), F.col(_q(c)))).alias(c) for c in cols]).first()
    return fill_missing(df, {c: row[c] for c in cols})


def impute_constant(df: DataFrame, columns: Sequence[str], value: str = "nodata") -> DataFrame:
    """Fill text columns with a constant."""
    return fill_missing(df, {c: value for c in columns})


def smallest_modes(df: DataFrame, columns: Sequence[str]) -> dict[str, object]:
    """{column: smallest most-frequent value} for text columns, in one shuffle of
    (column, value) counts; only one value per column reaches the driver."""
    if not columns:
        return {}
    pairs = F.explode(F.array(*[
        F.struct(F.lit(c).alias("column"), F.col(_q(c)).cast("string").alias("value")) for c in columns]))
    vc = (df.select(pairs.alias("p")).select("p.column", "p.value").where(F.col("value").isNotNull())
          .groupBy("column", "value").agg(F.count(F.lit(1)).alias("n")))
    # The most frequent value, the smallest of several: the least of (-count, value).
    best = vc.groupBy("column").agg(F.min(F.struct((-F.col("n")).alias("n"), "value")).alias("best"))
    return {r["column"]: r["best"]["value"] for r in best.collect()}


def impute_mode(df: DataFrame, columns: Sequence[str]) -> DataFrame:
    """Fill text columns with their (smallest) mode: the rule the reference describes."""
    return fill_missing(df, smallest_modes(df, columns))


# Patterns tried where none is given.
DATE_PATTERNS = (
    "yyyy-MM-dd", "dd-MM-yyyy", "MM-dd-yyyy", "yyyy/MM/dd", "dd/MM/yyyy", "MM/dd/yyyy", "dd.MM.yyyy", "yyyyMMdd",
    "dd-MMM-yyyy", "dd MMM yyyy", "MMM dd, yyyy", "yyyy-MM-dd HH:mm:ss", "yyyy-MM-dd HH:mm:ss.SSSSSS",
    "yyyy-MM-dd'T'HH:mm:ss", "dd-MM-yyyy HH:mm:ss", "dd/MM/yyyy HH:mm:ss", "MM/dd/yyyy HH:mm:ss",
)


def _parsed(column: str, fmt: str):
    return F.try_to_timestamp(F.col(_q(column)), F.lit(fmt)).cast("timestamp_ntz")


def found_pattern(df: DataFrame, column: str, patterns: Sequence[str] = DATE_PATTERNS) -> str:
    """The pattern that reads most of a column's texts, from one aggregation over all of them.

    Where several read as many but not all alike (only days up to 12, say), none is guessed:
    ValueError names two. So it does where no text fits any; a column without texts takes the first.
    """
    counts = df.agg(F.count(_q(column)), *(F.count(_parsed(column, p)) for p in patterns)).first()
    texts, fits = counts[0], counts[1:]
    if not texts:
        return patterns[0]
    best = [p for p, n in zip(patterns, fits, strict=True) if n == max(fits)]
    if not max(fits):
        raise ValueError(f"{column}: no text is a date by {', '.join(patterns)}")
    if len(best) > 1:
        first, *others = (_parsed(column, p) for p in best)
        differ = df.agg(*(F.count_if(~first.eqNullSafe(o)) for o in others)).first()
        for other, n in zip(best[1:], differ, strict=True):
            if n:
                raise ValueError(f"{column}: {best[0]} and {other} read equally many texts ({max(fits)}), {n} of them "
                                 "differently; give a pattern")
    return best[0]


def parse_datetime(df: DataFrame, column: str, fmt: str | None = None) -> DataFrame:
    """Text -> zone-less timestamp by a pattern, without one by ``found_pattern``; unparsable text
    becomes NULL."""
    return df.withColumn(column, _parsed(column, fmt or found_pattern(df, column)))


def _micros(c: str):
    return F.expr(f"timestampdiff(MICROSECOND, {EPOCH}, {_q(c)})")


def group_means_datetime(df: DataFrame, columns: Sequence[str], key: str) -> DataFrame:
    """(key, _mean0, _mean1, ...): per group, the average timestamp of each column, truncated
    to the microsecond, in one aggregation. Sums of microseconds are exact (decimal); a
    group with no value in a column gets NULL for it."""
    aggs = []
    for i, c in enumerate(columns):
        aggs += [F.sum(_micros(c).cast("decimal(38,0)")).alias(f"_s{i}"), F.count(F.col(_q(c))).alias(f"_n{i}")]
    agg = df.where(F.col(_q(key)).isNotNull()).groupBy(_q(key)).agg(*aggs)
    means = []
    for i in range(len(columns)):
        n = F.when(F.col(f"_n{i}") > 0, F.col(f"_n{i}").cast("decimal(38,0)"))
        q = ((F.col(f"_s{i}") - F.pmod(F.col(f"_s{i}"), n)) / n).cast("bigint")  # floor, exact
        means.append(F.timestamp_add("MICROSECOND", q, F.expr(EPOCH)).alias(f"_mean{i}"))
    return agg.select(_q(key), *means)


def group_mean_datetime(df: DataFrame, column: str, key: str) -> DataFrame:
    """(key, _mean) for one column (see ``group_means_datetime``)."""
    return group_means_datetime(df, [column], key).withColumnRenamed("_mean0", "_mean")


def impute_group_means_datetime(df: DataFrame, columns: Sequence[str], key: str) -> DataFrame:
    """Fill missing datetimes with the mean of their group, for several columns that share the
    grouping key: one aggregation and one join for all of them.

    Group means are a grouped aggregation (partial, so a hot group is cheap) joined back on
    the key: broadcast when the groups take at most ``MAX_BROADCAST_BYTES`` (measured), so the
    table is not shuffled at all; otherwise a shuffle join in which AQE splits a hot key's
    partition. Rows with a NULL key and all-missing groups stay NULL.
    """
    columns = list(columns)
    means = bounded_broadcast(group_means_datetime(df, columns, key))
    pos = {c: i for i, c in enumerate(columns)}
    cols = [F.coalesce(F.col(_q(c)), F.col(f"_mean{pos[c]}")).alias(c) if c in pos else F.col(_q(c))
            for c in df.columns]
    return df.join(means, key, "left").select(*cols)


def impute_group_mean_datetime(df: DataFrame, column: str, key: str) -> DataFrame:
    """One datetime column filled with its group mean (see ``impute_group_means_datetime``)."""
    return impute_group_means_datetime(df, [column], key)
