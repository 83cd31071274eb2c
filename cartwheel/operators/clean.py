"""The cleaning run of the notebook, as stated rules applied column by column.

parse dates -> missing % -> drop columns above the threshold -> fill the columns strictly
between 0 % and the threshold (designated median columns; other numeric columns with the
mean; datetime columns with their group mean; text with a constant) -> cleaned frame.

The notebook's loop fills the *whole frame* with the first numeric column's value; that is a
missing shares are taken and are never constant-filled.
"""

from __future__ import annotations

from collections.abc import Mapping
from dataclasses import dataclass, field

from pyspark.sql import DataFrame
from pyspark.sql import types as T

from pyspark.sql import functions as F

from cartwheel.functions.semantics import half_even_pct
from cartwheel.operators.impute import (
    fill_missing, impute_group_means_datetime, imputable_columns, parse_datetime, sparse_columns,
)
from cartwheel.operators.joins import materialize_table
from cartwheel.operators.profile import NUMERIC
from cartwheel.operators.quantiles import _q, exact_quantiles_multi, present


@dataclass(frozen=True)
class CleanRules:
    median_columns: tuple[str, ...] = ()
    date_formats: Mapping[str, str] = field(default_factory=dict)     # text column -> pattern
    group_mean_keys: Mapping[str, str] = field(default_factory=dict)  # datetime column -> key
    text_fill: str = "nodata"
    drop_above: float = 30.0
    impute_between: tuple[float, float] = (0.0, 30.0)
    decimals: int = 1
    #: Columns filled, whatever their own share, as soon as any text column is: text with
    #: ``text_fill``, datetimes with their group mean.
    with_text: tuple[str, ...] = ()


def clean_table(df: DataFrame, rules: CleanRules, *, materialize: bool = False) -> DataFrame:
    """Apply ``rules``; returns the cleaned frame (write it with ``sources.write_csv``).

    ``materialize`` writes the parsed input once as Parquet below ``spark.checkpoint.dir``
    and runs the statistics passes on that copy: worth it when the input is an expensive
    lineage (a CSV with inference, a join); a Parquet scan is cheaper to re-read column by
    column than to copy.
    """
    for column, fmt in rules.date_formats.items():
        df = parse_datetime(df, column, fmt)
    if materialize:
        df = materialize_table(df, "clean-input")
    # One aggregation gives every number the rules need except the medians: missing %,
    # the mean of each numeric column, and count/min/max of the median columns.
    types = {f.name: f.dataType for f in df.schema.fields}
    numeric = [c for c in df.columns if isinstance(types[c], NUMERIC)]
    medians = [c for c in rules.median_columns if c in types]
    aggs = [F.count(F.lit(1)).alias("_rows")]
    aggs += [F.count_if(~present(df, c)).alias(f"z{i}") for i, c in enumerate(df.columns)]
    aggs += [F.avg(F.when(present(df, c), F.col(_q(c)))).alias(f"m{i}") for i, c in enumerate(numeric)]
    for i, c in enumerate(medians):
        v = F.when(present(df, c), F.col(_q(c)))
        aggs += [F.count(v).alias(f"mn{i}"), F.min(v).alias(f"mlo{i}"), F.max(v).alias(f"mhi{i}")]
    one = df.agg(*aggs)
    row = one.select("*", *[half_even_pct(F.col(f"z{i}"), F.col("_rows"), rules.decimals).alias(f"p{i}")
                            for i in range(len(df.columns))]).first()
    pct = {c: row[f"p{i}"] for i, c in enumerate(df.columns)}
    means = {c: row[f"m{i}"] for i, c in enumerate(numeric)}
    median_stats = {c: (row[f"mn{i}"], row[f"mlo{i}"], row[f"mhi{i}"]) for i, c in enumerate(medians)}

    df = df.drop(*sparse_columns(pct, rules.drop_above))
    lo, hi = rules.impute_between
    todo = [c for c in imputable_columns(pct, lo, hi) if c in df.columns]
    if any(isinstance(types[c], T.StringType) for c in todo):
        todo += [c for c in rules.with_text if c in df.columns and c not in todo]
    fills: dict[str, object] = {}
    median_todo = [c for c in todo if c in medians]
    if median_todo:
        q = exact_quantiles_multi(df, median_todo, [0.5], stats={c: median_stats[c] for c in median_todo})
        fills.update({c: q[c][0] for c in median_todo})
    for c in todo:
        if c in fills:
            continue
        if isinstance(types[c], NUMERIC):
            fills[c] = means[c]
        elif isinstance(types[c], T.StringType):
            fills[c] = rules.text_fill
    out = fill_missing(df, fills)
    by_key: dict[str, list[str]] = {}
    for c in todo:
        if isinstance(types[c], (T.TimestampNTZType, T.TimestampType)) and c in rules.group_mean_keys:
            by_key.setdefault(rules.group_mean_keys[c], []).append(c)
    for key, cols in by_key.items():  # one aggregation and one join per group key
        out = impute_group_means_datetime(out, cols, key)
    return out


def clean_csv(spark, source: str, target: str, rules: CleanRules) -> DataFrame:
    """The notebook end to end: pandas-style CSV read -> ``clean_table`` -> CSV without an
    index. Returns the written table, read back in its types."""
    from cartwheel.sources.csv import load_csv, load_csv_inferred, write_csv
    cleaned = clean_table(load_csv_inferred(spark, source), rules)
    write_csv(cleaned, target)
    return load_csv(spark, target, cleaned.schema)
