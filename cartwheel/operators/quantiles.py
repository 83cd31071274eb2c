"""Exact quantiles without gathering a column into one task.

``percentile`` in Spark merges one value -> count map per group in a single task, which is
unbounded for a high-cardinality column at scale. Here the k-th smallest value is found by
narrowing: each pass is one distributed ``GROUP BY window, bucket(v)`` returning a bounded
number of (count, min, max) rows per open window; the bucket holding rank k becomes the next
window, until a window holds one distinct value. Values are compared and bucketed in a type
that holds them exactly: integers as BIGINT, floats as DOUBLE, each decimal type as itself.

Every pass makes progress whatever the values, so no cap on the passes is needed: buckets of
integers and decimals are exact quotients, so the window shrinks by the number of buckets each
time (at most 7 passes for 64 bits, 14 for 38 digits at the default); doubles are split by
infinity, by sign, by binary order of magnitude while a window spans more than two, then
linearly, where the smallest and largest value always fall into different buckets.

A window of at most ``local_limit`` values is finished in one pass by sorting that bounded
slice inside one task; the limit changes the number of passes, never a value. All ranks of all
columns of a type are refined together, so a pass is one scan whatever the number of columns.

Longer columns do not start from their whole range: one pass builds a mergeable KLL sketch of
each, which gives a bracket for every rank, and one more counts what lies below the brackets and
the distinct values inside. Where the counts show a rank outside its bracket, or a bracket is too
long to bring to the driver, the narrowing above goes on from there, so a sketch's error costs a
pass and never changes a value.

Interpolation follows the linear rule shared by numpy ``percentile`` and DuckDB
``quantile_cont``: h = (n - 1) p, value = x[floor h] + (h - floor h) (x[ceil h] - x[floor h]).
"""

from __future__ import annotations

import math
from collections.abc import Sequence
from dataclasses import dataclass, field, replace
from decimal import Decimal
from fractions import Fraction

from pyspark.sql import Column, DataFrame, Observation
from pyspark.sql import functions as F
from pyspark.sql import types as T

INTEGRAL = (T.ByteType, T.ShortType, T.IntegerType, T.LongType)
FLOATING = (T.FloatType, T.DoubleType)


@dataclass
class _Window:
    g: int                # which column
    lo: object
    hi: object
    offset: int           # number of values of the column below ``lo``
    count: int            # number of values in [lo, hi]
    ranks: list[int] = field(default_factory=list)


def exact_type(dtype: T.DataType) -> T.DataType:
    """The type in which values of ``dtype`` are compared without loss."""
    if isinstance(dtype, INTEGRAL):
        return T.LongType()
    if isinstance(dtype, FLOATING):
        return T.DoubleType()
    if isinstance(dtype, T.DecimalType):
        return dtype
    raise TypeError(f"quantiles need a numeric column, not {dtype.simpleString()}")


def _q(name: str) -> str:
    return "`" + name.replace("`", "``") + "`"


def present(df: DataFrame, column: str) -> Column:
    """Non-missing test: NULL, and NaN for floating columns, are missing (pandas' view)."""
    c = F.col(_q(column))
    if isinstance(df.schema[column].dataType, FLOATING):
        return c.isNotNull() & ~F.isnan(c)
    return c.isNotNull()


def _window_id(windows: list[_Window]) -> Column:
    g, v = F.col("g"), F.col("v")
    wid = None
    for i, w in enumerate(windows):
        cond = (g == w.g) & (v >= F.lit(w.lo)) & (v <= F.lit(w.hi))
        wid = F.when(cond, F.lit(i)) if wid is None else wid.when(cond, F.lit(i))
    return wid


def _choose(windows: list[_Window], per_window) -> Column:
    out = None
    for i, w in enumerate(windows):
        e = per_window(w)
        out = F.when(F.col("w") == i, e) if out is None else out.when(F.col("w") == i, e)
    return out


def order_statistics(values: DataFrame, requests: dict[int, tuple[int, object, object, Sequence[int]]], *,
                     buckets: int = 1024, local_limit: int = 100_000,
                     windows: Sequence[_Window] = ()) -> dict[tuple[int, int], object]:
    """Values at 0-based ranks, for several columns of one type at once.

    ``values`` has columns ``g`` (column number) and ``v`` (non-missing values only, in their
    exact type); ``requests[g] = (count, min, max, ranks)`` of column ``g``; ``windows`` are
    further ranges to start from. Returns {(g, rank): value}.
    """
    result: dict[tuple[int, int], object] = {}
    windows = [*windows] + [_Window(g, lo, hi, 0, n, sorted(set(ranks)))
               for g, (n, lo, hi, ranks) in requests.items() if n]
    while windows:
        for w in windows:
            if w.lo == w.hi:
                result.update({(w.g, r): w.lo for r in w.ranks})
        windows = [w for w in windows if w.lo != w.hi]
        small = [w for w in windows if w.count <= local_limit]
        if small:
            _resolve_small(values, small, result)
        large = [w for w in windows if w.count > local_limit]
        windows = _narrow(values, large, buckets) if large else []
    return result


def _double_bucket(v: Column, lo: float, hi: float, buckets: int) -> Column:
    """A number that never falls as ``v`` grows and differs between ``lo`` and ``hi``."""
    if math.isinf(lo) or math.isinf(hi):
        return F.when(v == F.lit(-math.inf), -1).when(v == F.lit(math.inf), 1).otherwise(0)
    if lo < 0 < hi or lo == 0 or hi == 0:
        # Zero on its own; zeros of either sign are equal.
        return F.when(v < 0, -1).when(v > 0, 1).otherwise(0)
    small, large = sorted((abs(lo), abs(hi)))
    if large / small > 4:
        order = F.floor(F.log2(F.abs(v)))
        return order if lo > 0 else -order
    return F.floor((v - F.lit(lo)) / F.lit(hi - lo) * F.lit(float(buckets)))


def _bucket(v: Column, lo, hi, buckets: int) -> Column:
    if isinstance(lo, float):
        return _double_bucket(v, lo, hi, buckets)
    if isinstance(lo, Decimal):
        scale = -min(lo.as_tuple().exponent, hi.as_tuple().exponent, 0)
        unit = max(1, int((hi - lo).scaleb(scale)) // buckets)
        step = F.lit(Decimal(unit).scaleb(-scale))
    else:
        step = F.lit(max(1, (hi - lo) // buckets)).cast("bigint")
    # A quotient cut towards zero never falls as v grows; only its bucket 0 is twice as wide.
    return F.call_function("div", v, step)


def _narrow(values: DataFrame, windows: list[_Window], buckets: int) -> list[_Window]:
    bucket = _choose(windows, lambda w: _bucket(F.col("v"), w.lo, w.hi, buckets).cast("bigint"))
    rows = (values.select(_window_id(windows).alias("w"), "v").where(F.col("w").isNotNull())
            .select("w", bucket.alias("b"), "v")
            .groupBy("w", "b").agg(F.count(F.lit(1)).alias("n"), F.min("v").alias("lo"),
                                   F.max("v").alias("hi"))
            .collect())  # at most a few thousand rows per window
    per_window: dict[int, list] = {}
    for row in rows:
        per_window.setdefault(row["w"], []).append(row)
    out = []
    for i, w in enumerate(windows):
        cum, pending = w.offset, list(w.ranks)
        for row in sorted(per_window.get(i, []), key=lambda r: r["b"]):
            inside = [r for r in pending if cum <= r < cum + row["n"]]
            if inside:
                out.append(_Window(w.g, row["lo"], row["hi"], cum, row["n"], inside))
                pending = [r for r in pending if r not in inside]
            cum += row["n"]
    return out


def _resolve_small(values: DataFrame, windows: list[_Window], result: dict) -> None:
    """Sort each bounded window inside one task and return only the wanted elements."""
    picked = _choose(windows, lambda w: F.array(
        *[F.element_at(F.col("s"), r - w.offset + 1) for r in w.ranks]))
    rows = (values.select(_window_id(windows).alias("w"), "v").where(F.col("w").isNotNull())
            .groupBy("w").agg(F.sort_array(F.collect_list("v")).alias("s"))
            .select("w", picked.alias("picked")).collect())
    for row in rows:
        w = windows[row["w"]]
        for r, val in zip(w.ranks, row["picked"]):
            result[(w.g, r)] = val


SKETCH_K = 4000       # about 60 KB a column
SKETCH_ERROR = 0.004  # of a rank; three times what 99 of 100 sketches of that size keep to


@dataclass
class _Bracket:
    """Values whose double lies in [lo, hi]; the cast keeps the order, so they are neighbours."""

    column: str
    lo: float
    hi: float
    ranks: list[int]

    def holds(self, v: Column) -> Column:
        return (v >= F.lit(self.lo)) & (v <= F.lit(self.hi))


def _as_double(df: DataFrame, c: str) -> Column:
    return F.when(present(df, c), F.col(_q(c)).cast("double"))


def _brackets(df: DataFrame, ranks: dict[str, tuple[int, list[int]]]) -> list[_Bracket]:
    """Ranges that should hold each column's ranks; overlapping ones of a column are one."""
    aggs = []
    for i, (c, (n, wanted)) in enumerate(ranks.items()):
        ends = sorted({min(1.0, max(0.0, r / n + e)) for r in wanted for e in (-SKETCH_ERROR, SKETCH_ERROR + 1 / n)})
        sketch = F.kll_sketch_agg_double(_as_double(df, c), F.lit(SKETCH_K))
        aggs.append(F.kll_sketch_get_quantile_double(sketch, F.array(*map(F.lit, ends))).alias(f"q{i}"))
        ranks[c] = (n, wanted, ends)
    row = df.agg(*aggs).first()
    out = []
    for i, (c, (n, wanted, ends)) in enumerate(ranks.items()):
        at = dict(zip(ends, row[f"q{i}"], strict=True))
        own: list[_Bracket] = []
        for r in wanted:
            lo, hi = (at[min(1.0, max(0.0, r / n + e))] for e in (-SKETCH_ERROR, SKETCH_ERROR + 1 / n))
            if own and lo <= own[-1].hi:
                own[-1] = _Bracket(c, own[-1].lo, max(hi, own[-1].hi), [*own[-1].ranks, r])
            else:
                own.append(_Bracket(c, lo, hi, [r]))
        out += own
    return out


def _from_brackets(df: DataFrame, brackets: list[_Bracket], counts: dict[str, int], limit: int) -> dict[tuple[str, int], object]:
    """{(column, rank): value} of the ranks that their bracket holds; one pass.

    What lies below and inside is counted as the rows pass by; of the values inside, distinct ones
    are counted, in text as their types differ, and come to the driver, ``limit`` at most.
    """
    seen, entries, metrics = Observation(), [], []
    for i, b in enumerate(brackets):
        v = _as_double(df, b.column)
        metrics += [F.count_if(v < b.lo).alias(f"below{i}"), F.count_if(b.holds(v)).alias(f"in{i}"), F.count_if(v > b.hi).alias(f"above{i}")]
        entries.append(F.when(b.holds(v), F.struct(F.lit(i).alias("w"), F.col(_q(b.column)).cast("string").alias("v"))))
    inside = F.explode(F.array_compact(F.array(*entries)))
    rows = (df.observe(seen, *metrics).select(inside.alias("p")).select("p.w", "p.v")
            .groupBy("w", "v").agg(F.count(F.lit(1)).alias("n")).limit(limit + 1).collect())
    found, result = seen.get, {}
    if len(rows) > limit:
        return {}
    for i, b in enumerate(brackets):
        below, own = found[f"below{i}"], found[f"in{i}"]
        if below + own + found[f"above{i}"] != counts[b.column]:
            continue  # a task ran twice: its counts are not those of the rows
        parse = _parser(df.schema[b.column].dataType)
        values = sorted((parse(r["v"]), r["n"]) for r in rows if r["w"] == i)
        if sum(n for _, n in values) != own:
            continue
        cum, pending = below, list(b.ranks)
        for value, n in values:
            result |= {(b.column, r): value for r in pending if cum <= r < cum + n}
            cum += n
    return result


def _windows(df: DataFrame, brackets: list[_Bracket]) -> dict[str, list[_Window]]:
    """Windows to narrow from: the counts of brackets that are too long for the driver."""
    aggs = []
    for i, b in enumerate(brackets):
        v, inside = _as_double(df, b.column), b.holds(_as_double(df, b.column))
        own = F.when(inside, F.col(_q(b.column)))
        aggs += [F.count_if(v < b.lo).alias(f"below{i}"), F.count(own).alias(f"in{i}"), F.min(own).alias(f"lo{i}"), F.max(own).alias(f"hi{i}")]
    row, out = df.agg(*aggs).first(), {}
    for i, b in enumerate(brackets):
        below, n = row[f"below{i}"], row[f"in{i}"]
        ranks = [r for r in b.ranks if below <= r < below + n]
        if ranks:
            out.setdefault(b.column, []).append(_Window(0, row[f"lo{i}"], row[f"hi{i}"], below, n, ranks))
    return out


def _parser(dtype: T.DataType):
    """From Spark's text of a value back to the value, in its exact type."""
    kind = exact_type(dtype)
    if isinstance(kind, T.LongType):
        return int
    return Decimal if isinstance(kind, T.DecimalType) else float


def _interpolate(n: int, probs, at) -> list[float | None]:
    if not n:
        return [None for _ in probs]
    out = []
    for p in probs:
        h = (n - 1) * float(p)
        a, b, d = at(int(math.floor(h))), at(int(math.ceil(h))), h - math.floor(h)
        if d == 0 or a == b:
            out.append(float(a))
        elif isinstance(a, float):
            out.append(a + d * (b - a))
        else:  # exact types: one rounding at the end
            out.append(float(Fraction(a) + Fraction(d) * (Fraction(b) - Fraction(a))))
    return out


def _ranks(n: int, probs) -> list[int]:
    hs = [(n - 1) * float(p) for p in probs]
    return sorted({int(math.floor(h)) for h in hs} | {int(math.ceil(h)) for h in hs})


def value_stats(df: DataFrame, columns: Sequence[str]) -> dict[str, tuple[int, object, object]]:
    """{column: (count, min, max)} of the non-missing values, in one aggregation."""
    aggs = []
    for i, c in enumerate(columns):
        v = F.when(present(df, c), F.col(_q(c)))
        aggs += [F.count(v).alias(f"n{i}"), F.min(v).alias(f"lo{i}"), F.max(v).alias(f"hi{i}")]
    row = df.agg(*aggs).first()
    return {c: (row[f"n{i}"], row[f"lo{i}"], row[f"hi{i}"]) for i, c in enumerate(columns)}


def exact_quantiles_multi(df: DataFrame, columns: Sequence[str], probs, *, buckets: int = 1024,
                          local_limit: int = 100_000,
                          stats: dict[str, tuple] | None = None) -> dict[str, list[float | None]]:
    """Exact quantiles of several columns, each compared in its own exact type; columns of one
    type share their passes. ``stats`` may give known (count, min, max) in the columns' types."""
    columns = list(columns)
    if not columns:
        return {}
    if stats is None:
        stats = value_stats(df, columns)
    wanted = {c: _ranks(stats[c][0], probs) for c in columns if stats[c][0]}
    long = {c: (stats[c][0], r) for c, r in wanted.items() if stats[c][0] > local_limit and stats[c][1] != stats[c][2]}
    at: dict[tuple[str, int], object] = {}
    # Float columns are compared as doubles and read back as such.
    known = df.select(*(F.col(_q(c)).cast(exact_type(df.schema[c].dataType)).alias(c) for c in columns))
    windows: dict[str, list[_Window]] = {}
    if long:
        counts, brackets = {c: n for c, (n, _) in long.items()}, _brackets(known, long)
        if sum(2 * SKETCH_ERROR * counts[b.column] for b in brackets) <= local_limit:
            at = _from_brackets(known, brackets, counts, local_limit)
        else:
            windows = _windows(known, brackets)
    groups: dict[str, list[str]] = {}
    for c in columns:
        if any((c, r) not in at for r in wanted.get(c, ())):
            groups.setdefault(known.schema[c].dataType.simpleString(), []).append(c)
    for names in groups.values():
        entries = [F.struct(F.lit(i).alias("g"), F.when(present(known, c), F.col(_q(c))).alias("v")) for i, c in enumerate(names)]
        pairs = entries[0] if len(entries) == 1 else F.explode(F.array(*entries))
        values = known.select(pairs.alias("p")).select("p.g", "p.v").where(F.col("v").isNotNull())
        starts = [replace(w, g=i) for i, c in enumerate(names) for w in windows.get(c, ())]
        started = {(w.g, r) for w in starts for r in w.ranks}
        requests = {i: (*stats[c], [r for r in wanted[c] if (c, r) not in at and (i, r) not in started]) for i, c in enumerate(names)}
        requests = {i: r for i, r in requests.items() if r[-1]}
        found = order_statistics(values, requests, buckets=buckets, local_limit=local_limit, windows=starts)
        at |= {(names[i], r): v for (i, r), v in found.items()}
    return {c: _interpolate(stats[c][0], probs, lambda r, c=c: at[(c, r)]) for c in columns}


def exact_quantiles(df: DataFrame, column: str, probs, *, buckets: int = 1024,
                    local_limit: int = 100_000, stats: tuple | None = None) -> list[float | None]:
    """Exact linear-interpolated quantiles of one column (missing values ignored). ``stats``
    may pass a known (count, min, max) to save a pass."""
    return exact_quantiles_multi(df, [column], probs, buckets=buckets, local_limit=local_limit,
                                 stats=None if stats is None else {column: stats})[column]


def exact_median(df: DataFrame, column: str, **kw) -> float | None:
    return exact_quantiles(df, column, [0.5], **kw)[0]


def approx_quantiles(df: DataFrame, columns: Sequence[str], probs, *,
                     accuracy: int = 10_000) -> dict[str, list[float | None]]:
    """Greenwald-Khanna estimates (``percentile_approx``) in one pass with bounded memory:
    the opt-in alternative when an exact answer is not needed. Not interpolated; the
    relative rank error is about 1 / ``accuracy``."""
    aggs = [F.percentile_approx(F.when(present(df, c), F.col(_q(c)).cast("double")),
                                [float(p) for p in probs], accuracy).alias(f"q{i}")
            for i, c in enumerate(columns)]
    row = df.agg(*aggs).first()
    return {c: (list(row[f"q{i}"]) if row[f"q{i}"] is not None else [None for _ in probs])
            for i, c in enumerate(columns)}
