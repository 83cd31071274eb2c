import math
from decimal import Decimal
import random

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from cartwheel.operators.quantiles import exact_quantiles, exact_quantiles_multi

PROBS = [0.0, 0.25, 0.5, 0.75, 1.0, 0.1, 0.9]


def _check(got, values):
    want = np.percentile(np.array(values, dtype=float), [p * 100 for p in PROBS])
    for g, w in zip(got, want):
        assert math.isclose(g, w, rel_tol=1e-12, abs_tol=1e-12), (g, w)


def test_trap_values(spark):
    df = spark.createDataFrame([(1.0,), (2.0,), (3.0,), (None,), (10.0,)], "x double")
    assert exact_quantiles(df, "x", [0.25, 0.5, 0.75]) == [1.75, 2.5, 4.75]


def test_nan_is_missing(spark):
    df = spark.createDataFrame([(1.0,), (float("nan"),), (3.0,)], "x double")
    assert exact_quantiles(df, "x", [0.5]) == [2.0]


def test_empty_and_constant(spark):
    empty = spark.createDataFrame([(None,)], "x double")
    assert exact_quantiles(empty, "x", [0.5]) == [None]
    const = spark.createDataFrame([(4.0,)] * 7, "x double")
    assert exact_quantiles(const, "x", [0.1, 0.9], local_limit=2) == [4.0, 4.0]


@pytest.mark.parametrize("seed", [1, 2, 3])
def test_narrowing_path_matches_numpy(spark, seed):
    rnd = random.Random(seed)
    # long tail, repeated values and one hot value holding a third of the rows
    values = [rnd.lognormvariate(3, 2) for _ in range(3000)] + [42.0] * 1500
    values += [float(rnd.randint(0, 20)) for _ in range(500)]
    df = spark.createDataFrame([(v,) for v in values], "x double").repartition(4)
    got = exact_quantiles(df, "x", PROBS, buckets=8, local_limit=50)
    _check(got, values)


def test_integer_and_decimal_columns(spark):
    from decimal import Decimal
    df = spark.createDataFrame([(i, Decimal(i)) for i in range(1, 1001)], "a long, b decimal(18,2)")
    assert exact_quantiles(df, "a", [0.5], buckets=4, local_limit=10) == [500.5]
    assert exact_quantiles(df, "b", [0.25], buckets=4, local_limit=10) == [250.75]


@settings(max_examples=15, deadline=None)
@given(st.lists(st.floats(min_value=-1e6, max_value=1e6, allow_nan=False), min_size=1, max_size=60))
def test_property_matches_numpy(spark, values):
    df = spark.createDataFrame([(v,) for v in values], "x double")
    _check(exact_quantiles(df, "x", PROBS, buckets=4, local_limit=5), values)


def _same_at_every_size(spark, column, kind, values, want=None):
    """One answer whether a window is sorted or narrowed, alone or beside another column."""
    df = spark.createDataFrame([(v, 1.5) for v in values], f"x {kind}, other double").selectExpr(column, "other")
    sorted_ = exact_quantiles(df, "x", PROBS)
    assert exact_quantiles(df, "x", PROBS, buckets=8, local_limit=0) == sorted_
    both = exact_quantiles_multi(df, ["x", "other"], PROBS, buckets=8, local_limit=0)
    assert both == {"x": sorted_, "other": [1.5] * len(PROBS)}
    return sorted_


def test_values_that_doubles_cannot_tell_apart(spark):
    got = _same_at_every_size(spark, "x", "bigint", [2**60 + i for i in range(101)])
    assert got[2] == float(2**60 + 50)
    _same_at_every_size(spark, "x", "bigint", [-2**63, -1, 0, 1, 2**63 - 1, 5, 5])
    _same_at_every_size(spark, "x", "decimal(38,0)", [Decimal(10**37 + i) for i in range(60)] + [Decimal(-10**37)])
    _same_at_every_size(spark, "x", "decimal(20,4)", [Decimal(i) / 8 for i in range(-40, 60)])


def test_infinities_and_wide_ranges(spark):
    inf = float("inf")
    assert _same_at_every_size(spark, "x", "double", [1.0, 2.0, 3.0, inf])[1] == 1.75
    _same_at_every_size(spark, "x", "double", [-inf, -inf, -3e300, -1e-300, -0.0, 0.0, 5e-324, 1.0, 1.0000000000000002, 1e308])
    _same_at_every_size(spark, "x", "double", [math.ldexp(1.0, e) for e in range(-1070, 1020, 37)])


def _long_columns(spark, seed, n=6000):
    """Columns of every exact type, with a value that holds a third of the rows."""
    rnd = random.Random(seed)
    rows = [(rnd.lognormvariate(3, 2), rnd.choice([7, rnd.randint(-10**12, 10**12)]), Decimal(rnd.randint(0, 10**6)) / 100,
             42.0 if i % 3 == 0 else rnd.gauss(0, 1), None if i % 5 else float(i)) for i in range(n)]
    return spark.createDataFrame(rows, "a double, b long, c decimal(18,2), d float, e double").repartition(5), rows


def _columns(rows):
    return {c: [r[i] for r in rows if r[i] is not None] for i, c in enumerate("abcde")}


def test_brackets_need_two_passes(spark, monkeypatch):
    """The sketch and the count of what is in its brackets; nothing is narrowed or sorted after."""
    from cartwheel.operators import quantiles
    df, rows = _long_columns(spark, 1)
    stats = quantiles.value_stats(df, list("abcd"))
    monkeypatch.setattr(quantiles, "order_statistics", lambda *a, **k: pytest.fail("a third pass"))
    got = exact_quantiles_multi(df, list("abcd"), [0.25, 0.5, 0.75], local_limit=1200, stats=stats)
    for c, values in list(_columns(rows).items())[:4]:
        want = np.percentile(np.array(values, dtype=np.float32 if c == "d" else float).astype(float), [25, 50, 75])
        assert got[c] == pytest.approx(want.tolist(), rel=1e-12)


@pytest.mark.parametrize("limit", [5000, 1200, 300, 0])
def test_one_answer_by_brackets_windows_and_sorting(spark, limit):
    df, rows = _long_columns(spark, 2)
    got = exact_quantiles_multi(df, list("abcde"), PROBS, local_limit=limit, buckets=64)
    assert got == exact_quantiles_multi(df, list("abcde"), PROBS)
    for c in "abce":
        _check(got[c], _columns(rows)[c])


@pytest.mark.parametrize("limit", [1200, 300])
def test_a_wrong_sketch_costs_a_pass_and_no_value(spark, monkeypatch, limit):
    from cartwheel.operators import quantiles
    df, _ = _long_columns(spark, 3)
    want = exact_quantiles_multi(df, list("abc"), PROBS)
    brackets = quantiles._brackets

    def moved(df, ranks):
        return [quantiles._Bracket(b.column, b.hi, b.hi + 1, b.ranks) for b in brackets(df, ranks)]

    monkeypatch.setattr(quantiles, "_brackets", moved)
    assert exact_quantiles_multi(df, list("abc"), PROBS, local_limit=limit) == want


def test_counts_of_a_task_that_ran_twice_are_not_used(spark, monkeypatch):
    from cartwheel.operators import quantiles
    df, _ = _long_columns(spark, 4)
    want = exact_quantiles_multi(df, ["a"], PROBS)

    class Twice(quantiles.Observation):
        @property
        def get(self):
            return {k: 2 * v for k, v in super().get.items()}

    monkeypatch.setattr(quantiles, "Observation", Twice)
    assert exact_quantiles_multi(df, ["a"], PROBS, local_limit=1200) == want
