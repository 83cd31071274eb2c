"""Trap rows for the profile and cleaning operators (FIXTURES.md §3)."""

from datetime import datetime

import pytest

from cartwheel.operators import impute, outliers, profile
from cartwheel.operators.clean import CleanRules, clean_table


def test_modes_tie(spark):
    df = spark.createDataFrame([(3,), (3,), (1,), (1,), (2,), (None,)], "x int")
    assert [r[0] for r in profile.modes(df, "x").collect()] == [1, 3]
    assert impute.smallest_modes(df.selectExpr("cast(x as string) x"), ["x"]) == {"x": "1"}


def test_duplicates_with_null(spark):
    df = spark.createDataFrame([(1, 1, None), (2, 1, None), (3, 2, "a"), (4, 2, "b")], "k int, a int, b string")
    dup = profile.duplicate_rows(df, "k")
    assert [r["k"] for r in dup.collect()] == [2]
    kept = profile.drop_duplicates(df, order_key="k")
    assert sorted(r["k"] for r in kept.collect()) == [1, 3, 4]
    assert dup.count() + kept.count() == df.count()


def test_hot_duplicate_group(spark):
    rows = [(i, "same") for i in range(3000)] + [(3000 + i, f"v{i}") for i in range(6000)]
    df = spark.createDataFrame(rows, "k long, t string").repartition(8)
    assert profile.duplicate_rows(df, "k").count() == 2999
    assert [r["k"] for r in profile.drop_duplicates(df, order_key="k").where("t = 'same'").collect()] == [0]


def test_null_pct_rounding_and_selection(spark):
    # 3 of 10 missing -> exactly 30.0: neither dropped nor imputed; 4 of 10000 -> 0.0
    rows = [(i, None if i < 3 else 1.0, None if i < 4 else "x") for i in range(10)]
    df = spark.createDataFrame(rows, "k int, a double, b string")
    pct = impute.missing_pct_map(df)
    assert pct == {"k": 0.0, "a": 30.0, "b": 40.0}
    assert impute.sparse_columns(pct) == ["b"]
    assert impute.imputable_columns(pct) == []
    big = spark.range(10000).selectExpr("id", "CASE WHEN id < 4 THEN NULL ELSE id END AS v")
    assert impute.missing_pct_map(big)["v"] == 0.0


def test_nan_counts_as_missing(spark):
    df = spark.createDataFrame([(1.0,), (float("nan"),), (None,)], "x double")
    assert profile.null_counts(df).first()["n_missing"] == 2


def test_group_mean_datetime(spark):
    rows = [("x", datetime(2020, 1, 1)), ("x", None), (None, None), ("y", None),
            ("z", datetime(1857, 1, 1)), ("z", datetime(1859, 1, 1)), ("z", None)]
    df = spark.createDataFrame(rows, "key string, d timestamp_ntz")
    out = impute.impute_group_mean_datetime(df, "d", "key").collect()
    got = sorted((r["key"] or "", r["d"]) for r in out)
    assert got.count(("x", datetime(2020, 1, 1))) == 2
    assert ("", None) in got and ("y", None) in got
    assert got.count(("z", datetime(1858, 1, 1))) == 1


def test_parse_bad_date(spark):
    df = spark.createDataFrame([("2020-01-02",), ("nodata",), (None,)], "d string")
    out = [r[0] for r in impute.parse_datetime(df, "d", "yyyy-MM-dd").collect()]
    assert out == [datetime(2020, 1, 2), None, None]


def test_describe_matches_numpy(spark):
    import numpy as np
    vals = [1.0, 2.0, 3.0, 10.0]
    df = spark.createDataFrame([(v,) for v in vals] + [(None,)], "x double")
    r = profile.describe(df).first()
    assert r["count"] == 4 and r["min"] == 1.0 and r["max"] == 10.0
    assert abs(r["std"] - np.std(vals, ddof=1)) < 1e-12
    assert (r["p25"], r["p50"], r["p75"]) == (1.75, 2.5, 4.75)


def test_iqr_filter_and_boxplot(spark):
    vals = [1.0, 2.0, 3.0, 4.0, 100.0, None]
    df = spark.createDataFrame([(v,) for v in vals], "x double")
    kept = sorted(r[0] for r in outliers.remove_outliers_iqr(df, "x").collect())
    assert kept == [1.0, 2.0, 3.0, 4.0]
    b = outliers.boxplot_stats(df, "x").first()
    assert (b["q1"], b["median"], b["q3"], b["n_outliers"]) == (2.0, 3.0, 4.0, 1)
    assert (b["lower_whisker"], b["upper_whisker"]) == (1.0, 4.0)


def test_clean_table_fills_imputed_columns(spark):
    rows = []
    for i in range(40):
        rows.append((i, "A" if i % 2 else "B",
                     None if i % 10 == 0 else float(i),
                     None if i % 8 == 0 else "t",
                     "bad" if i % 9 == 0 else f"2020-01-{(i % 28) + 1:02d}",
                     None if i % 3 else 1.0))
    df = spark.createDataFrame(rows, "k int, cat string, num double, txt string, d string, sparse double")
    rules = CleanRules(median_columns=("num",), date_formats={"d": "yyyy-MM-dd"},
                       group_mean_keys={"d": "cat"})
    out = clean_table(df, rules)
    assert "sparse" not in out.columns
    counts = {r["column"]: r["n_missing"] for r in profile.null_counts(out).collect()}
    assert counts == {"k": 0, "cat": 0, "num": 0, "txt": 0, "d": 0}
    assert out.where("txt = 'nodata'").count() == 5


def test_clean_csv_end_to_end(spark, tmp_path):
    from cartwheel.operators.clean import clean_csv
    from cartwheel.sources.csv import load_csv_inferred
    lines = ["ID,CATEGORY,CAP,EMAIL,REG_DATE,SPARSE"]
    for i in range(30):
        lines.append(",".join([
            str(i), "shares" if i % 3 else "guarantee",
            "" if i % 6 == 0 else str(1000 * i),
            "NA" if i % 5 == 0 else f"a{i}@x.in",
            "nodata" if i % 7 == 0 else f"2001-02-{(i % 27) + 1:02d}",
            "" if i % 2 else "1.5"]))
    src = tmp_path / "in.csv"
    src.write_text("\n".join(lines) + "\n")
    rules = CleanRules(median_columns=("CAP",), date_formats={"REG_DATE": "yyyy-MM-dd"},
                       group_mean_keys={"REG_DATE": "CATEGORY"})
    clean_csv(spark, str(src), str(tmp_path / "out"), rules)
    back = load_csv_inferred(spark, str(tmp_path / "out"))
    assert back.count() == 30 and "SPARSE" not in back.columns
    counts = {r["column"]: r["n_missing"] for r in profile.null_counts(back).collect()}
    assert all(v == 0 for v in counts.values()), counts
    assert back.where("EMAIL = 'nodata'").count() == 6


def test_empty_inputs(spark):
    empty = spark.createDataFrame([], "k int, x double, s string")
    assert [tuple(r) for r in profile.null_pct(empty).collect()] == [("k", None), ("x", None), ("s", None)]
    d = profile.describe(empty).collect()
    assert [(r["column"], r["count"], r["p50"]) for r in d] == [("k", 0, None), ("x", 0, None)]
    assert profile.modes(empty, "s").count() == 0
    assert profile.duplicate_rows(empty, "k").count() == 0
    assert outliers.iqr_bounds(empty, "x").first()["q1"] is None
    assert outliers.remove_outliers_iqr(empty, "x").count() == 0


def test_describe_approx_close(spark):
    df = spark.range(10001).selectExpr("CAST(id AS DOUBLE) AS x")
    r = profile.describe(df, approx_accuracy=100_000).first()
    assert abs(r["p50"] - 5000) <= 1 and r["count"] == 10001


def test_integer_column_takes_fractional_fill(spark):
    df = spark.createDataFrame([(1,), (2,), (None,)], "x long")
    out = impute.impute_median(df, "x")
    assert out.schema["x"].dataType.simpleString() == "double"
    assert sorted(r[0] for r in out.collect()) == [1.0, 1.5, 2.0]
    same = impute.impute_median(spark.createDataFrame([(1,), (3,), (None,)], "x long"), "x")
    assert same.schema["x"].dataType.simpleString() == "bigint"


def test_duplicates_exact_under_hash_collisions(spark, monkeypatch):
    from pyspark.sql import functions as F
    rows = [(1, "a", None), (2, "a", None), (3, "b", "x"), (4, "b", "y"), (5, "a", None), (6, "c", "x")]
    df = spark.createDataFrame(rows, "k int, t string, u string")
    want_dup = sorted(r["k"] for r in profile.duplicate_rows(df, "k").collect())
    want_keep = sorted(r["k"] for r in profile.drop_duplicates(df, order_key="k").collect())
    monkeypatch.setattr(profile, "_row_hashes",
                        lambda subset: [F.lit(0).cast("bigint").alias("_h1"), F.lit(0).alias("_h2")])
    assert sorted(r["k"] for r in profile.duplicate_rows(df, "k").collect()) == want_dup == [2, 5]
    assert sorted(r["k"] for r in profile.drop_duplicates(df, order_key="k").collect()) == want_keep == [1, 3, 4, 6]


def test_columns_filled_with_any_text(spark):
    """A share that rounds to 0.0 is not imputed of itself, but goes with the first text column."""
    from cartwheel.operators.clean import CleanRules, clean_table
    rows = [(i, None if i % 4 == 0 else "c", None if i == 7 else "mail", None if i < 2 else f"2020-01-{i % 28 + 1:02d}", "k")
            for i in range(4000)]
    df = spark.createDataFrame(rows, "i int, city string, mail string, day string, grp string")
    rules = CleanRules(date_formats={"day": "yyyy-MM-dd"}, group_mean_keys={"day": "grp"})
    nulls = lambda out, c: out.where(out[c].isNull()).count()
    plain = clean_table(df, rules)
    assert (nulls(plain, "city"), nulls(plain, "mail"), nulls(plain, "day")) == (0, 1, 2)
    full = clean_table(df, CleanRules(date_formats=rules.date_formats, group_mean_keys=rules.group_mean_keys,
                                      with_text=("mail", "day", "absent")))
    assert (nulls(full, "city"), nulls(full, "mail"), nulls(full, "day")) == (0, 0, 0)
    none = clean_table(df.drop("city"), CleanRules(with_text=("mail",)))
    assert nulls(none, "mail") == 1


def test_nunique_of_every_type(spark):
    from datetime import date, datetime
    from decimal import Decimal
    rows = [(i % 7, float(i % 5) * (-1 if i % 2 else 1), f"text {i % 11} " + "long " * (i % 3), Decimal(i % 4) / 3, i % 2 == 0,
             date(2024, 1, 1 + i % 9), datetime(2024, 1, 1, i % 24), bytes([i % 6]), [i % 3], {"k": i % 4}, Decimal(10) ** 30 + i % 8)
            for i in range(300)]
    schema = ("i int, d double, t string, m decimal(18,6), b boolean, y date, ts timestamp_ntz, x binary, l array<int>, "
              "k map<string,int>, w decimal(38,0)")
    from cartwheel.operators.profile import nunique
    got = {r["column"]: r["nunique"] for r in nunique(spark.createDataFrame(rows, schema).repartition(4)).collect()}
    want = {n: len({repr(r[j]) if n in ("l", "k") else r[j] for r in rows}) for j, n in enumerate(
        ("i", "d", "t", "m", "b", "y", "ts", "x", "l", "k", "w"))}
    assert got == want  # 0.0 and -0.0 are one value in Python too


def test_nunique_shuffles_no_text(spark):
    from cartwheel.operators.profile import nunique
    df = spark.createDataFrame([("a" * 1000, 1)] * 50, "t string, i int")
    plan = nunique(df)._jdf.queryExecution().executedPlan().toString()
    exchanged = [line for line in plan.splitlines() if "HashAggregate(keys=[i" in line]
    assert exchanged and all("t#" not in line.split("keys=")[1].split("]")[0] for line in exchanged)


def test_nunique_under_forced_collisions(spark, monkeypatch):
    """A first number that tells nothing apart leaves the count to the second."""
    from pyspark.sql import functions as F

    from cartwheel.operators import profile
    real = profile._fingerprint
    monkeypatch.setattr(profile, "_fingerprint", lambda df, c: [F.lit(0).cast("bigint").alias("a"), real(df, c)[1]])
    df = spark.createDataFrame([(f"text {i % 13}",) for i in range(100)], "t string")
    assert profile.nunique(df).first()["nunique"] == 13


def test_null_map_of_any_key(spark):
    """Ranges of about equally many rows, equal keys together, against Python's sort."""
    import random

    from cartwheel.operators.outliers import null_map
    rnd = random.Random(3)
    for kind, keys in (("string", [rnd.choice(["a", "é", "Z", "zz"]) + str(rnd.randint(0, 40)) for _ in range(400)] + ["hot"] * 200),
                       ("double", [rnd.gauss(0, 1) for _ in range(300)]), ("decimal(9,3)", None), ("string", [None] * 5)):
        if keys is None:
            from decimal import Decimal
            keys = [Decimal(rnd.randint(0, 10**6)) / 1000 for _ in range(300)]
        rows = [(k, i if i % 3 else None) for i, k in enumerate([*keys, None])]
        got = {r["bucket"]: (r["n_rows"], r["v"]) for r in null_map(spark.createDataFrame(rows, f"k {kind}, v int").repartition(4), "k", 7).collect()}
        known = sorted((k for k, _ in rows if k is not None), key=lambda k: k.encode() if isinstance(k, str) else k)
        below = {}
        for n, k in enumerate(known):
            below.setdefault(k, n)
        want = {}
        for k, v in rows:
            want.setdefault(None if k is None else below[k] * 7 // len(known), []).append(v is None)
        if not known:
            assert got == {}
        else:
            assert got == {b: (len(v), pytest.approx(sum(v) / len(v))) for b, v in want.items()}


def test_patterns_are_found_in_the_texts(spark):
    from datetime import datetime

    from cartwheel.operators.impute import found_pattern, parse_datetime

    def texts(*values):
        return spark.createDataFrame([(v,) for v in values], "t string")

    assert found_pattern(texts("03-04-2020", "25-12-2020", None, "n/a"), "t") == "dd-MM-yyyy"
    assert found_pattern(texts("03/04/2020", "12/25/2020"), "t") == "MM/dd/yyyy"
    assert found_pattern(texts("2020-03-04 10:11:12"), "t") == "yyyy-MM-dd HH:mm:ss"
    assert found_pattern(texts("04-04-2020", "05-05-2020"), "t") == "dd-MM-yyyy"  # both readings agree
    assert found_pattern(texts(None), "t") == "yyyy-MM-dd"
    with pytest.raises(ValueError, match="dd-MM-yyyy and MM-dd-yyyy"):
        found_pattern(texts("03-04-2020", "05-05-2020"), "t")
    with pytest.raises(ValueError, match="no text is a date"):
        found_pattern(texts("soon", "later"), "t")
    got = parse_datetime(texts("03-Apr-2020", "x"), "t").collect()
    assert [r["t"] for r in got] == [datetime(2020, 4, 3), None]
