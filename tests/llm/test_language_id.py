import random

import numpy as np
from pyspark.sql import functions as F

from cartwheel.llm import language_id
from cartwheel.llm.language_id import (Model, counts, fit_ftrl, fit_temperature, has_letter, held_out, identify,
                                       learnable, train)

from .conftest import ODD

SYLLABLES = {"en": "the and ing tion er on", "fr": "eau que les ment é è", "de": "sch ung der ein ü ß"}


def _text(rnd, lang, words):
    parts = SYLLABLES[lang].split()
    return " ".join("".join(rnd.choice(parts) for _ in range(rnd.randint(1, 3))) for _ in range(words))


def _docs(rnd, n, words=40):
    return [(i, _text(rnd, lang, rnd.randint(1, words)), lang, "s", 0)
            for i, lang in ((i, rnd.choice(list(SYLLABLES))) for i in range(n))]


def test_held_out_accuracy_and_calibration(make):
    rows = _docs(random.Random(1), 800)
    df = make(rows).repartition(4)
    out = identify(df, train(learnable(df), per_language=150)).withColumn("held", held_out(F.col("doc_id"))).collect()
    test = [r for r in out if r["held"]]
    assert 120 < len(test) < 280
    right = np.mean([r["lang"] == r["lang_pred"] for r in test])
    assert right >= 0.97 and abs(np.mean([r["score"] for r in test]) - right) < 0.1
    assert all(0 <= r["score"] <= 1 for r in out)


def test_only_text_is_looked_at_and_held_out_rows_teach_nothing(make, spark):
    rows = _docs(random.Random(2), 300)
    df = make(rows)
    wrong = make([(i, t, "xx" if (held := _held(spark, i)) else lang, None, None) for i, t, lang, *_ in rows])
    a, b = train(learnable(df)), train(learnable(wrong))
    assert a.languages == b.languages and (a.weights == b.weights).all() and a.temperature == b.temperature
    moved = make([(i + 10_000, t, None, "other", 5) for i, t, *_ in rows])
    seen = {r["text"]: (r["lang_pred"], r["score"]) for r in identify(df, a).collect()}
    assert {r["text"]: (r["lang_pred"], r["score"]) for r in identify(moved, a).collect()} == seen


def _held(spark, i):
    import zlib
    return zlib.crc32(str(i).encode()) % 4 == 2


def test_odd_rows(make):
    rows = _docs(random.Random(3), 60) + [(900 + i, t, "en" if i % 2 else None, None, None) for i, t in enumerate(ODD)]
    rows += [(None, "the and", "en", None, None), (1, "the", "en", None, None)]
    df = make(rows)
    out = identify(df, train(learnable(df))).collect()
    assert len(out) == len(rows)
    for r in out:
        assert (r["lang_pred"] == "und") == (not has_letter(r["text"])) and (r["score"] == 0) == (r["lang_pred"] == "und")
    assert identify(make([]), train(learnable(make([])))).count() == 0
    nothing = train(learnable(make([(1, "abc", None, None, None)])))
    assert [r["lang_pred"] for r in identify(df, nothing).select("lang_pred").distinct().collect()] == ["und"]
    one = make([(i, "the and ing", "en", None, None) for i in range(9)])
    assert identify(one, train(learnable(one))).first()["score"] == 1.0



def test_columns_of_the_same_name_are_replaced(make):
    df = make([(1, "a", "en", 7.0, "z")], "doc_id long, text string, lang string, score double, lang_pred string")
    out = identify(df, Model(["en"], np.ones(1 << 15), np.zeros((1, (1 << 15) + 1)), 1.0)).first()
    assert (out["lang_pred"], out["score"]) == ("en", 1.0)


def test_parts():
    assert counts("").sum() == 0 and counts("ab").sum() == 3 and counts("AB")[counts("ab") > 0].all()
    z = np.array([[4.0, 0.0], [4.0, 0.0], [4.0, 0.0], [0.0, 4.0]])
    assert fit_temperature(z, np.array([0, 0, 0, 1])) < 0.5 < 2 < fit_temperature(z, np.array([0, 1, 0, 1]))


def plain_ftrl(rows, n_languages, width):
    """FTRL-proximal with elastic net, one coefficient at a time."""
    alpha, beta, l1, l2 = language_id.ALPHA, language_id.BETA, language_id.L1, language_id.L2
    z = [[0.0] * width for _ in range(n_languages)]
    n = [[0.0] * width for _ in range(n_languages)]

    def weight(k, f):
        if abs(z[k][f]) <= l1:
            return 0.0
        sign = 1 if z[k][f] > 0 else -1
        return (sign * l1 - z[k][f]) / ((beta + n[k][f] ** 0.5) / alpha + l2)

    order = np.random.default_rng(0)
    for _ in range(language_id.EPOCHS):
        for i in order.permutation(len(rows)):
            idx, x, y = rows[i]
            w = {(k, f): weight(k, f) for k in range(n_languages) for f in idx}
            logits = [sum(w[k, f] * v for f, v in zip(idx, x, strict=True)) for k in range(n_languages)]
            total = sum(np.exp(v) for v in logits)
            for k in range(n_languages):
                for f, v in zip(idx, x, strict=True):
                    g = (np.exp(logits[k]) / total - (k == y)) * v
                    z[k][f] += g - ((n[k][f] + g * g) ** 0.5 - n[k][f] ** 0.5) / alpha * w[k, f]
                    n[k][f] += g * g
    return [[weight(k, f) for f in range(width)] for k in range(n_languages)]


def test_ftrl_equals_a_plain_version(monkeypatch):
    monkeypatch.setattr(language_id, "L1", 0.4)  # leaves some weights at zero
    rng = np.random.default_rng(4)
    rows = []
    for _ in range(60):
        idx = np.sort(rng.choice(40, rng.integers(1, 12), replace=False))
        rows.append((idx, rng.uniform(0.1, 1, len(idx)), int(rng.integers(0, 3))))
    got = fit_ftrl(rows, 3)
    want = np.array(plain_ftrl(rows, 3, 40))
    assert np.allclose(got[:, :40], want, rtol=1e-9, atol=1e-12) and not got[:, 40:].any()
    assert (want == 0).any() and (want != 0).any()


def test_temperature_is_inside_the_grid(make):
    model = train(learnable(make(_docs(random.Random(5), 800)).repartition(3)), per_language=150)
    assert np.exp(-4) * 1.1 < model.temperature < np.exp(2) * 0.9


def test_unlearned_languages_have_low_scores(make):
    rnd = random.Random(6)
    rows = _docs(rnd, 800)
    other = ["".join(rnd.choice("αβγδεζηθικλμνξοπρστυφχψω ") for _ in range(200)), "".join(chr(rnd.randrange(0x4E00, 0x9FA5)) for _ in range(100)),
             "все люди рождаются свободными и равными в своем достоинстве и правах",
             " ".join("".join(rnd.choice("bcdfjkpqvwxz") for _ in range(6)) for _ in range(30))]
    model = train(learnable(make(rows).repartition(3)))
    assert max(model.predict(other)[1]) < 0.3
    scores = model.predict([t for _, t, *_ in rows if has_letter(t)])[1]
    assert min(scores) > 0.3 and np.mean(scores) > 0.95
