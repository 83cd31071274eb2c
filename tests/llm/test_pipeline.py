import hashlib
import random

import pytest

import corpus_pipeline
from cartwheel.llm.language_id import has_letter

from . import plain_passages, test_decontaminate, test_jaccard_join
from .conftest import DOCS, ODD, prose
from .test_language_id import _text

ITEMS = "item_id long, text string"
#: In languages of which nothing is learned (their label is wrong, as labels are).
FOREIGN = ["όλοι οι άνθρωποι γεννιούνται ελεύθεροι και ίσοι στην αξιοπρέπεια", "人人生而自由在尊严和权利上一律平等他们赋有理性和良心",
           "все люди рождаются свободными и равными в своем достоинстве"]
EXTRA = DOCS + ", score double, stay string, rest int, row int"


@pytest.fixture(scope="module")
def sf_dir(spark, tmp_path_factory):
    """A folder with documents and benchmark as Parquet."""
    rnd, rows = random.Random(11), []
    items = [(i, " ".join(f"q{i}x{j}" for j in range(14))) for i in range(5)]
    passage = "\n".join(prose(rnd, 9) for _ in range(12))
    for i in range(200):
        lang = rnd.choice(["en", "fr", "de"])
        text = "\n".join(_text(rnd, lang, rnd.randint(20, 40)) for _ in range(3))
        if i % 10 == 0:
            text += "\n" + passage
        if i % 17 == 0:
            text += "\n" + items[i % 5][1]
        rows.append((i, text, lang, "s", len(text)))
    rows += [(500 + i, rows[i][1], rows[i][2], "s", 0) for i in range(5)]                 # copies
    rows += [(600 + i, rows[i][1] + " tail", rows[i][2], "s", 0) for i in range(5, 10)]   # near copies
    rows += [(700 + i, t, None, None, None) for i, t in enumerate(ODD)]
    rows += [(800 + i, t, "en", "s", 0) for i, t in enumerate(FOREIGN)]
    rows += [(None, _text(rnd, "en", 12), None, None, None), (3, rows[3][1], "en", "s", 1)]
    path = str(tmp_path_factory.mktemp("sf"))
    spark.createDataFrame(rows, DOCS).write.parquet(f"{path}/documents.parquet")
    spark.createDataFrame(items, ITEMS).write.parquet(f"{path}/benchmark.parquet")
    return path


def _tuples(df):
    return sorted(map(tuple, df.collect()), key=repr)


def test_each_stage_on_its_input(spark, sf_dir):
    """What each stage keeps, against a plain version over what it was given."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    items = [tuple(r) for r in spark.read.parquet(f"{sf_dir}/benchmark.parquet").collect()]
    assert [name for name, _ in corpus_pipeline.STAGES] == ["language_id", "line_dedup", "jaccard_join", "decontaminate", "byte_bpe"]
    given = _tuples(docs)
    for name, stage in corpus_pipeline.STAGES:
        out = corpus_pipeline.materialize(stage(spark, docs, sf_dir), "stage")
        kept = _tuples(out)
        if name != "byte_bpe":
            assert out.columns == docs.columns
        if name == "language_id":  # no clean document goes
            clean = [r for r in given if has_letter(r[1]) and r[1] not in (*FOREIGN, *ODD)]
            assert [r for r in kept if r[1] not in ODD] == clean  # odd ones with letters may be in no learned language
            assert all(has_letter(r[1]) for r in kept)
        elif name == "line_dedup":
            texts = plain_passages.expected(docs, [(r[0], r[1]) for r in given])
            words = [(d, t) for d, t, gone in texts if not gone or t.split()]
            assert sorted(((r[0], r[1]) for r in kept), key=repr) == sorted(words, key=repr) and len(words) < len(given)
            assert all(r[4] == len(r[1]) for r in kept if r[1] is not None)
        elif name == "jaccard_join":
            least = test_jaccard_join.brute(given)
            assert kept == [r for r in given if r[0] is None or least[r[0]][1] == r[0]]
        elif name == "decontaminate":
            hit = {r[0] for r in test_decontaminate.brute(given, items) if r[-1]}
            assert hit and kept == [r for r in given if r[0] not in hit]
        else:
            assert sorted((r["doc_id"] or -1, r["decoded_sha256"]) for r in out.collect()) == sorted(
                (r[0] or -1, hashlib.sha256((r[1] or "").encode()).hexdigest()) for r in given)
        docs, given = out, kept


def test_run_gives_the_stages_in_turn(spark, sf_dir):
    rows = corpus_pipeline.run(spark, sf_dir).collect()
    assert 0 < len(rows) < 225 and set(rows[0].asDict()) == {"doc_id", "n_tokens", "ids_sha256", "decoded_sha256"}


def test_empty_table_and_clashing_columns(spark, sf_dir, make):
    row = (1, "the and the", "en", "s", 11, 0.5, "x", 7, 8)
    for name, stage in corpus_pipeline.STAGES[:-1]:
        assert stage(spark, make([]), sf_dir).count() == 0
        df = make([row], EXTRA)
        out = stage(spark, df, sf_dir)
        assert out.columns == df.columns and tuple(out.first()) == row
    assert corpus_pipeline.byte_bpe(spark, make([]), sf_dir).count() == 0
