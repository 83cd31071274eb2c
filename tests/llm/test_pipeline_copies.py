"""Copies of multi-line documents go whole, through all the stages of run()."""

import hashlib
import random

import pytest

import corpus_pipeline

from . import test_decontaminate, test_jaccard_join
from .conftest import DOCS, prose
from .test_language_id import _text

COPIED = 40


@pytest.fixture(scope="module")
def sf_dir(spark, tmp_path_factory):
    """Documents of 2 to 9 lines, the first COPIED of them twice again; one benchmark item."""
    rnd, rows = random.Random(31), []
    for i in range(120):
        lang = rnd.choice(["en", "fr", "de"])
        rows.append((i, "\n".join(_text(rnd, lang, rnd.randint(4, 30)) for _ in range(rnd.randint(2, 9))), lang, "s", 0))
    rows += [(200 + 100 * k + i, *rows[i][1:]) for k in range(2) for i in range(COPIED)]
    path = str(tmp_path_factory.mktemp("copies"))
    spark.createDataFrame(rows, DOCS).write.parquet(f"{path}/documents.parquet")
    spark.createDataFrame([(1, prose(rnd, 14))], "item_id long, text string").write.parquet(f"{path}/benchmark.parquet")
    return path


def test_no_line_of_a_copy_is_left(spark, sf_dir):
    given = {r["doc_id"]: r["text"] for r in spark.read.parquet(f"{sf_dir}/documents.parquet").collect()}
    got = {r["doc_id"]: r["decoded_sha256"] for r in corpus_pipeline.run(spark, sf_dir).collect()}
    assert set(got) <= set(range(120)) and len(got) > 100
    assert all(sha == hashlib.sha256(given[i].encode()).hexdigest() for i, sha in got.items())


def test_stages_after_line_dedup(spark, sf_dir):
    docs = corpus_pipeline.line_dedup(spark, spark.read.parquet(f"{sf_dir}/documents.parquet"), sf_dir)
    given = [tuple(r) for r in docs.collect()]
    assert sorted(r[0] for r in given) == list(range(120))
    items = [tuple(r) for r in spark.read.parquet(f"{sf_dir}/benchmark.parquet").collect()]
    least = test_jaccard_join.brute(given)
    kept = sorted(r[0] for r in corpus_pipeline.jaccard_join(spark, docs, sf_dir).collect())
    assert kept == sorted(r[0] for r in given if least[r[0]][1] == r[0])
    hit = {r[0] for r in test_decontaminate.brute(given, items) if r[-1]}
    kept = sorted(r[0] for r in corpus_pipeline.decontaminate(spark, docs, sf_dir).collect())
    assert kept == sorted(r[0] for r in given if r[0] not in hit)
