"""Merkle manifest against a plain version that builds the trees and proofs in lists."""

import hashlib
import random
import zlib

import pytest
from pyspark.sql import functions as F

from cartwheel.llm import merkle_manifest
from cartwheel.llm.common import ascii_lower
from cartwheel.llm.merkle_manifest import COLUMNS, build, ranked, verify

from .conftest import ODD


def _sha(s):
    return hashlib.sha256(s.encode()).hexdigest()


def _leaf(doc):
    d = dict(zip(("doc_id", "text", "lang", "source", "n_chars"), doc, strict=False))
    return _sha("".join("-" if d[c] is None else f"{len(str(d[c]).encode())}:{d[c]}" for c in COLUMNS))


def _other(doc):
    if doc[0] is None or doc[1] is None or zlib.crc32(str(doc[0]).encode()) % 3:
        return _leaf(doc)
    lower = "".join(c.lower() if "A" <= c <= "Z" else c for c in doc[1])
    return _leaf((doc[0], lower, *doc[2:]))


def _climb(digests, proofs):
    """The root of a list of digests; proofs[i] gets the siblings above leaf i, as (before, after)."""
    at = [[i] for i in range(len(digests))]  # the leaves below each node
    while len(digests) > 1:
        up, below = [], []
        for k in range(0, len(digests), 8):
            run = digests[k:k + 8]
            for j in range(len(run)):
                for leaf in at[k + j]:
                    proofs[leaf].append(("".join(run[:j]), "".join(run[j + 1:])))
            up.append(_sha("".join(run)))
            below.append([leaf for x in at[k:k + 8] for leaf in x])
        digests, at = up, below
    return digests[0]


def brute(docs):
    langs = sorted({d[2] for d in docs}, key=lambda x: (x is not None, (x or "").encode()))
    groups, proofs, subroots = [], [], []
    for lang in langs:
        own = sorted((d for d in docs if d[2] == lang), key=lambda d: (d[0] is not None, d[0] or 0, _leaf(d)))
        found = [[] for _ in own]
        subroots.append(_climb([_leaf(d) for d in own], found))
        groups.append(own)
        proofs.append(found)
    over = [[] for _ in langs]
    root = _climb(list(subroots), over) if langs else None
    out = []
    for g, own in enumerate(groups):
        for d, found in zip(own, proofs[g], strict=True):
            path, folded = found + over[g], _other(d)
            for before, after in path:
                folded = _sha(before + folded + after)
            out.append((d[0], _leaf(d), subroots[g], root, _sha("".join(a + b for a, b in path)), folded, folded == root))
    return sorted(out, key=repr)


def _check(make, docs, schema=None):
    df = (make(docs, schema) if schema else make(docs)).repartition(5)
    third = F.coalesce(F.crc32(F.col("doc_id").cast("string").cast("binary")) % 3 == 0, F.lit(False))
    got = verify(build(df, tampered=(third, {"text": ascii_lower(df["text"])})))
    rows = sorted(map(tuple, got.collect()), key=repr)
    assert rows == brute([d[:5] for d in docs])
    return rows


def _docs(rnd, n, langs):
    return [(i, f"Text {rnd.randrange(9)} OF {i}", rnd.choice(langs), rnd.choice([None, "s", "é"]), i * 7) for i in range(n)]


@pytest.mark.parametrize("n, langs", [(1, ["en"]), (9, ["en"]), (700, ["en", "de", "fr", None]),
                                      (150, [f"l{i}" for i in range(30)]), (20, [None, "", "é", "z", "Z"])])
def test_against_brute_force(make, n, langs):
    rows = _check(make, _docs(random.Random(n), n, langs))
    assert n < 60 or {v for *_, v in rows} == {True, False}


def test_blocks_repeat_only_the_nodes_above_them(make, monkeypatch):
    levels = 1
    monkeypatch.setattr(merkle_manifest, "LOCAL_LEVELS", levels)
    monkeypatch.setattr(merkle_manifest, "BLOCK", 8 ** levels)
    monkeypatch.setattr(merkle_manifest, "CLIMB", merkle_manifest.CLIMB.replace("c.level < 4", f"c.level < {levels}"))
    docs = _docs(random.Random(5), 600, ["en", "en", "en", "de", None])
    _check(make, docs)
    nodes = build(make(docs)).nodes
    assert nodes.groupBy("grp", "level", "run", "block").count().where("count > 1").count() == 0
    assert nodes.where("level < 1 AND grp >= 0").where("block <> 0").count() == 0


def test_odd_rows(make):
    docs = [(i, t, "en", None, None) for i, t in enumerate(ODD)]
    docs += [(None, "No Id", "en", "s", 1), (None, "No Id", "en", "s", 1), (None, None, None, None, None), (3, "Again", "en", "s", 2),
             (3, "Again", "en", "s", 2), (3, "ANOTHER", "de", "s", 2), (-5, "NEGATIVE", "", "", 0)]
    _check(make, docs)


def test_empty_table(make):
    got = verify(build(make([])))
    assert got.count() == 0
    assert got.columns == ["doc_id", "leaf", "subroot", "root", "proof_sha256", "folded_root", "verified"]


def test_extra_columns_are_ignored(make):
    schema = "doc_id long, text string, lang string, source string, n_chars long, row int, idx int, grp string, `a.b` int, leaf string"
    _check(make, [(i, f"T{i}", "en", "s", i, 1, 2, "g", 3, "x") for i in range(20)], schema)


def test_ranked_numbers_a_group_that_many_tasks_share(make):
    docs = make(_docs(random.Random(6), 3000, ["en"]))
    out = ranked(docs, "lang", ["doc_id"], "spread")
    assert [tuple(r) for r in out.select("doc_id", "idx", "n").orderBy("doc_id").collect()] == [(i, i, 3000) for i in range(3000)]
    assert len({f.rsplit("/", 1)[-1] for f in out.inputFiles() if "spread" in f}) >= 8  # a file per task


def test_recursion_limit_is_put_back(make, spark):
    before = spark.conf.get("spark.sql.cteRecursionRowLimit")
    verify(build(make(_docs(random.Random(7), 20, ["en"])))).count()
    assert spark.conf.get("spark.sql.cteRecursionRowLimit") == before
