"""Line dedup against a brute force that looks for passages of any length, not for pairs."""

import random

from cartwheel.llm.line_dedup import dedup_lines

from .conftest import prose
from .plain_passages import brute


def _dedup(make, rows):
    df = make([(d, t, None, None, None) for d, t in rows]).repartition(4)
    return {r["doc_id"]: (r["text"], r["n_removed"]) for r in dedup_lines(df).collect()}


def test_passages_of_shorter_lines_go_whole(make):
    """Of more than 50 words in shorter lines, in fresh surroundings: no line is left."""
    rnd, rows, planted = random.Random(21), [], {}
    for k in range(20):
        for n, words in ((3, 20), (4, 15), (5, 12), (20, 10)):
            lines = [prose(rnd, words) for _ in range(n)]
            for _ in range(2):
                fresh = [prose(rnd, rnd.randint(3, 30)) for _ in range(4)]
                planted[len(rows)] = (lines, fresh)
                rows.append((len(rows), "\n".join([*fresh[:2], *lines, *fresh[2:]])))
    got = _dedup(make, rows)
    for i, (lines, fresh) in planted.items():
        assert got[i] == (("\n".join(fresh), len(lines)) if i % 2 else (rows[i][1], 0))


def test_against_every_passage(make):
    rnd = random.Random(22)
    pool = ["", " ", "a", "b c", "d", "e f g", prose(rnd, 60)]
    rows = [(i, "\n".join(rnd.choice(pool) if rnd.random() < 0.5 else prose(rnd, 4)
                          for _ in range(rnd.randint(0, 14)))) for i in range(120)]
    assert _dedup(make, rows) == {d: (t, n) for d, t, n in brute(rows, lambda r: r[0])}


def test_one_short_line_stays(make):
    rows = [(i, f"own {i}\na line of few words\nother {i}") for i in range(5)]
    assert _dedup(make, rows) == {i: (t, 0) for i, t in rows}
