import random

from cartwheel.llm import line_dedup
from cartwheel.llm.line_dedup import DIVISOR, LONG_WORDS, cut, dedup_lines, passages

from .conftest import ODD, prose
from .plain_passages import expected


def _check(make, rows):
    df = make([(d, t, None, None, None) for d, t in rows]).repartition(5)
    got = sorted(((r["doc_id"], r["text"], r["n_removed"]) for r in dedup_lines(df).collect()), key=repr)
    assert got == expected(df, rows)
    return got


def test_shared_passages_go_once(make):
    rnd = random.Random(3)
    shared = ["\n".join(prose(rnd, rnd.randint(6, 14)) for _ in range(rnd.randint(2, 12))) for _ in range(6)]
    long_line = prose(rnd, LONG_WORDS + 20)
    rows = []
    for i in range(60):
        parts = [prose(rnd, rnd.randint(3, 30)) for _ in range(rnd.randint(1, 6))]
        parts.insert(rnd.randint(0, len(parts)), rnd.choice([*shared, long_line, prose(rnd, 9)]))
        rows.append((i, "\n".join(parts)))
    rows += [(100, rows[5][1]), (101, rows[5][1])]
    got = {d: (t, n) for d, t, n in _check(make, rows)}
    assert sum(long_line in t for t, _ in got.values()) == 1
    assert all(sum(p in t for t, _ in got.values()) == 1 for p in shared) and got[101] == got[100]


def test_boundaries_resist_shifts():
    """Lines put in before and inside a text change the chunks there and no others; cutting every
    so many lines would change all that follow, and every line on its own is no chunk."""
    rnd = random.Random(6)
    body = [prose(rnd, 8) for _ in range(300)]
    chunks = lambda lines: {tuple(lines[a:b]) for a, b in cut(lines)}
    moved = [prose(rnd, 5), *body[:150], prose(rnd, 7), *body[150:]]
    assert len(chunks(body) & chunks(moved)) >= len(chunks(body)) - 6
    fixed = lambda lines: {tuple(lines[i:i + DIVISOR]) for i in range(0, len(lines), DIVISOR)}
    assert len(fixed(body) & fixed(moved)) < 5
    assert [x for a, b in cut(body) for x in body[a:b]] == body
    assert 300 / DIVISOR * 0.6 < len(cut(body)) < 300 / DIVISOR * 1.6 and max(b - a for a, b in cut(body)) > DIVISOR


def test_chunks_hold_most_pairs():
    rnd = random.Random(7)
    lines = [prose(rnd, 5) if i % 7 else "" for i in range(400)]
    found = passages(lines)
    chunks = [p for p in found if p[2] == -1]
    pairs = [p for p in found if p[2] != -1]
    assert found[:len(chunks)] == chunks
    for a, b, within in pairs:
        holds = [k for k, (c, d, _) in enumerate(chunks) if c <= a and b <= d]
        assert holds == ([] if within is None else [within])
    assert sum(w is not None for *_, w in pairs) > len(pairs) / 2


def test_pairs_in_repeated_chunks_are_not_counted_again(make):
    rnd = random.Random(8)
    text = "\n".join(prose(rnd, 6) for _ in range(60))
    rows = make([(i, text, None, None, None) for i in range(6)]).selectExpr("doc_id", "doc_id AS k1", "doc_id AS k2", "text")
    found = line_dedup.repeated_passages(rows).groupBy("doc_id").count().collect()
    count = {r["doc_id"]: r["count"] for r in found}
    chunks = sum(w == -1 for *_, w in passages(text.split("\n")))
    inside = sum(w not in (-1, None) for *_, w in passages(text.split("\n")))
    assert inside > 20 and all(count[i] == chunks + 59 - inside for i in range(1, 6))


def test_overlapping_repeats_leave_the_first_occurrence(make):
    rows = [(1, "ha\nha\nha\nha"), (2, "a\nb\na\nb\na\nb\nc"), (3, "\n".join(["x"] * 50)), (4, "\n\n".join(["y", "z"] * 20))]
    got = {d: t for d, t, _ in _check(make, rows)}
    assert got[1] == "ha\nha" and got[2] == "a\nb\nc" and got[3] == "x\nx"


def test_odd_rows(make):
    two = "one line of words\nand another line\n" * 3
    rows = [(i, t) for i, t in enumerate(ODD)] + [(50, two), (51, two), (50, two), (None, two), (None, None), (60, "\n".join(["same"] * 20))]
    _check(make, rows)
    assert dedup_lines(make([])).count() == 0


def test_columns_are_kept(make):
    df = make([(1, "x", 2, 3, 4, "t", 5)], "doc_id long, text string, key int, no int, digest int, `a.b` string, within int")
    out = dedup_lines(df)
    assert out.columns == [*df.columns, "n_removed"] and tuple(out.first()) == (1, "x", 2, 3, 4, "t", 5, 0)



def test_texts_are_looked_at_in_small_parts(spark, make):
    import pyarrow as pa

    from cartwheel.llm import line_dedup
    from cartwheel.llm.common import rows_sent

    texts = ["é" * 700, None, "", "x" * (5 << 20), "a\nb"] * 40 + ["y" * 1000] * 9000
    batch = pa.RecordBatch.from_pydict({"doc_id": list(range(len(texts))), "text": texts})
    parts = list(line_dedup._slices(iter([batch, batch.slice(0, 0)])))
    assert [x for _, part in parts for x in part] == texts
    assert [x for b, _ in parts for x in b.column("doc_id").to_pylist()] == list(range(len(texts)))
    assert all(len(part) == 1 or sum(len((x or "").encode()) for x in part) <= line_dedup.SLICE_BYTES for _, part in parts)

    def rows(batches):
        yield from (pa.RecordBatch.from_pydict({"n": [b.num_rows]}) for b in batches)

    docs = spark.range(0, 5000, 1, 1)
    with rows_sent(spark, 1000):
        assert max(r["n"] for r in docs.mapInArrow(rows, "n long").collect()) <= 1000
    assert max(r["n"] for r in docs.mapInArrow(rows, "n long").collect()) == 5000
