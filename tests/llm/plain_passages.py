"""Line dedup by brute force: every passage of any length, looked up as a string."""

from cartwheel.llm.line_dedup import LONG_WORDS


def brute(rows, order):
    """(doc_id, text, lines removed) rows; ``rows`` are (doc_id, text), ``order(row)`` gives a row's
    place among the rows. Rows of equal place are one row that stands twice."""
    first, gone = {}, {}
    for row in sorted(rows, key=order):
        at, lines = order(row), (row[1] or "").split("\n")
        full = [i for i, x in enumerate(lines) if x and not x.isspace()]
        gone[at] = set()
        for n, a in enumerate(full):
            for b in full[n:]:
                if b > a or len(lines[a].split()) >= LONG_WORDS:
                    where, start, end = first.setdefault("\n".join(lines[a:b + 1]), (at, a, b))
                    if (where, start) != (at, a):  # lines of the first occurrence stay
                        gone[at].update(i for i in range(a, b + 1) if where != at or i > end)
    out = []
    for row in rows:
        lines, go = (row[1] or "").split("\n"), gone[order(row)]
        words = sum(bool(lines[i]) and not lines[i].isspace() for i in go)
        out.append((row[0], "\n".join(x for i, x in enumerate(lines) if i not in go) if go else row[1], words))
    return sorted(out, key=repr)


def expected(df, rows):
    """The same with the operator's order of rows: doc_id (null first), then the row's hashes."""
    named = df.selectExpr("doc_id", "text", "xxhash64(doc_id, text) AS k1", "xxhash64(text, 1, doc_id) AS k2")
    keys = {(r["doc_id"], r["text"]): (r["k1"], r["k2"]) for r in named.collect()}
    return brute(rows, lambda r: (r[0] is not None, r[0] or 0, *keys[r[0], r[1]]))
