import hashlib
import random
import re

from cartwheel.llm import decontaminate
from cartwheel.llm.decontaminate import contamination

from .conftest import ODD, prose

ITEMS = "item_id long, text string"


def _words(text):
    lowered = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or "")
    return re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", lowered)


def brute(docs, items):
    out = []
    for doc_id, text, *_ in docs:
        w, hit, found = _words(text), set(), set()
        for item_id, item in items:
            v = _words(item)
            if item_id is None:
                continue
            for x in ([v[i:i + 10] for i in range(len(v) - 9)] if len(v) >= 10 else [v] if v else []):
                for i in range(len(w) - len(x) + 1):
                    if w[i:i + len(x)] == x:
                        hit |= set(range(i, i + len(x)))
                        found.add(str(item_id))
        ids = sorted(found)
        out.append((doc_id, len(w), len(hit), len(ids), hashlib.sha256(",".join(ids).encode()).hexdigest(), bool(hit)))
    return sorted(out, key=repr)


def _rows(df):
    return sorted((tuple(r) for r in df.drop("items").collect()), key=repr)


def test_passages_short_items_and_near_misses(make):
    rnd = random.Random(8)
    items = [(i, prose(rnd, rnd.randint(11, 40), 400)) for i in range(30)]
    items += [(100, "two words"), (101, "Single"), (102, "a a a a a a a a a a a a"), (103, ""), (104, None), (None, "no id at all"),
              (3, items[3][1]), (7, "É-ü 9x")]
    docs = []
    for i in range(120):
        text = prose(rnd, rnd.randint(0, 60), 400)
        if i % 3 == 0:
            v = rnd.choice(items[:30])[1].split()
            at = rnd.randint(0, len(v) - 10)
            part = v[at:at + rnd.randint(9, 14)]  # nine words are no window
            text = f"{text} {', '.join(part).upper()}! {prose(rnd, 5)}"
        docs.append((i, text, None, None, None))
    docs += [(200, "has two Words. twice two words", None, None, None), (201, "single", None, None, None),
             (202, "a " * 25, None, None, None), (203, "é-Ü 9X é-ü 9x", None, None, None), (5, docs[3][1], None, None, None)]
    docs += [(300 + i, t, None, None, None) for i, t in enumerate(ODD)]
    got = contamination(make(docs).repartition(4), make(items, ITEMS))
    assert _rows(got) == brute(docs, items)


def test_the_shuffle_join_gives_the_same(make, monkeypatch):
    docs = [(i, "x y z " * 5 + "q w e r t y u i o p a", None, None, None) for i in range(20)]
    items = [(1, "w e r t y u i o p a"), (2, "z x"), (3, "nothing of this kind")]
    want = brute(docs, items)
    monkeypatch.setattr(decontaminate, "BROADCAST_SHINGLES", 0)
    assert _rows(contamination(make(docs), make(items, ITEMS))) == want


def test_empty_tables_and_clashing_columns(make):
    items = make([(1, "a b c")], ITEMS)
    assert contamination(make([]), items).count() == 0
    df = make([(1, "a b c", 5, 6, 7)], "doc_id long, text string, row int, w int, s int")
    assert contamination(df, make([], ITEMS)).first()["contaminated"] is False
    wide = make([(1, "a b c", 1, 2)], ITEMS + ", w int, item int")
    assert contamination(df, wide).first()["items"] == ["1"]
