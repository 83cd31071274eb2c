import random

from cartwheel.llm.components import components
from cartwheel.llm.jaccard_join import near_duplicates, shingles

from .conftest import ODD, prose


def brute(rows):
    """{doc_id: (set size, least doc_id reachable)} over exact shingle strings."""
    def grams(text):
        w = (text or "").encode().lower().split()
        return {tuple(w[i:i + 5]) for i in range(max(1, len(w) - 4))} if w else set()

    sets = [(d, grams(t)) for d, t, *_ in rows if d is not None]
    root = {d: d for d, _ in sets}

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for i, (a, x) in enumerate(sets):
        for b, y in sets[i + 1:]:
            if x and y and 100 * len(x & y) >= 75 * len(x | y):
                p, q = find(a), find(b)
                root[max(p, q)] = min(p, q)
    return {d: (len(s), find(d)) for d, s in sets}


def _near(rnd, text, edits):
    w = text.split()
    for _ in range(edits):
        w[rnd.randrange(len(w))] = f"e{rnd.randrange(10**6)}"
    return " ".join(w)


def _check(make, rows, partitions=4):
    got = {r["doc_id"]: (r["n_shingles"], r["component_id"]) for r in near_duplicates(make(rows).repartition(partitions)).collect()
           if r["doc_id"] is not None}
    assert got == brute(rows)


def test_copies_chains_and_passages(make):
    rnd = random.Random(4)
    base = [prose(rnd, rnd.randint(20, 120)) for _ in range(40)]
    passage = prose(rnd, 25)
    texts = list(base)
    texts += [rnd.choice(base) for _ in range(30)]                      # exact copies
    texts += [_near(rnd, rnd.choice(base), rnd.randint(1, 6)) for _ in range(120)]
    chain = prose(rnd, 100)                                             # links only step by step
    for _ in range(8):
        texts.append(chain)
        w = chain.split()
        chain = " ".join(w[4:] + [f"c{rnd.randrange(10**6)}" for _ in range(4)])
    texts += [f"{prose(rnd, rnd.randint(3, 40))} {passage} {prose(rnd, 3)}" for _ in range(60)]
    texts += [passage.upper(), passage, "short text", "Short  TEXT", "short", "a b c d e", "a b c d"]
    rnd.shuffle(texts)
    _check(make, [(i, t, None, None, None) for i, t in enumerate(texts)], 6)


def test_a_large_group_of_near_copies(make):
    rnd = random.Random(9)
    base = prose(rnd, 150)
    rows = [(i, _near(rnd, base, rnd.randint(0, 5)), None, None, None) for i in range(400)]
    rows += [(1000 + i, prose(rnd, 30), None, None, None) for i in range(50)]
    _check(make, rows, 5)


def test_threshold_is_exact(make):
    words = [f"w{i}" for i in range(40)]
    rows = [(100 + k, " ".join(words[:40 - k]), None, None, None) for k in range(0, 16)]  # 36 - k of 36 shingles
    _check(make, rows)


def test_odd_rows(make):
    rows = [(i, t, None, None, None) for i, t in enumerate([*ODD, *ODD])]
    _check(make, rows)
    out = near_duplicates(make([(None, "a b c d e f", None, None, None), (None, None, None, None, None)])).collect()
    assert sorted((r["n_shingles"], r["component_id"]) for r in out) == [(0, None), (2, None)]
    assert near_duplicates(make([])).count() == 0
    twice = near_duplicates(make([(1, "a b c d e f", None, None, None), (2, "p q r s t u", None, None, None),
                                  (1, "p q r s t u", None, None, None)])).collect()
    assert {(r["doc_id"], r["component_id"]) for r in twice} == {(1, 1), (2, 1)}


def test_a_doc_id_links_all_its_texts(make):
    """Ids 3 and 4 are linked through id 5, which has the texts of both, and an empty one."""
    one, two, three = "a b c d e f", "p q r s t u", "v w x y z a b c"
    rows = [(3, one), (4, two), (5, one), (5, two), (5, None), (6, three), (7, three), (7, ""), (8, "")]
    got = near_duplicates(make([(d, t, None, None, None) for d, t in rows])).collect()
    assert sorted(tuple(r) for r in got) == [(3, 2, 3), (4, 2, 3), (5, 0, 3), (5, 2, 3), (5, 2, 3), (6, 4, 6), (7, 0, 6), (7, 4, 6), (8, 0, 8)]


def test_extra_columns_do_not_clash(make):
    df = make([(2, "a b c d e f", 1, 2, 3, 4)], "doc_id long, text string, n int, k1 int, component_id int, h int")
    assert [tuple(r) for r in near_duplicates(df).collect()] == [(2, 2, 2)]


def test_components_of_long_paths(make):
    links = [(i, i + 1) for i in range(1, 60)] + [(100, 100), (None, 3), (200, 201), (201, 200)]
    got = {r["node"]: r["component"] for r in components(make(links, "a long, b long")).collect()}
    assert got == {**{i: 1 for i in range(1, 61)}, 200: 200, 201: 200}


def test_shingles_are_sets_of_lowered_words():
    assert len(shingles("A b C d E f")) == 2 and (shingles("A b C d E f") == shingles("a B c D e F")).all()
    assert len(shingles("É b")) == 1 and (shingles("É b") != shingles("é b")).all()
