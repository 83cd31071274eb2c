import random
import re
from collections import Counter

from cartwheel.llm.quality_rules import base_rules, host_verdicts, quality_verdicts

from .conftest import ODD, prose


def brute(text):
    t = text or ""
    w = [x for x in re.split(r"[\x20\x09-\x0D]+", t) if x]
    found = Counter(tuple(w[i:i + 3]) for i in range(len(w) - 2))
    inside = {j for i in range(len(w) - 2) if found[tuple(w[i:i + 3])] > 1 for j in range(i, i + 3)}
    lines = [x for x in t.split("\n") if re.search(r"[^\x20\x09-\x0D]", x)]
    return (len(w), sum(map(len, w)), len(re.findall(r"[#*$%&|<>]", t)), len(lines) - len(set(lines)), len(inside),
            len(w) < 50 or 100 * len(inside) > 50 * len(w))


def test_rules_against_brute_force(make):
    rnd = random.Random(4)
    texts = [*ODD, "a b c", "a b c a b c", "a a a a", "x y x y x y z", "l\nl\n \n l\n#*$%&|<>\n\nl"]
    texts += [prose(rnd, rnd.randint(0, 120), rnd.choice([2, 4, 30, 1000])) for _ in range(60)]
    rows = [(i, t, None, "h", None) for i, t in enumerate(texts)]
    got = {r["doc_id"]: tuple(r)[2:] for r in base_rules(make(rows).repartition(3)).select(
        "doc_id", "host", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed").collect()}
    assert got == {i: brute(t) for i, t, *_ in rows}


def test_hosts_fail_only_for_certain(make):
    rnd = random.Random(5)
    good = lambda: prose(rnd, 60)
    rows = []
    for host, n, bad in (("clean", 300, 0.05), ("spam", 200, 0.95), ("small", 3, 1.0), ("mixed", 100, 0.5)):
        rows += [(len(rows) + i, "bad" if i < bad * n else good(), None, host, None) for i in range(n)]
    rows += [(9000, good(), None, None, None), (9001, "bad", None, None, None), (1, good(), None, "clean", None)]
    out = quality_verdicts(make(rows)).collect()
    assert len(out) == len(rows)
    for r in out:
        assert r["kept"] == (not r["base_failed"] and r["host"] != "spam")
    verdicts = {r["host"]: r for r in host_verdicts(base_rules(make(rows))).collect()}
    assert verdicts["spam"]["host_failed"] and not verdicts["small"]["host_failed"]
    assert verdicts["small"]["host_fail_rate"] < 1 and verdicts["clean"]["host_docs"] == 301


def test_empty_one_host_and_clashing_columns(make):
    assert quality_verdicts(make([])).count() == 0
    one = quality_verdicts(make([(1, prose(random.Random(1), 60), None, "h", None)])).first()
    assert one["kept"] and one["host_docs"] == 1
    df = make([(1, "x", "h", 1, 2)], "doc_id long, text string, source string, host int, n_words int")
    assert quality_verdicts(df).first()["host"] == "h"


def test_rows_of_a_host_are_not_shuffled_for_its_verdict(make):
    from cartwheel.llm.quality_rules import quality_verdicts
    docs = make([(i, "some words here " * 30, "en", f"h{i % 2}", 0) for i in range(60)])
    plan = quality_verdicts(docs)._jdf.queryExecution().executedPlan().toString()
    assert "BroadcastHashJoin" in plan and "hashpartitioning" not in plan
