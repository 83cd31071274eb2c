from cartwheel.llm.url_filter import RULES, filter_urls, host_reputation, page_outcomes

PAGES, OUTCOMES = "page_id long, url string", "page_id long, good int"


def _judge(make, urls, outcomes=(), **options):
    out = filter_urls(make(list(enumerate(urls)), PAGES), make(list(outcomes), OUTCOMES), **options).collect()
    return [(r["host"], r["path"], r["rule"], r["verdict"]) for r in sorted(out, key=lambda r: r["page_id"])]


def test_parts_and_rules(make):
    urls = ["http://A.Example.COM/en/1?x#y", "https://www.example.com/en/", "https://sub.www.example.com/en/x", "http://b.net/es/1",
            "http://b.net/fr", "http://com/", "http://x.com", "ftp://x.com?q", "noscheme.com/en/", None, "", "a://b://c/d",
            "http://notexample.com/en/1", "http://É.net/fr/é#z", "http://x.org/\nnext"]
    assert _judge(make, urls) == [
        ("a.example.com", "/en/1", "example.com/en/", "block"), ("www.example.com", "/en/", "www.example.com/en/", "allow"),
        ("sub.www.example.com", "/en/x", "www.example.com/en/", "allow"), ("b.net", "/es/1", "net/es/", "block"),
        ("b.net", "/fr", None, "allow"), ("com", "/", "com/", "allow"), ("x.com", "", None, "allow"), ("x.com", "", None, "allow"),
        ("", "", None, "allow"), ("", "", None, "allow"), ("", "", None, "allow"), ("b:", "//c/d", None, "allow"),
        ("notexample.com", "/en/1", "com/", "allow"), ("É.net", "/fr/é", "net/fr/", "block"), ("x.org", "/\nnext", None, "allow")]


def test_bad_hosts_are_blocked_and_small_ones_shrunk(make):
    urls, outcomes = [], []
    for host, n, good in (("good.a.org", 200, 0.95), ("bad.b.org", 80, 0.02), ("two.a.org", 2, 0), ("new.a.org", 5, None)):
        for i in range(n):
            if good is not None:
                outcomes.append((len(urls), int(i < good * n)))
            urls.append(f"http://{host}/{i}")
    verdict = {h: v for h, _, _, v in _judge(make, urls, outcomes)}
    assert verdict == {"good.a.org": "allow", "bad.b.org": "block", "two.a.org": "allow", "new.a.org": "allow"}
    hosts = {r["host"]: r for r in host_reputation(make([(urls[p].split("/")[2], g) for p, g in outcomes], "host string, good int")).collect()}
    assert hosts["two.a.org"]["mean"] > 0.2 and hosts["two.a.org"]["domain"] == "a.org" and hosts["bad.b.org"]["suffix"] == "org"


def test_odd_rows(make):
    assert filter_urls(make([], PAGES), make([], OUTCOMES)).count() == 0
    pages = make([(1, "http://h.co.uk:80/a", 5), (1, "http://h.co.uk:80/a", 6), (None, "http://h.co.uk/b", 7)], PAGES + ", host int")
    out = filter_urls(pages, make([(1, 1), (1, 0), (None, 1), (1, None)], OUTCOMES)).collect()
    assert len(out) == 3 and {r["host_labels"] for r in out if r["page_id"] == 1} == {2}
    assert all(r["host_good"] < 0.5 for r in out if r["page_id"] == 1)
    labels = make([(1, 1, 0), (2, 1, 1), (3, None, 0), (4, 0, 0)], "doc_id long, quality int, toxic int")
    assert {r["page_id"]: r["good"] for r in page_outcomes(labels).collect()} == {1: 1, 2: 0, 3: None, 4: 0}
    assert {a for _, a in RULES} == {"allow", "block"}
    two = host_reputation(make([("x.co.uk", 1), ("u:p@y.x.co.uk:8080", 0)], "host string, good int")).collect()
    assert {(r["domain"], r["suffix"]) for r in two} == {("x.co.uk", "co.uk")}


def test_pages_are_not_shuffled_for_their_verdict(make):
    pages = make([(i, f"http://h{i % 3}.org/{i}") for i in range(60)], PAGES)
    plan = filter_urls(pages, make([(i, i % 2) for i in range(60)], OUTCOMES))._jdf.queryExecution().executedPlan().toString()
    assert "BroadcastHashJoin" in plan and "hashpartitioning" not in plan and plan.count("FileScan") <= 1
