from cartwheel.llm.license_scan import known_digests, scan_licenses
from cartwheel.llm.license_texts import FULL_TEXTS

from .conftest import ODD


def _scan(make, texts, known=None):
    rows = scan_licenses(make([(i, t, None, None, None) for i, t in enumerate(texts)]), known).collect()
    return [(r["licence"], list(r["notices"])) for r in sorted(rows, key=lambda r: r["doc_id"])]


def test_spellings_layout_and_copyright_lines(make):
    mit = FULL_TEXTS["MIT"]
    wrapped = "/*\n * " + mit.replace("\n", "\n * ").replace("sublicense", "sub-license") + "\n */"
    texts = [mit, "MIT License".join(["Copyright (c) 2020 A. B.\nAll rights reserved.\n\n", ""]).replace("MIT License", "") + mit.upper(),
             wrapped, mit + "\none more clause", FULL_TEXTS["ISC"], FULL_TEXTS["BSD-3-Clause"].replace("COPYRIGHT HOLDER ", "COPYRIGHT OWNER "),
             FULL_TEXTS["Zlib"].replace("acknowledgment", "acknowledgement")]
    assert [a for a, _ in _scan(make, texts)] == ["MIT", "MIT", "MIT", None, "ISC", "BSD-3-Clause", "Zlib"]


def test_titles_above_a_text(make):
    texts = [f"{title}\n\nCopyright (c) 2020 A. B.\n\n{FULL_TEXTS[k]}" for k, title in (
        ("MIT", "MIT License"), ("MIT", "The MIT License (MIT)"), ("ISC", "ISC License"), ("BSD-3-Clause", "The BSD 3-Clause License"),
        ("BSD-3-Clause", 'BSD 3-Clause "New" or "Revised" License'), ("BSD-2-Clause", "# BSD-2-Clause"), ("Zlib", "zlib License"),
        ("0BSD", "BSD Zero Clause License"))]
    assert [a for a, _ in _scan(make, texts)] == ["MIT", "MIT", "ISC", "BSD-3-Clause", "BSD-3-Clause", "BSD-2-Clause", "Zlib", "0BSD"]
    texts = ["MIT License", "My own title\n" + FULL_TEXTS["MIT"], "MIT License\nMIT License\n" + FULL_TEXTS["MIT"], "MIT License\nand other words"]
    assert [a for a, _ in _scan(make, texts)] == [None] * 4


def test_every_wrapping_is_one_text(make):
    """A line's end at any word of each text, and one at every word."""
    texts, names = [], []
    for name, text in FULL_TEXTS.items():
        words = text.split()
        texts += [" ".join(words[:i]) + "\n" + " ".join(words[i:]) for i in range(1, len(words), 5)] + ["\n".join(words)]
        names += [name] * (len(range(1, len(words), 5)) + 1)
    other = FULL_TEXTS["BSD-3-Clause"].replace("COPYRIGHT HOLDER ", "COPYRIGHT\nOWNER ").replace("sublicense", "sub\nlicense")
    assert [a for a, _ in _scan(make, [*texts, other])] == [*names, "BSD-3-Clause"]


def test_notices_are_whole_lines(make):
    texts = ["text\nLicensed under CC BY-NC 4.0.\nmore\n  RELEASED under the MIT licence!", "it is Released under the MIT License.",
             "SPDX-License-Identifier: GPL-3.0\n" * 3]
    assert [n for _, n in _scan(make, texts)] == [["CC-BY-NC-4.0", "MIT"], [], ["GPL-3.0"]]


def test_odd_rows_and_own_registry(make, spark):
    assert _scan(make, ODD) == [(None, [])] * len(ODD)
    assert scan_licenses(make([])).count() == 0
    own = known_digests(spark, [("B", "text", "Do as you like."), ("A", "text", "do as YOU like"), ("C", "notice", "mine")])
    assert _scan(make, ["Do, as you like", "x\nMINE\n"], own) == [("A", []), (None, ["C"])]
    df = make([(1, "x", 1, 2)], "doc_id long, text string, digest int, licence int")
    assert scan_licenses(df).first()["licence"] is None
    null, blank = scan_licenses(make([(1, None, None, None, None), (2, "..", None, None, None)])).orderBy("doc_id").collect()
    assert null["digest"] is None and blank["digest"] is not None
