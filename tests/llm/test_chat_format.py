"""Chat formatting: escapes, spans and masks against plain versions, and whole round trips."""

import hashlib
import random

import numpy as np
import public_tokenizers
from hypothesis import given, settings
from hypothesis import strategies as st

from cartwheel.llm.chat_format import CONTROLS, HARD_TEXT, digests, escape, format_conversations, loss_mask, parse, render, unescape

from .conftest import ODD, prose

PATH = public_tokenizers.path("byte_bpe_50k.json")
TURNS = "conv_id long, turn long, role string, text string"
piece = st.sampled_from([*CONTROLS, "<", "[", "\\", "\\\\", "/", "s>", "INST]", "ROLE]", "TEXT]", "a", " ", "\n", "中"])
hard = st.lists(piece, max_size=12).map("".join)
turns = st.lists(st.tuples(st.one_of(st.sampled_from(["user", "assistant", "system", ""]), hard), hard), max_size=5)


@settings(max_examples=400, deadline=None)
@given(hard)
def test_escape_is_reversible_and_leaves_no_control_string(text):
    assert unescape(escape(text)) == text
    assert not any(c in escape(text) for c in CONTROLS)


@settings(max_examples=300, deadline=None)
@given(turns)
def test_turns_are_read_back(some):
    formatted, spans = render(some)
    assert parse(formatted) == some
    assert [unescape(formatted[a:b]) for a, b in spans] == [t for r, t in some if r == "assistant"]


def test_mask_equals_comparing_every_pair():
    rng = np.random.default_rng(1)
    for _ in range(200):
        cuts = np.sort(rng.choice(60, rng.integers(2, 20), replace=False))
        starts, ends = cuts[:-1], cuts[1:]
        edges = np.sort(rng.choice(60, 2 * rng.integers(0, 5), replace=True))
        spans = [(int(a), int(b)) for a, b in zip(edges[::2], edges[1::2], strict=True)]
        want = [any(a < e and s < b for a, b in spans if a < b) for s, e in zip(starts, ends, strict=True)]
        assert loss_mask(starts, ends, spans).tolist() == want


def expected(rows):
    """Digest rows by plain Python; rows are (conv_id, turn, role, text)."""
    convs = {}
    for k, (conv, turn, role, text) in enumerate(rows):
        convs.setdefault((conv, k if conv is None else None), []).append((turn is not None, turn or 0, role or "", text or ""))
    out = []
    for (conv, _), own in convs.items():
        own.sort()
        learned = "".join(t for *_, r, t in own if r == "assistant")
        sha = lambda s: hashlib.sha256(s.encode()).hexdigest()
        out.append((conv, len(own), sha("".join(f"{r}\n{t}\n" for *_, r, t in own)), len(learned), sha(learned)))
    return sorted(out, key=repr)


def _check(make, rows, schema=TURNS):
    done = format_conversations(make(rows, schema).repartition(3), path=PATH)
    got = digests(done)
    assert sorted((tuple(r)[:5] for r in got.collect()), key=repr) == expected([r[:4] for r in rows])
    return done


def test_conversations_round_trip(make):
    rnd = random.Random(8)
    rows = [(c, t, rnd.choice(["system", "user", "assistant"]), prose(rnd, rnd.randint(0, 40)) + rnd.choice(["", " ", "é😀", HARD_TEXT, "\n"]))
            for c in range(60) for t in range(rnd.randint(1, 8))]
    _check(make, rows)


def test_odd_rows(make):
    rows = [(1, i, "assistant", t) for i, t in enumerate(ODD)]
    rows += [(2, 0, None, "no role"), (2, 1, "tool", None), (2, 2, "[ROLE]x", "[TEXT]"), (2, None, "user", "first"),
             (None, 0, "user", "alone"), (None, 1, "assistant", "alone too"), (3, 0, "assistant", "twice"), (3, 0, "assistant", "twice"),
             (4, 5, "assistant", "b"), (4, 5, "assistant", "a"), (5, 0, "assistant", ""), (6, 0, "user", "<|endoftext|> is a text")]
    _check(make, rows)
    assert format_conversations(make([], TURNS), path=PATH).count() == 0


def test_extra_columns_are_ignored(make):
    schema = TURNS + ", lone string, ids int, `a.b` string"
    _check(make, [(1, 0, "user", "q", "x", 1, "y"), (1, 1, "assistant", "a", None, None, None)], schema)


def test_ids_are_those_of_the_whole_text(make):
    """Decoded, the ids give the formatted text; marks are one token each and never learned."""
    from cartwheel.llm.chat_format import _encoder
    rows = [(1, 0, "user", "What is 中文?"), (1, 1, "assistant", f" It is 😀 {HARD_TEXT}"), (1, 2, "assistant", "more")]
    (row,) = format_conversations(make(rows, TURNS), path=PATH).collect()
    own = _encoder(PATH)
    marks = {own.token_to_id(c) for c in CONTROLS}
    assert sum(i in marks for i in row["ids"]) == 6 and not any(on for i, on in zip(row["ids"], row["loss"], strict=True) if i in marks)
    assert "".join(own.decode([i]) if i in marks else "" for i in row["ids"]) == "[INST][/INST]<s></s><s></s>"
    starts = np.cumsum(row["gaps"])
    covered = set()
    for a, w, on in zip(starts, row["widths"], row["loss"], strict=True):
        if on:
            covered.update(range(a, a + w))
    assert [unescape(x) for x in (row["formatted"][min(covered):max(covered) + 1].split("</s><s>"))] == [rows[1][3], "more"]
