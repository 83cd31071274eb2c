import random
import zlib

import numpy as np
import public_tokenizers
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from tokenizers import Tokenizer

from cartwheel.llm.token_files import ESCAPE, TokenFile, Words, read_token_files, to_file, token_index, write_token_files
from cartwheel.session import scratch_path

from .conftest import ODD, prose

PATH = public_tokenizers.path("word_bpe_49k.json")


@settings(max_examples=60, deadline=None)
@given(st.lists(st.one_of(st.integers(0, 3), st.integers(0, 50_000), st.sampled_from([ESCAPE - 1, ESCAPE, ESCAPE + 1, 2**32 - 1])),
                max_size=400), st.sampled_from([1, 7, 64, 1 << 14]), st.data())
def test_codec_round_trip(ids, block, data):
    ids = np.array(ids, np.uint32)
    f = TokenFile(to_file([5, None], [len(ids), 0], ids, 3, 1, block) + b"\n")
    assert (f.ids(0, len(ids)) == ids).all() and f.doc_ids == [5, None] and (f.bucket, f.part) == (3, 1)
    a = data.draw(st.integers(0, len(ids)))
    b = data.draw(st.integers(a, len(ids)))
    assert (f.ids(a, b) == ids[a:b]).all()


def test_words_are_packed():
    ids = np.full(6000, 900, np.uint32)  # 10 bits: six to a word
    assert len(TokenFile(to_file([1], [6000], ids, 0, 0) + b"\n").words) == 1000
    with pytest.raises(ValueError):
        TokenFile(b"nonsense" * 20)


def test_equals_the_library_on_odd_characters():
    library = Tokenizer.from_file(PATH)
    own, rnd = Words(PATH), random.Random(3)
    assert own.by_word
    letters = [*" \n\t  ab'sletx1٣éÉ中ΣσΑİǅ́ \x1c\x85​#😀.,!", "<|endoftext|>", "<|STARTOFTEXT|>", "don't", "I'LL", "ﬁ", "Å", "가"]
    texts = ["".join(rnd.choice(letters) for _ in range(rnd.randint(0, 40))) for _ in range(1500)] + [t or "" for t in ODD]
    for text, got in zip(texts, own.encode(texts), strict=True):
        assert np.frombuffer(got, own.dtype).tolist() == library.encode(text, add_special_tokens=False).ids


def test_added_tokens_in_a_text_are_what_the_library_makes_of_them():
    assert np.frombuffer(Words(PATH).encode(["a <|endoftext|> b"])[0], "<u2").tolist() == [320, 49407, 321]


def test_extra_columns_are_ignored(spark, make):
    path = scratch_path(spark, "test-tokens")
    df = make([(1, "a b", 2, "x", 3, 4)], "doc_id long, text string, bucket int, ids string, part int, `a.b` int")
    write_token_files(df, path, tokenizer=PATH, end_id=2)
    out = token_index(spark, path)
    assert out.columns == ["doc_id", "start", "n_tokens", "ids_crc32"] and tuple(out.first())[:3] == (1, 0, 3)


def test_files_and_index(spark, make):
    rnd = random.Random(2)
    ids = list(range(0, 300, 3))
    rnd.shuffle(ids)
    rows = [(i, prose(rnd, rnd.randint(0, 80)), "en", "s", 0) for i in ids] + [
        (1000 + i, t, None, None, None) for i, t in enumerate(ODD)] + [(None, "no id", None, None, None), (9, "same id", None, None, None)]
    path = scratch_path(spark, "test-tokens")
    write_token_files(make(rows).repartition(5), path, tokenizer=PATH, end_id=2, bucket_bytes=3000, file_ids=500, block=128)
    library = Tokenizer.from_file(PATH)
    coded = sorted(((d is not None, d or 0, library.encode(t or "", add_special_tokens=False).ids + [2]) for d, t, *_ in rows),
                   key=lambda r: r[:2])
    got = sorted(token_index(spark, path).collect(), key=lambda r: r["start"])
    assert [r["doc_id"] for r in got] == [d if known else None for known, d, _ in coded]
    assert read_token_files(spark, path).select("bucket", "part").distinct().count() > 5
    at = 0
    for r in got:
        assert r["start"] == at
        at += r["n_tokens"]
    crc = sorted((r["doc_id"] is not None, r["doc_id"] or 0, r["n_tokens"], r["ids_crc32"]) for r in got)
    assert crc == sorted((known, d, len(x), zlib.crc32(np.array(x, "<u4").tobytes())) for known, d, x in coded)



def test_empty_table(spark, make):
    path = scratch_path(spark, "test-tokens")
    write_token_files(make([]), path, tokenizer=PATH, end_id=2)
    assert token_index(spark, path).count() == 0


def test_plain_texts_are_cut_at_once_and_each_part_is_looked_up_once(monkeypatch):
    library = Tokenizer.from_file(PATH)
    own, rnd = Words(PATH), random.Random(4)
    letters = [*"  \n\nabESTsletrvmdxyz0123456789'''.,!$#²½ªºßéÉİǅÆæŒÿ×÷¡ɏ~", "don't", "I'LL", " 'Re", "we've", "$$$", "<|", "|>", "end"]
    texts = ["".join(rnd.choices(letters, k=rnd.randint(0, 60))) for _ in range(1500)] + ["", "\n", " ", "a" * 3000, "İ" * 50]
    lookups = []
    part = own.parts.make
    monkeypatch.setattr(own.parts, "make", lambda x: lookups.append(x) or part(x))
    for text, got in zip(texts, own.encode(texts), strict=True):
        assert np.frombuffer(got, own.dtype).tolist() == library.encode(text, add_special_tokens=False).ids, text
    assert len(lookups) == len(set(lookups)) and not own.known


def test_words_asked_for_again_outlast_a_full_memory(monkeypatch):
    from cartwheel.llm import token_files
    monkeypatch.setattr(token_files, "KNOWN_PARTS", 50)
    own, asked = Words(PATH), []
    part = own.parts.make
    own.parts.make = lambda x: asked.append(x) or part(x)
    for i in range(40):
        own.encode([" ".join(["often", *("".join(random.Random(20 * i + k).choices("abcdefgh", k=9)) for k in range(20))])])
    assert asked.count("often") == 1 and len(own.parts) + len(own.parts.before) < 200
