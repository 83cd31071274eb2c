import gc
import hashlib
import random
import time

import public_tokenizers
import tiktoken

from cartwheel.llm.byte_bpe import Codec, encode_documents

from .conftest import ODD, prose

PATH = public_tokenizers.path("byte_bpe_multi_50k.tiktoken")


def _library():
    own = Codec(PATH, public_tokenizers.PATTERN)
    return own, tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, mergeable_ranks=own.ranks, special_tokens={})


def test_equals_the_library_on_odd_characters():
    own, library = _library()
    rnd = random.Random(5)
    letters = " \n\t  ab'sletx1٣é中Σ́ \x1c\x85​<|endoftext|>#😀.,!"
    texts = ["".join(rnd.choice(letters) for _ in range(rnd.randint(0, 60))) for _ in range(1500)]
    texts += [t or "" for t in ODD] + ["  a", "a  \n b", "a\n", "ab" * 700, "don't I'LL"]
    for text, (n, ids, back) in zip(texts, own.documents(texts), strict=True):
        want = library.encode_ordinary(text)
        assert (n, ids.decode()) == (len(want), ",".join(map(str, want))) and back == text.encode()


def test_long_pieces_go_on_where_the_step_bound_stops(monkeypatch):
    from cartwheel.llm import byte_bpe
    monkeypatch.setattr(byte_bpe, "ROWS_AT_ONCE", 500)
    monkeypatch.setattr(byte_bpe, "LONG", 10_000)
    own, library = _library()
    pieces = ["abcdefgh" * 30, "a", "hello", "zq" * 90]
    got = own.encode_pieces([p.encode() for p in pieces])
    assert [ids.decode() for _, ids, _ in got] == [",".join(map(str, library.encode_ordinary(p))) for p in pieces]
    assert own.decode([[own.ranks[b"a"], own.ranks[b"b"]], []]) == [b"ab", b""]


def test_query_rows(make):
    rnd = random.Random(1)
    texts = [*ODD, *(prose(rnd, 50) for _ in range(20))]
    rows = [(i, t, "en", "s", 0) for i, t in enumerate(texts)] + [(3, "again", None, None, None), (None, "no id", None, None, None)]
    _, library = _library()
    got = encode_documents(make(rows), path=PATH, keep_ids=True).collect()
    key = lambda r: (r["doc_id"] is None, r["doc_id"], r["decoded_sha256"])
    want = sorted(((d is None, d, hashlib.sha256((t or "").encode()).hexdigest()), t or "") for d, t, *_ in rows)
    for r, (k, text) in zip(sorted(got, key=key), want, strict=True):
        ids = library.encode_ordinary(text)
        assert key(r) == k and list(r["ids"]) == ids and r["n_tokens"] == len(ids) and bytes(r["decoded"]) == text.encode()
        assert r["ids_sha256"] == hashlib.sha256(",".join(map(str, ids)).encode()).hexdigest()
    assert encode_documents(make([]), path=PATH).count() == 0


def test_segments_of_long_pieces_equal_the_library():
    own, library = _library()
    rnd = random.Random(9)
    pieces = ["".join(rnd.choice(letters) for _ in range(rnd.randint(513, 3000))) for letters in
              ("ab", "etaoinshr", "abcdefghijklmnopqrstuvwxyz", "éàü中文ñ", "=-_", "01", "aaaab") for _ in range(12)]
    pieces += ["a" * n for n in (513, 576, 577, 832, 5000)] + ["hello" * 400, "=" * 3000, "ab" * 2000]
    for piece, (n, ids, back) in zip(pieces, own.encode_pieces([p.encode() for p in pieces]), strict=True):
        want = library._encode_single_piece(piece)
        assert (n, ids.decode()) == (len(want), ",".join(map(str, want))) and back == piece.encode()


def test_a_long_run_without_space_takes_seconds():
    own, library = _library()
    rnd = random.Random(10)
    text = "".join(rnd.choice("abcdefghijklmnopqrstuvwxyz") for _ in range(100_000))
    began = time.process_time()
    ((n, ids, _),) = own.documents([text])
    assert time.process_time() - began < 60
    want = library.encode_ordinary(text)
    assert (n, ids.decode()) == (len(want), ",".join(map(str, want)))


def test_a_piece_without_a_common_seam_is_coded_whole(monkeypatch):
    from cartwheel.llm import byte_bpe
    own, library = _library()
    monkeypatch.setattr(byte_bpe, "OVERLAP", 1)  # hardly ever holds one
    piece = "internationalisation" * 40
    ((n, ids, _),) = own.encode_pieces([piece.encode()])
    assert ids.decode() == ",".join(map(str, library._encode_single_piece(piece))) and n == ids.count(b",") + 1


def test_memory_is_bounded_and_keeps_what_is_in_use():
    own, library = _library()
    small = Codec(PATH, public_tokenizers.PATTERN, cache_bytes=20_000)
    rnd = random.Random(11)
    for k in range(30):
        texts = ["common words stay " + prose(rnd, 30, 10**6) for _ in range(4)]
        for text, (_, ids, _) in zip(texts, small.documents(texts), strict=True):
            assert ids.decode() == ",".join(map(str, library.encode_ordinary(text)))
        assert small.chunks.size < 20_000 + 200 * 500 and "words" in {**small.chunks.now, **small.chunks.before}
    assert len(small.chunks.now) + len(small.chunks.before) < 500


def test_extra_columns_are_ignored(make):
    df = make([(1, "a b", 2, "x", 3, "y")], "doc_id long, text string, n_tokens int, ids string, w int, `a.b` string")
    out = encode_documents(df, path=PATH)
    assert out.columns == ["doc_id", "n_tokens", "ids_sha256", "decoded_sha256"] and out.first()["n_tokens"] == 2


def test_an_idle_process_gives_the_codec_back(monkeypatch):
    from cartwheel.llm import byte_bpe
    monkeypatch.setattr(byte_bpe, "IDLE_SECONDS", 0.2)
    held = byte_bpe._Held()
    key = (PATH, public_tokenizers.PATTERN, 1000)
    with held.use(*key) as one:
        assert one.documents(["a b"])[0][0] == 2
    with held.use(*key) as again:  # the next task in time
        assert again is one
        time.sleep(0.5)
        assert held.codec is one
    time.sleep(1)
    assert held.codec is None
    with held.use(*key) as other:
        assert other is not one and other.documents(["a b"])[0][0] == 2


def test_many_new_words_are_contracted_at_once_without_garbage_collection(monkeypatch):
    rnd = random.Random(9)
    texts = [" ".join("".join(rnd.choices("abcdeorstéñ", k=rnd.randint(3, 14))) + rnd.choice(["", "", ".", "!!", "$$$"])
                      for _ in range(4000)) for _ in range(6)]
    own = Codec(PATH, public_tokenizers.PATTERN)
    begun, collected, begin = [], [], own._begin
    monkeypatch.setattr(own, "_begin", lambda pieces: begun.append(len(pieces)) or begin(pieces))
    count = lambda phase, info: collected.append(phase)
    gc.callbacks.append(count)
    try:
        got = own.documents(texts)
    finally:
        gc.callbacks.remove(count)
    assert gc.isenabled()
    assert sum(begun) > 15_000 and len(begun) <= 2 and len(collected) <= 2
    reference = tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, mergeable_ranks=own.ranks, special_tokens={})
    for text, (n, ids, back) in zip(texts, got, strict=True):
        want = reference.encode_ordinary(text)
        assert (n, ids, back) == (len(want), ",".join(map(str, want)).encode(), text.encode())
