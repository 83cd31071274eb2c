"""Token ids in binary files of word-aligned Simple-8b blocks.

A 64-bit word holds a 4-bit selector and as many ids as its width allows; an id too wide for
the widest slot is written as that slot's all-ones escape and kept in full beside the words.
Blocks of ids start at recorded word and escape offsets, so that any of them can be decoded
alone, and all ids of one selector are unpacked by one vector operation.

File layout (little-endian):
  magic ``S8B1``, uint32 block size, then uint64 bucket, part, documents, ids, blocks, words,
  escapes; int64 doc_id per document, uint8 "doc_id is null" per document (padded to 8),
  uint64 first id per document and one more; uint64 first word and first escape per block and
  one more each; uint64 words; uint32 escapes; a final newline.
"""

from __future__ import annotations

import json
import re
import struct
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import public_tokenizers
import regex
import zstandard
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from cartwheel.llm.byte_bpe import Parts, slices
from cartwheel.llm.common import materialize, read_files, table, write_files
from cartwheel.session import scratch_path

WIDTHS = (20, 15, 12, 10, 8, 7, 6, 5, 4, 3, 2, 1)   # selector s: 60 // WIDTHS[s] ids a word
COUNTS = tuple(60 // w for w in WIDTHS)
ESCAPE = (1 << WIDTHS[0]) - 1
BLOCK = 1 << 14             # ids of a block
FILE_IDS = 1 << 21          # ids of a file, about (the last document is not cut)
BUCKET_BYTES = 16 << 20     # text of a range of doc_id, about
HEADER = struct.Struct("<4sI7Q")
KNOWN_WORDS, KNOWN_PARTS = 300_000, 300_000  # of a worker's two generations (some 200 bytes each)


# ---- the codec -------------------------------------------------------------------------

def _fitting(grid: np.ndarray, at: np.ndarray, s: int) -> np.ndarray:
    """Of the places ``at``, those where a word of selector ``s`` holds the next ids; zeros follow
    the grid."""
    count, small = COUNTS[s], grid < (1 << WIDTHS[s])
    if len(at) == len(grid) and count < 8:
        fits = small.copy()
        for k in range(1, count):
            fits[:-k] &= small[k:]
        return np.flatnonzero(fits)
    if len(at) * count < 4 * len(grid):  # few: place by place
        for k in range(count):
            at = at[small[np.minimum(at + k, len(grid) - 1)]]
        return at
    seen = np.zeros(len(grid) + count, np.int32)
    np.cumsum(~small, out=seen[1:len(grid) + 1])
    seen[len(grid) + 1:] = seen[len(grid)]
    return at[seen[at + count] == seen[at]]


def pack(ids: np.ndarray, block: int = BLOCK):
    """uint32 ids -> (words, escapes, first word per block, first escape per block)."""
    n_blocks = -(-len(ids) // block)
    wide = ids >= ESCAPE
    # Each block is followed by zeros, so that no word reaches into the next block.
    grid = np.zeros((n_blocks, block + COUNTS[-1]), np.uint32)
    flat = np.zeros(n_blocks * block, np.uint32)
    flat[:len(ids)] = np.where(wide, ESCAPE, ids)
    grid[:, :block] = flat.reshape(n_blocks, block)
    grid = grid.ravel()
    selector = np.zeros(len(grid), np.int8)
    at = np.arange(len(grid))
    for s in range(1, len(WIDTHS)):
        # A narrower slot fits only where the wider one does: the selectors nest.
        at = _fitting(grid, at, s)
        if not len(at):
            break
        selector[at] = s
    step = np.array(COUNTS, np.int64)[selector]
    edges = np.arange(n_blocks + 1) * (block + COUNTS[-1])
    at, end = edges[:-1], edges[:-1] + np.minimum(block, len(ids) - np.arange(n_blocks) * block)
    begins = np.zeros(len(grid), bool)
    while len(at):  # the next word of every block
        begins[at] = True
        at = at + step[at]
        if (at >= end).any():
            at, end = at[at < end], end[at < end]
    starts = np.flatnonzero(begins)
    first_word = np.searchsorted(starts, edges)
    words = np.empty(len(starts), np.uint64)
    chosen = selector[starts]
    for s, (width, count) in enumerate(zip(WIDTHS, COUNTS, strict=True)):
        at = np.flatnonzero(chosen == s)
        if not len(at):
            continue
        value = np.full(len(at), s << 60, np.uint64)
        # The zeros after a block end are shorter than a word only where the grid ends.
        for k in range(count):
            value |= grid[np.minimum(starts[at] + k, len(grid) - 1)].astype(np.uint64) << np.uint64(k * width)
        words[at] = value
    escapes = ids[wide].astype(np.uint32)
    first_escape = np.searchsorted(np.flatnonzero(wide), np.arange(n_blocks + 1) * block)
    return words, escapes, first_word.astype(np.uint64), first_escape.astype(np.uint64)


def unpack(words: np.ndarray, escapes: np.ndarray, first_word: np.ndarray, n_ids: int,
           block: int = BLOCK) -> np.ndarray:
    """The uint32 ids of whole blocks (of the offsets given) holding ``n_ids`` ids."""
    n_blocks = len(first_word) - 1
    chosen = (words >> np.uint64(60)).astype(np.int64)
    count = np.array(COUNTS, np.int64)[chosen]
    before = np.cumsum(count) - count
    first_word = first_word.astype(np.int64) - int(first_word[0])
    # Words of a block follow each other; its first word starts at the block's first id.
    shift = np.repeat(np.arange(n_blocks) * block - before[first_word[:-1]] if n_blocks else [],
                      np.diff(first_word)).astype(np.int64)
    at = before + shift
    out = np.zeros(n_blocks * block + COUNTS[-1], np.uint32)
    last = np.repeat((np.arange(n_blocks) + 1) * block, np.diff(first_word))
    chosen[at + count > last] += len(WIDTHS)  # words that reach beyond their block's end
    for s, (width, slots) in enumerate(zip(WIDTHS, COUNTS, strict=True)):
        mask = np.uint64((1 << width) - 1)
        own = np.flatnonzero(chosen == s)
        if len(own):
            first, value = at[own], words[own]
            for k in range(slots):
                out[first + k] = (value >> np.uint64(k * width)) & mask
        for i in np.flatnonzero(chosen == s + len(WIDTHS)).tolist():
            for k in range(int(last[i] - at[i])):
                out[at[i] + k] = (words[i] >> np.uint64(k * width)) & mask
    out = out[:n_ids]
    if len(escapes):
        out[np.flatnonzero(out == ESCAPE)] = escapes
    return out


def to_file(doc_ids: list, lengths: list[int], ids: np.ndarray, bucket: int, part: int,
            block: int = BLOCK) -> bytes:
    """A whole file but for the newline that the writer adds."""
    words, escapes, first_word, first_escape = pack(ids, block)
    n = len(doc_ids)
    null = np.zeros(-(-n // 8) * 8, np.uint8)
    null[:n] = [d is None for d in doc_ids]
    return b"".join((
        HEADER.pack(b"S8B1", block, bucket, part, n, len(ids), len(first_word) - 1, len(words), len(escapes)),
        np.array([d or 0 for d in doc_ids], "<i8").tobytes(), null.tobytes(),
        np.concatenate(([0], np.cumsum(lengths))).astype("<u8").tobytes(),
        first_word.astype("<u8").tobytes(), first_escape.astype("<u8").tobytes(),
        words.astype("<u8").tobytes(), escapes.astype("<u4").tobytes()))


class TokenFile:
    """A file's bytes; ``ids(a, b)`` decodes only the blocks that hold ids a to b."""

    def __init__(self, data):
        magic, self.block, self.bucket, self.part, n, self.n_ids, blocks, words, escapes = HEADER.unpack_from(data)
        if magic != b"S8B1":
            raise ValueError("not a token file")
        at = HEADER.size

        def take(kind: str, count: int) -> np.ndarray:
            nonlocal at
            out = np.frombuffer(data, kind, count, at)
            at += out.nbytes
            return out

        doc_ids, null = take("<i8", n), take("u1", -(-n // 8) * 8)
        self.doc_ids = [None if x else int(d) for d, x in zip(doc_ids, null[:n], strict=True)]
        self.starts = take("<u8", n + 1).astype(np.int64)
        self.first_word, self.first_escape = take("<u8", blocks + 1), take("<u8", blocks + 1)
        self.words, self.escapes = take("<u8", words), take("<u4", escapes)

    def ids(self, a: int, b: int) -> np.ndarray:
        if a >= b:
            return np.zeros(0, np.uint32)
        lo, hi = a // self.block, -(-b // self.block)
        n = min(self.n_ids, hi * self.block) - lo * self.block
        w, e = self.first_word[lo:hi + 1], self.first_escape[lo:hi + 1]
        out = unpack(self.words[int(w[0]):int(w[-1])], self.escapes[int(e[0]):int(e[-1])], w, n, self.block)
        return out[a - lo * self.block:b - lo * self.block]


# ---- the tokenizer ---------------------------------------------------------------------

# The parts of a tokenizer file under which words between blanks are encoded
# independently and lower case can be applied beforehand.
_NORMALIZERS = ["NFC", "Replace", "Lowercase"]
_PRE_TOKENIZERS = ["Split", "ByteLevel"]
# No control character, no combining mark: NFC leaves these alone, white space is not among them.
_PLAIN = re.compile("[!-~¡-ɏ]*").fullmatch
_PLAIN_TEXT = re.compile("[ \n!-~¡-ɏ]*").fullmatch
# The pre-tokenizer's pattern by which Arrow cuts plain texts too.
_PATTERN = r"'s|'t|'re|'ve|'m|'ll|'d|[\p{L}]+|[\p{N}]|[^\s\p{L}\p{N}]+"

# Ends of a word that the pre-tokenizer's pattern always matches on their own after a letter.
_STOPS = frozenset(".,;:!?")


def _byte_letters() -> dict[int, str]:
    """The printable stand-in of each byte that byte-level vocabularies are written in."""
    own = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    rest = [b for b in range(256) if b not in own]
    return {b: chr(b) for b in own} | {b: chr(256 + i) for i, b in enumerate(rest)}


class _Memory(dict):
    """What ``make`` gave for each key. Of the generation before the last ``turn`` it keeps what is
    asked for again."""

    def __init__(self, make):
        super().__init__()
        self.make, self.before = make, {}

    def __missing__(self, key):
        value = self.before.get(key)
        if value is None:
            value = self.make(key)
        self[key] = value
        return value

    def turn(self) -> None:
        self.before = dict(self)
        self.clear()


class Words:
    """The library's tokenizer with a bounded memory of words it has encoded in this process.

    Where the file's normalizers and pre-tokenizer treat words between blanks independently, a
    text is cut at blanks and newlines, and plain words go to the library's model directly (a plain
    text is first cut into the pattern's matches, and these go there); any other word goes through the whole tokenizer. So does, as a whole, any text that holds the
    string of an added token (in any letter case), and any text under another kind of file.
    """

    def __init__(self, path: str):
        self.whole = Tokenizer.from_file(path)
        self.added = [t.content.lower() for t in self.whole.get_added_tokens_decoder().values()]
        self.dtype = np.dtype("<u2" if self.whole.get_vocab_size() <= 1 << 16 else "<u4")
        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        norm = (spec.get("normalizer") or {}).get("normalizers", [])
        pre = (spec.get("pre_tokenizer") or {}).get("pretokenizers", [])
        self.by_word = ([x["type"] for x in norm] == _NORMALIZERS and norm[1]["content"] == " "
                        and norm[1]["pattern"] == {"Regex": r"\s+"}
                        and [x["type"] for x in pre] == _PRE_TOKENIZERS and pre[0]["invert"]
                        and pre[0]["behavior"] == "Removed" and not pre[1]["add_prefix_space"])
        if self.by_word:
            self.find = regex.compile(pre[0]["pattern"]["Regex"]).findall
            self.by_part = pre[0]["pattern"]["Regex"] == _PATTERN
            self.letters = _byte_letters()
        self.tokenize = self.whole.model.tokenize
        self.few = [struct.Struct(f"<{n}{'H' if self.dtype.itemsize == 2 else 'I'}").pack for n in range(16)]
        self.known, self.parts = _Memory(self._word), _Memory(self._part)

    def _encode(self, text: str) -> bytes:
        return np.array(self.whole.encode(text, add_special_tokens=False).ids, self.dtype).tobytes()

    def _part(self, part: str) -> bytes:
        letters = part if part.isascii() else "".join([self.letters[b] for b in part.encode()])
        ids = [t.id for t in self.tokenize(letters)]
        if len(ids) < len(self.few):
            return self.few[len(ids)](*ids)
        return np.array(ids, self.dtype).tobytes()

    def _word(self, word: str) -> bytes:
        if word.isascii() and word.isalpha():
            return self.parts[word.lower()]
        if not _PLAIN(word):
            return self._encode(word)
        low = word.lower()
        if low.isalpha():
            return self.parts[low]
        if low[-1:] in _STOPS and low[:-1].isalpha():
            return self.parts[low[:-1]] + self.parts[low[-1]]
        return b"".join(map(self.parts.__getitem__, self.find(low)))

    def encode(self, texts: list[str]) -> list[bytes]:
        """The ids of each text as little-endian numbers of ``dtype``."""
        if not self.by_word:
            return [self._encode(t) for t in texts]
        for memory, most in ((self.known, KNOWN_WORDS), (self.parts, KNOWN_PARTS)):
            if len(memory) > most:
                memory.turn()
        out, plain, other = [b""] * len(texts), [], []
        for i, t in enumerate(texts):
            if self._holds_added(t):
                out[i] = self._encode(t)
            else:
                (plain if self.by_part and _PLAIN_TEXT(t) else other).append(i)
        for numbers, parts in ((plain, True), (other, False)):
            if numbers:
                chosen = [texts[i] for i in numbers]
                for i, ids in zip(numbers, self._parts_of(chosen) if parts else self._words_of(chosen), strict=True):
                    out[i] = ids
        return out

    def _words_of(self, texts: list[str]) -> list[bytes]:
        return self._looked_up(pc.replace_substring(pa.array(texts, pa.string()), "\n", " "), self.known)

    def _parts_of(self, texts: list[str]) -> list[bytes]:
        """No match of the pattern crosses a blank, so plain texts are cut into its matches at once."""
        column = pa.array([t.lower() for t in texts], pa.string())
        column = pc.replace_substring_regex(column, _PATTERN, r"\0 ")
        return self._looked_up(pc.replace_substring(column, "\n", " "), self.parts)

    @staticmethod
    def _looked_up(column: pa.Array, memory: _Memory) -> list[bytes]:
        """What ``memory`` has for what stands between blanks; looked up once for each distinct value."""
        lists = pc.split_pattern(column, " ")
        distinct = lists.flatten().dictionary_encode()
        ids = pa.array([memory[w] for w in distinct.dictionary.to_numpy(zero_copy_only=False).tolist()], pa.large_binary())
        return Parts(ids.take(distinct.indices)).runs(lists.offsets.to_numpy())

    def _holds_added(self, text: str) -> bool:
        low = text.lower()
        return any(a in low for a in self.added)


_WORDS: dict[str, Words] = {}


def words(path: str) -> Words:
    if path not in _WORDS:
        _WORDS[path] = Words(path)
    return _WORDS[path]


# ---- the Spark jobs --------------------------------------------------------------------

def write_token_files(docs: DataFrame, path: str, *, tokenizer: str, end_id: int,
                      bucket_bytes: int = BUCKET_BYTES, file_ids: int = FILE_IDS,
                      block: int = BLOCK) -> None:
    """Encode every row of ``docs`` (doc_id, text) into files in ascending ``doc_id`` order.

    ``end_id`` ends each document; a null or empty text has that id alone. A null doc_id comes
    first; rows of equal doc_id follow each other, ordered by their ids. Other columns are
    ignored. Quantiles of doc_id
    cut the table into ranges of about ``bucket_bytes`` of text, so the number of tasks grows
    with the data; ids are compressed before the one shuffle.
    """
    total = docs.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    n = 1 + total // bucket_bytes
    cuts = docs.agg(F.percentile_approx("doc_id", [i / n for i in range(1, n)] or [0.5],
                                        max(10_000, 20 * n))).first()[0] or []
    cuts = np.unique(np.array(cuts if n > 1 else [], np.int64))

    def encode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own, squeeze = words(tokenizer), zstandard.ZstdCompressor(level=1).compress
        end = np.array([end_id], own.dtype).tobytes()
        for batch in batches:
            ids = batch.column("doc_id")
            for start, texts in slices(batch.column("text")):
                coded = own.encode(texts)
                part = ids.slice(start, len(texts))
                at = np.searchsorted(cuts, part.fill_null(0).to_numpy(zero_copy_only=False), "right") + 1
                at[part.is_null().to_numpy(zero_copy_only=False)] = 0
                yield pa.RecordBatch.from_pydict({
                    "bucket": pa.array(at, pa.int64()), "doc_id": part.cast(pa.int64()),
                    "ids": pa.array([squeeze(c + end) for c in coded], pa.binary())})

    def files(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        dtype, expand = words(tokenizer).dtype, zstandard.ZstdDecompressor().decompress
        held, size, bucket, part = [], 0, None, 0

        def file() -> pa.RecordBatch:
            every = np.frombuffer(b"".join(x for _, x in held), dtype).astype(np.uint32)
            lengths = [len(x) // dtype.itemsize for _, x in held]
            data = to_file([d for d, _ in held], lengths, every, bucket, part, block)
            return pa.RecordBatch.from_pydict({"file": pa.array([data], pa.binary())})

        for batch in batches:
            for b, d, x in zip(*(batch.column(c).to_pylist() for c in ("bucket", "doc_id", "ids")), strict=True):
                if held and (b != bucket or size >= file_ids):
                    yield file()
                    held, size, part = [], 0, part + 1 if b == bucket else 0
                bucket = b
                held.append((d, expand(x)))
                size += len(held[-1][1]) // dtype.itemsize
        if held:
            yield file()

    coded = docs.select("doc_id", "text").mapInArrow(encode, "bucket long, doc_id long, ids binary")
    ranged = coded.repartition(max(1, len(cuts) + 1), "bucket").sortWithinPartitions("bucket", "doc_id", "ids")
    write_files(ranged.mapInArrow(files, "file binary"), "file", path)


def read_token_files(spark: SparkSession, path: str) -> DataFrame:
    """One row per document of the files: bucket, part, doc_id, at (its first id in the file),
    n_tokens, ids_crc32 (of the ids as little-endian uint32)."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for content in batch.column("content"):
                f = TokenFile(content.as_buffer())
                ids, at = f.ids(0, f.n_ids).astype("<u4"), f.starts
                n = len(f.doc_ids)
                yield pa.RecordBatch.from_pydict({
                    "bucket": pa.array([f.bucket] * n, pa.int64()), "part": pa.array([f.part] * n, pa.int64()),
                    "doc_id": pa.array(f.doc_ids, pa.int64()), "at": pa.array(at[:-1], pa.int64()),
                    "n_tokens": pa.array(np.diff(at), pa.int64()),
                    "ids_crc32": pa.array([zlib.crc32(ids[a:b]) for a, b in zip(at, at[1:], strict=False)], pa.int64())})

    return read_files(spark, path).select("content").mapInArrow(
        run, "bucket long, part long, doc_id long, at long, n_tokens long, ids_crc32 long")


def token_index(spark: SparkSession, path: str) -> DataFrame:
    """doc_id, start (ids of all documents before it), n_tokens, ids_crc32 from the files.

    Only the files' totals, a row each, are summed up in order in one task.
    """
    rows = materialize(read_token_files(spark, path), "token-rows")
    totals = rows.groupBy("bucket", "part").agg(F.sum("n_tokens").alias("n"))
    order = Window.orderBy("bucket", "part").rowsBetween(Window.unboundedPreceding, -1)
    totals = totals.withColumn("before", F.coalesce(F.sum("n").over(order), F.lit(0)))
    return (rows.join(totals, ["bucket", "part"])
            .select("doc_id", (F.col("before") + F.col("at")).alias("start"), "n_tokens", "ids_crc32"))


def op10_token_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = scratch_path(spark, "token-files")
    write_token_files(table(spark, sf_dir, "documents"), path,
                      tokenizer=public_tokenizers.path("word_bpe_49k.json"), end_id=2)
    return token_index(spark, path)


QUERIES = {"op10_token_files": op10_token_files}
ORACLE_SQL = {}
