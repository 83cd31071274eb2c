"""Byte-level BPE: encoding and decoding with recursive DuckDB queries in each partition.

Every worker holds the merge table in a DuckDB of its own process. The distinct pieces of a
batch become token-position rows; a recursive query joins neighbouring tokens with the merge
table and contracts each piece's leftmost pair of minimum rank until none is left. Decoding is
an ordered aggregation of the tokens' bytes. Spark reads, splits and schedules the texts.
"""

from __future__ import annotations

import base64
import ctypes
import gc
import hashlib
import threading
from collections.abc import Iterator
from contextlib import contextmanager, suppress

import duckdb
import numpy as np
import pyarrow as pa
import public_tokenizers
import regex
from pyspark.sql import DataFrame, SparkSession

from cartwheel.llm.common import table

POS_BITS = 23           # a piece may have up to 2^23 - 1 bytes (its positions share a BIGINT)
MAX_PIECE = (1 << POS_BITS) - 1
ROWS_AT_ONCE = 4_000_000  # bound on the rows one recursive query gathers
PIECES_AT_ONCE = 50_000
TEXT_AT_ONCE = 2 << 20  # bytes of texts that are cut together
IDLE_SECONDS = 2.0      # a worker without a task for so long forgets all of it
CACHE_BYTES = 160 << 20  # of the pieces a worker remembers, in each of two generations
ENTRY_BYTES = 350       # about what an entry takes besides its key, ids and bytes
LONG = 512              # pieces of more bytes are coded in segments
STEP, OVERLAP = 256, 64

# Per step: the best pair of a piece is the least (rank, position) packed into one number. The
# right token of that pair takes over its start and becomes the merged one, the left token
# goes, and the token before them learns its new neighbour.
_CONTRACT = f"""
CREATE OR REPLACE TEMP TABLE reached AS
WITH RECURSIVE t(step, w, s, e, id, nid) AS (
  SELECT 0, w, s, e, id, nid FROM begin_rows
  UNION ALL
  SELECT step + 1, t.w, (CASE WHEN s = mid THEN start ELSE s END)::INTEGER, e,
         (CASE WHEN s = mid THEN merged ELSE id END)::INTEGER,
         (CASE WHEN e = start THEN merged ELSE nid END)::INTEGER
  FROM t JOIN (
    SELECT w, (best >> {2 * POS_BITS})::INTEGER AS merged,
           ((best >> {POS_BITS}) & {MAX_PIECE})::INTEGER AS start, (best & {MAX_PIECE})::INTEGER AS mid
    FROM (SELECT w, min((rank << {2 * POS_BITS}) | (s::BIGINT << {POS_BITS}) | e) AS best
          FROM t JOIN merges ON pair = (id::BIGINT << 32) | nid GROUP BY w)) b ON t.w = b.w
  WHERE s <> start AND step < $steps
)
SELECT w, s, e, id, nid FROM t
JOIN (SELECT w AS lw, max(step) AS last FROM t GROUP BY w) ON w = lw AND step = last
"""
_OPEN = """
CREATE OR REPLACE TEMP TABLE open_words AS
SELECT DISTINCT w FROM reached JOIN merges ON pair = (id::BIGINT << 32) | nid
"""
# The contracted tokens in order: each id's decimals and the bytes it decodes to.
_ENDED = """
SELECT w, decimals, bytes FROM {reached} JOIN tokens USING (id) ORDER BY w, s
"""
_REST = "(SELECT * FROM reached ANTI JOIN open_words USING (w))"
# Ends of a chunk that the pattern always matches on their own after a letter.
_STOPS = frozenset(".,;:!?")


class Parts:
    """The values of a text or binary column as one string of bytes."""

    def __init__(self, column: pa.Array | pa.ChunkedArray):
        joined = column.cast(pa.large_binary())
        if isinstance(joined, pa.ChunkedArray):
            joined = pa.concat_arrays(joined.chunks)
        offsets = np.frombuffer(joined.buffers()[1], np.int64)[joined.offset:joined.offset + len(joined) + 1]
        self.offsets = offsets - offsets[0]
        data = joined.buffers()[2]  # None where nothing has a byte
        self.data = bytes(data[int(offsets[0]):int(offsets[-1])]) if data else b""

    def runs(self, at: np.ndarray, spare: int = 0) -> list[bytes]:
        """The values from each place of ``at`` to the next, without the last ``spare`` bytes."""
        ends = self.offsets[at]
        return [self.data[a:b] for a, b in zip(ends[:-1].tolist(), (ends[1:] - spare).tolist(), strict=True)]


class Codec:
    """Encoder and decoder of one rank file, in this process."""

    def __init__(self, path: str, pattern: str, cache_bytes: int = CACHE_BYTES):
        self.cache_bytes = cache_bytes
        with open(path, "rb") as f:
            self.ranks = {base64.b64decode(a): int(b) for a, b in (x.split() for x in f if x.strip())}
        self.find = regex.compile(pattern).findall
        self.byte_ids = np.array([self.ranks[bytes([i])] for i in range(256)], np.int32)
        splits = [(a << 32 | b, c) for token, c in self.ranks.items() for i in range(1, len(token))
                  if (a := self.ranks.get(token[:i])) is not None
                  and (b := self.ranks.get(token[i:])) is not None]
        self.db = duckdb.connect(config={"threads": 1, "memory_limit": "600MB"})
        merges = pa.table({"pair": [x for x, _ in splits], "rank": [x for _, x in splits]})
        tokens = pa.table({"id": pa.array(self.ranks.values(), pa.int32()),
                           "decimals": [f"{i}," for i in self.ranks.values()],
                           "bytes": pa.array(self.ranks, pa.binary()), "hex": [t.hex() for t in self.ranks]})
        self.db.register("m", merges).execute("CREATE TABLE merges AS SELECT * FROM m")
        self.db.register("v", tokens).execute("CREATE TABLE tokens AS SELECT * FROM v")
        self.chunks, self.heads = _Remembered(cache_bytes), _Remembered(cache_bytes)

    def _begin(self, pieces: list[bytes]) -> pa.Table:
        """Token-position rows: one per byte, or one where the whole piece is a token."""
        if max(map(len, pieces)) > MAX_PIECE:
            raise ValueError(f"a piece between white space has more than {MAX_PIECE} bytes")
        whole = np.array([self.ranks.get(p, -1) for p in pieces], np.int32)
        size = np.array([len(p) for p in pieces], np.int32)
        rows = np.where(whole >= 0, 1, size)
        first = np.cumsum(rows) - rows
        w = np.repeat(np.arange(len(pieces), dtype=np.int32), rows)
        s = (np.arange(len(w)) - np.repeat(first, rows)).astype(np.int32)
        ids = np.empty(len(w), np.int32)
        split = whole < 0
        ids[np.repeat(split, rows)] = self.byte_ids[np.frombuffer(
            b"".join(p for p, x in zip(pieces, split, strict=True) if x), np.uint8)]
        ids[first[~split]] = whole[~split]
        nid = np.append(ids[1:], -1).astype(np.int32)
        nid[first + rows - 1] = -1
        return pa.table({"w": w, "s": s, "e": s + 1, "id": ids, "nid": nid})

    def _coded(self, pieces: list[bytes]) -> Iterator[tuple[np.ndarray, Parts, Parts]]:
        """Runs the contraction; of the tokens of some pieces, in order: the piece's number, its id as
        ``decimals,`` and its bytes."""
        rows = self._begin(pieces)
        while rows.num_rows:
            longest = int(np.max(rows["s"].to_numpy())) + 1
            steps = max(1, min(longest, ROWS_AT_ONCE // rows.num_rows))
            self.db.register("begin_rows", rows).execute(_CONTRACT, {"steps": steps})
            more = False
            if steps < longest:  # a piece loses a token with each step, so all others have ended
                self.db.execute(_OPEN)  # a long piece goes on from where it got to
                more = self.db.execute("SELECT count(*) FROM open_words").fetchall()[0][0] > 0
            ended = self.db.sql(_ENDED.format(reached=_REST if more else "reached")).to_arrow_table()
            if ended.num_rows:
                yield ended["w"].to_numpy(), Parts(ended["decimals"]), Parts(ended["bytes"])
            if not more:
                return
            rows = self.db.sql("SELECT w, s, e, id, nid FROM reached SEMI JOIN open_words USING (w)").to_arrow_table()

    def _contracted(self, pieces: list[bytes]) -> Iterator[tuple[list[int], np.ndarray, Parts, Parts]]:
        """Numbers of pieces, where their tokens start (and the last ones' end), and all of these tokens."""
        for i in range(0, len(pieces), PIECES_AT_ONCE):
            for w, decimals, data in self._coded(pieces[i:i + PIECES_AT_ONCE]):
                first = np.flatnonzero(np.diff(w, prepend=-1))
                yield (w[first] + i).tolist(), np.append(first, len(w)), decimals, data

    def _tokens(self, pieces: list[bytes]) -> list[list[str]]:
        """[id, hex, id, hex, ...] of each piece, contracted as a whole."""
        out = [[]] * len(pieces)
        for numbers, at, decimals, data in self._contracted(pieces):
            every = np.arange(at[-1] + 1)
            both = [x for i, b in zip(decimals.runs(every, 1), data.runs(every), strict=True) for x in (i.decode(), b.hex())]
            for w, a, b in zip(numbers, at[:-1].tolist(), at[1:].tolist(), strict=True):
                out[w] = both[2 * a:2 * b]
        return out

    def encode_pieces(self, pieces: list[bytes]) -> list[tuple[int, bytes, bytes]]:
        """(number of ids, ids as decimals joined by commas, decoded bytes) of non-empty pieces."""
        short = [p for p in pieces if len(p) <= LONG]
        found = [None] * len(short)
        for numbers, at, decimals, data in self._contracted(short):
            entries = zip(np.diff(at).tolist(), decimals.runs(at, 1), data.runs(at), strict=True)
            if len(numbers) == len(short):
                found = list(entries)
            else:
                for w, entry in zip(numbers, entries, strict=True):
                    found[w] = entry
        if len(short) == len(pieces):
            return found
        long = iter([(len(t) // 2, ",".join(t[::2]).encode(), bytes.fromhex("".join(t[1::2])))
                     for t in self._in_segments([p for p in pieces if len(p) > LONG])])
        rest = iter(found)
        return [next(rest if len(p) <= LONG else long) for p in pieces]

    def _in_segments(self, pieces: list[bytes]) -> list[list[str]]:
        """The same for long pieces, without a step for each of their merges.

        A sequence of tokens is what a text contracts to if each two neighbours are what the two
        contract to alone. So overlapping segments are contracted side by side, and two of them
        are joined at a place inside their overlap where both have a token's end and the tokens
        there pass that test; a piece without such a place is contracted as a whole.
        """
        out = []
        for piece in pieces:
            starts = range(0, max(1, len(piece) - OVERLAP), STEP)
            segments = self._tokens([piece[a:a + STEP + OVERLAP] for a in starts])
            ends = [a + np.cumsum([len(h) // 2 for h in t[1::2]]) for a, t in zip(starts, segments, strict=True)]
            seams = [[(int(np.searchsorted(ends[k - 1], p)), j + 1) for j, p in enumerate(ends[k].tolist()[:-1])
                      if p < a + OVERLAP and p in ends[k - 1][:-1]] for k, a in enumerate(starts) if k]
            pairs = {(segments[k][2 * i + 1], segments[k + 1][2 * j + 1]): (segments[k][2 * i], segments[k + 1][2 * j])
                     for k, seam in enumerate(seams) for i, j in seam}
            both = self._tokens([bytes.fromhex(a + b) for a, b in pairs]) if pairs else []
            fits = {p for (p, ids), t in zip(pairs.items(), both, strict=True) if t[::2] == list(ids)}
            tokens, first = [], 0
            for k, t in enumerate(segments):
                seam = seams[k] if k < len(seams) else []
                cut = next(((i, j) for i, j in seam if (t[2 * i + 1], segments[k + 1][2 * j + 1]) in fits and i >= first), None)
                if cut is None and k < len(seams):
                    tokens = self._tokens([piece])[0]
                    break
                tokens += t[2 * first:2 * cut[0] + 2] if cut else t[2 * first:]
                first = cut[1] if cut else 0
            out.append(tokens)
        return out

    def decode(self, ids: list[list[int]]) -> list[bytes]:
        """Bytes of each id list (an empty list gives no bytes)."""
        size = np.array([len(x) for x in ids], np.int64)
        flat = np.fromiter((i for x in ids for i in x), np.int32, int(size.sum()))
        rows = pa.table({"w": np.repeat(np.arange(len(ids)), size),
                         "s": np.arange(len(flat)), "id": flat})
        found = dict(self.db.register("coded", rows).execute(
            "SELECT w, string_agg(hex, '' ORDER BY s) FROM coded JOIN tokens USING (id) GROUP BY w").fetchall())
        return [bytes.fromhex(found.get(i, "")) for i in range(len(ids))]

    def _learn(self, pieces: set[str]) -> dict[str, tuple]:
        new = sorted(pieces, key=len)  # like lengths end at the same step
        return dict(zip(new, self.encode_pieces([p.encode() for p in new]), strict=True)) if new else {}

    def _match(self, chunk: str, lead: str) -> list[str]:
        """The pattern's matches of ``lead + chunk``; a word and a stop after it need no regex."""
        if chunk[-1:] in _STOPS and chunk[:-1].isalpha():
            return [lead + chunk[:-1], chunk[-1]]
        return self.find(lead + chunk)

    def _known(self, piece: str) -> tuple | None:
        """What is remembered of a piece: of a blank and a word, that of the word as a chunk."""
        if piece[:1] != " ":
            return self.heads.get(piece)
        return self.chunks.get(piece[1:]) if piece[1:] and not piece.isspace() else None

    def _add(self, cache: _Remembered, chunks: set[str], lead: str) -> None:
        """Learn chunks; None for one that ends with white space (see documents)."""
        new = cache.missing(chunks)
        words, cut = [], []
        for c in new:
            if c.isalpha():
                words.append(c)
            else:
                cut.append((c, self._match(c, "" if c[:1] == "\n" else lead)))
        pieces = {p: self._known(p) for p in set().union(*[m for _, m in cut])}
        pieces |= self._learn({lead + c for c in words}.union([p for p, known in pieces.items() if known is None]))
        cache.add_all(words, [pieces[lead + c] for c in words])
        cache.add_all([c for c, _ in cut], [
            None if not m or (c or lead)[-1:].isspace() else pieces[m[0]] if len(m) == 1 else
            self._two(pieces[m[0]], pieces[m[1]]) if len(m) == 2 else self._join([pieces[p] for p in m]) for c, m in cut])

    @staticmethod
    def _two(a: tuple, b: tuple) -> tuple:
        return a[0] + b[0], b"%b,%b" % (a[1], b[1]), a[2] + b[2]

    @staticmethod
    def _join(found: list[tuple]) -> tuple:
        n, ids, back = zip(*found)
        return sum(n), b",".join(ids), b"".join(back)

    def documents(self, texts: list[str]) -> list[tuple]:
        """See _documents. Of its many new entries none is in a cycle, so nobody looks for cycles meanwhile."""
        was = gc.isenabled()
        gc.disable()
        try:
            return self._documents(texts)
        finally:
            if was:
                gc.enable()

    def _documents(self, texts: list[str]) -> list[tuple]:
        """(number of ids, ids as decimals joined by commas, decoded bytes) of each text.

        No match of the pattern crosses from a non-space to a space, so a text is cut before
        each blank and newline and equal chunks are looked up once. A chunk that ends with
        white space breaks that rule; such a text is matched as a whole.
        """
        cut = [t.replace("\n", " \n").split(" ") for t in texts]
        first = [c.pop(0) for c in cut]
        self._add(self.heads, set(first), "")
        self._add(self.chunks, set().union(*cut), " ")
        heads, chunks = self.heads.now, self.chunks.now
        out, whole = [(0, b"", b"")] * len(texts), []
        for i, (head, c) in enumerate(zip(first, cut, strict=True)):
            found = [heads[head]] if head else []
            found += map(chunks.__getitem__, c)
            if found:
                try:
                    out[i] = self._join(found)
                except TypeError:  # None among them
                    whole.append(i)
        matched = [self.find(texts[i]) for i in whole]
        pieces = self._learn(set().union(*matched))
        for i, m in zip(whole, matched, strict=True):
            out[i] = self._join([pieces[p] for p in m])
        self.heads.turn()
        self.chunks.turn()
        return out


class _Remembered:
    """Entries by key in two generations: when the younger one is full, the older one is forgotten,
    so that what is in use stays. An entry asked for by ``missing`` is in ``now``."""

    def __init__(self, max_bytes: int):
        self.max_bytes, self.size = max_bytes, 0
        self.now: dict[str, tuple | None] = {}
        self.before: dict[str, tuple | None] = {}

    def add_all(self, keys: list[str], entries: list[tuple | None]) -> None:
        self.now.update(zip(keys, entries, strict=True))
        self.size += ENTRY_BYTES * len(keys) + sum(map(len, keys)) + sum([len(e[1]) + len(e[2]) for e in entries if e])

    def get(self, key: str) -> tuple | None:
        return self.now.get(key) or self.before.get(key)

    def missing(self, keys: set[str]) -> list[str]:
        """The keys that neither generation has; the older one's entries become young again."""
        rest = keys.difference(self.now)  # (the difference to a view walks over all of its keys)
        new = rest.difference(self.before)
        old = list(rest - new)
        self.add_all(old, [self.before[k] for k in old])
        return list(new)

    def turn(self) -> None:
        if self.size > self.max_bytes:
            self.now, self.before, self.size = {}, self.now, 0


class _Held:
    """This process's codec: a worker that runs many tasks builds one and remembers its pieces. A
    worker that other stages go on using gives the memory back once it has had no task for a while."""

    def __init__(self):
        self.lock, self.codec, self.key, self.users, self.timer = threading.Lock(), None, None, 0, None

    @contextmanager
    def use(self, *key) -> Iterator[Codec]:
        with self.lock:
            self.users += 1
            if self.timer:
                self.timer.cancel()
            if self.key != key:
                self.codec, self.key = Codec(*key), key
            own = self.codec
        try:
            yield own
        finally:
            with self.lock:
                self.users -= 1
                self.timer = threading.Timer(IDLE_SECONDS, self.drop)
                self.timer.daemon = True
                self.timer.start()

    def drop(self) -> None:
        with self.lock:
            if self.users or self.codec is None:
                return
            self.codec.db.close()
            self.codec = self.key = None
        gc.collect()
        pa.default_memory_pool().release_unused()
        with suppress(OSError, AttributeError):  # where the C library has it
            ctypes.CDLL(None).malloc_trim(0)


_HELD = _Held()


def codec(path: str, pattern: str, cache_bytes: int):
    """A context with this process's codec."""
    return _HELD.use(path, pattern, cache_bytes)


def slices(texts: pa.Array, max_bytes: int = 8 << 20) -> Iterator[tuple[int, list[str]]]:
    """(offset, texts) parts of a column, each of about max_bytes or one text; null is empty."""
    start, size, part = 0, 0, []
    for i, t in enumerate(texts):
        part.append(t.as_py() or "")
        size += len(part[-1])
        if size >= max_bytes:
            yield start, part
            start, size, part = i + 1, 0, []
    if part:
        yield start, part


def encode_documents(docs: DataFrame, *, path: str, pattern: str = public_tokenizers.PATTERN,
                     keep_ids: bool = False, cache_bytes: int = CACHE_BYTES) -> DataFrame:
    """doc_id, n_tokens, ids_sha256, decoded_sha256 of every row, in one pass without shuffle.

    ``ids_sha256``: of the decimal ids joined by commas; ``decoded_sha256``: of the bytes the
    ids decode to. With ``keep_ids`` also ``ids`` (array<int>) and ``decoded`` (binary). A
    null text is an empty one: no ids. Repeated rows give a row each, other columns are
    ignored. ``path`` must be readable on every worker. ``cache_bytes`` trades a worker's memory
    for CPU: rare pieces beyond are encoded again.
    """
    schema = "doc_id {}, n_tokens long, ids_sha256 string, decoded_sha256 string".format(
        docs.schema["doc_id"].dataType.simpleString())
    if keep_ids:
        schema += ", ids array<int>, decoded binary"

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        with codec(path, pattern, cache_bytes) as own:
            for batch in batches:
                yield from coded(own, batch)

    def coded(own: Codec, batch: pa.RecordBatch) -> Iterator[pa.RecordBatch]:
        for start, texts in slices(batch.column("text"), TEXT_AT_ONCE):
            rows = own.documents(texts)
            out = {"doc_id": batch.column("doc_id").slice(start, len(rows)),
                   "n_tokens": pa.array([r[0] for r in rows], pa.int64()),
                   "ids_sha256": pa.array([hashlib.sha256(r[1]).hexdigest() for r in rows]),
                   "decoded_sha256": pa.array([hashlib.sha256(r[2]).hexdigest() for r in rows])}
            if keep_ids:
                ids = [[int(x) for x in r[1].split(b",") if x] for r in rows]
                out |= {"ids": pa.array(ids, pa.list_(pa.int32())),
                        "decoded": pa.array([r[2] for r in rows], pa.binary())}
            yield pa.RecordBatch.from_pydict(out)

    return docs.select("doc_id", "text").mapInArrow(run, schema)


def op9_byte_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    return encode_documents(table(spark, sf_dir, "documents"),
                            path=public_tokenizers.path("byte_bpe_multi_50k.tiktoken"))


QUERIES = {"op9_byte_bpe": op9_byte_bpe}
ORACLE_SQL = {}
