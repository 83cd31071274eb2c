"""N-gram Jaccard join: a blocked sparse product of the document by n-gram incidence.

Rows of the matrix are documents, columns are hashed 5-word shingles; two documents link when
their sets' Jaccard similarity reaches a threshold. The product is never formed for columns or
rows that cannot matter:

1. *Rows.* Documents of equal sets are one row. A linked document shares most of its least
   hashes with another one, so a first product over a prefix of each row, in column blocks,
   counts how many of them occur elsewhere; rows below the bound go.
2. *Columns.* Of the remaining rows, column blocks count each column; a row's prefix in order
   of rarity is all that has to be multiplied, as overlap outside it cannot reach the bound.
3. *Products.* Overlaps are accumulated for pairs that pass the size and position bounds:
   first each row with one pivot per column and size band, then, between different components
   only, the rest. A group of near copies is thus joined without forming its pairs.

Hashes have 64 bits and are only compared within a document or a pair of them; the block
products use 32 bits of them and may only let through more candidates.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import xxhash
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from cartwheel.llm.byte_bpe import slices
from cartwheel.llm.common import materialize, table
from cartwheel.llm.components import components

WORDS = 5                # of a shingle
PERCENT = 75             # least similarity
EXTRA = 0.1              # share of a row by which the first product's prefix is longer
BLOCK_BYTES = 16 << 20   # text per column block of the first product, about
FLUSH = 1_000_000        # incidences a task gathers before it sends its blocks

_MIX = [np.uint64(x) for x in (0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F, 0xD6E8FEB86659FD93)]


def shingles(text: str | None, words: int = WORDS) -> np.ndarray:
    """Sorted distinct hashes of a text's word n-grams (A-Z lower-cased; fewer words: one)."""
    found = (text or "").encode().lower().split()  # bytes: ASCII case and white space only
    if not found:
        return np.zeros(0, np.uint64)
    h = np.fromiter(map(xxhash.xxh3_64_intdigest, found), np.uint64, len(found))
    k = min(words, len(h))
    s = np.full(len(h) - k + 1, k, np.uint64)
    for i in range(k):
        s = (s ^ h[i:i + len(s)]) * _MIX[0]
        s ^= s >> np.uint64(32)
    s *= _MIX[1]
    return np.unique(s ^ (s >> np.uint64(29)))


def _least_overlap(n, percent: int):
    """Least overlap of a set of n with any set it links to."""
    return -(-n * percent // 100)


class _Blocks:
    """Incidences (hash, row) of a task, sent as one packed row per column block."""

    def __init__(self, n_blocks: int):
        self.n_blocks, self.flushes = n_blocks, 0
        self.clear()

    def clear(self) -> None:
        self.hashes, self.rows, self.size, self.docs = [], [], 0, []
        self.index: dict[bytes, int] = {}

    def add(self, doc_id: int, own: np.ndarray, prefix: np.ndarray, need: int) -> None:
        key = xxhash.xxh3_128_digest(own.tobytes())
        row = self.index.get(key)
        if row is None and len(own):  # equal sets of a task are one row
            row = self.index[key] = len(self.index)
            self.hashes.append(prefix)
            self.rows.append(np.full(len(prefix), row, np.uint32))
            self.size += len(prefix)
        self.docs.append((doc_id, len(own), key, -1 if row is None else row, need))

    def send(self) -> Iterator[pa.RecordBatch]:
        """(block, flush, hashes, rows, docs): a block's incidences, or the flush's documents."""
        if not self.docs:
            return
        flush = TaskContext.get().partitionId() << 32 | self.flushes
        self.flushes += 1
        h = np.concatenate(self.hashes) if self.hashes else np.zeros(0, np.uint64)
        r = np.concatenate(self.rows) if self.rows else np.zeros(0, np.uint32)
        order = np.argsort(h, kind="stable")
        h, r = h[order], r[order]
        first = np.r_[True, h[1:] != h[:-1]] if len(h) else np.zeros(0, bool)
        alone = first & np.r_[first[1:], True] if len(h) else first
        # A hash of two rows is known to repeat: it is counted here, and sent once for others.
        local = np.bincount(r[~alone], minlength=len(self.index)).astype("<u4")
        r = np.where(alone, r + 1, 0)[first].astype("<u4")
        h = h[first]
        block = ((h >> np.uint64(32)) * np.uint64(self.n_blocks)) >> np.uint64(32)
        cuts = np.searchsorted(block, np.arange(self.n_blocks + 1, dtype=np.uint64))
        low = (h & np.uint64(0xFFFFFFFF)).astype("<u4")
        docs = [np.array([d[0] for d in self.docs], "<i8"), np.array([d[1] for d in self.docs], "<u4"),
                np.array([d[3] for d in self.docs], "<i4"), np.array([d[4] for d in self.docs], "<u4"), local]
        full = np.flatnonzero(np.diff(cuts))
        n = len(full) + 1
        yield pa.RecordBatch.from_pydict({
            "block": pa.array([*full.tolist(), self.n_blocks + flush % self.n_blocks], pa.int32()),
            "flush": pa.array([flush] * n, pa.int64()),
            "hashes": pa.array([*(low[cuts[b]:cuts[b + 1]].tobytes() for b in full), None], pa.binary()),
            "rows": pa.array([*(r[cuts[b]:cuts[b + 1]].tobytes() for b in full), None], pa.binary()),
            "docs": pa.array([None] * len(full) + [[x.tobytes() for x in docs] + [b"".join(d[2] for d in self.docs)]],
                             pa.list_(pa.binary()))})
        self.clear()


def _repeated(key: tuple[pa.Scalar, ...], part: pa.Table) -> pa.Table:
    """A column block: the rows, per flush, of the hashes that occur more than once in it."""
    own = part.filter(pc.is_valid(part["hashes"]))
    out = {"flush": part["flush"].filter(pc.is_valid(part["docs"])).to_pylist(), "rows": [],
           "docs": [d for d in part["docs"].to_pylist() if d is not None]}
    out["rows"] = [None] * len(out["flush"])
    if own.num_rows:
        h = [np.frombuffer(x.as_buffer(), "<u4") for x in own["hashes"]]
        r = np.concatenate([np.frombuffer(x.as_buffer(), "<u4") for x in own["rows"]])
        of = np.repeat(np.arange(len(h)), [len(x) for x in h])
        h = np.concatenate(h)
        order = np.argsort(h, kind="stable")
        same = h[order][1:] == h[order][:-1]
        again = np.zeros(len(h), bool)
        again[order] = np.r_[False, same] | np.r_[same, False]
        again &= r > 0
        for i, flush in enumerate(own["flush"].to_pylist()):
            if len(rows := r[again & (of == i)]):
                out["flush"].append(flush)
                out["rows"].append((rows - 1).astype("<u4").tobytes())
                out["docs"].append(None)
    return pa.table({"flush": pa.array(out["flush"], pa.int64()), "rows": pa.array(out["rows"], pa.binary()),
                     "docs": pa.array(out["docs"], pa.list_(pa.binary()))})


def _judged(key: tuple[pa.Scalar, ...], part: pa.Table) -> pa.Table:
    """A flush's documents: set size, set key, and whether the row may have a partner."""
    doc_ids, sizes, rows, need, counts, keys = next(d for d in part["docs"].to_pylist() if d is not None)
    counts = np.frombuffer(counts, "<u4").astype(np.int64)
    for x in part["rows"].to_pylist():
        if x is not None:
            counts = counts + np.bincount(np.frombuffer(x, "<u4"), minlength=len(counts))
    rows, need = np.frombuffer(rows, "<i4"), np.frombuffer(need, "<u4")
    key = np.frombuffer(keys, "<i8").reshape(-1, 2)
    maybe = np.zeros(len(rows), bool)
    has = rows >= 0
    maybe[has] = counts[rows[has]] >= need[has]
    return pa.table({"doc_id": pa.array(np.frombuffer(doc_ids, "<i8")),
                     "n": pa.array(np.frombuffer(sizes, "<u4").astype(np.int64)),
                     "k1": pa.array(key[:, 0]), "k2": pa.array(key[:, 1]), "maybe": pa.array(maybe)})


def candidate_rows(docs: DataFrame, *, words: int = WORDS, percent: int = PERCENT,
                   extra: float = EXTRA, block_bytes: int = BLOCK_BYTES) -> DataFrame:
    """doc_id, n, k1, k2 (key of the set), maybe (false: it links to no different set).

    With overlap at least c = least(n) the least ``l`` common hashes of a pair lie in its
    prefixes of ``n - c + l``; sizes of a pair differ by the threshold at most, so a row needs
    ``least(l)`` prefix hashes that occur elsewhere.
    """
    text_bytes = docs.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    n_blocks = 1 + text_bytes // block_bytes

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        blocks = _Blocks(n_blocks)
        for batch in batches:
            ids = batch.column("doc_id")
            for start, texts in slices(batch.column("text")):
                for doc_id, text in zip(ids.slice(start, len(texts)).to_pylist(), texts, strict=True):
                    own = shingles(text, words)
                    n = len(own)
                    more = max(1, int(n * extra))
                    prefix = own[:n - _least_overlap(n, percent) + more]
                    blocks.add(doc_id, own, prefix, max(1, more * percent // 100 - 1))
                    if blocks.size >= FLUSH:
                        yield from blocks.send()
        yield from blocks.send()

    sent = docs.where("doc_id IS NOT NULL").select("doc_id", "text").mapInArrow(
        run, "block int, flush long, hashes binary, rows binary, docs array<binary>")
    found = sent.groupBy("block").applyInArrow(_repeated, "flush long, rows binary, docs array<binary>")
    return found.groupBy("flush").applyInArrow(
        _judged, "doc_id long, n long, k1 long, k2 long, maybe boolean")


def _packed_sets(texts: DataFrame, words: int) -> DataFrame:
    """Sets of the remaining rows, packed: flush, docs (int64), sizes (uint32), hashes (uint64)."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, size, flushes = [], 0, 0

        def pack() -> pa.RecordBatch:
            return pa.RecordBatch.from_pydict({
                "flush": pa.array([TaskContext.get().partitionId() << 32 | flushes], pa.int64()),
                "docs": [np.array([d for d, _ in held], "<i8").tobytes()],
                "sizes": [np.array([len(s) for _, s in held], "<u4").tobytes()],
                "hashes": [np.concatenate([s for _, s in held]).tobytes()]})

        for batch in batches:
            ids = batch.column("doc_id")
            for start, part in slices(batch.column("text")):
                for doc_id, text in zip(ids.slice(start, len(part)).to_pylist(), part, strict=True):
                    held.append((doc_id, shingles(text, words)))
                    size += len(held[-1][1])
                    if size >= FLUSH:
                        yield pack()
                        held, size, flushes = [], 0, flushes + 1
        if size:
            yield pack()

    return texts.select("doc_id", "text").mapInArrow(run, "flush long, docs binary, sizes binary, hashes binary")


def _columns(sets: DataFrame, n_blocks: int) -> DataFrame:
    """flush, hashes, counts: those of a flush's columns that more than one row has."""
    def local(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for flush, data in zip(batch.column("flush").to_pylist(), batch.column("hashes"), strict=True):
                h, n = np.unique(np.frombuffer(data.as_buffer(), "<u8"), return_counts=True)
                block = ((h >> np.uint64(32)) * np.uint64(n_blocks)) >> np.uint64(32)
                cuts = np.searchsorted(block, np.arange(n_blocks + 1, dtype=np.uint64))
                full = np.flatnonzero(np.diff(cuts))
                yield pa.RecordBatch.from_pydict({
                    "block": pa.array(full, pa.int32()), "flush": pa.array([flush] * len(full), pa.int64()),
                    "hashes": pa.array([h[cuts[b]:cuts[b + 1]].tobytes() for b in full], pa.binary()),
                    "counts": pa.array([n[cuts[b]:cuts[b + 1]].astype("<u4").tobytes() for b in full], pa.binary())})

    def total(key: tuple[pa.Scalar, ...], part: pa.Table) -> pa.Table:
        h = [np.frombuffer(x.as_buffer(), "<u8") for x in part["hashes"]]
        n = np.concatenate([np.frombuffer(x.as_buffer(), "<u4") for x in part["counts"]])
        every, of = np.unique(np.concatenate(h), return_inverse=True)
        n = np.bincount(of, weights=n).astype("<u4")[of]
        cuts = np.cumsum([0, *map(len, h)])
        many = [n[a:b] > 1 for a, b in zip(cuts, cuts[1:], strict=False)]
        return pa.table({"flush": part["flush"],
                         "hashes": pa.array([x[m].tobytes() for x, m in zip(h, many, strict=True)], pa.binary()),
                         "counts": pa.array([n[a:b][m].tobytes() for a, b, m in
                                             zip(cuts, cuts[1:], many, strict=False)], pa.binary())})

    blocks = sets.select("flush", "hashes").mapInArrow(local, "block int, flush long, hashes binary, counts binary")
    return blocks.groupBy("block").applyInArrow(total, "flush long, hashes binary, counts binary")


def _prefixes(sets: DataFrame, columns: DataFrame, percent: int) -> DataFrame:
    """h, doc, n, rank: each row's repeated columns among its first n - least(n) + 1 by rarity."""
    def run(key: tuple[pa.Scalar, ...], own: pa.Table, found: pa.Table) -> pa.Table:
        empty = pa.table({"h": pa.array([], pa.int64()), "doc": pa.array([], pa.int64()),
                          "n": pa.array([], pa.int64()), "rank": pa.array([], pa.int64())})
        if not own.num_rows or not found.num_rows:
            return empty
        docs = np.frombuffer(own["docs"][0].as_buffer(), "<i8")
        sizes = np.frombuffer(own["sizes"][0].as_buffer(), "<u4").astype(np.int64)
        h = np.frombuffer(own["hashes"][0].as_buffer(), "<u8")
        known = np.concatenate([np.frombuffer(x.as_buffer(), "<u8") for x in found["hashes"]])
        count = np.concatenate([np.frombuffer(x.as_buffer(), "<u4") for x in found["counts"]])
        order = np.argsort(known)
        known, count = np.append(known[order], np.uint64(0)), np.append(count[order], 1)
        at = np.searchsorted(known[:-1], h)
        n = np.where(known[at] == h, count[at], 1)
        row = np.repeat(np.arange(len(docs)), sizes)
        order = np.lexsort((h, n, row))
        rank = np.arange(len(h)) - np.repeat(np.cumsum(sizes) - sizes, sizes)
        prefix = np.repeat(sizes - _least_overlap(sizes, percent) + 1, sizes)
        use = (rank < prefix) & (n[order] > 1)
        row = row[order][use]
        return pa.table({"h": h[order][use].view(np.int64), "doc": docs[row], "n": sizes[row], "rank": rank[use]})

    return sets.groupBy("flush").cogroup(columns.groupBy("flush")).applyInArrow(
        run, "h long, doc long, n long, rank long")


def _verified(pairs: DataFrame, sets: DataFrame, percent: int) -> DataFrame:
    """The (a, b) pairs whose accumulated overlap reaches the threshold."""
    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for docs, sizes, hashes in zip(*(batch.column(c) for c in ("docs", "sizes", "hashes")), strict=True):
                docs, sizes = (np.frombuffer(x.as_buffer(), k) for x, k in ((docs, "<i8"), (sizes, "<u4")))
                ends, data = np.cumsum(sizes.astype(np.int64)) * 8, hashes.as_py()
                yield pa.RecordBatch.from_pydict({"doc": docs, "own": pa.array(
                    [data[e - 8 * int(s):e] for e, s in zip(ends, sizes, strict=True)], pa.binary())})

    def overlap(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            keep = []
            for x, y in zip(batch.column("own_a"), batch.column("own_b"), strict=True):
                x, y = np.frombuffer(x.as_buffer(), "<u8"), np.frombuffer(y.as_buffer(), "<u8")
                both = np.sort(np.concatenate((x, y)))
                common = int(np.count_nonzero(both[1:] == both[:-1]))
                keep.append(100 * common >= percent * (len(both) - common))
            yield batch.select(["a", "b"]).filter(pa.array(keep, pa.bool_()))

    single = sets.select("docs", "sizes", "hashes").mapInArrow(rows, "doc long, own binary")
    left = pairs.join(single.select(F.col("doc").alias("a"), F.col("own").alias("own_a")), "a")
    full = left.join(single.select(F.col("doc").alias("b"), F.col("own").alias("own_b")), "b")
    return full.select("a", "b", "own_a", "own_b").mapInArrow(overlap, "a long, b long")


def _may_link(a: str, b: str, percent: int):
    """Size and position bounds of a common column: enough can follow it in both rows."""
    after = F.least(F.col(f"n_{a}") - F.col(f"rank_{a}"), F.col(f"n_{b}") - F.col(f"rank_{b}"))
    return (100 + percent) * after >= percent * (F.col(f"n_{a}") + F.col(f"n_{b}"))


def _as(postings: DataFrame, side: str, *keys: str) -> DataFrame:
    return postings.select(*keys, *(F.col(c).alias(f"{c}_{side}") for c in ("doc", "n", "rank")))


def row_links(sets: DataFrame, n_blocks: int, *, percent: int = PERCENT) -> DataFrame:
    """(a, b) links that connect every component of the rows in ``sets``."""
    postings = materialize(_prefixes(sets, _columns(sets, n_blocks), percent).withColumn(
        "band", F.floor(F.log("n") / math.log(100 / percent))), "postings")
    # Rows with the first and the last row of the same column and size band.
    side = F.struct("doc", "n", "rank")
    ends = postings.groupBy("h", "band").agg(F.min(side).alias("low"), F.max(side).alias("high"))
    ends = ends.where("low.doc <> high.doc")
    pivots = ends.select("h", "band", F.inline(F.array("low", "high"))).toDF("h", "band", "doc_p", "n_p", "rank_p")
    near = _as(postings, "d", "h", "band").join(pivots, ["h", "band"]).where("doc_d <> doc_p")
    pairs = near.where(_may_link("d", "p", percent)).select(
        F.greatest("doc_d", "doc_p").alias("a"), F.least("doc_d", "doc_p").alias("b")).distinct()
    tried = materialize(pairs, "pairs")
    links = materialize(_verified(tried, sets, percent), "links")
    # What may still connect two components: pairs of components that share a column. With
    # ``most`` the size up to which a partner may reach the threshold from that column on, a
    # pair of sizes n <= m needs m <= most of the one and n <= most of the other: its smaller
    # row has few columns rarer than the shared one, which common passages seldom are.
    groups = components(links)
    named = materialize(postings.join(groups, postings["doc"] == groups["node"], "left").select(
        "h", "doc", "n", F.coalesce("component", "doc").alias("c"),
        (F.floor((100 + percent) * (F.col("n") - F.col("rank")) / percent) - F.col("n")).alias("most")), "postings")
    bounds = [F.min("n").alias("low"), F.max("n").alias("high"), F.max("most").alias("most"), F.count("*").alias("rows")]
    held = named.groupBy("h", "c").agg(*bounds)
    mixed = held.groupBy("h").agg(F.min("c").alias("x"), F.max("c").alias("y")).where("x <> y").select("h")
    named = named.join(mixed, "h")
    small = named.where("most >= n")
    x, y = small.groupBy("h", "c").agg(*bounds).alias("x"), named.groupBy("h", "c").agg(*bounds).alias("y")
    across = x.join(y, (F.col("x.h") == F.col("y.h")) & (F.col("x.c") != F.col("y.c"))
                    & (F.col("x.low") <= F.col("y.high")) & (F.col("x.most") >= F.col("y.low"))
                    & (F.col("y.most") >= F.col("x.low")))
    across = across.select("x.h", F.col("x.c").alias("c_a"), F.col("y.c").alias("c_b"),
                           (F.col("x.rows") <= F.col("y.rows")).alias("a_first"))
    across = materialize(across, "across")

    def members(rows: DataFrame, side: str) -> DataFrame:
        return rows.select("h", *(F.col(k).alias(f"{k}_{side}") for k in ("c", "doc", "n", "most")))

    # The smaller side's rows first: a large component meets them under the bounds only.
    a, b = (members(small, "a"), ["h", "c_a"]), (members(named, "b"), ["h", "c_b"])
    rest = across.where("a_first").join(*a).join(*b).unionByName(across.where("NOT a_first").join(*b).join(*a))
    rest = rest.where("n_a <= n_b AND n_b <= most_a AND n_a <= most_b").select(
        F.greatest("doc_a", "doc_b").alias("a"), F.least("doc_a", "doc_b").alias("b")).distinct()
    rest = materialize(rest.join(tried, ["a", "b"], "left_anti"), "pairs")
    return links.unionAll(_verified(rest, sets, percent))


def _shared_ids(rows: DataFrame, classes: DataFrame) -> DataFrame:
    """doc_id, low of the doc_ids whose rows differ: the least doc_id of each class they are in."""
    text = F.struct("k1", "k2")
    several = rows.groupBy("doc_id").agg(F.min(text).alias("one"), F.max(text).alias("other")).where("one <> other")
    of = rows.where("n > 0").join(materialize(several.select("doc_id"), "several"), "doc_id").select("doc_id", "k1", "k2").distinct()
    return materialize(of.join(classes.select("k1", "k2", "low"), ["k1", "k2"]).select("doc_id", "low").distinct(), "shared-ids")


def _ties(shared: DataFrame) -> DataFrame:
    """(a, b) links between the classes that one doc_id is in."""
    least = shared.groupBy("doc_id").agg(F.min("low").alias("b"))
    return shared.join(least, "doc_id").where("low <> b").select(F.col("low").alias("a"), "b").distinct()


def near_duplicates(docs: DataFrame, *, words: int = WORDS, percent: int = PERCENT) -> DataFrame:
    """doc_id, n_shingles, component_id of every row of ``docs`` (doc_id, text).

    ``component_id`` is the smallest doc_id reachable over links of Jaccard similarity
    ``percent`` or more. A text without words, or null, has an empty set and links to nothing;
    fewer words than a shingle make one shingle. Rows that share a doc_id are one document with
    several texts. A null doc_id takes no part and has a null component. Other columns are
    ignored; an empty table gives no rows.
    """
    rows = materialize(candidate_rows(docs, words=words, percent=percent), "rows")
    classes = rows.where("n > 0").groupBy("k1", "k2").agg(
        F.min("doc_id").alias("low"), F.max("maybe").alias("maybe"), F.max("n").alias("n"))
    classes = materialize(classes, "classes")
    chosen = classes.where("maybe").select(F.col("low").alias("doc_id")).distinct()
    sets = materialize(_packed_sets(docs.select("doc_id", "text").join(chosen, "doc_id", "left_semi"), words), "sets")
    size = classes.where("maybe").agg(F.sum("n")).first()[0] or 0
    shared = _shared_ids(rows, classes)
    groups = components(row_links(sets, 1 + size // (2 * FLUSH), percent=percent).select("a", "b").unionAll(_ties(shared)))
    # Classes of one least doc_id meet through the component of the id.
    labels = classes.join(groups, classes["low"] == groups["node"], "left").select(
        "k1", "k2", F.coalesce("component", "low").alias("component_id"))
    full = rows.where("n > 0").join(labels, ["k1", "k2"]).select("doc_id", F.col("n").alias("n_shingles"), "component_id")
    # A row without words is in the component of its doc_id's other rows.
    own = shared.join(groups, shared["low"] == groups["node"], "left").groupBy("doc_id").agg(
        F.min(F.coalesce("component", "low")).alias("of_others"))
    empty = rows.where("n = 0").join(own, "doc_id", "left").select(
        "doc_id", F.col("n").alias("n_shingles"), F.coalesce("of_others", "doc_id").alias("component_id"))
    unnamed = docs.where("doc_id IS NULL").select("doc_id", "text").mapInArrow(
        lambda batches: (pa.RecordBatch.from_pydict({
            "doc_id": pa.nulls(b.num_rows, pa.int64()), "component_id": pa.nulls(b.num_rows, pa.int64()),
            "n_shingles": pa.array([len(shingles(t, words)) for t in b.column("text").to_pylist()], pa.int64())
        }).select(["doc_id", "n_shingles", "component_id"]) for b in batches),
        "doc_id long, n_shingles long, component_id long")
    return full.unionAll(empty).unionAll(unnamed)


def op7_jaccard_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_duplicates(table(spark, sf_dir, "documents"))


OP7_SQL = r"""
WITH RECURSIVE w AS (
  SELECT doc_id, list_filter(regexp_split_to_array(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ',
           'abcdefghijklmnopqrstuvwxyz'), '[\x20\x09-\x0D]+'), lambda x: x <> '') AS words
  FROM documents WHERE text IS NOT NULL),
s AS (
  SELECT DISTINCT doc_id, words[i:i + 4] AS shingle
  FROM (SELECT doc_id, words, unnest(range(1, greatest(2, len(words) - 3))) AS i FROM w WHERE len(words) > 0)),
n AS (SELECT doc_id, count(*) AS n FROM s GROUP BY doc_id),
pairs AS (
  SELECT x.doc_id AS a, y.doc_id AS b, count(*) AS shared FROM s x JOIN s y USING (shingle)
  WHERE x.doc_id <> y.doc_id GROUP BY ALL),
links AS (
  SELECT a, b FROM pairs JOIN n na ON na.doc_id = a JOIN n nb ON nb.doc_id = b
  WHERE 100 * shared >= 75 * (na.n + nb.n - shared)),
reach(doc_id, c) AS (
  SELECT doc_id, doc_id FROM documents
  UNION SELECT b, c FROM reach JOIN links ON a = reach.doc_id)
SELECT r.doc_id, coalesce(max(n), 0)::BIGINT AS n_shingles, min(c) AS component_id
FROM reach r LEFT JOIN n USING (doc_id) GROUP BY r.doc_id
"""

QUERIES = {"op7_jaccard_join": op7_jaccard_join}
ORACLE_SQL = {"op7_jaccard_join": OP7_SQL}
