"""Line deduplication: passages of lines that stand elsewhere before are cut out.

A rolling hash over the hashes of neighbouring lines chooses the boundaries of chunks, so that
equal runs of lines are cut alike whatever stands around them. Multi-line chunks are counted by
digest over all documents; the bytes of repeated ones are compared before all but their first
occurrence are removed.

A passage seldom ends at a boundary, and a short one may hold no whole chunk. Therefore a repeated
chunk is an anchor only: of the lines that no removed chunk holds, and of those at its edges, each
pair of neighbouring lines (and each line of LONG_WORDS words) is counted and compared the same
way. A run of lines repeats where all its neighbouring pairs do, so passages reach as far to both
sides as they are equal, and those without an anchor are found too.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import xxhash
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from cartwheel.llm.common import materialize, rows_sent, table

LONG_WORDS = 50   # a line of so many words is a passage of its own
WINDOW = 2        # lines that a boundary depends on
DIVISOR = 4       # lines of an average chunk
_BASE = np.uint64(0x9E3779B97F4A7C15)
_HIGH = np.uint64(33)
SALTS = 8
SLICE_BYTES = 2 << 20  # of texts that a task looks at together
ROWS_SENT = 1000          # to a Python worker at once


def cut(lines: list[str]) -> list[tuple[int, int]]:
    """(first, end) of each chunk of ``lines``: one ends where the rolling hash over the hashes of
    WINDOW lines is a multiple of DIVISOR."""
    if not lines:
        return []
    h = np.array([xxhash.xxh3_64_intdigest(x) for x in lines], np.uint64)
    rolling, shifted = h.copy(), h
    for _ in range(WINDOW - 1):  # fewer lines at the start
        shifted = np.append(np.uint64(0), shifted[:-1]) * _BASE
        rolling += shifted
    ends = np.flatnonzero((rolling >> _HIGH) % np.uint64(DIVISOR) == 0) + 1
    ends = [*ends[ends < len(lines)].tolist(), len(lines)]
    return list(zip([0, *ends[:-1]], ends, strict=True))


def has_words(line: str) -> bool:
    return bool(line) and not line.isspace()


def _long(line: str) -> bool:
    return len(line) >= 2 * LONG_WORDS - 1 and len(line.split()) >= LONG_WORDS


def passages(lines: list[str]) -> list[tuple[int, int, int | None]]:
    """(first, end, within) of what is counted: multi-line chunks (``within`` -1) first, then each
    line with words to the next one (blank lines between them included) and each long line, with
    the number of the multi-line chunk that holds it whole, or None."""
    full = [i for i, x in enumerate(lines) if has_words(x)]
    out, chunk = [], []
    for a, b in cut([lines[i] for i in full]):
        chunk += [len(out) if b - a > 1 else None] * (b - a)
        if b - a > 1:
            out.append((full[a], full[b - 1] + 1, -1))
    for k, i in enumerate(full):
        if _long(lines[i]):
            out.append((i, i + 1, chunk[k]))
        if k + 1 < len(full):
            out.append((i, full[k + 1] + 1, chunk[k] if chunk[k] == chunk[k + 1] else None))
    return out


def _slices(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[pa.RecordBatch, list[str | None]]]:
    """Rows of about SLICE_BYTES of text, or one, at a time, and their texts: what is made of a whole
    batch (10,000 rows) would be held at once."""
    for batch in batches:
        text = batch.column("text")
        ends = np.cumsum(pc.fill_null(pc.binary_length(text), 0).to_numpy(zero_copy_only=False).astype(np.int64))
        a = 0
        while a < len(text):
            b = max(a + 1, int(np.searchsorted(ends, (ends[a - 1] if a else 0) + SLICE_BYTES, "right")))
            yield batch.slice(a, b - a), text.slice(a, b - a).to_pylist()
            a = b


ROW = ("k1", "k2")  # 128 bits that name a row by its doc_id and text
NAMES = "k1 long, k2 long, no int, digest binary"


def _place():
    return F.struct("doc_id", *ROW, "no")


def _repeated(found: DataFrame) -> DataFrame:
    """The rows of ``found`` whose digest stands at several places, with ``first``, the least one.

    Rows that are equal in doc_id and text are one place. The repeated digests are stored, so that
    Spark can split a digest with very many rows in the join."""
    often = found.groupBy("digest").agg(F.min(_place()).alias("first"), F.max(_place()).alias("last"))
    often = materialize(often.where(~F.col("first").eqNullSafe(F.col("last"))).drop("last"), "often")
    return found.join(often, "digest")


def repeated_passages(rows: DataFrame) -> DataFrame:
    """doc_id, k1, k2, no, digest, first of the passages whose digest occurs more than once.

    ``rows`` has doc_id, k1, k2, text; ``first`` is the digest's least (doc_id, k1, k2, no). What
    lies whole in a repeated chunk, its first occurrence apart, is not counted again: its first
    occurrence is in the chunk's.
    """
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch, texts in _slices(batches):
            at, no, digest, inside = [], [], [], []
            for i, text in enumerate(texts):
                lines = (text or "").split("\n")
                for k, (a, b, within) in enumerate(passages(lines)):
                    at.append(i)
                    no.append(k)
                    digest.append(xxhash.xxh3_128_digest("\n".join(lines[a:b]).encode()))
                    inside.append(within)
            at = pa.array(at, pa.int64())
            yield pa.RecordBatch.from_pydict({c: batch.column(c).take(at) for c in ("doc_id", *ROW)} | {
                "no": pa.array(no, pa.int32()), "digest": pa.array(digest, pa.binary()), "within": pa.array(inside, pa.int32())})

    kind = rows.schema["doc_id"].dataType.simpleString()
    found = rows.select("doc_id", *ROW, "text").mapInArrow(run, f"doc_id {kind}, {NAMES}, within int")
    with rows_sent(rows.sparkSession, ROWS_SENT):
        found = materialize(found, "chunks")
    chunks = materialize(_repeated(found.where("within = -1").drop("within")), "anchors")
    copies = chunks.where(~_place().eqNullSafe(F.col("first"))).select(*ROW, F.col("no").alias("within")).distinct()
    rest = found.where("within IS NULL").unionAll(found.where("within >= 0").join(copies, [*ROW, "within"], "left_anti").select(*found.columns))
    return chunks.unionByName(_repeated(rest.drop("within")))


def dedup_lines(docs: DataFrame) -> DataFrame:
    """``docs`` with the repeated passages cut out of ``text``, and ``n_removed`` (lines with words).

    A line goes if it stands in a passage that occurs before, by doc_id (null first), row and
    place, unless it also belongs to the passage's first occurrence (where both overlap); so the
    first occurrence of every line stays. A digest whose passages differ in any byte is left
    alone. A null text stays null; a text whose passages all stand elsewhere
    becomes empty; rows equal in doc_id and text are treated alike. Columns are kept; one named
    ``n_removed`` is replaced.

    Texts are shuffled once, by row: the join that fetches the bytes to compare and the one
    that removes lines read the same exchange.
    """
    own = docs.drop("n_removed")
    names = [c for c in own.columns if c not in ("doc_id", "text")]
    rest = F.struct(*(f"`{c}`" for c in names)) if names else F.lit(None).cast("boolean")
    rows = own.select("doc_id", F.xxhash64("doc_id", "text").alias("k1"), F.xxhash64("text", F.lit(1), "doc_id").alias("k2"),
                      "text", rest.alias("rest"))
    found = materialize(repeated_passages(rows), "repeated")
    wanted = found.groupBy(*ROW).agg(F.collect_set(F.struct("no", "digest")).alias("chunks"))
    placed = rows.repartition(*ROW)

    def compared(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch, texts in _slices(batches):
            digest, data = [], []
            for text, chunks in zip(texts, batch.column("chunks").to_pylist(), strict=True):
                lines = (text or "").split("\n")
                at = passages(lines)
                for c in chunks:
                    a, b, _ = at[c["no"]]
                    digest.append(c["digest"])
                    data.append("\n".join(lines[a:b]).encode())
            yield pa.RecordBatch.from_pydict({"digest": pa.array(digest, pa.binary()), "data": pa.array(data, pa.binary())})

    # All columns go in, or pruning would make this another exchange than the last join's.
    data = placed.join(wanted, list(ROW)).mapInArrow(compared, "digest binary, data binary")
    unlike = data.groupBy("digest").agg(F.min("data").alias("low"), F.max("data").alias("high")).where("low <> high")
    # Hardly any; spread over the rows of a frequent digest.
    unlike = unlike.select("digest", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))).alias("salt"))
    same_row = F.struct("doc_id", *ROW).eqNullSafe(F.struct("first.doc_id", *(f"first.{c}" for c in ROW)))
    gone = found.where(~_place().eqNullSafe(F.col("first")))
    gone = gone.select(*ROW, "digest", F.struct("no", F.when(same_row, F.col("first.no")).alias("spare")).alias("one"),
                       F.pmod("k1", F.lit(SALTS)).cast("int").alias("salt"))
    gone = gone.join(unlike, ["digest", "salt"], "left_anti").groupBy(*ROW).agg(F.collect_set("one").alias("gone"))

    def strip(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch, out in _slices(batches):
            removed = [0] * len(out)
            for i, found_here in enumerate(batch.column("gone").to_pylist()):
                if found_here:
                    lines = out[i].split("\n")
                    at, gone_now = passages(lines), set()
                    for one in found_here:
                        a, b, _ = at[one["no"]]
                        if one["spare"] is not None:  # the first occurrence is in this row too
                            a = max(a, at[one["spare"]][1])
                        gone_now.update(range(a, b))
                    out[i] = "\n".join(x for k, x in enumerate(lines) if k not in gone_now)
                    removed[i] = sum(has_words(lines[k]) for k in gone_now)
            yield pa.RecordBatch.from_arrays(
                [batch.column("doc_id"), pa.array(out, pa.string()), batch.column("rest"), pa.array(removed, pa.int32())],
                names=["doc_id", "text", "rest", "n_removed"])

    schema = T.StructType([own.schema["doc_id"], own.schema["text"], rows.schema["rest"],
                           T.StructField("n_removed", T.IntegerType())])
    out = placed.join(gone, list(ROW), "left").mapInArrow(strip, schema)
    return out.select(*(F.col("rest")[c].alias(c) if c in names else c for c in own.columns), "n_removed")


def op3_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = dedup_lines(table(spark, sf_dir, "documents").select("doc_id", "text"))
    return out.select("doc_id", "n_removed", F.length("text").cast("long").alias("kept_chars"),
                      F.sha2(F.col("text").cast("binary"), 256).alias("text_sha256"))


QUERIES = {"op3_line_dedup": op3_line_dedup}
ORACLE_SQL = {}
