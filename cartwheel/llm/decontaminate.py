"""Benchmark decontamination: a prefix-filtered set join of item windows with documents.

An item's windows are its runs of consecutive words; a window's tokens are its word shingles.
As a window must be contained whole, one prefix token is necessary: its rarest shingle, by
counts over all documents. Documents are joined on those, an occurrence's position gives the
only possible start, length bounds drop starts outside the document, and a start is verified
by finding every shingle of the window at its place.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from cartwheel.llm.common import ascii_lower, materialize, table

WORD = r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+"
WINDOW = 10                      # words of a window
SHINGLE = 3                      # words of a shingle (shorter items: all their words)
BROADCAST_SHINGLES = 200_000     # of at most so many and
BROADCAST_BYTES = 32 << 20       # so many bytes, the items' shingles are sent to every task


def words(text: Column) -> Column:
    """Lower-cased (A-Z) words; null has none."""
    return F.regexp_extract_all(ascii_lower(F.coalesce(text, F.lit(""))), F.lit(WORD), F.lit(0))


def _shingles(w: Column, size: Column) -> Column:
    """array<struct<j, s>>: the shingles of a word array with their places."""
    return F.transform(F.sequence(F.lit(0), F.size(w) - size),
                       lambda j: F.struct(j.alias("j"), F.slice(w, j + 1, size).alias("s")))


def item_windows(items: DataFrame, *, window: int = WINDOW, shingle: int = SHINGLE) -> DataFrame:
    """(item_id, text) -> one row per different window: w (its words), items, shingles.

    Items without words, without text or without id have no window; one of fewer words than
    ``window`` is a window as it is.
    """
    w = items.where("item_id IS NOT NULL").select(
        F.col("item_id").cast("string").alias("item"), words(F.col("text")).alias("words"))
    runs = F.transform(F.sequence(F.lit(1), F.greatest(F.size("words") - (window - 1), F.lit(1))),
                       lambda i: F.slice("words", i, window))
    runs = w.where(F.size("words") > 0).select("item", F.explode(runs).alias("w"))
    runs = runs.groupBy("w").agg(F.collect_set("item").alias("items"))
    size = F.least(F.size("w"), F.lit(shingle))
    return runs.select("w", "items", _shingles(F.col("w"), size).alias("shingles"))


def _key(parts: list[Column]) -> Column:
    return F.xxhash64(*parts)


def shingle_hits(docs: DataFrame, tokens: DataFrame, *, shingle: int = SHINGLE) -> DataFrame:
    """Places in ``docs`` of the shingles in ``tokens`` (column s: array of words).

    One scan gives row (a number for each row of docs), doc_id, n_words, pos, s; every row of
    docs also has a line of pos -1 without shingle, which keeps it in the result. Shingles
    are joined by a 64-bit hash and compared word by word.
    """
    known = tokens.select("s", F.size("s").alias("size")).distinct()
    width = known.agg(F.count("*"), F.sum(F.length(F.concat_ws(" ", "s"))), F.collect_set("size")).first()
    sizes = sorted(width[2])
    part = [F.get("s", i) for i in range(shingle)]
    known = known.select("s", "size", _key([F.col("size"), *part]).alias("key"))
    if width[0] <= BROADCAST_SHINGLES and (width[1] or 0) + 64 * width[0] <= BROADCAST_BYTES:
        known = F.broadcast(known)  # beyond: a sort-merge join, split where a shingle is hot
    rows = docs.select(F.monotonically_increasing_id().alias("row"), "doc_id", words(F.col("text")).alias("w"))
    runs = F.arrays_zip(*(F.slice("w", i + 1, F.greatest(F.size("w") - i, F.lit(0))).alias(f"w{i}") if i else
                          F.col("w").alias("w0") for i in range(shingle)))
    empty = F.array(F.struct(*(F.lit(None).cast("string").alias(f"w{i}") for i in range(shingle))))
    # The first entry of each row stands for the row itself.
    at = rows.select("row", "doc_id", F.size("w").alias("n_words"), F.posexplode(F.concat(empty, runs)).alias("p", "x"))
    keys = [F.when(F.col(f"x.w{k - 1}").isNotNull(), _key([F.lit(k), *(
        F.col(f"x.w{i}") if i < k else F.lit(None).cast("string") for i in range(shingle))]))
        for k in sizes]
    if len(keys) > 1:
        itself = F.array(F.lit(None).cast("long"))
        at = at.withColumn("key", F.explode(F.when(F.col("p") == 0, itself).otherwise(F.array(*keys))))
    else:
        at = at.withColumn("key", keys[0] if keys else F.lit(None).cast("long"))
    same = F.lit(True)
    for i in range(shingle):
        same &= (F.size("s") <= i) | (F.get("s", i) == F.col(f"x.w{i}"))
    found = at.join(known, (at["key"] == known["key"]) & same, "left")
    return found.where((F.col("p") == 0) | F.col("s").isNotNull()).select(
        "row", "doc_id", "n_words", (F.col("p") - 1).alias("pos"), "s")


def contained_windows(hits: DataFrame, windows: DataFrame) -> DataFrame:
    """row, start, w, items: the places where a whole window stands in a row."""
    counts = hits.where("s IS NOT NULL").groupBy("s").agg(F.count("*").alias("n"))
    parts = windows.select("w", F.inline("shingles"))
    # A window with a shingle that occurs nowhere is nowhere; the rarest is its prefix token.
    prefix = (parts.join(counts, "s", "left").groupBy("w")
              .agg(F.min(F.struct("n", "s", "j")).alias("rare"), F.count("n").alias("found"), F.count("*").alias("all"))
              .where("found = all").select("w", F.col("rare.s").alias("s"), F.col("rare.j").alias("j")))
    start = F.col("pos") - F.col("j")
    starts = hits.where("s IS NOT NULL").join(prefix, "s").select("row", start.alias("start"), "w", "n_words")
    starts = starts.where((F.col("start") >= 0) & (F.col("start") + F.size("w") <= F.col("n_words")))
    places = starts.join(windows, "w").select(
        "row", "start", "w", "items", F.size("shingles").alias("all"), F.inline("shingles"))
    places = places.select("*", (F.col("start") + F.col("j")).alias("pos"))
    return (places.join(hits.select("row", "pos", "s"), ["row", "pos", "s"])
            .groupBy("row", "start", "w").agg(F.count("*").alias("found"), F.first("all").alias("all"),
                                              F.first("items").alias("items"))
            .where("found = all").select("row", "start", "w", "items"))


def contamination(docs: DataFrame, items: DataFrame, *, window: int = WINDOW,
                  shingle: int = SHINGLE) -> DataFrame:
    """doc_id, n_words, n_hit, n_items, items_sha256, contaminated, items of every row of ``docs``.

    A word inside any occurrence of an item's window is hit. ``items`` are the ids as sorted
    strings, ``items_sha256`` their digest joined by commas. A null or empty text has no words;
    no items hit nothing; repeated doc_id rows are judged row by row; repeated item rows count
    once. Other columns are ignored.
    """
    windows = materialize(item_windows(items, window=window, shingle=shingle), "windows")
    tokens = windows.select(F.explode("shingles").alias("x")).select("x.s")
    hits = materialize(shingle_hits(docs, tokens, shingle=shingle), "hits")
    whole = materialize(contained_windows(hits, windows), "contained")
    hit = (whole.select("row", F.explode(F.sequence("start", F.col("start") + F.size("w") - 1)).alias("at"))
           .distinct().groupBy("row").agg(F.count("*").alias("n_hit")))
    named = (whole.select("row", F.explode("items").alias("item")).distinct()
             .groupBy("row").agg(F.array_sort(F.collect_list("item")).alias("items")))
    none = F.array().cast("array<string>")
    return (hits.where("pos = -1").select("row", "doc_id", "n_words").join(hit, "row", "left").join(named, "row", "left")
            .select("doc_id", F.col("n_words").cast("long").alias("n_words"),
                    F.coalesce("n_hit", F.lit(0)).cast("long").alias("n_hit"),
                    F.coalesce("items", none).alias("items"))
            .select("doc_id", "n_words", "n_hit", F.size("items").cast("long").alias("n_items"),
                    F.sha2(F.concat_ws(",", "items").cast("binary"), 256).alias("items_sha256"),
                    (F.col("n_hit") > 0).alias("contaminated"), "items"))


def op6_decontaminate(spark: SparkSession, sf_dir: str) -> DataFrame:
    return contamination(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark")).drop("items")


OP6_SQL = r"""
WITH d AS (
  SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ',
    'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM documents),
b AS (
  SELECT item_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ',
    'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM benchmark),
win AS (
  SELECT DISTINCT item_id, w[i:i + 9] AS x
  FROM (SELECT item_id, w, unnest(range(1, greatest(2, len(w) - 8))) AS i FROM b WHERE len(w) > 0)),
sizes AS (SELECT DISTINCT len(x) AS n FROM win),
run AS (
  SELECT doc_id, i, n, w[i:i + n - 1] AS x
  FROM (SELECT doc_id, w, n, unnest(range(1, len(w) - n + 2)) AS i FROM d, sizes WHERE len(w) >= n)),
found AS (SELECT doc_id, i, n, item_id FROM run JOIN win USING (x)),
hit AS (
  SELECT doc_id, count(DISTINCT place) AS n_hit
  FROM (SELECT doc_id, unnest(range(i, i + n)) AS place FROM found) GROUP BY doc_id),
named AS (
  SELECT doc_id, count(DISTINCT item_id) AS n_items,
         string_agg(DISTINCT item_id::VARCHAR, ',' ORDER BY item_id::VARCHAR) AS items
  FROM found GROUP BY doc_id)
SELECT doc_id, len(w)::BIGINT AS n_words, coalesce(n_hit, 0) AS n_hit, coalesce(n_items, 0) AS n_items,
       sha256(coalesce(items, '')) AS items_sha256, coalesce(n_hit, 0) > 0 AS contaminated
FROM d LEFT JOIN hit USING (doc_id) LEFT JOIN named USING (doc_id)
"""

QUERIES = {"op6_decontaminate": op6_decontaminate}
ORACLE_SQL = {"op6_decontaminate": OP6_SQL}
