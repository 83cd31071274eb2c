"""Quality rules: per-document rules, and host verdicts from their failures.

Failures are counted per host and shrunk with an empirical beta prior; a host's documents are
all dropped only if the lower bound of its posterior failure rate is above a limit.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from cartwheel.llm.beta import posterior_mean, posterior_sd, strength
from cartwheel.llm.common import materialize, table
from cartwheel.operators.joins import takes_at_most

SPACE = r"[\x20\x09-\x0D]+"       # what separates words
SYMBOLS = r"[#*$%&|<>]+"
MIN_WORDS = 50                    # fewer fail
MAX_REPEAT_PERCENT = 50           # more repeated words fail
MAX_FAIL_RATE = 0.5               # a host fails if its rate is above this for certain
Z = 3.0                           # posterior standard deviations between mean and bound


def _bind(value: Column, then) -> Column:
    """``then(value)`` with ``value`` computed once (a lambda body would repeat it)."""
    return F.transform(F.array(value), then)[0]


def repeat_words(words: Column) -> Column:
    """Words inside 3-word windows found twice or more, the first occurrence included.

    Window hashes are sorted with their positions, so that equal windows are neighbours;
    each marked window adds the words up to the next marked one, three at most. Everything
    stays in the row: O(n log n), no shuffle of windows.
    """
    def windows(w: Column) -> Column:
        return F.transform(F.slice(w, 1, F.greatest(F.size(w) - 2, F.lit(0))),
                           lambda x, i: F.xxhash64(x, F.get(w, i + 1), F.get(w, i + 2)))

    def marked(hashes: Column) -> Column:
        pairs = F.array_sort(F.transform(hashes, lambda h, i: F.struct(h.alias("h"), i.alias("i"))))
        return _bind(pairs, lambda p: F.array_sort(F.transform(F.filter(
            p, lambda x, i: ((i > 0) & (x["h"] == F.get(p, i - 1)["h"]))
            | F.coalesce(x["h"] == F.get(p, i + 1)["h"], F.lit(False))), lambda x: x["i"])))

    def covered(hashes: Column) -> Column:
        return _bind(marked(hashes), lambda m: F.aggregate(
            F.transform(m, lambda p, i: F.least(F.lit(3), F.coalesce(F.get(m, i + 1) - p, F.lit(3)))),
            F.lit(0), lambda a, x: a + x))

    return _bind(words, lambda w: _bind(windows(w), lambda h: F.when(
        F.size(F.array_distinct(h)) == F.size(h), F.lit(0)).otherwise(covered(h))))


def base_rules(docs: DataFrame, *, host: str = "source", min_words: int = MIN_WORDS,
               max_repeat_percent: int = MAX_REPEAT_PERCENT) -> DataFrame:
    """doc_id, host, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed.

    A null or empty text has no words (and fails for having too few).
    """
    text = F.coalesce(F.col("text"), F.lit(""))
    words = F.filter(F.split(text, SPACE), lambda w: w != "")
    lines = F.filter(F.split(text, "\n"), lambda x: x.rlike(r"[^\x20\x09-\x0D]"))
    rows = docs.select(
        "doc_id", F.col(host).cast("string").alias("host"),
        F.length(F.regexp_replace(text, SPACE, "")).cast("long").alias("word_chars"),
        (F.length(text) - F.length(F.regexp_replace(text, SYMBOLS, ""))).cast("long").alias("n_symbols"),
        _bind(lines, lambda x: F.size(x) - F.size(F.array_distinct(x))).cast("long").alias("n_dup_lines"),
        _bind(words, lambda w: F.struct(F.size(w).cast("long").alias("n"),
                                        repeat_words(w).cast("long").alias("r"))).alias("w"))
    rows = rows.select("doc_id", "host", F.col("w.n").alias("n_words"), "word_chars", "n_symbols",
                       "n_dup_lines", F.col("w.r").alias("n_repeat_words"))
    failed = ((F.col("n_words") < min_words)
              | (100 * F.col("n_repeat_words") > max_repeat_percent * F.col("n_words")))
    return rows.withColumn("base_failed", failed)


def host_verdicts(rows: DataFrame, *, max_fail_rate: float = MAX_FAIL_RATE,
                  z: float = Z) -> DataFrame:
    """(host, base_failed) rows -> host, host_docs, host_fail_rate, host_failed.

    Rows without a host are left out. One partial count per host and task is shuffled.
    """
    hosts = (rows.where("host IS NOT NULL").groupBy("host")
             .agg(F.count("*").alias("n"), F.sum(F.col("base_failed").cast("long")).alias("k")))
    hosts = hosts.withColumn("m0", hosts.agg((F.sum("k") + 0.5) / (F.sum("n") + 1)).scalar())
    s = hosts.agg(strength(F.col("n"), F.col("k"), F.col("m0")))
    hosts = hosts.withColumn("s", s.scalar()).withColumn(
        "rate", posterior_mean(F.col("n"), F.col("k"), F.col("m0"), F.col("s")))
    bound = F.col("rate") - z * posterior_sd(F.col("n"), F.col("rate"), F.col("s"))
    return hosts.select("host", F.col("n").alias("host_docs"), F.col("rate").alias("host_fail_rate"),
                        (bound > max_fail_rate).alias("host_failed"))


def quality_verdicts(docs: DataFrame, *, host: str = "source", min_words: int = MIN_WORDS,
                     max_repeat_percent: int = MAX_REPEAT_PERCENT,
                     max_fail_rate: float = MAX_FAIL_RATE, z: float = Z) -> DataFrame:
    """The base rules of every row, its host's verdict, and ``kept``.

    A document without a host is judged by the base rules alone; repeated ``doc_id`` rows are
    judged row by row. The rules read each text once: their narrow result is written to the
    shared folder, as both the counts and the final join need it. Other columns are ignored.
    """
    rows = materialize(base_rules(docs, host=host, min_words=min_words,
                                  max_repeat_percent=max_repeat_percent), "quality-rules")
    verdicts = host_verdicts(rows, max_fail_rate=max_fail_rate, z=z)
    failed = F.col("base_failed") | F.coalesce("host_failed", F.lit(False))
    verdicts = materialize(verdicts, "host-verdicts")
    verdicts = F.broadcast(verdicts) if takes_at_most(verdicts) else verdicts  # a hot host's rows stay where they are
    return (rows.join(verdicts, "host", "left")
            .select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines",
                    "n_repeat_words", "base_failed", (~failed).alias("kept"), "host",
                    "host_docs", "host_fail_rate"))


def op4_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = quality_verdicts(table(spark, sf_dir, "documents"))
    return out.withColumn("host_fail_rate", F.round("host_fail_rate", 6))


OP4_SQL = r"""
WITH d AS (
  SELECT doc_id, source AS host, coalesce(text, '') AS t,
         list_filter(regexp_split_to_array(coalesce(text, ''), '[\x20\x09-\x0D]+'),
                     lambda x: x <> '') AS w
  FROM documents),
win AS (
  SELECT doc_id, i, w[i] AS a, w[i + 1] AS b, w[i + 2] AS c
  FROM (SELECT doc_id, w, unnest(range(1, len(w) - 1)) AS i FROM d)),
hit AS (SELECT doc_id, i FROM win QUALIFY count(*) OVER (PARTITION BY doc_id, a, b, c) > 1),
rep AS (
  SELECT doc_id, count(DISTINCT i + o) AS r
  FROM hit, (VALUES (0), (1), (2)) v(o) GROUP BY doc_id),
base AS (
  SELECT d.doc_id, host, len(w)::BIGINT AS n_words,
         length(regexp_replace(t, '[\x20\x09-\x0D]+', '', 'g'))::BIGINT AS word_chars,
         (length(t) - length(regexp_replace(t, '[#*$%&|<>]', '', 'g')))::BIGINT AS n_symbols,
         (SELECT count(*) - count(DISTINCT l) FROM (SELECT unnest(string_split(t, chr(10))) AS l)
          WHERE regexp_matches(l, '[^\x20\x09-\x0D]')) AS n_dup_lines,
         coalesce(r, 0)::BIGINT AS n_repeat_words
  FROM d LEFT JOIN rep USING (doc_id)),
judged AS (
  SELECT *, n_words < 50 OR 100 * n_repeat_words > 50 * n_words AS base_failed FROM base),
hosts AS (
  SELECT host, count(*) AS n, count(*) FILTER (base_failed) AS k FROM judged
  WHERE host IS NOT NULL GROUP BY host),
prior AS (SELECT (sum(k) + 0.5::DOUBLE) / (sum(n) + 1) AS m FROM hosts),
moments AS (
  SELECT sum((k - n * m) ** 2 - n * m * (1 - m)) / sum(n * (n - 1) * m * (1 - m)) AS r
  FROM hosts, prior),
shrunk AS (
  SELECT host, n, s, (s * m + k) / (s + n) AS rate
  FROM hosts, prior, (SELECT 1 / greatest(0.001, least(0.5, r)) - 1 AS s FROM moments))
SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed,
       NOT (base_failed OR coalesce(rate - 3 * sqrt(rate * (1 - rate) / (s + n + 1)) > 0.5, false)) AS kept,
       judged.host, n AS host_docs, round(rate, 6) AS host_fail_rate
FROM judged LEFT JOIN shrunk USING (host)
"""

QUERIES = {"op4_quality_rules": op4_quality_rules}
ORACLE_SQL = {"op4_quality_rules": OP4_SQL}
