"""Licence scan: canonical digests of entire texts joined to known licences' digests.

A text's canonical form has lower case, no punctuation, no copyright lines, one blank between
words, one spelling of equivalent words, and no line of its own for the licence's name above it.
How the lines were wrapped makes no difference. Entire documents are matched to full licence
texts, and their lines, each an entire text too, to one-line licence notices.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from cartwheel.llm.common import materialize, table
from cartwheel.llm.license_texts import FULL_DIGESTS, known_texts, titles

BROADCAST_TEXTS = 100_000   # known digests sent to every task, at most (72 bytes or so each)

# A line that only states who holds the copyright, or reserves all rights.
COPYRIGHT_LINE = (r"(?m)^[^\p{L}\p{N}\n(©]*(copyright[ \t]*([(][c][)]|©|<|\[|[0-9]|by )|[(]c[)][ \t]*[0-9]|©"
                  r"|all rights reserved)[^\n]*$")
NOT_A_WORD = r"[^\p{L}\p{N}\n]+"
LINE_ENDS = r" *\n[ \n]*"

# Spellings that licence texts use alike, in canonical (punctuation-free) form.
EQUIVALENT = (("https", "http"), ("licence", "license"), ("sub license", "sublicense"),
              ("non commercial", "noncommercial"), ("non infringement", "noninfringement"),
              ("organisation", "organization"), ("acknowledgement", "acknowledgment"),
              ("favour", "favor"), ("honour", "honor"), ("fulfill", "fulfil"), ("whilst", "while"),
              ("per cent", "percent"), ("copyright owner", "copyright holder"),
              ("merchantibility", "merchantability"), ("initialise", "initialize"),
              ("recognise", "recognize"), ("utilisation", "utilization"))


def _spelled(text: Column) -> Column:
    for old, new in EQUIVALENT:
        text = F.replace(text, F.lit(old), F.lit(new))
    return text


def canonical_lines(text: Column) -> Column:
    """The canonical form, with newlines kept between lines that have words; null stays null."""
    out = F.regexp_replace(F.lower(text), COPYRIGHT_LINE, "")
    out = _spelled(F.regexp_replace(out, NOT_A_WORD, " "))
    return F.trim(F.regexp_replace(F.concat(F.lit("\n"), out, F.lit("\n")), LINE_ENDS, "\n"))


def canonical_title(title: str) -> str:
    """The canonical form of one line of ASCII."""
    out = " ".join("".join(c if c.isalnum() else " " for c in title.lower()).split())
    for old, new in EQUIVALENT:
        out = out.replace(old, new)
    return out


TITLES = sorted({canonical_title(t) for t in titles()})


def _whole(lines: Column) -> Column:
    """Canonical lines as one, without a title above them; a title alone stays. Spellings of two
    words may have stood across a line's end."""
    lines = F.btrim(lines, F.lit("\n"))
    body = F.substring(lines, F.locate("\n", lines) + 1, F.length(lines))
    text = F.when(F.substring_index(lines, "\n", 1).isin(TITLES) & lines.contains("\n"), body).otherwise(lines)
    return _spelled(F.trim(F.replace(text, F.lit("\n"), F.lit(" "))))


def known_digests(spark: SparkSession, texts=None) -> DataFrame:
    """licence, kind, digest, chars of (licence, kind, text) rows; kind is text or notice.

    Without ``texts``, of the known texts, and the digests of those known by digest only."""
    rows = spark.createDataFrame(texts or known_texts(), "licence string, kind string, text string")
    form = rows.select("licence", "kind", _whole(canonical_lines(F.col("text"))).alias("form"))
    form = form.where("form <> ''").select("licence", "kind", F.sha2(F.col("form").cast("binary"), 256).alias("digest"),
                                           F.length("form").alias("chars"))
    if texts is None:
        more = [(k, "text", x, None) for k, digests in FULL_DIGESTS.items() for x in digests]
        form = form.unionByName(spark.createDataFrame(more, "licence string, kind string, digest string, chars int"))
    return form.groupBy("kind", "digest", "chars").agg(F.min("licence").alias("licence"))


def scan_licenses(docs: DataFrame, known: DataFrame | None = None) -> DataFrame:
    """doc_id, digest, licence, notices of every row of ``docs`` (doc_id, text).

    ``digest`` is of the canonical entire text (without a first line that only names a licence),
    ``licence`` the known licence of that digest or
    null, ``notices`` the sorted licences whose notice is a whole line (empty array if none).
    A null text has a null digest, a text without words the digest of nothing; neither
    matches. A digest known under several licences counts for the first by name. Repeated
    rows are judged row by row, other columns are ignored.
    """
    spark = docs.sparkSession
    known = materialize(known if known is not None else known_digests(spark), "licences")
    size = known.agg(F.count("*"), F.min(F.when(F.col("kind") == "notice", F.col("chars"))),
                     F.max(F.when(F.col("kind") == "notice", F.col("chars")))).first()
    if size[0] <= BROADCAST_TEXTS:
        known = F.broadcast(known)  # beyond: an ordinary shuffle join
    low, high = size[1] or 0, size[2] or 0
    rows = docs.select(F.monotonically_increasing_id().alias("row"), "doc_id", canonical_lines(F.col("text")).alias("form"))
    # A line whose length no notice has cannot be one; the rest are few and short.
    lines = F.filter(F.split("form", "\n"), lambda x: F.length(x).between(low, high))
    rows = rows.select("row", "doc_id", F.sha2(_whole(F.col("form")).cast("binary"), 256).alias("digest"),
                       F.transform(F.array_distinct(lines), lambda x: F.sha2(x.cast("binary"), 256)).alias("lines"))
    rows = materialize(rows, "digests")
    notices = (rows.select("row", F.explode("lines").alias("digest"))
               .join(known.where("kind = 'notice'").select("digest", "licence"), "digest")
               .groupBy("row").agg(F.array_sort(F.collect_set("licence")).alias("notices")))
    texts = known.where("kind = 'text'").select("digest", "licence")
    none = F.array().cast("array<string>")
    return (rows.join(texts, "digest", "left").join(notices, "row", "left")
            .select("doc_id", "digest", "licence", F.coalesce("notices", none).alias("notices")))


def op1_license_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = scan_licenses(table(spark, sf_dir, "documents"))
    return out.withColumn("notices", F.concat_ws(",", "notices"))


def _sql() -> str:
    """The same in DuckDB SQL, the known texts as VALUES."""
    def spelled(text: str) -> str:
        for old, new in EQUIVALENT:
            text = f"replace({text}, '{old}', '{new}')"
        return text

    def form(text: str) -> str:
        out = f"regexp_replace(lower({text}), '{COPYRIGHT_LINE}', '', 'g')"
        out = spelled(f"regexp_replace({out}, '{NOT_A_WORD}', ' ', 'g')")
        return f"trim(regexp_replace(chr(10) || {out} || chr(10), '{LINE_ENDS}', chr(10), 'g'), ' ')"

    named = ", ".join(f"'{t}'" for t in TITLES)
    f = "trim(f, chr(10))"
    whole = spelled(f"""trim(replace(CASE WHEN split_part({f}, chr(10), 1) IN ({named}) AND contains({f}, chr(10))
      THEN substr({f}, position(chr(10) IN {f}) + 1) ELSE {f} END, chr(10), ' '), ' ')""")
    values = ", ".join("('{}', '{}', '{}')".format(a, b, c.replace("'", "''")) for a, b, c in known_texts())
    return f"""
WITH known AS (
  SELECT kind, sha256({whole}) AS digest, min(licence) AS licence
  FROM (SELECT licence, kind, {form('text')} AS f FROM (VALUES {values}) v(licence, kind, text))
  GROUP BY ALL),
d AS (SELECT doc_id, {form('text')} AS f FROM documents),
n AS (
  SELECT doc_id, string_agg(DISTINCT licence, ',' ORDER BY licence) AS notices
  FROM (SELECT doc_id, sha256(unnest(string_split(f, chr(10)))) AS digest FROM d)
  JOIN (SELECT digest, licence FROM known WHERE kind = 'notice') USING (digest) GROUP BY doc_id),
w AS (SELECT doc_id, sha256({whole}) AS digest FROM d)
SELECT w.doc_id, w.digest, licence, coalesce(notices, '') AS notices
FROM w LEFT JOIN n USING (doc_id)
LEFT JOIN (SELECT digest, licence FROM known WHERE kind = 'text') k ON k.digest = w.digest
"""


QUERIES = {"op1_license_scan": op1_license_scan}
ORACLE_SQL = {"op1_license_scan": _sql()}
