"""A training corpus from raw documents: five stages, each written as Parquet and read again.

``STAGES`` lists (name, function); a function takes (spark, docs, sf_dir) and returns what it
keeps, with the columns of ``documents`` (the last: the encoded documents). ``run`` applies
them to the table ``documents``. Each stage is judged on its own input: it learns, counts and
compares over all the rows that its predecessor kept.
"""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from cartwheel.llm.byte_bpe import encode_documents
from cartwheel.llm.common import materialize, table, workers_import_package
from cartwheel.llm.decontaminate import contamination
from cartwheel.llm.jaccard_join import near_duplicates
from cartwheel.llm.language_id import UNKNOWN, identify, learnable, train
from cartwheel.llm.line_dedup import dedup_lines

BPE_BYTES = 48 << 20  # earlier stages have grown the executors' heap; the encoder's memory stays small
MIN_SCORE = 0.3   # a language less probable than this is not told (nor one hardly more than by chance)

#: SQL can express neither the trained stage nor the passages' first places; tests/llm compares
#: every stage with a brute-force version.
ORACLE_SQL = None


def _packed(docs: DataFrame) -> DataFrame:
    """doc_id, text and the other columns in one, so that no name can clash."""
    rest = [f"`{c}`" for c in docs.columns if c not in ("doc_id", "text")]
    return docs.select("doc_id", "text", (F.struct(*rest) if rest else F.lit(None).cast("boolean")).alias("rest"))


def _unpacked(rows: DataFrame, docs: DataFrame) -> DataFrame:
    return rows.select(*(c if c in ("doc_id", "text") else F.col("rest")[c].alias(c) for c in docs.columns))


def language_id(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents whose language can be told; those without a letter, of a score below MIN_SCORE or,
    with more than three languages, hardly above that of a guess, go. Texts in languages that were
    not learned have such scores. Where no row has a language to learn from, nothing is rejected but those
    without a letter."""
    workers_import_package(spark)
    model = train(learnable(docs))
    rows = identify(_packed(docs), model)
    if model.languages:
        least = min(MIN_SCORE, 1.1 / len(model.languages))
        return _unpacked(rows.where((F.col("lang_pred") != UNKNOWN) & (F.col("score") >= least)), docs)
    return docs.where(F.col("text").rlike(r"\p{L}"))


def line_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without the passages of lines that stand elsewhere before; ``n_chars`` follows
    the text. A document that is left without a word goes, one that had none stays."""
    workers_import_package(spark)
    rows = dedup_lines(_packed(docs))
    rows = rows.where((F.col("n_removed") == 0) | F.col("text").rlike(r"[^\x20\x09-\x0D]"))
    out = _unpacked(rows.drop("n_removed"), docs)
    if "n_chars" not in docs.columns:
        return out
    kind = docs.schema["n_chars"].dataType
    return out.withColumn("n_chars", F.when(F.col("text").isNull(), F.col("n_chars")).otherwise(F.length("text")).cast(kind))


def jaccard_join(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each group of near duplicates the document of the least doc_id. Rows that share a
    doc_id are one document; rows without doc_id are in no group and stay."""
    workers_import_package(spark)
    groups = near_duplicates(docs)
    least = groups.where("doc_id = component_id").select("doc_id").distinct()
    kept = docs.join(materialize(least, "least"), "doc_id", "left_semi")
    return kept.unionByName(docs.where("doc_id IS NULL")).select(*(f"`{c}`" for c in docs.columns))


def decontaminate(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without any benchmark window. Rows that share a doc_id go together; rows
    without one are told apart by their text."""
    workers_import_package(spark)
    key = F.coalesce(F.col("doc_id").cast("string"), F.concat(F.lit("text "), F.sha1(F.col("text").cast("binary"))))
    found = contamination(docs.select(key.alias("doc_id"), "text"), table(spark, sf_dir, "benchmark"))
    hit = materialize(found.where("contaminated").select(F.col("doc_id").alias("hit")).distinct(), "hit")
    return docs.join(hit, key == hit["hit"], "left_anti")


def byte_bpe(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """doc_id, n_tokens, ids_sha256, decoded_sha256 of every document."""
    workers_import_package(spark)
    return encode_documents(docs, path=public_tokenizers.path("byte_bpe_multi_50k.tiktoken"), cache_bytes=BPE_BYTES)


STAGES = [("language_id", language_id), ("line_dedup", line_dedup), ("jaccard_join", jaccard_join),
          ("decontaminate", decontaminate), ("byte_bpe", byte_bpe)]


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES:
        docs = materialize(stage(spark, docs, sf_dir), name)
    return docs
