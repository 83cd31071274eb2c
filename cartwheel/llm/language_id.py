"""Language identification: sparse multinomial logistic regression on character n-grams.

Features are hashed n-grams of 1 to 3 characters, weighted by TF-IDF. Document frequencies
are counted over every labelled text; the weights are fitted by follow-the-regularised-leader
with elastic-net penalties on a bounded sample per language, and a temperature fitted on a
part of the sample left out makes the scores probabilities. A text most of whose n-grams are
rare in all the learned texts is in none of their languages, so its score falls towards 0.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from cartwheel.llm.byte_bpe import slices
from cartwheel.llm.common import table

BITS = 15                 # features: 2^BITS
ORDERS = (1, 2, 3)        # characters of an n-gram
PER_LANGUAGE = 1500       # about so many labelled rows of a language fit the weights
ALPHA, BETA, L1, L2 = 0.5, 1.0, 1e-3, 1e-3
EPOCHS = 3
SMOOTHING = 5e-4          # of the held-out targets, or a model without error would never be unsure
RARE = 1000               # an n-gram is known if one of so many labelled texts holds it, and two of a hundred or more
SEEN_NONE, SEEN_ALL = 0.65, 0.8  # shares of known n-grams between which a score rises to its full
LEAST = 0.01              # of a score that stays below
UNKNOWN = "und"

_SEEDS = [np.uint32(x) for x in (0x9E3779B1, 0x85EBCA6B, 0xC2B2AE35)]
_ASCII_LETTER = re.compile("[A-Za-z]").search


def counts(text: str) -> np.ndarray:
    """Occurrences of each feature in a text (letters in lower case)."""
    c = np.frombuffer(text.lower().encode("utf-32-le", "replace"), np.uint32)
    found = []
    for n in ORDERS:
        if len(c) >= n:
            h = np.full(len(c) - n + 1, n * 0x27D4EB2F & 0xFFFFFFFF, np.uint32)
            for i in range(n):
                h = (h ^ c[i:i + len(h)]) * _SEEDS[i]
                h ^= h >> np.uint32(15)
            found.append(h >> np.uint32(32 - BITS))
    if not found:
        return np.zeros(1 << BITS, np.int64)
    return np.bincount(np.concatenate(found), minlength=1 << BITS)


def has_letter(text: str | None) -> bool:
    return bool(text) and (_ASCII_LETTER(text) is not None or any(map(str.isalpha, text)))


def _unit(idx: np.ndarray, tf: np.ndarray, idf: np.ndarray) -> np.ndarray:
    """TF-IDF values of length one."""
    x = (1 + np.log(tf)) * idf[idx]
    return x / max(float(np.sqrt(x @ x)), 1e-12)


@dataclass
class Model:
    languages: list[str]
    idf: np.ndarray           # per feature
    weights: np.ndarray       # languages x (features + 1), the last the intercept
    temperature: float
    known: np.ndarray | None = None  # per feature; None: all are

    def certainty(self, n: np.ndarray) -> float:
        """From LEAST to 1: whether a text of these counts can be in a learned language at all."""
        if self.known is None:
            return 1.0
        share = n[self.known].sum() / n.sum()
        return float(min(1.0, max(LEAST, (share - SEEN_NONE) / (SEEN_ALL - SEEN_NONE))))

    def predict(self, texts: list[str | None]) -> tuple[list[str], list[float]]:
        """Language and probability of each text, lowered where its n-grams are not known; ``und``
        with 0 where it has no letter."""
        names, scores = [], []
        for t in texts:
            if not self.languages or not has_letter(t):
                names.append(UNKNOWN)
                scores.append(0.0)
                continue
            n = counts(t)
            idx = np.flatnonzero(n)
            z = (self.weights[:, idx] @ _unit(idx, n[idx], self.idf) + self.weights[:, -1]) / self.temperature
            p = np.exp(z - z.max())
            best = int(np.argmax(p))
            names.append(self.languages[best])
            scores.append(float(p[best] / p.sum()) * self.certainty(n))
        return names, scores


def fit_ftrl(rows: list[tuple[np.ndarray, np.ndarray, int]], n_languages: int) -> np.ndarray:
    """Weights from (features, values, language) rows by FTRL-proximal steps, one row at a time."""
    z = np.zeros((n_languages, (1 << BITS) + 1))
    n = np.zeros_like(z)

    def weights(zi, ni):
        w = (np.sign(zi) * L1 - zi) / ((BETA + np.sqrt(ni)) / ALPHA + L2)
        return np.where(np.abs(zi) > L1, w, 0.0)

    order = np.random.default_rng(0)
    for _ in range(EPOCHS):
        for i in order.permutation(len(rows)):
            idx, x, y = rows[i]
            zi, ni = z[:, idx], n[:, idx]
            w = weights(zi, ni)
            s = w @ x
            p = np.exp(s - s.max())
            p /= p.sum()
            p[y] -= 1
            g = p[:, None] * x
            z[:, idx] = zi + g - (np.sqrt(ni + g * g) - np.sqrt(ni)) / ALPHA * w
            n[:, idx] = ni + g * g
    return weights(z, n)


def fit_temperature(logits: np.ndarray, y: np.ndarray) -> float:
    """The divisor of the logits with the least mean log loss against targets that keep SMOOTHING
    for all languages alike (1 without rows)."""
    if not len(y):
        return 1.0

    def loss(t):
        s = logits / t
        s = s - s.max(axis=1, keepdims=True)
        target = (1 - SMOOTHING) * s[np.arange(len(y)), y] + SMOOTHING * s.mean(axis=1)
        return float(np.mean(np.log(np.exp(s).sum(axis=1)) - target))

    return float(min(np.exp(np.linspace(-4, 2, 121)), key=loss))


def train(docs: DataFrame, *, per_language: int = PER_LANGUAGE) -> Model:
    """Fit on rows (text, lang, pick): ``pick`` a stable hash that samples and orders rows.

    Rows without language, or whose text has no letter, teach nothing. Counts cover all rows;
    only they (at most 2^BITS numbers) and the weights reach the driver. The sample holds
    about ``per_language`` rows of each language, a fifth of them for the temperature, and is
    fitted in one task whose size that parameter bounds.
    """
    rows = docs.where("lang IS NOT NULL AND text IS NOT NULL")
    per = {r["lang"]: r["count"] for r in rows.groupBy("lang").count().collect()}
    languages = sorted(per)

    def frequencies(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        df, n = np.zeros(1 << BITS, np.int64), 0
        for batch in batches:
            for _, texts in slices(batch.column("text")):
                for t in texts:
                    df += counts(t) > 0
                    n += 1
        idx = np.flatnonzero(df)
        yield pa.RecordBatch.from_pydict({"f": pa.array([-1, *idx.tolist()], pa.int32()),
                                          "n": pa.array([n, *df[idx].tolist()], pa.int64())})

    found = rows.select("text").mapInArrow(frequencies, "f int, n long").groupBy("f").agg(F.sum("n")).toPandas()
    total = {int(f): int(n) for f, n in found.itertuples(index=False)}
    n_docs = total.pop(-1, 0)
    df = np.zeros(1 << BITS)
    df[list(total)] = list(total.values())
    idf = np.log((1 + n_docs) / (1 + df)) + 1
    known = df >= max(1.0, min(2.0, n_docs / 50), n_docs / RARE)
    if not languages:
        return Model([], idf, np.zeros((0, (1 << BITS) + 1)), 1.0)

    share = F.lit(0)
    for name in languages:
        share = F.when(F.col("lang") == name, F.lit(min(1.0, per_language / per[name]))).otherwise(share)
    picked = rows.where(F.pmod("pick", F.lit(1 << 20)) < share * (1 << 20)).select("text", "lang", "pick")

    def features(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for t, lang, pick in zip(*(batch.column(c).to_pylist() for c in ("text", "lang", "pick")), strict=True):
                if has_letter(t):
                    n = counts(t)
                    idx = np.flatnonzero(n)
                    yield pa.RecordBatch.from_pydict({
                        "pick": [pick], "y": pa.array([languages.index(lang)], pa.int32()),
                        "idx": [idx.astype("<u2").tobytes()], "tf": [n[idx].astype("<u4").tobytes()]})

    def fit(part: pa.Table) -> pa.Table:
        part = part.sort_by([("pick", "ascending"), ("idx", "ascending"), ("y", "ascending")])
        data, held = [], []
        for pick, y, idx, tf in zip(*(part[c].to_pylist() for c in ("pick", "y", "idx", "tf")), strict=True):
            idx = np.frombuffer(idx, "<u2").astype(np.int64)
            x = _unit(idx, np.frombuffer(tf, "<u4"), idf)
            # The intercept is a feature of its own.
            (held if (pick >> 20) % 5 == 0 else data).append((np.append(idx, 1 << BITS), np.append(x, 1.0), y))
        w = fit_ftrl(data or held, len(languages))
        logits = np.array([w[:, i] @ x for i, x, _ in held]).reshape(-1, len(languages))
        t = fit_temperature(logits, np.array([y for _, _, y in held], np.int64))
        return pa.table({"y": pa.array(range(len(w)), pa.int32()), "t": pa.array([t] * len(w)),
                         "w": pa.array([r.astype("<f4").tobytes() for r in w], pa.binary())})

    sample = picked.mapInArrow(features, "pick long, y int, idx binary, tf binary")
    fitted = sample.groupBy(F.lit(0).alias("all")).applyInArrow(fit, "y int, t double, w binary").collect()
    weights = np.zeros((len(languages), (1 << BITS) + 1), np.float32)
    temperature = 1.0
    for y, temperature, w in fitted:
        weights[y] = np.frombuffer(w, "<f4")
    return Model(languages if fitted else [], idf.astype(np.float32), weights, temperature, known)


def held_out(doc_id: Column) -> Column:
    """Documents nothing is learned from: crc32(doc_id as text) mod 4 is 2."""
    return F.coalesce(F.crc32(doc_id.cast("string").cast("binary")) % 4 == 2, F.lit(False))


def learnable(docs: DataFrame) -> DataFrame:
    """text, lang, pick of the rows that may be learned from (a null doc_id never is)."""
    rows = docs.where(F.col("doc_id").isNotNull() & ~held_out(F.col("doc_id")))
    return rows.select("text", "lang", F.xxhash64("doc_id").alias("pick"))


def identify(docs: DataFrame, model: Model) -> DataFrame:
    """``docs`` with lang_pred and score; only ``text`` is looked at.

    Columns of these names are replaced. A null text, or one without any letter, is ``und``
    with score 0, as is every text where the model has learned no language. A text in a language
    that was not learned has a low score, near 0 in another script.
    """
    kept = docs.drop("lang_pred", "score")
    schema = T.StructType([*kept.schema, T.StructField("lang_pred", T.StringType()),
                           T.StructField("score", T.DoubleType())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            names, scores = model.predict(batch.column("text").to_pylist())
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(names, pa.string()), pa.array(scores, pa.float64())],
                                             names=[*batch.schema.names, "lang_pred", "score"])

    return kept.mapInArrow(run, schema)


def op5_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    found = identify(docs.select("doc_id", "text"), train(learnable(docs)))
    return found.select("doc_id", held_out(F.col("doc_id")).alias("held_out"), "lang_pred", "score")


QUERIES = {"op5_language_id": op5_language_id}
ORACLE_SQL = {}
