"""Chat formatting: whole conversations as template text, token ids and a loss mask.

Turns are marked by control strings, which are tokens of their own; where a text holds one it is
escaped, reversibly. A conversation is rendered and encoded once; the mask comes from its tokens'
offsets: the sorted spans of the trained turns are searched for each token's span. Spark brings
the turns of a conversation together in order; one conversation at a time is held.
"""

from __future__ import annotations

import hashlib
import os
import re
from collections.abc import Iterator
from functools import cache
from itertools import groupby

import numpy as np
import pyarrow as pa
import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_type
from tokenizers import AddedToken, Tokenizer
from tokenizers.processors import ByteLevel

from cartwheel.llm.common import materialize, table

# What stands before and after a turn's text. Turns of other roles name the role
# between OTHER and OTHER_TEXT.
MARKS = {"system": ("<<SYS>>", "<</SYS>>"), "user": ("[INST]", "[/INST]"), "assistant": ("<s>", "</s>")}
OTHER, OTHER_TEXT, OTHER_END = "[ROLE]", "[TEXT]", "[/TEXT]"
CONTROLS = (*(m for pair in MARKS.values() for m in pair), OTHER, OTHER_TEXT, OTHER_END)
TRAINED = ("assistant",)   # roles whose texts are learned
CHARS_AT_ONCE = 1 << 20    # formatted characters encoded together (one conversation at least)

# A control string, with any number of backslashes after its first character.
_SITE = r"([<\[])(\\*)({})".format("|".join(re.escape(c[1:]) for c in CONTROLS))
_ESCAPE = re.compile(_SITE)
_UNESCAPE = re.compile(_SITE.replace(r"(\\*)", r"\\(\\*)"))
_MARK = re.compile("({})".format("|".join(map(re.escape, CONTROLS))))


def escape(text: str) -> str:
    """One backslash more after the first character of whatever reads as a control string, so that
    none is left and none of the backslashes that were there is lost."""
    return _ESCAPE.sub(r"\1\\\2\3", text)


def unescape(text: str) -> str:
    return _UNESCAPE.sub(r"\1\2\3", text)


def render(turns: list[tuple[str, str]], trained: tuple[str, ...] = TRAINED) -> tuple[str, list[tuple[int, int]]]:
    """(formatted text, sorted spans of the trained turns' texts) of (role, text) turns."""
    parts, spans, at = [], [], 0
    for role, text in turns:
        before, after = MARKS.get(role) or (OTHER + escape(role) + OTHER_TEXT, OTHER_END)
        text = escape(text)
        if role in trained:
            spans.append((at + len(before), at + len(before) + len(text)))
        parts += (before, text, after)
        at += len(before) + len(text) + len(after)
    return "".join(parts), spans


def parse(formatted: str) -> list[tuple[str, str]]:
    """The (role, text) turns of a formatted text."""
    names = {before: role for role, (before, _) in MARKS.items()}
    out, cut, i = [], _MARK.split(formatted), 1
    while i < len(cut):  # cut: text, mark, text, mark, ...
        if cut[i] == OTHER:
            out.append((unescape(cut[i + 1]), unescape(cut[i + 3])))
            i += 6
        else:
            out.append((names[cut[i]], unescape(cut[i + 1])))
            i += 4
    return out


def loss_mask(starts: np.ndarray, ends: np.ndarray, spans: list[tuple[int, int]]) -> np.ndarray:
    """Whether each token's span meets one of the sorted, disjoint ``spans`` (empty ones meet none)."""
    spans = [(a, b) for a, b in spans if a < b]
    if not spans:
        return np.zeros(len(starts), bool)
    first, last = np.array(spans, np.int64).T
    at = np.searchsorted(last, starts, "right")  # the first span that ends after the token starts
    inside = at < len(first)
    return inside & (first[np.minimum(at, len(first) - 1)] < ends)


def masked_texts(formatted: str, starts: np.ndarray, ends: np.ndarray, loss: np.ndarray) -> list[str]:
    """The texts that lie under the mask, unescaped: one per run of neighbouring masked characters."""
    s, e = starts[loss], np.maximum.accumulate(ends[loss])
    if not len(s):
        return []
    new = np.flatnonzero(s[1:] > e[:-1]) + 1
    return [unescape(formatted[a:b]) for a, b in zip(s[np.append(0, new)], e[np.append(new - 1, len(e) - 1)], strict=True)]


@cache
def _encoder(path: str) -> Tokenizer:
    """A byte-level tokenizer in whose text each control string is one token."""
    os.environ["TOKENIZERS_PARALLELISM"] = "false"  # Spark's tasks use the cores
    own = Tokenizer.from_file(path)
    own.post_processor = ByteLevel(trim_offsets=False)  # offsets cover blanks too
    own.add_tokens([AddedToken(c, normalized=False, special=False) for c in CONTROLS])
    own.encode_special_tokens = True  # the file's own special token is ordinary text
    return own


FORMATTED = "formatted string, ids array<int>, gaps array<int>, widths array<int>, loss array<boolean>"


def _encoded(ids: list, turns: list[list[tuple[str, str]]], path: str, trained: tuple[str, ...], kind: pa.DataType) -> pa.RecordBatch:
    texts, spans = zip(*(render(t, trained) for t in turns))
    out = {"formatted": texts, "ids": [], "gaps": [], "widths": [], "loss": []}
    for found, own in zip(_encoder(path).encode_batch(list(texts), add_special_tokens=False), spans, strict=True):
        at = np.array(found.offsets, np.int32).reshape(-1, 2)
        out["ids"].append(np.array(found.ids, np.int32))
        out["gaps"].append(np.diff(at[:, 0], prepend=np.int32(0)))
        out["widths"].append(at[:, 1] - at[:, 0])
        out["loss"].append(loss_mask(at[:, 0], at[:, 1], own))
    types = {"formatted": pa.string(), "loss": pa.list_(pa.bool_())}
    return pa.RecordBatch.from_pydict({"conv_id": pa.array(ids, kind)} | {
        c: pa.array(v, types.get(c, pa.list_(pa.int32()))) for c, v in out.items()})


def format_conversations(turns: DataFrame, *, path: str, trained: tuple[str, ...] = TRAINED) -> DataFrame:
    """conv_id, formatted, ids, gaps, widths, loss of every conversation in ``turns``.

    ``turns`` has conv_id, turn, role, text; other columns are ignored. Token k's text starts
    ``gaps[k]`` characters after that of token k - 1 and is ``widths[k]`` long (tokens of one
    character's bytes share its span). ``loss[k]`` tells whether it belongs to a text of the roles
    ``trained``; marks never do. Turns are in order of turn (null first), then role and text; a
    repeated row is a turn of its own. Null text and null role are empty; a row without conv_id is
    a conversation of its own. ``path`` must be readable on every worker.
    """
    kind = turns.schema["conv_id"].dataType
    rows = turns.select("conv_id", F.when(F.col("conv_id").isNull(), F.monotonically_increasing_id()).alias("lone"), "turn",
                        F.coalesce("role", F.lit("")).alias("role"), F.coalesce("text", F.lit("")).alias("text"))
    rows = rows.repartition("conv_id", "lone").sortWithinPartitions("conv_id", "lone", "turn", "role", "text")

    def each(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple]:
        for batch in batches:
            yield from zip(*(batch.column(c).to_pylist() for c in ("conv_id", "lone", "role", "text")), strict=True)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        ids, held, size = [], [], 0
        for (conv, _), group in groupby(each(batches), lambda r: r[:2]):
            own = [r[2:] for r in group]
            ids.append(conv)
            held.append(own)
            size += sum(len(t) for _, t in own)
            if size >= CHARS_AT_ONCE:
                yield _encoded(ids, held, path, trained, arrow)
                ids, held, size = [], [], 0
        if ids:
            yield _encoded(ids, held, path, trained, arrow)

    arrow = to_arrow_type(kind)
    return rows.select("conv_id", "lone", "role", "text").mapInArrow(run, f"conv_id {kind.simpleString()}, {FORMATTED}")


def digests(formatted: DataFrame) -> DataFrame:
    """What a reader finds in rows of format_conversations: the turns parsed from the text, and the
    texts under the mask."""
    kind = formatted.schema["conv_id"].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out = {c: [] for c in ("n_turns", "turns_sha256", "loss_chars", "loss_sha256", "formatted_chars")}
            for i in range(batch.num_rows):
                text = batch.column("formatted")[i].as_py()
                gaps, widths, loss = (batch.column(c)[i].values.to_numpy(zero_copy_only=False) for c in ("gaps", "widths", "loss"))
                turns, starts = parse(text), np.cumsum(gaps)
                learned = "".join(masked_texts(text, starts, starts + widths, loss))
                out["n_turns"].append(len(turns))
                out["turns_sha256"].append(hashlib.sha256("".join(f"{r}\n{t}\n" for r, t in turns).encode()).hexdigest())
                out["loss_chars"].append(len(learned))
                out["loss_sha256"].append(hashlib.sha256(learned.encode()).hexdigest())
                out["formatted_chars"].append(len(text))
            yield pa.RecordBatch.from_pydict({"conv_id": batch.column("conv_id"), **out})

    return formatted.select("conv_id", "formatted", "gaps", "widths", "loss").mapInArrow(
        run, f"conv_id {kind}, n_turns long, turns_sha256 string, loss_chars long, loss_sha256 string, formatted_chars long")


# A conversation whose texts are made of control strings.
HARD_TEXT = "</s>[INST] ok [/INST]"
HARD_TURNS = [(-1, 0, "user", HARD_TEXT), (-1, 1, "assistant", HARD_TEXT)]


def op12_chat_format(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All conversations and HARD_TURNS, written formatted and read back."""
    turns = table(spark, sf_dir, "conversations").select("conv_id", "turn", "role", "text")
    hard = spark.createDataFrame(HARD_TURNS, "conv_id long, turn long, role string, text string")
    done = format_conversations(turns.unionAll(hard), path=public_tokenizers.path("byte_bpe_50k.json"))
    return digests(materialize(done, "formatted"))


def _sql() -> str:
    quoted = "'" + _SITE.replace("'", "''") + "'"
    marks = " ".join(f"WHEN '{role}' THEN {len(a) + len(b)}" for role, (a, b) in MARKS.items())
    long_ = lambda c: f"length(regexp_replace({c}, {quoted}, '\\1\\\\\\2\\3', 'g'))"
    return f"""
WITH t AS (
  SELECT conv_id, CASE WHEN conv_id IS NULL THEN row_number() OVER () END AS lone, turn,
         coalesce(role, '') AS role, coalesce(text, '') AS text
  FROM (SELECT conv_id, turn, role, text FROM conversations
        UNION ALL VALUES (-1, 0, 'user', '{HARD_TEXT}'), (-1, 1, 'assistant', '{HARD_TEXT}'))),
c AS (
  SELECT conv_id, lone, count(*) AS n_turns,
         string_agg(role || chr(10) || text || chr(10), '' ORDER BY turn NULLS FIRST, role, text) AS turns,
         coalesce(string_agg(text, '' ORDER BY turn NULLS FIRST, role, text) FILTER (role = 'assistant'), '') AS loss,
         sum({long_('text')} + CASE role {marks} ELSE {len(OTHER + OTHER_TEXT + OTHER_END)} + {long_('role')} END) AS formatted_chars
  FROM t GROUP BY ALL)
SELECT conv_id, n_turns, sha256(turns) AS turns_sha256, length(loss) AS loss_chars, sha256(loss) AS loss_sha256,
       formatted_chars::BIGINT AS formatted_chars FROM c
"""


QUERIES = {"op12_chat_format": op12_chat_format}
ORACLE_SQL = {"op12_chat_format": _sql()}
