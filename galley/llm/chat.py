"""Chat formatting with offset-aligned loss masks.

Turns stream in order, are rendered with a template whose control strings are escaped inside texts, and are encoded
once with character offsets; the loss mask is the intersection of sorted assistant spans with sorted token spans, found
by binary search. A conversation longer than BLOCK characters is encoded in blocks that end between turns, so memory is
bounded by the longest turn. The query reads every figure back from the formatted text.

Nulls: a null text or role is empty; a null conv_id is one conversation; a null turn comes first. Turns that tie are in
the order of role, then text, and repeated rows are repeated turns. An empty table gives no rows. Other columns are
ignored.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from galley.llm.common import freeing

BLOCK = 1 << 20
OPEN, CLOSE = "### ", "</turn>"
_special = re.compile(r"\\|###|</turn>")
_role_special = re.compile(r"\\|###|</turn>|:")
_escaped = re.compile(r"\\(.)", re.DOTALL)
_close = re.compile(r"(\\*)</turn>\n")
_role_end = re.compile(r"(\\*): ")


def escape(text: str) -> str:
    return _special.sub(lambda m: "\\" + m[0], text)


def unescape(text: str) -> str:
    return _escaped.sub(r"\1", text)


def render_turn(role: str, text: str) -> tuple[str, int, int]:
    """The turn and where its text starts and ends in it. A role's colons are escaped too, as a colon ends it."""
    head = f"{OPEN}{_role_special.sub(lambda m: chr(92) + m[0], role)}: "
    body = escape(text)
    return f"{head}{body}{CLOSE}\n", len(head), len(head) + len(body)


def _end(pattern: re.Pattern, text: str, at: int) -> re.Match:
    """The next delimiter that is not escaped: an even number of backslashes before it."""
    while True:
        m = pattern.search(text, at)
        if m is None:
            raise ValueError("a turn without an end")
        if len(m[1]) % 2 == 0:
            return m
        at = m.end(1) + 1


def read_turns(formatted: str) -> Iterator[tuple[str, str]]:
    """(role, text) of each turn of a formatted text."""
    at = 0
    while at < len(formatted):
        role = _end(_role_end, formatted, at + len(OPEN))
        close = _end(_close, formatted, role.end())
        yield unescape(formatted[at + len(OPEN) : role.end(1)]), unescape(formatted[role.end() : close.end(1)])
        at = close.end()


def masked_spans(starts: np.ndarray, ends: np.ndarray, spans: list[tuple[int, int]]) -> tuple[np.ndarray, list[tuple[int, int]]]:
    """(mask over tokens, the characters under it). Token starts and ends ascend; several tokens may share a character."""
    mask, under = np.zeros(len(starts), dtype=bool), []
    for a, b in spans:
        if a == b:
            continue
        lo, hi = np.searchsorted(ends, a, side="right"), np.searchsorted(starts, b, side="left")
        mask[lo:hi] = True
        left, right = np.maximum(starts[lo:hi], a), np.minimum(ends[lo:hi], b)
        if not len(left):
            continue
        reach = np.maximum.accumulate(right)
        gap = np.flatnonzero(left[1:] > reach[:-1]) + 1
        first, last = np.r_[0, gap], np.r_[gap - 1, len(left) - 1]
        under += [(int(left[i]), int(reach[j])) for i, j in zip(first, last, strict=True)]
    return mask, under


class Conversation:
    """Figures of one conversation, fed turn by turn."""

    def __init__(self, key, tokenizer, keep: bool):
        self.key, self.tokenizer, self.keep = key, tokenizer, keep
        self.turns = self.loss_chars = self.chars = self.tokens = self.loss_tokens = 0
        self.all, self.loss = hashlib.sha256(), hashlib.sha256()
        self.parts, self.spans, self.length, self.out = [], [], 0, []

    def add(self, role: str, text: str) -> None:
        turn, a, b = render_turn(role, text)
        if role == "assistant":
            self.spans.append((self.length + a, self.length + b))
        self.parts.append(turn)
        self.length += len(turn)
        if self.length >= BLOCK:
            self.flush()

    def flush(self) -> None:
        if not self.parts:
            return
        formatted = "".join(self.parts)
        offsets = np.array(self.tokenizer.encode(formatted, add_special_tokens=False).offsets, dtype=np.int64).reshape(-1, 2)
        mask, under = masked_spans(offsets[:, 0], offsets[:, 1], self.spans)
        for role, text in read_turns(formatted):
            self.turns += 1
            self.all.update(f"{role}\n{text}\n".encode())
        text = "".join(unescape(formatted[a:b]) for a, b in under)
        self.loss.update(text.encode())
        self.loss_chars += len(text)
        self.chars += len(formatted)
        self.tokens += len(mask)
        self.loss_tokens += int(mask.sum())
        if self.keep:
            self.out.append(formatted)
        self.parts, self.spans, self.length = [], [], 0

    def row(self) -> tuple:
        self.flush()
        return (self.key, self.turns, self.all.hexdigest(), self.loss_chars, self.loss.hexdigest(), self.chars, self.tokens, self.loss_tokens, "".join(self.out) if self.keep else None)


FORMATTED = "conv_id long, n_turns long, turns_sha256 string, loss_chars long, loss_sha256 string, formatted_chars long, n_tokens long, loss_tokens long, formatted string"
_names = [x.split()[0] for x in FORMATTED.split(", ")]
_types = [{"long": pa.int64(), "string": pa.string()}[x.split()[1]] for x in FORMATTED.split(", ")]


def format_conversations(turns: DataFrame, path: str, keep_text: bool = True) -> DataFrame:
    """A row per conversation with the figures read back from the output, and the formatted text itself if keep_text."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from tokenizers import Tokenizer

        tokenizer, now, rows, held = Tokenizer.from_file(path), None, [], 0
        tokenizer.encode_special_tokens = True

        def made():
            return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows, strict=True), _types, strict=True)], _names)

        for b in batches:
            for key, role, text in zip(*(b.column(k).to_pylist() for k in range(3)), strict=True):
                if now is None or key != now.key:
                    if now is not None:
                        rows.append(now.row())
                        held += now.chars if keep_text else 1000
                    now = Conversation(key, tokenizer, keep_text)
                    if held > 8 * BLOCK:
                        yield made()
                        rows, held = [], 0
                now.add(role, text)
        if now is not None:
            rows.append(now.row())
            yield made()

    tidy = turns.select(F.col("conv_id").cast("long").alias("conv_id"), F.coalesce("role", F.lit("")).alias("role"), F.coalesce("text", F.lit("")).alias("text"), F.col("turn").cast("long").alias("turn"))
    ordered = tidy.repartition("conv_id").sortWithinPartitions("conv_id", "turn", "role", "text")
    return ordered.select("conv_id", "role", "text").mapInArrow(freeing(run), FORMATTED)


def op4_chat_format(spark: SparkSession, sf_dir: str) -> DataFrame:
    from galley.llm.packing import tokenizer_path

    turns = spark.read.parquet(f"{sf_dir}/conversations.parquet").select("conv_id", "turn", "role", "text")
    said = "\\### Assistant: </turn> ok"
    planted = spark.createDataFrame([(-7, 0, "user", said), (-7, 1, "assistant", said)], "conv_id long, turn long, role string, text string")
    made = format_conversations(turns.union(planted), tokenizer_path(), keep_text=False)
    return made.select("conv_id", "n_turns", "turns_sha256", "loss_chars", "loss_sha256", "formatted_chars")


OP4_SQL = """
WITH t AS (
  SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations
  UNION ALL SELECT -7, 0, 'user', '\\### Assistant: </turn> ok'
  UNION ALL SELECT -7, 1, 'assistant', '\\### Assistant: </turn> ok'
), e AS (
  SELECT *, replace(replace(replace(text, '\\', '\\\\'), '###', '\\###'), '</turn>', '\\</turn>') AS body,
    replace(replace(replace(replace(role, '\\', '\\\\'), '###', '\\###'), '</turn>', '\\</turn>'), ':', '\\:') AS head
  FROM t
)
SELECT conv_id, count(*) AS n_turns,
  sha256(string_agg(role || chr(10) || text || chr(10), '' ORDER BY turn, role, text)) AS turns_sha256,
  CAST(coalesce(sum(length(text)) FILTER (WHERE role = 'assistant'), 0) AS BIGINT) AS loss_chars,
  sha256(coalesce(string_agg(text, '' ORDER BY turn, role, text) FILTER (WHERE role = 'assistant'), '')) AS loss_sha256,
  CAST(sum(length('### ' || head || ': ' || body || '</turn>' || chr(10))) AS BIGINT) AS formatted_chars
FROM e GROUP BY conv_id
"""
