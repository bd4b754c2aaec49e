"""Chat conversations as token ids with a loss mask on the assistant's texts.

A conversation is rendered whole: ``<s>``, then for each turn ``[INST] role [/INST] text </s>`` without the blanks.
Control strings inside roles and texts are escaped: backslashes are doubled and a backslash goes behind a control
string's first character, so dropping each backslash and keeping the character behind it restores the text.  The
control strings are special tokens of their own, hence no token lies across a turn's edge.  The rendering is encoded
once, with character offsets; the sorted spans of the assistant's texts are met with the sorted token spans by binary
search, and every token that lies in one is under the loss.

Turns are ordered by turn, then role, then text.  One conversation is one sequence and is rendered in one task.

Cases: null role or text is empty; a row without a conv_id is a conversation of its own; repeated rows are repeated
turns; an empty table gives no rows.
"""

from __future__ import annotations

import os
import re
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# The template's marks, and the tokenizer's own control string.
BEGIN, OPEN, CLOSE, END = "<s>", "[INST]", "[/INST]", "</s>"
CONTROL = (BEGIN, OPEN, CLOSE, END, "<|endoftext|>")
IS_CONTROL = re.compile("|".join(map(re.escape, CONTROL)))
ESCAPED = re.compile(r"\\(.)", re.DOTALL)
LEARNED = "assistant"
RENDERED = "struct<formatted:string,ids:array<int>,ends:array<int>,loss:array<boolean>>"
READ = "struct<roles:array<string>,texts:array<string>,learned:string>"


def escape(text: str) -> str:
    return IS_CONTROL.sub(lambda m: m[0][0] + "\\" + m[0][1:], text.replace("\\", "\\\\"))


def unescape(text: str) -> str:
    return ESCAPED.sub(r"\1", text)


def render(turns: list[tuple[str, str]]) -> tuple[str, list[tuple[int, int]]]:
    """The formatted conversation and the spans of the assistant's texts."""
    parts, at, spans = [BEGIN], len(BEGIN), []
    for role, text in turns:
        head, body = OPEN + escape(role) + CLOSE, escape(text)
        at += len(head)
        if role == LEARNED and body:
            spans.append((at, at + len(body)))
        at += len(body) + len(END)
        parts += [head, body, END]
    return "".join(parts), spans


def default_tokenizer() -> str:
    import public_tokenizers

    return public_tokenizers.path("byte_bpe_50k.json")


@lru_cache(maxsize=2)
def _tokenizer(path: str):
    os.environ["TOKENIZERS_PARALLELISM"] = "false"
    from tokenizers import AddedToken, Tokenizer, processors

    tokenizer = Tokenizer.from_file(path)
    tokenizer.post_processor = processors.ByteLevel(trim_offsets=False)
    tokenizer.add_special_tokens([AddedToken(x, normalized=False, special=True) for x in CONTROL])
    return tokenizer


def loss_mask(ends: np.ndarray, spans: list[tuple[int, int]]) -> np.ndarray:
    """Whether each token (they tile the text; ``ends`` are sorted) has a character in one of the sorted spans."""
    if not spans or not len(ends):
        return np.zeros(len(ends), bool)
    first, last = np.array(spans).T
    begins = np.concatenate([[0], ends[:-1]])
    begins = np.minimum(begins, ends - 1)  # tokens that share a character begin in it
    at = np.searchsorted(last, begins, "right")
    return (at < len(last)) & (first[np.minimum(at, len(last) - 1)] < ends)


def _rendered(path: str | None):
    def work(turns: pa.Array) -> pa.Array:
        tokenizer = _tokenizer(path or default_tokenizer())
        formatted, ids, ends, masks = [], [], [], []
        for conversation in turns:
            text, spans = render([(t["role"] or "", t["text"] or "") for t in conversation.as_py() or []])
            got = tokenizer.encode(text, add_special_tokens=False)
            end = np.maximum.accumulate(np.array([b for _, b in got.offsets], np.int32)) if len(got) else np.zeros(0, np.int32)
            formatted.append(text)
            ids.append(np.array(got.ids, np.int32))
            ends.append(end)
            masks.append(loss_mask(end, spans))
        return pa.StructArray.from_arrays(
            [pa.array(formatted, pa.string()), pa.array(ids, pa.list_(pa.int32())), pa.array(ends, pa.list_(pa.int32())),
             pa.array(masks, pa.list_(pa.bool_()))], names=["formatted", "ids", "ends", "loss"])
    return work


def formatted(rows: DataFrame, conv_col: str = "conv_id", turn_col: str = "turn", role_col: str = "role",
              text_col: str = "text", *, path: str | None = None) -> DataFrame:
    """One row per conversation: conv_col, formatted, ids, ends (character after each token), loss (mask over the ids)."""
    @F.arrow_udf(RENDERED)
    def rendered(turns: pa.Array) -> pa.Array:
        return _rendered(path)(turns)

    own = F.when(F.col(conv_col).isNull(), F.monotonically_increasing_id())
    turns = (rows.select(F.col(conv_col).alias("conv"), own.alias("own"), F.struct(
        F.col(turn_col).alias("turn"), F.col(role_col).cast("string").alias("role"), F.col(text_col).cast("string").alias("text")).alias("t"))
        .groupBy("conv", "own").agg(F.array_sort(F.collect_list("t")).alias("turns")))
    return turns.withColumn("out", rendered("turns")).select(F.col("conv").alias(conv_col), "out.*")


def parse(text: str) -> list[tuple[str, str]]:
    """The turns of a formatted conversation."""
    marks = [(m.start(), m.end(), m[0]) for m in IS_CONTROL.finditer(text)]
    out, role, at = [], "", 0
    for begin, end, mark in marks:
        if mark == CLOSE:
            role = unescape(text[at:begin])
        elif mark == END:
            out.append((role, unescape(text[at:begin])))
        at = end
    return out


def learned_text(text: str, ends: np.ndarray, mask: np.ndarray) -> str:
    """What is under the loss, unescaped: runs of masked tokens, cut out by their offsets."""
    begins = np.minimum(np.concatenate([[0], ends[:-1]]), ends - 1) if len(ends) else ends
    edges = np.flatnonzero(np.diff(np.concatenate([[0], mask.astype(np.int8), [0]])))
    return "".join(unescape(text[begins[a]:ends[b - 1]]) for a, b in zip(edges[::2], edges[1::2]))


def read_back(text: Column, ends: Column, loss: Column) -> Column:
    """Struct column: roles, texts, and the text under the loss mask, from the operator's output."""
    @F.arrow_udf(READ)
    def read(texts: pa.Array, ends: pa.Array, masks: pa.Array) -> pa.Array:
        roles, bodies, learned = [], [], []
        for text, end, mask in zip(texts.to_pylist(), ends, masks):
            turns = parse(text)
            roles.append([r for r, _ in turns])
            bodies.append([t for _, t in turns])
            learned.append(learned_text(text, np.asarray(end.values, np.int64), np.asarray(mask.values.to_numpy(zero_copy_only=False), bool)))
        return pa.StructArray.from_arrays([pa.array(roles, pa.list_(pa.string())), pa.array(bodies, pa.list_(pa.string())),
                                           pa.array(learned, pa.string())], names=["roles", "texts", "learned"])
    return read(text, ends, loss)
