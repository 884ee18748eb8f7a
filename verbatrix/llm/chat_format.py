"""Chat formatting with token masks aligned by offsets.

A conversation is rendered as one string whose turns' byte spans are known,
the string is encoded once, and the tokens' byte spans follow from the sizes
of byte-level tokens, which tile the text. Both lists of spans are sorted, so
the tokens that meet the spans to be trained on are found by binary search.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from verbatrix.llm import tokens

OPEN, MIDDLE, CLOSE, BETWEEN = "<|im_start|>", "\n", "<|im_end|>", "\n"
TRAINED = ("assistant",)
RESULT = "conv_id bigint, n_turns int, n_tokens int, n_trained int, token_ids array<int>, mask array<int>"


def render(turns: list[tuple[str, str]], trained: tuple[str, ...] = TRAINED) -> tuple[bytes, np.ndarray]:
    """UTF-8 text of (role, text) turns and the (n, 2) byte spans to be trained
    on: the text and the closing mark of each turn of a trained role. A mark
    within a turn's own role or text is broken by a zero-width space, so that it can't pass for a turn's end."""
    out, spans, at = [], [], 0
    for role, text in turns:
        role, text = (x.replace("<|im_", "<\u200b|im_") for x in (role, text))
        head, body = f"{OPEN}{role}{MIDDLE}".encode(), f"{text}{CLOSE}".encode()
        if role in trained:
            spans.append((at + len(head), at + len(head) + len(body)))
        out += [head, body, BETWEEN.encode()]
        at += len(head) + len(body) + len(BETWEEN)
    return b"".join(out), np.array(spans, np.int64).reshape(-1, 2)


def mask_of(token_ends: np.ndarray, spans: np.ndarray) -> np.ndarray:
    """1 for each token that shares a byte with a span. Both are in order."""
    mask = np.zeros(len(token_ends) + 1, np.int32)
    if len(spans):
        starts = np.r_[0, token_ends[:-1]] if len(token_ends) else token_ends
        first = np.searchsorted(token_ends, spans[:, 0], side="right")
        last = np.searchsorted(starts, spans[:, 1], side="left")
        np.add.at(mask, first, 1)
        np.add.at(mask, np.maximum(first, last), -1)
    return (np.cumsum(mask)[:-1] > 0).astype(np.int32)


def _encode(path: str, trained: tuple[str, ...]):
    names = [x.split()[0] for x in RESULT.split(", ")]

    def lists(parts: list[np.ndarray]) -> pa.Array:
        offsets = np.r_[0, np.cumsum([len(p) for p in parts])].astype(np.int32)
        return pa.ListArray.from_arrays(pa.array(offsets), pa.array(np.concatenate(parts).astype(np.int32)))

    def run(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tok = tokens.tokenizer(path)
        for batch in it:
            talks = batch.column("talk")
            # as many conversations at once as have about a megabyte of text
            sizes = np.r_[0, np.cumsum(pc.binary_length(talks.flatten().field("text")).to_numpy(zero_copy_only=False))]
            ends, start = sizes[np.cumsum(pc.list_value_length(talks).to_numpy(zero_copy_only=False))], 0
            while start < batch.num_rows:
                room = (ends[start - 1] if start else 0) + (1 << 20)
                part = batch.slice(start, max(1, int(np.searchsorted(ends, room, side="right")) - start))
                start += part.num_rows
                ids, masks, turns = [], [], []
                for talk in part.column("talk").to_pylist():
                    data, spans = render([(t["role"], t["text"]) for t in talk], trained)
                    own = np.array(tok.encode(data.decode()), np.int32)
                    ids.append(own)
                    masks.append(mask_of(np.cumsum(tok.size[own]), spans))
                    turns.append(len(talk))
                yield pa.RecordBatch.from_arrays(
                    [part.column("conv_id"), pa.array(turns, pa.int32()), pa.array([len(x) for x in ids], pa.int32()), pa.array([int(m.sum()) for m in masks], pa.int32()), lists(ids), lists(masks)], names
                )

    return run


def format_chats(turns: DataFrame, trained: tuple[str, ...] = TRAINED, vocabulary: str = tokens.VOCABULARY) -> DataFrame:
    """One row for each conversation of ``turns`` (conv_id, turn, role, text):
    ``conv_id, n_turns, n_tokens, n_trained, token_ids, mask``.

    Turns go by ``turn``, null first, then by role and text. Rows that repeat
    whole are one turn. A null role is the role ``unknown``, a null text is
    empty. Rows with null ``conv_id`` belong to no conversation and are left
    out. A conversation without a turn of a trained role has a mask of zeros.
    No rows: no rows. Further columns are not read.
    """
    turn = F.struct(F.col("turn").cast("bigint").alias("turn"), F.coalesce("role", F.lit("unknown")).alias("role"), F.coalesce("text", F.lit("")).alias("text"))
    talks = turns.where("conv_id is not null").groupBy(F.col("conv_id").cast("bigint").alias("conv_id")).agg(F.sort_array(F.collect_set(turn)).alias("talk"))
    return talks.mapInArrow(_encode(vocabulary, trained), RESULT)


def op4_chat_format(spark, sf_dir: str) -> DataFrame:
    return format_chats(spark.read.parquet(f"{sf_dir}/conversations.parquet"))
