"""Sum-of-squares online packing of documents into windows of fixed length.

Documents are spread over shards by a hash of their id; every shard packs its
documents one by one in order of id. A level array N counts the open windows
by fill level. A document of s tokens goes to the level h (0: a new window)
for which the sum of N(l)^2 over the partly filled levels is smallest
afterwards; of equal ones, to the fullest. Shards need nothing of one another.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from verbatrix.llm import common, tokens

WINDOW = 2048
#: Documents a shard has on average; a shard's last open windows are all that stays partly filled.
SHARD_DOCS = 32768
RESULT = "doc_id bigint, piece int, token_start bigint, n_tokens int, window bigint, window_offset int"


class LevelArray:
    """Windows of ``capacity`` tokens that one shard packs."""

    def __init__(self, capacity: int):
        self.capacity, self.made = capacity, 0
        self.count = np.zeros(capacity + 1, np.int64)
        self.open: list[list[int]] = [[] for _ in range(capacity + 1)]

    def place(self, size: int) -> tuple[int, int]:
        """Window and offset for ``size`` tokens, 1 to capacity."""
        full = self.capacity - size
        if size == self.capacity:
            self.made += 1
            return self.made - 1, 0
        n = self.count
        # change of the sum of squares, halved and less 1, for a move from level h to h + size
        change = (n[size:] - n[: full + 1]).astype(np.float64)
        change[n[: full + 1] == 0] = np.inf
        change[0] = n[size] - 0.5
        if n[full]:
            change[full] -= 0.5
        level = full - int(np.argmin(change[::-1]))
        if level == 0:
            window, self.made = self.made, self.made + 1
        else:
            window = self.open[level].pop()
            n[level] -= 1
        if level + size < self.capacity:
            self.open[level + size].append(window)
            n[level + size] += 1
        return window, level


def pieces_of(n_tokens: int, capacity: int) -> list[tuple[int, int]]:
    """(start, size): whole windows, then what is left of a document."""
    return [(s, min(capacity, n_tokens - s)) for s in range(0, n_tokens, capacity)]


def _count(path: str):
    def run(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        count = tokens.tokenizer(path).count
        for batch in it:
            for part in common.batches_of(iter([batch]), "text"):
                n = [count(x) if x else 0 for x in part.column("text").to_pylist()]
                yield pa.RecordBatch.from_arrays([part.column("doc_id"), pa.array(n, pa.int64())], ["doc_id", "n_tokens"])

    return run


def _pack(capacity: int):
    def run(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        at, levels = None, None
        for batch in it:
            out: list[tuple] = []
            for shard, doc, n in zip(*(batch.column(c).to_pylist() for c in ("shard", "doc_id", "n_tokens"))):
                if shard != at:
                    at, levels = shard, LevelArray(capacity)
                if not n:
                    out.append((doc, 0, 0, 0, None, None))
                for piece, (start, size) in enumerate(pieces_of(n, capacity)):
                    window, offset = levels.place(size)
                    out.append((doc, piece, start, size, shard << 40 | window, offset))
            if out:
                kinds = (pa.int64(), pa.int32(), pa.int64(), pa.int32(), pa.int64(), pa.int32())
                yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*out), kinds)], RESULT.replace(" bigint", "").replace(" int", "").split(", "))

    return run


def pack(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", window: int = WINDOW, shard_docs: int = SHARD_DOCS, vocabulary: str = tokens.VOCABULARY) -> DataFrame:
    """Rows ``doc_id, piece, token_start, n_tokens, window, window_offset``: where
    each piece of each document lies.

    A document of more than ``window`` tokens is cut into whole windows and a
    rest, its pieces. A null or empty text has no tokens: one row with
    ``n_tokens`` 0 and null window. Null ids are packed like others, first in
    their shard. Rows that repeat are packed once for each row; rows that share
    an id are ordered by their token count. No rows: no rows. Further columns
    of ``docs`` are not read.
    """
    spark = docs.sparkSession
    rows = docs.select(F.col(id_col).cast("bigint").alias("doc_id"), F.col(text_col).alias("text"))
    shards = max(1, -(-rows.count() // shard_docs))
    counted = rows.mapInArrow(_count(vocabulary), "doc_id bigint, n_tokens bigint")
    return (
        counted.withColumn("shard", F.pmod(F.xxhash64(F.lit(17), "doc_id"), F.lit(shards)))
        .repartitionById(min(shards, max(common.partitions(spark), 1)), F.pmod("shard", F.lit(min(shards, max(common.partitions(spark), 1)))).cast("int"))
        .sortWithinPartitions("shard", "doc_id", "n_tokens")
        .mapInArrow(_pack(window), RESULT)
    )


def op9_packing(spark, sf_dir: str) -> DataFrame:
    return pack(common.documents(spark, sf_dir))
