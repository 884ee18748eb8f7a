"""The most similar sets of each set, by search instead of by a join of pairs.

Every set is held against every other, but no pair of sets leaves the task that
compares them: a task holds a block of the sets that are asked for, reads all sets
from the shared folder in chunks, and counts common items along the chunk's
postings. Memory is a block and a chunk, what is written are a few rows for each
set asked for. The time is that of all pairs.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.parquet as pq
from pyarrow import fs as pafs
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Sets of a chunk and of a block at most, about.
CHUNK, BLOCK = 1 << 13, 1 << 11
NEAR = "x long, y long, score double"


def _lists(batch: pa.RecordBatch) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Ordinals, sizes and all items of (ordinal, items)."""
    items = batch.column(1)
    return batch.column(0).to_numpy(), items.value_lengths().to_numpy(zero_copy_only=False).astype(np.int64), items.flatten().to_numpy(zero_copy_only=False)


def _chunks(files: list[str], size: int) -> Iterator[pa.RecordBatch]:
    for uri in files:
        system, path = pafs.FileSystem.from_uri(uri)
        with system.open_input_file(path) as f:
            yield from pq.ParquetFile(f).iter_batches(size, columns=["ordinal", "items"])


def _search(files: list[str], least: float, most: int, chunk: int) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    def run(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = [_lists(b) for b in it if b.num_rows]
        if not own:
            return
        ordinal, sizes, flat = (np.concatenate(c) for c in zip(*own, strict=True))
        ends = np.cumsum(sizes)
        best = [(np.zeros(0), np.zeros(0, np.int64))] * len(ordinal)
        floor = np.full(len(ordinal), least)
        for batch in _chunks(files, chunk):
            y, y_sizes, y_flat = _lists(batch)
            if not len(y_flat):
                continue
            order = np.argsort(y_flat, kind="stable")
            rows = np.repeat(np.arange(len(y)), y_sizes)[order]
            known, begin = np.unique(y_flat[order], return_index=True)
            stop = np.append(begin[1:], len(rows)).tolist()
            begin = begin.tolist()
            at = np.searchsorted(known, flat)
            at[at == len(known)] = 0
            there = known[at] == flat
            small, large = y_sizes.min(), y_sizes.max()
            # nothing in the chunk can be as similar as what a set already has
            nearest = np.where(sizes < small, sizes / max(small, 1), np.where(sizes > large, large / np.maximum(sizes, 1), 1.0))
            for i in np.flatnonzero(nearest >= floor - 1e-9).tolist():
                span = slice(ends[i] - sizes[i], ends[i])
                met = at[span][there[span]].tolist()
                if not met:
                    continue
                both = np.bincount(np.concatenate([rows[begin[k] : stop[k]] for k in met]), minlength=len(y))
                some = np.flatnonzero(both * (1 + floor[i]) >= floor[i] * (sizes[i] + y_sizes) - 1e-6)
                n = both[some]
                score = n / (sizes[i] + y_sizes[some] - n)
                kept = (score >= least) & (n > 0)
                if kept.any():
                    score, found = np.concatenate([best[i][0], score[kept]]), np.concatenate([best[i][1], y[some][kept]])
                    first = np.lexsort((found, -score))[:most]
                    best[i] = score[first], found[first]
                    if len(first) == most:
                        floor[i] = max(least, score[first[-1]])
        yield pa.RecordBatch.from_arrays([
            pa.array(np.repeat(ordinal, [len(s) for s, _ in best])), pa.array(np.concatenate([f for _, f in best])), pa.array(np.concatenate([s for s, _ in best]))], ["x", "y", "score"])

    return run


def nearest(sets: DataFrame, asked: DataFrame, least: float, most: int, chunk: int = CHUNK) -> DataFrame:
    """(x, y, score): for each set of ``asked`` the ``most`` sets of largest Jaccard
    similarity, ``least`` or more and above 0, itself among them; ties by ordinal. Both are (ordinal,
    items), items are distinct numbers; ``sets`` is a table in the shared folder."""
    spark = sets.sparkSession
    blocks = max(2 * spark.sparkContext.defaultParallelism, -(-asked.count() // BLOCK))
    return asked.select("ordinal", "items").repartition(blocks, "ordinal").mapInArrow(_search(sets.inputFiles(), least, most, chunk), NEAR)
