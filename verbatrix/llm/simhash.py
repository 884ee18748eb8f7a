"""Near-duplicate documents by SimHash and random bit-sampling hashing.

A document's fingerprint has 256 bits: the signs of the sums of the hashed
word pairs of its whole text, each pair once however often it occurs, with sums of zero
settled by weights of the pairs so that texts of few words are as far apart as others.
Documents with one fingerprint are grouped
first, so that copies by the thousand count once. Each of several tables
samples coordinates of the fingerprint; documents that agree on a table's
sample share a bucket. All pairs of a bucket are verified by Hamming distance.
A bucket of more than ``BIG`` fingerprints is parted into blocks, and each two of
its blocks are one group for some task. Verified pairs are
edges; documents of one connected component are one group.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from verbatrix.llm import common, components

BITS = 256
#: Largest Hamming distance of a pair, of 256 bits; recall is planned for pairs at this distance, which agree in this share of bits.
MAX_DISTANCE = 62
PLANNED_AGREEMENT = 1 - MAX_DISTANCE / BITS
RECALL = 0.95
CAP = 512
LEAST_SAMPLE = 10
#: Fingerprints of a bucket that one task compares at most.
BIG = 4096
#: Rows of a tile.
TILE = 1024
RESULT = "doc_id bigint, group_id bigint, group_size bigint, kept boolean"

_R = 0x9E3779B97F4A7C15 | 1
_WORD_BYTE = np.ones(256, bool)
_WORD_BYTE[list(b" \t\n\r\v\f\0")] = False
_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32
#: Signs of a byte's bits, for byte counts @ signs.
_SIGNS = (np.unpackbits(np.arange(256, dtype=np.uint8)[:, None], axis=1).astype(np.float64) * 2 - 1)


def _powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    """r^0..r^n and their inverses modulo 2^64."""
    def chain(r: int) -> np.ndarray:
        out = np.ones(n + 1, np.uint64)
        if n:
            out[1:] = np.uint64(r)
        return np.multiply.accumulate(out, dtype=np.uint64)
    return chain(_R), chain(pow(_R, -1, 1 << 64))


_pow_cache: list = [np.zeros(0, np.uint64), np.zeros(0, np.uint64)]


def word_hashes(raw: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Hash and document number of every word, in order. A word is a run of
    bytes other than ASCII white space; the case of ASCII letters doesn't count."""
    n = len(raw)
    if n == 0:
        return np.zeros(0, np.uint64), np.zeros(0, np.int64)
    if len(_pow_cache[0]) < n + 1:
        _pow_cache[:] = _powers(max(n, 1 << 20))
    power, inverse = _pow_cache
    low = _LOWER[raw]
    inside = _WORD_BYTE[low]
    before = np.empty(n, bool)
    before[0], before[1:] = False, inside[:-1]
    cuts = offsets[1:-1]
    before[cuts[cuts < n]] = False
    start = np.flatnonzero(inside & ~before)
    after = np.empty(n, bool)
    after[-1], after[:-1] = False, inside[1:]
    ends = offsets[1:-1] - 1
    after[ends[ends >= 0]] = False
    end = np.flatnonzero(inside & ~after) + 1
    total = np.zeros(n + 1, np.uint64)
    np.cumsum((low.astype(np.uint64) + np.uint64(1)) * power[:n], out=total[1:])
    h = common.mix64((total[end] - total[start]) * inverse[start], 3)
    return h, np.searchsorted(offsets, start, side="right") - 1


def _settled(f: np.ndarray, tied: np.ndarray) -> np.ndarray:
    """Values of tied bits: signs of the sums in which each feature has a random
    weight of its own for each bit."""
    total = np.zeros(len(tied), np.int64)
    if not len(tied):
        return total > 0
    own, octet, shift = tied // 64, tied % 64 // 8, (7 - tied % 8).astype(np.uint8)
    salt = common.mix64(tied.astype(np.uint64), 17)
    step = max(1, (1 << 18) // len(tied))
    for s in range(0, len(f), step):
        part = f[s : s + step]
        octets = np.stack([common.mix64(part, 11 + k).view(np.uint8).reshape(-1, 8) for k in range(4)], axis=1)
        sign = ((octets[:, own, octet] >> shift) & 1).astype(np.int64) * 2 - 1
        weight = (common.mix64(part[:, None] ^ salt[None, :], 19) >> np.uint64(40)).astype(np.int64)
        total += (sign * weight).sum(0)
    return total > 0


def fingerprints(raw: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """256-bit fingerprints (n, 4) of texts, and whether a text has any word.
    Features are the different pairs of neighbouring words, in a text of one word that word."""
    h, doc = word_hashes(raw, offsets)
    n = len(offsets) - 1
    out = np.zeros((n, 4), np.uint64)
    words = np.bincount(doc, minlength=n)
    at = np.r_[0, np.cumsum(words)]
    if len(h) == 0:
        return out, words > 0
    pair = common.mix64(h[:-1] * np.uint64(0xD6E8FEB86659FD93) + h[1:], 5) if len(h) > 1 else np.zeros(0, np.uint64)
    for i in np.flatnonzero(words):
        a, b = at[i], at[i + 1]
        f = np.unique(pair[a : b - 1]) if b - a > 1 else h[a:b]
        sums = np.empty((4, 64))
        for k in range(4):
            octets = common.mix64(f, 11 + k).view(np.uint8).reshape(-1, 8)
            if len(f) < 400:
                sums[k] = (np.unpackbits(octets, axis=1).sum(0, dtype=np.int64) * 2 - len(f))
            else:
                for o in range(8):
                    sums[k, 8 * o : 8 * o + 8] = np.bincount(octets[:, o], minlength=256) @ _SIGNS
        above = sums > 0
        if len(f) % 2 == 0:
            tied = np.flatnonzero(sums.ravel() == 0)
            above.ravel()[tied] = _settled(f, tied)
        out[i] = np.packbits(above, axis=1).view(np.uint64).ravel()
    return out, words > 0


def _fingerprint_batches(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in common.batches_of(it, "text", 1 << 20):
        fp, any_word = fingerprints(*common.text_bytes(batch.column("text")))
        some = np.flatnonzero(any_word)
        binary = pa.FixedSizeBinaryArray.from_buffers(pa.binary(32), len(some), [None, pa.py_buffer(np.ascontiguousarray(fp[some]))]).cast(pa.binary())
        yield pa.RecordBatch.from_arrays([batch.column("doc_id").take(pa.array(some)), binary], ["doc_id", "fp"])


def _bits_of(fp: np.ndarray) -> np.ndarray:
    return np.unpackbits(fp.view(np.uint8).reshape(len(fp), 32), axis=1)


def _codes(bits: np.ndarray, chosen: np.ndarray) -> np.ndarray:
    """The chosen bits of each row as one integer."""
    weight = np.uint64(1) << np.arange(len(chosen), dtype=np.uint64)
    return (bits[:, chosen].astype(np.uint64) * weight).sum(1, dtype=np.uint64)


def _sample(table: int, count: int) -> np.ndarray:
    return np.random.default_rng([7919, table]).permutation(BITS)[:count]


def _table_rows(tables: int, sample: int):
    chosen = [_sample(t, sample) for t in range(tables)]

    def run(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in it:
            fp = np.frombuffer(b"".join(batch.column("fp").to_pylist()), np.uint64).reshape(-1, 4)
            bits = _bits_of(fp)
            for t in range(tables):
                bucket = (_codes(bits, chosen[t]) | np.uint64(t << 48)).view(np.int64)
                yield pa.RecordBatch.from_arrays([pa.array(bucket), batch.column("rep"), batch.column("fp")], ["bucket", "rep", "fp"])

    return run


class _Union:
    def __init__(self, n: int):
        self.parent = np.arange(n)

    def find(self, x: int) -> int:
        p = self.parent
        while p[x] != x:
            p[x] = p[p[x]]
            x = p[x]
        return x

    def join(self, a: int, b: int) -> None:
        a, b = self.find(a), self.find(b)
        if a != b:
            self.parent[max(a, b)] = min(a, b)

    def flatten(self) -> None:
        while not np.array_equal(up := self.parent[self.parent], self.parent):
            self.parent = up


def _near(x: np.ndarray, y: np.ndarray, limit: int) -> np.ndarray:
    distance = np.zeros((len(x), len(y)), np.uint16)
    for k in range(4):
        distance += np.bitwise_count(x[:, k, None] ^ y[None, :, k])
    return distance <= limit


def _components(near: np.ndarray) -> np.ndarray:
    """Smallest row of each row's component, spread along the pairs until nothing changes."""
    label, some = np.arange(len(near)), np.flatnonzero(near.sum(1) > 1)
    near, own = near[np.ix_(some, some)], np.arange(len(some))
    while len(some):
        low = np.where(near, own[None, :], len(some)).min(1)
        low = np.minimum(low, low[low])
        if np.array_equal(low, own):
            break
        own = low
    label[some] = some[own]
    return label


def bucket_edges(fp: np.ndarray, limit: int, side: int = TILE, split: int | None = None) -> np.ndarray:
    """Component of each row of one group, from all its pairs, or from those of its first
    ``split`` rows with the others. More than ``side`` rows are compared in tiles, so that memory stays small."""
    if split is None and len(fp) <= side:
        return _components(_near(fp, fp, limit))
    union = _Union(len(fp))
    left, right = (range(0, len(fp), side), None) if split is None else (range(0, split, side), range(split, len(fp), side))
    end = lambda s: min(s + side, split if split is not None and s < split else len(fp))
    if split is None:
        for s in left:
            union.parent[s : s + side] = s + _components(_near(fp[s : s + side], fp[s : s + side], limit))
    for s in left:
        for t in right or range(s + side, len(fp), side):
            near = _near(fp[s : end(s)], fp[t : end(t)], limit)
            if not near.any():
                continue
            # one pair for each two components that meet, none for what is joined already
            a, b = union.parent[s : end(s)], union.parent[t : end(t)]
            x, y = np.nonzero(near & (a[:, None] != b[None, :]))
            if not len(x):
                continue
            for code in np.unique(a[x] * len(fp) + b[y]).tolist():
                union.join(*divmod(code, len(fp)))
            union.flatten()
    return union.parent


def _edges(limit: int):
    def flush(key: tuple, reps: list, fps: list, blocks: list) -> pa.RecordBatch | None:
        rep, block, raw = np.concatenate(reps), np.concatenate(blocks), b"".join(fps)
        if len(rep) < 2:
            return None
        order = np.lexsort((rep, block))
        rep, fp = rep[order], np.frombuffer(raw, np.uint64).reshape(-1, 4)[order]
        # two blocks of a big bucket: their own pairs are compared where each meets itself
        root = bucket_edges(fp, limit, split=None if key[1] == key[2] else int(np.count_nonzero(block == key[1])))
        new = np.flatnonzero(root != np.arange(len(rep)))
        if not len(new):
            return None
        return pa.RecordBatch.from_arrays([pa.array(rep[new]), pa.array(rep[root[new]])], ["a", "b"])

    def run(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        at, reps, fps, blocks = None, [], [], []
        for batch in it:
            bucket, low, high, block, rep = (batch.column(c).to_numpy() for c in ("bucket", "low", "high", "block", "rep"))
            fp = b"".join(batch.column("fp").to_pylist())
            if not len(bucket):
                continue
            cuts = np.r_[0, np.flatnonzero((bucket[1:] != bucket[:-1]) | (low[1:] != low[:-1]) | (high[1:] != high[:-1])) + 1, len(bucket)]
            for s, e in zip(cuts[:-1], cuts[1:]):
                key = (int(bucket[s]), int(low[s]), int(high[s]))
                if key != at:
                    if reps and (out := flush(at, reps, fps, blocks)) is not None:
                        yield out
                    at, reps, fps, blocks = key, [], [], []
                reps.append(rep[s:e])
                blocks.append(block[s:e])
                fps.append(fp[32 * s : 32 * e])
        if reps and (out := flush(at, reps, fps, blocks)) is not None:
            yield out

    return run


def plan(distinct: int, max_distance: int = MAX_DISTANCE, recall: float = RECALL, cap: int = CAP) -> tuple[int, int]:
    """Sampled bits and tables for so many fingerprints: as many bits as give
    buckets of about ``cap``, and as many tables as a pair at ``max_distance``
    needs to meet with probability ``recall``. Bits are sampled without
    repetition, so that nearer pairs meet more often."""
    sample = max(LEAST_SAMPLE, math.ceil(math.log2(max(1, distinct) / cap)))
    same = math.comb(BITS - max_distance, sample) / math.comb(BITS, sample)
    if not 0 < same < 1:
        return sample, 1
    return sample, math.ceil(math.log(1 - recall) / math.log(1 - same))


def near_duplicates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", max_distance: int = MAX_DISTANCE, cap: int = CAP, recall: float = RECALL, big: int = BIG) -> DataFrame:
    """One row for each row of ``docs``: ``doc_id``, ``group_id`` (the smallest
    id of its group), ``group_size`` (ids in the group), ``kept`` (true for the
    document whose id is the group's).

    A text that is null, empty or without words has no near copies: its group
    is itself. A row with null id is a group of its own with null ``group_id``
    and is kept. Rows that repeat an id are one document: they share its group
    and its decision. No rows: no rows. Ties don't occur: groups don't depend on
    order. Further columns of ``docs`` are not read.
    """
    rows = docs.select(F.col(id_col).cast("bigint").alias("doc_id"), F.col(text_col).alias("text"))
    prints = common.cut(rows.where("doc_id is not null and text is not null").mapInArrow(_fingerprint_batches, "doc_id bigint, fp binary"))
    reps = prints.groupBy("fp").agg(F.min("doc_id").alias("rep"))
    sample, tables = plan(reps.count(), max_distance, recall, cap)
    spark = docs.sparkSession
    coded = reps.mapInArrow(_table_rows(tables, sample), "bucket bigint, rep bigint, fp binary")
    # a big bucket's rows are dealt to blocks, and go to each pair of blocks that has theirs
    crowded = common.cut(coded.groupBy("bucket").agg(F.count("*").alias("n")).where(F.col("n") > big).select("bucket", F.ceil(F.col("n") / big).cast("int").alias("parts")))
    block = F.when(F.col("parts").isNull(), 0).otherwise(F.pmod(F.xxhash64(F.lit(3), "rep"), F.col("parts"))).cast("int")
    met = F.transform(F.sequence(F.lit(0), F.coalesce("parts", F.lit(1)) - 1), lambda other: F.struct(F.least("block", other).alias("low"), F.greatest("block", other).alias("high")))
    dealt = coded.join(crowded, "bucket", "left") if not crowded.isEmpty() else coded.withColumn("parts", F.lit(None).cast("int"))
    edges = (
        dealt.withColumn("block", block).select("bucket", "rep", "fp", "block", F.explode(met).alias("m")).select("bucket", "rep", "fp", "block", "m.low", "m.high")
        .repartition(common.partitions(spark), "bucket", "low", "high")
        .sortWithinPartitions("bucket", "low", "high")
        .mapInArrow(_edges(max_distance), "a bigint, b bigint")
    )
    same = prints.join(reps, "fp").where("doc_id <> rep").select(F.col("doc_id").alias("a"), F.col("rep").alias("b"))
    labels = common.cut(components.min_labels(edges.unionByName(same)))
    sizes = labels.groupBy("label").agg(F.count("*").alias("group_size"))
    marked = labels.join(sizes, "label").select(F.col("node").alias("doc_id"), "label", "group_size")
    return rows.select("doc_id").join(marked, "doc_id", "left").select(
        "doc_id",
        F.coalesce("label", "doc_id").alias("group_id"),
        F.coalesce("group_size", F.lit(1)).cast("bigint").alias("group_size"),
        F.coalesce(F.col("label") == F.col("doc_id"), F.lit(True)).alias("kept"),
    )


def drop_near_duplicates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", **params) -> DataFrame:
    """The rows of ``docs``, all columns, without those whose document is not
    the kept one of its group (see ``near_duplicates`` for nulls and repeats)."""
    dropped = near_duplicates(docs, id_col, text_col, **params).where("not kept").select(F.col("doc_id").alias("__vx_dropped")).distinct()
    return docs.join(dropped, F.col(id_col).cast("bigint") == F.col("__vx_dropped"), "left_anti")


def op10_simhash(spark, sf_dir: str) -> DataFrame:
    return near_duplicates(common.documents(spark, sf_dir))
