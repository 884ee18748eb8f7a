"""Mixing of sources to target weights, by blocks of fixed length.

The tokens of a source, in an order given by its documents' ids, are one
stream that is cut into blocks of fixed length. Every output shard draws how
many of its slots each source gets from a multinomial distribution with the
target weights. The slots of a source, counted over all shards, are mapped to
its blocks by a pseudorandom permutation of the block indices (a Feistel
network, nothing is shuffled for it); a source that is drawn more often than
it has blocks starts again with another permutation. Blocks and slots are
joined by (source, block index).
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from verbatrix.llm import common, tokens

BLOCK = 2048
SHARD_SLOTS = 4096
BUCKET_DOCS = 4096
#: Weights where none are given: proportional to tokens ** ALPHA.
ALPHA = 0.7
SEED = 20240501
PIECES = "source string, block bigint, seq int, doc_id bigint, lang string, n_tokens int, text string"


COUNTED = "source string, bucket bigint, doc_id bigint, key bigint, tokens bigint, chars array<int>, passed array<int>"


def permute(index: np.ndarray, n: np.ndarray | int, seed: np.ndarray | int) -> np.ndarray:
    """Image of ``index`` in [0, n) under the permutation that ``seed`` names."""
    index = np.asarray(index, np.uint64)
    n = np.broadcast_to(np.asarray(n, np.uint64), index.shape)
    seed = np.broadcast_to(np.asarray(seed, np.uint64), index.shape)
    bits = np.maximum(1, np.ceil(np.log2(np.maximum(n.astype(np.float64), 2)) / 2)).astype(np.uint64)
    mask = (np.uint64(1) << bits) - np.uint64(1)
    out, todo = index.copy(), np.arange(len(index))
    while len(todo):
        x, b, m, s = out[todo], bits[todo], mask[todo], seed[todo]
        left, right = x >> b, x & m
        for r in range(6):
            left, right = right, left ^ (common.mix64(right ^ common.mix64(s, r), r) & m)
        out[todo] = (left << b) | right
        todo = todo[out[todo] >= n[todo]]
    return out.astype(np.int64)


def _bucket_tokens(path: str):
    def run(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        count = tokens.tokenizer(path).anchored
        for batch in it:
            for part in common.batches_of(iter([batch]), "text"):
                n, chars, passed = zip(*map(count, part.column("text").to_pylist()))
                yield pa.RecordBatch.from_arrays([*(part.column(c) for c in ("source", "bucket", "doc_id", "key")), pa.array(n, pa.int64()), pa.array(chars, pa.list_(pa.int32())), pa.array(passed, pa.list_(pa.int32()))], [x.split()[0] for x in COUNTED.split(", ")])

    return run


def _cut(path: str, block: int):
    names = [x.split()[0] for x in PIECES.split(", ")]

    order = [("doc_id", "ascending"), ("key", "ascending")]

    def run(docs: pa.Table, counted: pa.Table) -> pa.Table:
        kinds = (pa.string(), pa.int64(), pa.int32(), pa.int64(), pa.string(), pa.int32(), pa.string())
        if not docs.num_rows or not counted.num_rows:
            return pa.table([pa.array([], k) for k in kinds], names)
        tok = tokens.tokenizer(path)
        # in one order, so that each document meets its own count
        docs, counted = docs.sort_by(order), counted.sort_by(order)
        at, source, out = counted["start"][0].as_py(), docs["source"][0].as_py(), []
        for doc, lang, text, n, chars, passed in zip(*(docs[c].to_pylist() for c in ("doc_id", "lang", "text")), *(counted[c].to_pylist() for c in ("tokens", "chars", "passed"))):
            marks = list(range(block - at % block, n, block))
            edges = [0, *marks, n]
            for s, e, piece in zip(edges, edges[1:], tok.cut_anchored(text, marks, chars, passed)):
                if e > s:
                    out.append((source, (at + s) // block, (at + s) % block, doc, lang, e - s, piece))
            at += n
        return pa.table([pa.array(c, k) for c, k in zip(zip(*out), kinds)], names) if out else pa.table([pa.array([], k) for k in kinds], names)

    return run


def _draws(weights: np.ndarray, slots: int, shard_slots: int, seed: int):
    def run(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in it:
            for shard in batch.column("id").to_pylist():
                size = min(shard_slots, slots - shard * shard_slots)
                drawn = np.random.default_rng([seed, shard]).multinomial(size, weights)
                some = np.flatnonzero(drawn)
                first = np.r_[0, np.cumsum(drawn)][some]
                yield pa.RecordBatch.from_arrays([pa.array(np.full(len(some), shard)), pa.array(np.full(len(some), size)), pa.array(some), pa.array(drawn[some].astype(np.int64)), pa.array(first)], ["shard", "size", "number", "drawn", "first"])

    return run


def _slots(names: list[str], blocks: np.ndarray, seed: int):
    def run(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        labels = pa.array(names, pa.string())
        for batch in it:
            if not batch.num_rows:
                continue
            shard, size, number, drawn, first, before = (batch.column(c).to_numpy() for c in ("shard", "size", "number", "drawn", "first", "before"))
            row = np.repeat(np.arange(len(drawn)), drawn)
            i = np.arange(len(row)) - np.repeat(np.r_[0, np.cumsum(drawn)[:-1]], drawn)
            turn, index = np.divmod(before[row] + i, blocks[number[row]])
            own = (np.uint64(seed) << np.uint64(32)) + (turn.astype(np.uint64) << np.uint64(16)) + number[row].astype(np.uint64)
            block = permute(index, blocks[number[row]], own)
            slot = permute(first[row] + i, size[row], shard[row].astype(np.uint64) + np.uint64(seed + 1))
            yield pa.RecordBatch.from_arrays([pa.array(shard[row]), pa.array(slot), labels.take(pa.array(number[row])), pa.array(block), pa.array(turn)], ["shard", "slot", "source", "block", "turn"])

    return run


def mix(docs: DataFrame, weights: dict[str, float] | None = None, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source", block: int = BLOCK, slots: int | None = None, shard_slots: int = SHARD_SLOTS, bucket_docs: int = BUCKET_DOCS, seed: int = SEED, vocabulary: str = tokens.VOCABULARY) -> DataFrame:
    """One row for each output slot: ``shard, slot, source, block, turn, n_tokens,
    pieces``; ``pieces`` is an array of (seq, doc_id, lang, n_tokens, text), the
    documents' parts in the block in order. ``turn`` counts how often the source
    has started again.

    ``weights`` by source need not sum to 1; sources that it doesn't name get
    none. ``slots`` is as many as there are blocks if not given. The last
    block of a source may be short. Null and empty texts have no tokens and
    no place; a null source is the source ''; null ids come last. Rows that
    repeat take part as often as they occur. No tokens or no weight: no rows.
    ``lang`` is null where ``docs`` has no such column; other further columns aren't read.
    """
    spark = docs.sparkSession
    lang = F.col("lang").cast("string") if "lang" in docs.columns else F.lit(None).cast("string")
    rows = docs.where(F.col(text_col) != "").select(
        F.col(id_col).cast("bigint").alias("doc_id"), F.col(text_col).alias("text"), lang.alias("lang"),
        F.coalesce(F.col(source_col).cast("string"), F.lit("")).alias("source"), common.text_key(id_col, text_col).alias("key"),
    )
    buckets = max(1, -(-rows.count() // bucket_docs))
    rows = rows.withColumn("bucket", F.pmod(F.xxhash64(F.lit(29), "doc_id"), F.lit(buckets)))
    counted = common.cut(rows.select("source", "bucket", "doc_id", "key", "text").mapInArrow(_bucket_tokens(vocabulary), COUNTED))
    sums = counted.groupBy("source", "bucket").agg(F.sum("tokens").alias("tokens"))
    totals = sorted((r.source, r.tokens) for r in sums.groupBy("source").agg(F.sum("tokens").alias("tokens")).collect() if r.tokens)
    share = np.array([(weights.get(s, 0.0) if weights is not None else float(t) ** ALPHA) for s, t in totals], np.float64)
    blocks = np.array([-(-t // block) for _, t in totals], np.int64)
    schema = "shard bigint, slot bigint, source string, block bigint, turn bigint"
    slots = int(blocks.sum()) if slots is None else slots
    if not len(share) or share.sum() <= 0 or slots <= 0:
        return spark.createDataFrame([], schema + ", n_tokens bigint, pieces array<struct<seq: int, doc_id: bigint, lang: string, n_tokens: int, text: string>>")
    shards = -(-slots // shard_slots)
    drawn = spark.range(0, shards, 1, min(shards, common.partitions(spark))).mapInArrow(_draws(share / share.sum(), slots, shard_slots, seed), "shard bigint, size bigint, number bigint, drawn bigint, first bigint")
    before = F.sum("drawn").over(Window.partitionBy("number").orderBy("shard")) - F.col("drawn")
    places = drawn.withColumn("before", before).mapInArrow(_slots([s for s, _ in totals], blocks, seed), schema)
    # token offset of each bucket in its source's stream; a row for each bucket, not for each document
    starts = sums.withColumn("start", F.sum("tokens").over(Window.partitionBy("source").orderBy("bucket")) - F.col("tokens")).select("source", "bucket", "start")
    pieces = rows.groupBy("source", "bucket").cogroup(counted.join(starts, ["source", "bucket"]).groupBy("source", "bucket")).applyInArrow(_cut(vocabulary, block), PIECES)
    packed = pieces.groupBy("source", "block").agg(F.sum("n_tokens").alias("n_tokens"), F.sort_array(F.collect_list(F.struct("seq", "doc_id", "lang", "n_tokens", "text"))).alias("pieces"))
    # both sides grow with the data; their estimated sizes don't, so that a broadcast is ruled out by name
    return places.join(packed.hint("merge"), ["source", "block"]).select("shard", "slot", "source", "block", "turn", "n_tokens", "pieces")


def mixed_documents(docs: DataFrame, **params) -> DataFrame:
    """``mix`` as rows ``doc_id, text, lang, source, n_chars``: one for each part
    of a document in each slot."""
    part = mix(docs, **params).select("source", F.explode("pieces").alias("p"))
    return part.select("p.doc_id", "p.text", "p.lang", "source", F.length("p.text").cast("bigint").alias("n_chars"))


def op7_mixing(spark, sf_dir: str) -> DataFrame:
    mixed = mix(common.documents(spark, sf_dir))
    return mixed.select("shard", "slot", "source", "block", "turn", "n_tokens", F.col("pieces.doc_id").alias("doc_ids"), F.array_join("pieces.text", "").alias("text"))
