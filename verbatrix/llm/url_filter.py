"""Exact URL filters by a cascade of Bloom filters.

The first level encodes the listed keys. Each further level encodes the keys
of the complete universe that the level before lets through wrongly: unlisted
ones after an odd level, listed ones after an even level, until none is left.
A key of the universe is listed if the first level that rejects it is even
(or, passing all, if their number is odd), with no error. Keys are spread over shards by their
hash; every shard has a cascade of its own, which one task builds from its
part of the universe.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from verbatrix.llm import common

#: Keys of the universe in a shard, on average.
SHARD_KEYS = 1 << 20
#: Cascades up to this size in all go to every task; larger ones are brought to the rows of their shard.
BROADCAST_BYTES = 64 << 20
FIRST_RATE, NEXT_RATE = 0.02, 0.5
LEVELS = 64
RESULT = "shard bigint, level int, hashes int, bits binary"


def url_key(url: str | Column) -> Column:
    """Normal form of a URL: lower case, without scheme, leading www., fragment,
    query and closing slashes."""
    key = F.lower(F.trim(url))
    for pattern in (r"^[a-z][a-z0-9+.-]*://", r"^www\.", r"[?#].*$", r"/+$"):
        key = F.regexp_replace(key, pattern, "")
    return key


class Bloom:
    def __init__(self, size: int, hashes: int, bits: np.ndarray | None = None):
        self.size, self.hashes = size, hashes
        self.bits = np.zeros((size + 7) // 8, np.uint8) if bits is None else bits

    @classmethod
    def planned(cls, keys: int, rate: float) -> "Bloom":
        size = max(64, int(np.ceil(-keys * np.log(rate) / np.log(2) ** 2)))
        return cls((size + 7) // 8 * 8, max(1, round(-np.log2(rate))))

    def places(self, h1: np.ndarray, h2: np.ndarray, level: int) -> Iterator[np.ndarray]:
        a, b = common.mix64(h1, level), common.mix64(h2, level) | np.uint64(1)
        for i in range(self.hashes):
            yield ((a + np.uint64(i) * b) % np.uint64(self.size)).astype(np.int64)

    def add(self, h1, h2, level: int) -> None:
        for p in self.places(h1, h2, level):
            np.bitwise_or.at(self.bits, p >> 3, (1 << (p & 7)).astype(np.uint8))

    def has(self, h1, h2, level: int) -> np.ndarray:
        out = np.ones(len(h1), bool)
        for p in self.places(h1, h2, level):
            out &= (self.bits[p >> 3] >> (p & 7).astype(np.uint8)) & 1 == 1
        return out


def cascade(listed: tuple[np.ndarray, np.ndarray], rest: tuple[np.ndarray, np.ndarray]) -> list[Bloom]:
    """Levels for listed keys and the rest of the universe, each as two hashes."""
    levels: list[Bloom] = []
    inside, outside = listed, rest
    while len(inside[0]):
        if len(levels) >= LEVELS:
            raise ValueError("keys of both kinds share their 128-bit hash")
        level = Bloom.planned(len(inside[0]), FIRST_RATE if not levels else NEXT_RATE)
        level.add(*inside, len(levels))
        wrong = level.has(*outside, len(levels))
        inside, outside = (outside[0][wrong], outside[1][wrong]), inside
        levels.append(level)
    return levels


def member(levels: list[Bloom], h1: np.ndarray, h2: np.ndarray) -> np.ndarray:
    out, todo = np.full(len(h1), len(levels) % 2 == 1), np.arange(len(h1))
    for n, level in enumerate(levels):
        passed = level.has(h1[todo], h2[todo], n)
        out[todo[~passed]] = n % 2 == 1
        todo = todo[passed]
    return out


def _hashes(key: str) -> list[Column]:
    return [F.xxhash64(F.lit(1), key).alias("h1"), F.xxhash64(F.lit(2), key).alias("h2")]


def _shard(shards: int) -> Column:
    return F.pmod(F.xxhash64(F.lit(3), F.col("h1")), F.lit(shards)).alias("shard")


def _u64(table: pa.Table, rows=None) -> tuple[np.ndarray, np.ndarray]:
    h = [table[c].to_numpy().view(np.uint64) for c in ("h1", "h2")]
    return (h[0], h[1]) if rows is None else (h[0][rows], h[1][rows])


def _build(table: pa.Table) -> pa.Table:
    listed = table["listed"].to_numpy()
    levels = cascade(_u64(table, listed), _u64(table, ~listed))
    shard = table["shard"][0].as_py()
    return pa.table([pa.array([shard] * len(levels), pa.int64()), pa.array(range(len(levels)), pa.int32()), pa.array([x.hashes for x in levels], pa.int32()), pa.array([x.bits.tobytes() for x in levels], pa.binary())], [x.split()[0] for x in RESULT.split(", ")])


def build_filter(universe: DataFrame, listed: DataFrame, shard_keys: int = SHARD_KEYS) -> tuple[DataFrame, int]:
    """Cascades (shard, level, hashes, bits) and the number of shards, for two
    tables of one column of keys. Listed keys outside the universe are left out.
    Null keys are no keys; repeated ones count once."""
    spark = universe.sparkSession
    u, l = universe.columns[0], listed.columns[0]
    keys = universe.where(F.col(f"`{u}`").isNotNull()).select(*_hashes(f"`{u}`"), F.lit(True).alias("own"), F.lit(False).alias("on"))
    on = listed.where(F.col(f"`{l}`").isNotNull()).select(*_hashes(f"`{l}`"), F.lit(False).alias("own"), F.lit(True).alias("on"))
    marked = common.cut(keys.unionByName(on).groupBy("h1", "h2").agg(F.bool_or("own").alias("own"), F.bool_or("on").alias("listed")).where("own").drop("own"))
    shards = max(1, -(-marked.count() // shard_keys))
    levels = marked.withColumn("shard", _shard(shards)).groupBy("shard").applyInArrow(_build, RESULT)
    return common.written(levels, "url-filter"), shards


def _levels(rows) -> dict[int, list[Bloom]]:
    out: dict[int, dict[int, Bloom]] = {}
    for shard, level, hashes, bits in rows:
        out.setdefault(shard, {})[level] = Bloom(len(bits) * 8, hashes, np.frombuffer(bits, np.uint8))
    return {s: [x[k] for k in sorted(x)] for s, x in out.items()}


def _flag(table: pa.Table | pa.RecordBatch, cascades: dict[int, list[Bloom]]) -> pa.Array:
    shard = table["shard"].to_numpy(zero_copy_only=False) if isinstance(table, pa.RecordBatch) else table["shard"].to_numpy()
    h = [(table[c].to_numpy(zero_copy_only=False) if isinstance(table, pa.RecordBatch) else table[c].to_numpy()).view(np.uint64) for c in ("h1", "h2")]
    out = np.zeros(len(shard), bool)
    order = np.argsort(shard, kind="stable")
    for part in np.split(order, np.flatnonzero(np.diff(shard[order])) + 1) if len(order) else []:
        levels = cascades.get(int(shard[part[0]]))
        if levels:
            out[part] = member(levels, h[0][part], h[1][part])
    return pa.array(out)


def filter_urls(rows: DataFrame, key_col: str, levels: DataFrame, shards: int, broadcast_bytes: int = BROADCAST_BYTES) -> DataFrame:
    """``rows`` with a boolean column ``listed``, false for a null key. Every key must be
    in the universe the filter was built for. A column ``listed`` of ``rows`` is
    replaced; no other is touched."""
    base = rows.drop("listed") if "listed" in rows.columns else rows
    names = base.columns
    packed = base.select(F.struct(*[F.col(f"`{c}`") for c in names]).alias("row"), F.col(f"`{key_col}`").alias("key")).select("row", F.col("key").isNotNull().alias("some"), *_hashes("key")).withColumn("shard", _shard(shards))
    schema = packed.select("row", F.lit(True).alias("listed")).schema
    schema["listed"].nullable = True
    size = levels.agg(F.sum(F.octet_length("bits"))).first()[0] or 0
    if size <= broadcast_bytes:
        cascades = base.sparkSession.sparkContext.broadcast([tuple(r) for r in levels.collect()])

        def flag(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            own = _levels((a, b, c, bytes(d)) for a, b, c, d in cascades.value)
            for batch in it:
                yield pa.RecordBatch.from_arrays([batch.column("row"), pa.compute.and_(_flag(batch, own), batch.column("some"))], ["row", "listed"])

        done = packed.mapInArrow(flag, schema)
    else:

        def flag_shard(left: pa.Table, right: pa.Table) -> pa.Table:
            own = _levels(zip(*(right[c].to_pylist() for c in ("shard", "level", "hashes", "bits"))))
            return pa.table([left["row"], pa.compute.and_(_flag(left, own), left["some"])], ["row", "listed"])

        done = packed.groupBy("shard").cogroup(levels.groupBy("shard")).applyInArrow(flag_shard, schema)
    return done.select(*[F.col("row").getField(c).alias(c) for c in names], "listed")


def op6_url_filter(spark, sf_dir: str) -> DataFrame:
    """Every page with whether its URL is on the block list (``block_list``)."""
    pages = spark.read.parquet(f"{sf_dir}/pages.parquet")
    keyed = pages.select("page_id", "url", url_key("url").alias("key"))
    listed = block_list(pages)
    levels, shards = build_filter(keyed.select("key"), listed)
    return filter_urls(keyed, "key", levels, shards)


#: Labels of unwanted hosts; a block list of one's own goes to ``build_filter`` as its second table.
BAD_HOSTS = ("ads-track", "adult-x", "casino-win", "cheap-pills", "free-bets", "spam-farm")
_ON_BAD_HOST = "^([^/]*[.])?(" + "|".join(BAD_HOSTS) + ")[.]"


def block_list(pages: DataFrame) -> DataFrame:
    """Keys of the pages on unwanted hosts, whatever the rest of their address."""
    return pages.select(url_key("url").alias("key")).where(F.col("key").rlike(_ON_BAD_HOST)).distinct()


OP6_SQL = rf"""
WITH keyed AS (
    SELECT page_id, url,
           regexp_replace(regexp_replace(regexp_replace(regexp_replace(lower(trim(url)), '^[a-z][a-z0-9+.-]*://', ''), '^www\.', ''), '[?#].*$', ''), '/+$', '') AS key
    FROM pages
)
SELECT page_id, url, key, key IS NOT NULL AND key IN (SELECT key FROM keyed WHERE key IS NOT NULL AND regexp_matches(key, '{_ON_BAD_HOST}')) AS listed
FROM keyed
"""
