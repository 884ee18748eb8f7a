"""Exact deduplication over an extendible-hash index on shared files.

Texts that are equal within one read batch are first united where they lie, so
that a text which is a third of all rows reaches its owner as a few
representatives. The 64-bit keys of the representatives are split into ranges,
one owner task for each, as many as their rows and bytes need. An owner inserts
its rows into an extendible-hash index: a directory of 2^g slots points at
buckets of fixed capacity, an overfull bucket is split by one more key bit and
the directory doubles when the bucket's depth has reached its own. Entries with
one whole key are chained. The bytes of a new text are compared with those of
every distinct text in the chain of its key, so that a collision of keys never
merges texts. Buckets are pages and texts are records in log files in the shared
folder; memory holds the directory, some recent pages and one open segment of either.
"""

from __future__ import annotations

import struct
import uuid
from collections import OrderedDict
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import zstandard
from pyarrow import fs as pafs
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from verbatrix.llm import common

RESULT = "doc_id bigint, keep_id bigint, copies bigint, kept boolean"
BUCKET = 64
#: Pages that are held in memory at once.
PAGES = 256
SEGMENT = 16 << 20
#: Representatives and bytes of text of one owner.
OWNER_ROWS, OWNER_BYTES = 1 << 18, 1 << 29
LOCAL = "doc_id bigint, rep bigint, size bigint, first boolean, key bigint, text string"


class Log:
    """Records by locator (file, start, length) in append-only files."""

    def __init__(self, fs: pafs.FileSystem, base: str):
        self.fs, self.base = fs, base
        fs.create_dir(base, recursive=True)
        self.open, self.number = bytearray(), 0
        self.readers: dict[int, pa.NativeFile] = {}

    def path(self, number: int) -> str:
        return f"{self.base}/segment-{number:06d}"

    def append(self, record: bytes) -> tuple[int, int, int]:
        if self.open and len(self.open) + len(record) > SEGMENT:
            self.flush()
        at = (self.number, len(self.open), len(record))
        self.open += record
        return at

    def flush(self) -> None:
        with self.fs.open_output_stream(self.path(self.number)) as out:
            out.write(bytes(self.open))
        self.open, self.number = bytearray(), self.number + 1

    def read(self, at: tuple[int, int, int]) -> bytes:
        number, start, size = at
        if number == self.number:
            return bytes(self.open[start : start + size])
        if number not in self.readers:
            if len(self.readers) >= 16:
                self.readers.pop(next(iter(self.readers))).close()
            self.readers[number] = self.fs.open_input_file(self.path(number))
        return self.readers[number].read_at(size, start)

    def close(self) -> None:
        for reader in self.readers.values():
            reader.close()
        self.readers = {}
        if self.open:
            self.flush()


class Texts:
    """Compressed texts in a log; the last one read stays unpacked."""

    def __init__(self, fs: pafs.FileSystem, base: str):
        self.log = Log(fs, base)
        self.pack, self.unpack = zstandard.ZstdCompressor(level=1), zstandard.ZstdDecompressor()
        self.last: tuple = (None, b"")

    def append(self, text: bytes) -> tuple[int, int, int]:
        at = self.log.append(self.pack.compress(text))
        self.last = (at, text)
        return at

    def read(self, at: tuple[int, int, int]) -> bytes:
        if self.last[0] != at:
            self.last = (at, self.unpack.decompress(self.log.read(at)))
        return self.last[1]


class Bucket:
    """A page: the chains of up to ``capacity`` keys that share their low ``depth`` bits.
    An entry of a chain is (group, length of the text, locator of the text)."""

    __slots__ = ("depth", "chains")

    def __init__(self, depth: int, chains: dict | None = None):
        self.depth, self.chains = depth, chains if chains is not None else {}

    ENTRY = struct.Struct("<QqqIII")

    def dump(self) -> bytes:
        return struct.pack("<I", self.depth) + b"".join(self.ENTRY.pack(key, group, size, *at) for key, chain in self.chains.items() for group, size, at in chain)

    @classmethod
    def load(cls, page: bytes) -> "Bucket":
        out = cls(struct.unpack_from("<I", page)[0])
        for key, group, size, *at in cls.ENTRY.iter_unpack(page[4:]):
            out.chains.setdefault(key, []).append((group, size, tuple(at)))
        return out


class ExtendibleHash:
    """Directory over bucket pages by the low bits of the key. ``capacity`` bounds
    the keys of a page; entries of one key are a chain and don't count twice.

    Pages live in a log, of which the ``pages`` last used ones are held; a
    changed page that is put away is appended again and its locator changes. The
    directory grows with the keys: where it would have more than 64 slots for
    each key, which takes keys that agree in far more bits than hashes do, a page
    has more than ``capacity`` keys instead, and none is lost.
    """

    def __init__(self, log: Log, capacity: int = BUCKET, pages: int = PAGES):
        self.log, self.capacity, self.pages = log, capacity, pages
        self.depth, self.keys = 0, 0
        self.directory = np.zeros(1, np.int64)
        self.at: list[tuple[int, int, int] | None] = [None]
        self.held: OrderedDict[int, Bucket] = OrderedDict({0: Bucket(0)})
        self.changed: set[int] = {0}

    def page(self, number: int) -> Bucket:
        found = self.held.get(number)
        if found is None:
            found = self.held[number] = Bucket.load(self.log.read(self.at[number]))
            self._shrink()
        self.held.move_to_end(number)
        return found

    def _shrink(self) -> None:
        while len(self.held) > self.pages:
            number, bucket = self.held.popitem(last=False)
            if number in self.changed:
                self.at[number] = self.log.append(bucket.dump())
                self.changed.discard(number)

    def chain(self, key: int) -> list:
        """Entries under ``key``."""
        return self.page(int(self.directory[key & ((1 << self.depth) - 1)])).chains.get(key, [])

    def add(self, key: int, entry: tuple) -> None:
        while True:
            number = int(self.directory[key & ((1 << self.depth) - 1)])
            bucket = self.page(number)
            if key in bucket.chains or len(bucket.chains) < self.capacity or (bucket.depth == self.depth and 2 << self.depth > 64 * (self.keys + self.capacity)):
                self.keys += key not in bucket.chains
                bucket.chains.setdefault(key, []).append(entry)
                self.changed.add(number)
                return
            self._split(number, bucket)

    def _split(self, number: int, bucket: Bucket) -> None:
        if bucket.depth == self.depth:
            self.directory = np.concatenate([self.directory, self.directory])
            self.depth += 1
        bit, low = 1 << bucket.depth, next(iter(bucket.chains)) & ((1 << bucket.depth) - 1)
        bucket.depth += 1
        other = Bucket(bucket.depth, {k: bucket.chains.pop(k) for k in [k for k in bucket.chains if k & bit]})
        self.directory[low | bit :: bit << 1] = len(self.at)
        self.held[len(self.at)] = other
        self.changed |= {number, len(self.at)}
        self.at.append(None)
        self._shrink()

    def close(self, path: str) -> None:
        """Puts all pages away and writes the directory to ``path``."""
        pages, self.pages = self.pages, 0
        self._shrink()
        self.pages = pages
        self.log.close()
        with self.log.fs.open_output_stream(path) as out:
            out.write(struct.pack("<IIQQ", self.depth, self.capacity, self.keys, len(self.at)) + self.directory.astype("<i8").tobytes() + np.array(self.at, "<u4").tobytes())

    @classmethod
    def opened(cls, log: Log, path: str) -> "ExtendibleHash":
        """The index that ``close`` has written, for lookups."""
        with log.fs.open_input_file(path) as file:
            raw = file.read()
        out = cls(log)
        out.depth, out.capacity, out.keys, pages = struct.unpack_from("<IIQQ", raw)
        slots = 1 << out.depth
        out.directory = np.frombuffer(raw, "<i8", slots, 24).copy()
        out.at = [tuple(x) for x in np.frombuffer(raw, "<u4", 3 * pages, 24 + 8 * slots).reshape(-1, 3).tolist()]
        # no open segment: whatever the directory names lies in files
        out.log.number, out.held, out.changed = 1 << 32, OrderedDict(), set()
        return out


def _united(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows of each batch with the number of the first row of the batch that has
    their text. That row has the text, the smallest id and the number of rows;
    ``first`` marks one row that has the smallest id."""
    from pyspark import TaskContext

    at = TaskContext.get().partitionId() << 36
    for batch in it:
        for part in common.batches_of(iter([batch]), "text", 32 << 20):
            n = part.num_rows
            raw, off = common.text_bytes(part.column("text"))
            view, found, group = raw.tobytes(), {}, np.empty(n, np.int64)
            for i in range(n):
                group[i] = found.setdefault(view[off[i] : off[i + 1]], i)
            ids = part.column("doc_id")
            null, value = ids.is_null().to_numpy(zero_copy_only=False), ids.fill_null(0).to_numpy(zero_copy_only=False)
            order = np.lexsort((value, null, group))
            lowest = order[np.r_[True, group[order][1:] != group[order][:-1]]] if n else order
            first, own = np.zeros(n, bool), group == np.arange(n)
            first[lowest] = True
            sizes = np.bincount(group, minlength=n)
            yield pa.RecordBatch.from_arrays([ids, pa.array(at + group), pa.array(np.where(own, sizes, 0)), pa.array(first), part.column("key"), pa.array([x if o else None for x, o in zip(part.column("text").to_pylist(), own)], pa.string())], [x.split()[0] for x in LOCAL.split(", ")])
            at += n


def _own(uri: str, keep_files: bool, capacity: int):
    def run(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        index = None
        for batch in it:
            if not batch.num_rows:
                continue
            if index is None:
                fs, root = pafs.FileSystem.from_uri(uri)
                # each attempt has files of its own: a retried or speculative task never reads another's
                base = f"{root}/owner-{TaskContext.get().partitionId():06d}-{uuid.uuid4().hex}"
                texts, index = Texts(fs, f"{base}/texts"), ExtendibleHash(Log(fs, f"{base}/pages"), capacity)
            keys, reps = batch.column("key").to_numpy().view(np.uint64).tolist(), batch.column("rep").to_pylist()
            raw, off = common.text_bytes(batch.column("text"))
            view, group = memoryview(raw), []
            for i, key in enumerate(keys):
                text = view[off[i] : off[i + 1]]
                for number, size, at in index.chain(key):
                    if size == len(text) and texts.read(at) == text:
                        group.append(number)
                        break
                else:
                    index.add(key, (reps[i], len(text), texts.append(bytes(text))))
                    group.append(reps[i])
            yield pa.RecordBatch.from_arrays([batch.column("rep"), pa.array(group, pa.int64())], ["rep", "group"])
        if index is not None:
            texts.log.close()
            index.close(f"{base}/directory")
            if not keep_files:
                fs.delete_dir(base)

    return run


def exact_duplicates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", keep_files: str | None = None, key: Column | None = None, capacity: int = BUCKET, owner_rows: int = OWNER_ROWS) -> DataFrame:
    """One row for each row of ``docs``: ``doc_id``, ``keep_id`` (the smallest id
    among rows with the same text), ``copies`` (rows with that text), ``kept``
    (true for one row of each text).

    Null text: no copy of anything, ``keep_id`` is the row's own id, ``copies``
    1, kept. Empty texts are copies of one another. A null id sorts after all
    ids. Rows that repeat whole count as copies, of which one is kept. No rows:
    no rows. Further columns of ``docs`` are not read. ``keep_files`` names a folder
    under which every owner leaves its texts, pages and directory; else it deletes its
    own. ``key`` takes the place of the texts' 64-bit hash.
    """
    spark = docs.sparkSession
    uri = keep_files or common.shared_path(spark, "exact-dedup")
    rows = docs.select(F.col(id_col).cast("bigint").alias("doc_id"), F.col(text_col).alias("text"))
    keyed = rows.where("text is not null").select("doc_id", (F.xxhash64("text") if key is None else key).cast("bigint").alias("key"), "text")
    # written once: the numbers of representatives are the same for every later reader
    local = common.written(keyed.mapInArrow(_united, LOCAL), "exact-dedup-rows")
    reps = local.where("text is not null").select("rep", "key", "text")
    n, size = reps.agg(F.count("*"), F.coalesce(F.sum(F.octet_length("text")), F.lit(0))).first()
    owners = max(common.partitions(spark), -(-n // owner_rows), -(-size // OWNER_BYTES))
    # the upper 31 bits of the key, scaled to the number of owners: each owner has one range of keys
    owner = F.shiftrightunsigned(F.shiftrightunsigned("key", 33) * owners, 31).cast("int")
    groups = common.cut(reps.repartitionById(owners, owner).sortWithinPartitions("key").mapInArrow(_own(uri, keep_files is not None, capacity), "rep bigint, group bigint"))
    # the smallest id of each representative's rows, then of each group; all is partial first
    lowest = local.where("first").select("rep", "doc_id").hint("merge").join(local.where("size > 0").select("rep", "size"), "rep").hint("merge").join(groups, "rep")
    best = F.min(F.struct(F.col("doc_id").isNull().alias("none"), "doc_id", "rep"))
    whole = lowest.groupBy("group").agg(best.alias("best"), F.sum("size").alias("copies"))
    named = groups.hint("merge").join(whole, "group").select("rep", F.col("best.doc_id").alias("keep_id"), "copies", (F.col("best.rep") == F.col("rep")).alias("leads"))
    owned = local.select("doc_id", "rep", "first").hint("merge").join(named, "rep").select("doc_id", "keep_id", "copies", (F.col("first") & F.col("leads")).alias("kept"))
    alone = rows.where("text is null").select("doc_id", F.col("doc_id").alias("keep_id"), F.lit(1).cast("bigint").alias("copies"), F.lit(True).alias("kept"))
    return owned.unionByName(alone)


def op8_exact_dedup(spark, sf_dir: str) -> DataFrame:
    return exact_duplicates(common.documents(spark, sf_dir))


OP8_SQL = """
SELECT doc_id,
       CASE WHEN text IS NULL THEN doc_id ELSE min(doc_id) OVER (PARTITION BY text) END AS keep_id,
       CASE WHEN text IS NULL THEN 1 ELSE count(*) OVER (PARTITION BY text) END AS copies,
       text IS NULL OR row_number() OVER (PARTITION BY text ORDER BY doc_id) = 1 AS kept
FROM documents
"""
