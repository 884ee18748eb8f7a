"""Removal of repeated line runs by a suffix array over line-ID sequences.

Every document is a sequence of line IDs. The suffixes of all sequences are
sorted by distributed prefix doubling: the first order is that of the 128-bit
IDs of their first lines, by a range partitioning that is salted so that a line
which is a third of all lines is spread over tasks like the others; a rank is the
number of smaller suffixes. A round that doubles the sorted depth k refines each
interval of equal ranks by the rank k lines further on, from counts of the pairs
of ranks. Suffixes that stand alone are sorted and leave. After the round for k the
intervals are those of suffixes whose longest common prefix is k lines or more.
Every round is written to the shared folder, so that no plan grows with the rounds.

A run of lines counts as repeated if it has ``min_words`` words and occurs at
two places. Such a run is the union of the shortest runs of ``min_words``
words that start or end at one of its lines; each of these is looked up as the
two overlapping power-of-two intervals that cover it. The first place
(smallest document and line) keeps its lines, those of later places go.
Depths beyond the longest shortest run can't change that; the doubling ends there.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from verbatrix.llm import common

MIN_WORDS = 50
#: Parts of the ranks within an interval whose counts are summed before the ranks themselves.
CHUNKS = 1024
LINES = "doc bigint, key bigint, pos int, h1 bigint, h2 bigint, ahead int, back int"


def shortest_runs(words: np.ndarray, least: int) -> tuple[np.ndarray, np.ndarray]:
    """For each line the number of lines in the shortest run of ``least`` words
    that starts there, and that ends there; 0 where there is none."""
    n = len(words)
    total = np.r_[0, np.cumsum(words)]
    end = np.searchsorted(total, total[:-1] + least, side="left")
    ahead = np.where(end <= n, end - np.arange(n), 0)
    start = np.searchsorted(total, total[1:] - least, side="right") - 1
    back = np.where(start >= 0, np.arange(n) + 1 - start, 0)
    return ahead.astype(np.int32), back.astype(np.int32)


def _line_rows(min_words: int):
    def run(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in common.batches_of(it, "text"):
            raw, off = common.text_bytes(batch.column("text"))
            data = raw.tobytes()
            counts, ids, ahead, back = [], [], [], []
            for i in range(batch.num_rows):
                lines = data[off[i] : off[i + 1]].split(b"\n")
                counts.append(len(lines))
                ids.append(b"".join([xxhash.xxh3_128_digest(x) for x in lines]))
                a, b = shortest_runs(np.array([len(x.split()) for x in lines]), min_words)
                ahead.append(a)
                back.append(b)
            h = np.frombuffer(b"".join(ids), np.int64).reshape(-1, 2)
            row = np.repeat(np.arange(batch.num_rows), counts)
            pos = np.arange(len(row)) - np.repeat(np.r_[0, np.cumsum(counts)[:-1]], counts)
            take = pa.array(row)
            yield pa.RecordBatch.from_arrays(
                [batch.column("doc").take(take), batch.column("key").take(take), pa.array(pos.astype(np.int32)), pa.array(np.ascontiguousarray(h[:, 0])), pa.array(np.ascontiguousarray(h[:, 1])), pa.array(np.concatenate(ahead)), pa.array(np.concatenate(back))],
                ["doc", "key", "pos", "h1", "h2", "ahead", "back"],
            )

    return run


def _ordered_rows(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Sorted rows of one partition with the number of the first row that has
    their pair, and whether the pair is there once. One row of a batch is held
    back until its successor is known."""
    from pyspark import TaskContext

    part, at, first, last, held = TaskContext.get().partitionId(), 0, 0, None, None
    for batch in it:
        if not batch.num_rows:
            continue
        if held is not None:
            batch = pa.Table.from_batches([held, batch]).combine_chunks().to_batches()[0]
        r, z = batch.column("r").to_numpy(), batch.column("z").to_numpy()
        new = np.r_[last is None or last != (r[0], z[0]), (r[1:] != r[:-1]) | (z[1:] != z[:-1])]
        number = at + np.arange(len(r))
        firsts = np.maximum.accumulate(np.where(new, number, first))
        done = len(r) - 1
        if done:
            yield _placed(batch.slice(0, done), part, firsts[:done], new[:done] & new[1:])
            at, first, last = at + done, int(firsts[done - 1]), (r[done - 1], z[done - 1])
        held = batch.slice(done)
    if held is not None:
        r, z = held.column("r").to_numpy()[0], held.column("z").to_numpy()[0]
        new = last is None or last != (r, z)
        yield _placed(held, part, np.array([at if new else first]), np.array([new]))


def _placed(batch: pa.RecordBatch, part: int, firsts: np.ndarray, alone: np.ndarray) -> pa.RecordBatch:
    out = [*batch.columns, pa.array(np.full(batch.num_rows, part, np.int32)), pa.array(firsts.astype(np.int64)), pa.array(alone)]
    return pa.RecordBatch.from_arrays(out, [*batch.schema.names, "part", "first", "alone"])


def ordered(pairs: DataFrame) -> tuple[DataFrame, int]:
    """(doc, key, pos, r) of the suffixes that share their pair (r, z) with
    another one; the new r is the number of rows with smaller pairs. And the number of rows.

    The rows are range partitioned by pair and, among equal pairs, by a hash of
    their place, so that no task has more than its share, however often a pair
    occurs. The driver sees one row for each partition and joins the ends."""
    spark = pairs.sparkSession
    parts = common.partitions(spark)
    rows = (
        pairs.withColumn("salt", F.xxhash64("doc", "key", "pos")).repartitionByRange(parts, "r", "z", "salt").sortWithinPartitions("r", "z")
        .select("doc", "key", "pos", "r", "z").mapInArrow(_ordered_rows, "doc bigint, key bigint, pos int, r bigint, z bigint, part int, first bigint, alone boolean")
    )
    rows = common.cut(rows)
    pair = F.struct("r", "z")
    ends = rows.groupBy("part").agg(F.count("*").alias("n"), F.min(pair).alias("low"), F.max(pair).alias("high"), F.max("first").alias("tail")).orderBy("part").collect()
    joined, base, rank = [], 0, 0
    for i, e in enumerate(ends):
        before = i > 0 and tuple(ends[i - 1].high) == tuple(e.low)
        after = i + 1 < len(ends) and tuple(ends[i + 1].low) == tuple(e.high)
        head = rank if before else base
        rank = head if e.tail == 0 else base + e.tail
        joined.append((e.part, base, head, e.tail, before, after))
        base += e.n
    # one row for each partition: bounded by their number
    ends = spark.createDataFrame(joined, "part int, base bigint, head bigint, tail bigint, before boolean, after boolean")
    at_head, at_tail = F.col("first") == 0, F.col("first") == F.col("tail")
    ranked = rows.join(F.broadcast(ends), "part").where(~F.col("alone") | (at_head & F.col("before")) | (at_tail & F.col("after"))).select(
        "doc", "key", "pos", F.when(at_head, F.col("head")).otherwise(F.col("base") + F.col("first")).alias("r")
    )
    return ranked, base


def refined(pairs: DataFrame, total: int) -> DataFrame:
    """(doc, key, pos, r) of the suffixes that share their pair (r, z) with
    another one, ordered within their interval of equal r by z; ``total`` is above all ranks.

    Only counts by pair are put in order, in ``CHUNKS`` chunks of z whose own
    counts are summed first: a chunk has at most total / CHUNKS values. The join
    back is by sort, where a pair with many places can be split."""
    counted = pairs.groupBy("r", "z").agg(F.count("*").alias("n")).where("n > 1").withColumn("c", F.expr(f"z * {CHUNKS} div {total}"))
    before = lambda by, at: F.coalesce(F.sum("n").over(Window.partitionBy(*by).orderBy(at).rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    chunks = counted.groupBy("r", "c").agg(F.sum("n").alias("n")).select("r", "c", before(["r"], "c").alias("chunk"))
    placed = counted.withColumn("within", before(["r", "c"], "z")).hint("merge").join(chunks, ["r", "c"])
    return pairs.hint("merge").join(placed.select("r", "z", (F.col("r") + F.col("chunk") + F.col("within")).alias("new")), ["r", "z"]).select("doc", "key", "pos", F.col("new").alias("r"))


def _later_runs(docs: DataFrame, id_col: str, text_col: str, min_words: int) -> DataFrame:
    """(doc, key, start, size): the shortest runs that have an earlier place."""
    rows = (
        docs.where(F.col(id_col).isNotNull() & F.col(text_col).isNotNull())
        .select(F.col(id_col).cast("bigint").alias("doc"), common.text_key(id_col, text_col).alias("key"), F.col(text_col).alias("text"))
    )
    lines = rows.mapInArrow(_line_rows(min_words), LINES)
    # rows that repeat whole are one document: each line of it once
    lines = common.cut(lines.groupBy("doc", "key", "pos").agg(F.first("h1").alias("h1"), F.first("h2").alias("h2"), F.first("ahead").alias("ahead"), F.first("back").alias("back")))
    # depth 1: suffixes whose first line occurs once stand alone and leave
    ranked, total = ordered(lines.select("doc", "key", "pos", F.col("h1").alias("r"), F.col("h2").alias("z")))
    ranked = common.cut(ranked)
    # a run whose first or last line occurs once isn't repeated
    ends = ranked.select("doc", "key", "pos").hint("merge").join(lines.where("ahead > 0 or back > 0").select("doc", "key", "pos", "ahead", "back"), ["doc", "key", "pos"])
    runs = common.cut(
        ends.where("ahead > 0").select("doc", "key", F.col("pos").alias("start"), F.col("ahead").alias("size"))
        .unionByName(ends.where("back > 0").select("doc", "key", (F.col("pos") - F.col("back") + 1).alias("start"), F.col("back").alias("size")))
        .distinct()
        # the interval to look at: the largest power of two that isn't longer than the run
        .withColumn("depth", F.expr("cast(1 as int) << cast(floor(log2(size)) as int)"))
    )
    longest = runs.agg(F.max("size")).first()[0] or 0
    ranks, depth = ranked.withColumn("depth", F.lit(1)), 1
    while 2 * depth <= longest:
        ranked = common.cut(refined(ranked.hint("merge").join(ranked.select("doc", "key", (F.col("pos") - depth).alias("pos"), F.col("r").alias("z")), ["doc", "key", "pos"]), total))
        depth *= 2
        ranks = ranks.unionByName(ranked.withColumn("depth", F.lit(depth)))
    # a run is named by the intervals at its start and depth lines before its end
    by_place = ["doc", "key", "depth", "pos"]
    at_start = runs.withColumn("pos", F.col("start")).hint("merge").join(ranks, by_place).withColumn("pos", F.expr("start + size - depth"))
    named = common.cut(at_start.hint("merge").join(ranks.withColumnRenamed("r", "z"), by_place).drop("pos", "depth"))
    # the first place of each run, from partial minima
    place = F.struct("doc", "key", "start")
    first = named.groupBy("size", "r", "z").agg(F.min(place).alias("at"), F.count("*").alias("n")).where("n > 1").drop("n")
    return named.hint("merge").join(first, ["size", "r", "z"]).where(place > F.col("at")).select("doc", "key", "start", "size")


def _islands(runs: DataFrame) -> DataFrame:
    """(doc, key, s, e): the runs of each document united to ranges of lines."""
    by_start = Window.partitionBy("doc", "key").orderBy("start", "size")
    reach = F.max(F.col("start") + F.col("size")).over(by_start.rowsBetween(Window.unboundedPreceding, -1))
    marked = runs.withColumn("reach", reach).withColumn("island", F.sum((F.coalesce("reach", F.lit(-1)) < F.col("start")).cast("int")).over(by_start))
    return marked.groupBy("doc", "key", "island").agg(F.min("start").alias("s"), F.max(F.col("start") + F.col("size") - 1).alias("e"))


def repeated_lines(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", min_words: int = MIN_WORDS) -> DataFrame:
    """(doc, key, pos): the lines to delete, counted from 0. ``key`` is the
    content key of the document (``common.text_key``)."""
    return _islands(_later_runs(docs, id_col, text_col, min_words)).select("doc", "key", F.explode(F.sequence("s", "e")).alias("pos"))


def dedup_lines(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", min_words: int = MIN_WORDS, count_col: str | None = "n_chars") -> DataFrame:
    """The rows of ``docs`` without the later copies of repeated line runs.

    Lines end at ``\\n`` and are compared byte by byte; words are runs of bytes
    other than ASCII white space. All columns stay, in order; ``count_col``, if
    ``docs`` has it, becomes the length of the new text where lines went. A document of which
    every line went is left out. Rows with null id or null text pass as they
    are, an empty text is one line without words and passes too. Rows that repeat id
    and text are one document and get the same decision; rows that share only
    the id are ordered by a hash of their content. No rows: no rows.
    """
    # a document's ranges of lines are one array
    ranges = _islands(_later_runs(docs, id_col, text_col, min_words))
    masks = ranges.groupBy("doc", "key").agg(F.collect_list(F.struct("s", "e")).alias("__vx_ranges")).select(F.col("key").alias("__vx_key"), F.col("doc").alias("__vx_doc"), "__vx_ranges")
    joined = docs.join(masks, (F.col(id_col).cast("bigint") == F.col("__vx_doc")) & (common.text_key(id_col, text_col) == F.col("__vx_key")), "left")
    rest = F.filter(F.split(F.col(text_col), "\n", -1), lambda line, i: ~F.exists("__vx_ranges", lambda r: i.between(r["s"], r["e"])))
    cut = joined.withColumn("__vx_rest", F.when(F.col("__vx_ranges").isNotNull(), rest)).where(F.col("__vx_rest").isNull() | (F.size("__vx_rest") > 0))
    touched, text = F.col("__vx_rest").isNotNull(), F.array_join("__vx_rest", "\n")
    out = []
    for name, kind in docs.dtypes:
        old = F.col(f"`{name}`")
        if name == text_col:
            out.append(F.when(touched, text).otherwise(old).alias(name))
        elif name == count_col:
            out.append(F.when(touched, F.length(text).cast(kind)).otherwise(old).alias(name))
        else:
            out.append(old)
    return cut.select(*out)


def op1_line_dedup(spark, sf_dir: str) -> DataFrame:
    return dedup_lines(common.documents(spark, sf_dir))


#: All pairs of equal lines, joined to runs along their diagonals; a run of enough words marks its later place.
OP1_SQL = f"""
WITH lines AS (
    SELECT doc_id, CAST(unnest(generate_series(1, len(string_split(text, chr(10))))) AS BIGINT) AS pos, unnest(string_split(text, chr(10))) AS line FROM documents WHERE text IS NOT NULL AND doc_id IS NOT NULL
), n AS (
    SELECT doc_id, pos, line, len(regexp_extract_all(line, '[^ \\t\\n\\r\\f\\x0b]+')) AS words FROM lines
), pairs AS (
    SELECT b.doc_id, b.pos, b.words, a.doc_id AS o_doc, a.pos - b.pos AS shift
    FROM n a JOIN n b ON a.line = b.line AND (a.doc_id, a.pos) < (b.doc_id, b.pos)
), islands AS (
    SELECT *, pos - row_number() OVER (PARTITION BY doc_id, o_doc, shift ORDER BY pos) AS island FROM pairs
), runs AS (
    SELECT doc_id, min(pos) AS s, max(pos) AS e FROM islands GROUP BY doc_id, o_doc, shift, island HAVING sum(words) >= {MIN_WORDS}
), gone AS (
    SELECT DISTINCT doc_id, unnest(generate_series(s, e)) AS pos FROM runs
), kept AS (
    SELECT n.doc_id, string_agg(line, chr(10) ORDER BY n.pos) AS text FROM n ANTI JOIN gone USING (doc_id, pos) GROUP BY n.doc_id
)
SELECT d.doc_id, k.text, d.lang, d.source, CASE WHEN k.text = d.text THEN d.n_chars ELSE length(k.text) END AS n_chars
FROM documents d JOIN kept k USING (doc_id)
"""
