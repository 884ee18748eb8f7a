"""Graph between sections: adjacency, links, overlap of keywords and of symbols.

Overlap is a search for the most similar sets. Sections with equal sets count as one.
With a threshold each set is held against all, without a table of pairs. Where there is none, as
for symbols, sets are joined by rare items, and those that share only
frequent items are compared by these items and their sizes.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from verbatrix.functions import text as T
from verbatrix.operators import markdown, similar
from verbatrix.sources import shared

KEYWORD_LEAST, TOP = 0.2, 5
#: Items of more sets than this make no pairs of sets; the sets that share only such items are found by signature.
HEAVY = 256
KINDS = ("heading_prev", "heading_next", "intra_doc_link", "keyword_overlap", "symbol_overlap")
EDGE = ["src_ref", "dst_ref", "kind", "edge_type", "rank"]


def refs(sections: DataFrame) -> DataFrame:
    return sections.withColumn("ref", F.concat_ws("#", "doc_id", "anchor"))


def _copy(last: bool = False) -> Column:
    """Number of a section among those with its reference, in order or from the last."""
    line, path = F.col("line_start"), T.icu(F.col("source_path"))
    return F.row_number().over(Window.partitionBy("doc_id", "anchor").orderBy(*((line.desc(), path.desc()) if last else (line, path))))


def adjacent(sections: DataFrame) -> DataFrame:
    """Edges to the section before and after in the same document; those of the first section with a reference."""
    doc = Window.partitionBy("doc_id").orderBy("line_start", T.icu(F.col("source_path")))
    near = refs(sections).select("ref", F.lag("ref").over(doc).alias("before"), F.lead("ref").over(doc).alias("after"), _copy().alias("copy")).where("copy = 1")
    both = near.select(F.col("ref").alias("src_ref"), F.explode(F.array(F.struct(F.col("before").alias("dst_ref"), F.lit(0).alias("kind")), F.struct(F.col("after").alias("dst_ref"), F.lit(1).alias("kind")))).alias("e"))
    return both.where("e.dst_ref is not null").select("src_ref", "e.dst_ref", "e.kind", F.lit("heading_adjacent").alias("edge_type"), F.lit(1).alias("rank"))


def links(sections: DataFrame) -> DataFrame:
    """Edges along markdown links, each target once; a target may not exist."""
    own = refs(sections).withColumn("copy", _copy()).where("copy = 1")
    found = own.select("ref", "doc_id", F.explode(F.split("body", "\n", -1)).alias("line")).select("ref", "doc_id", F.explode(F.regexp_extract_all("line", F.lit("\\[[^\\]]+\\]\\(([^)]+)\\)"), F.lit(1))).alias("target"))
    resolved = found.select(F.col("ref").alias("src_ref"), T.resolve_link(F.col("doc_id"), F.col("target")).alias("dst_ref")).where("dst_ref is not null").distinct()
    rank = F.row_number().over(Window.partitionBy("src_ref").orderBy(T.icu(F.col("dst_ref"))))
    return resolved.select("src_ref", "dst_ref", F.lit(2).alias("kind"), F.lit("intra_doc_link").alias("edge_type"), rank.alias("rank"))


def keyword_sets(units: DataFrame) -> DataFrame:
    """(ref, item): the keywords of three or more letters of each section; of several units the same more than once."""
    return units.select("ref", F.explode(F.array_distinct("keywords")).alias("item")).where("length(item) > 2")


def symbol_sets(sections: DataFrame) -> DataFrame:
    """(ref, item): symbol-like words of each section's lines and code; of sections with one reference the last
    counts. ``sections`` have them as ``symbols``, else they are looked for. Text isn't shuffled for them."""
    found = sections if "symbols" in sections.columns else markdown.with_symbols(sections)
    last = F.max_by("symbols", F.struct("line_start", T.icu(F.col("source_path")).alias("path")))
    return refs(found.groupBy("doc_id", "anchor").agg(last.alias("symbols"))).select("ref", F.explode("symbols").alias("item"))


def overlap(sets: DataFrame, least: float, top: int = TOP, heavy: int = HEAVY, asked: DataFrame | None = None) -> DataFrame:
    """(src_ref, dst_ref, score, rank): for each ref of ``sets`` (ref, item) the
    ``top`` others of largest Jaccard similarity, ``least`` or more and above 0; ties by
    ref. Items of one 64-bit hash count as one. ``asked`` (ref) names the refs that are wanted, if not all.

    With a threshold the sets are searched block by block (``similar``). Without one, items of more than ``heavy``
    sets aren't joined: what shares nothing else is found by ``_by_signature``."""
    # items as 64-bit hashes: what is compared and shuffled is numbers
    sets = sets.select("ref", F.xxhash64("item").alias("item"))
    own, offered = _searched(sets, least, top, asked) if least > 0 else _joined(shared.written(sets.distinct(), "item-sets"), top, heavy)
    best = F.row_number().over(Window.partitionBy("x_sid").orderBy(F.desc("score"), T.icu(F.col("dst_ref"))))
    offered = offered.withColumn("n", best).where(F.col("n") <= top + 1).drop("n")
    if asked is not None:
        own = own.join(asked.select("ref").distinct(), "ref", "left_semi")
    final = own.select(F.col("ref").alias("src_ref"), F.col("sid").alias("x_sid")).join(offered, "x_sid").where("src_ref <> dst_ref")
    rank = F.row_number().over(Window.partitionBy("src_ref").orderBy(F.desc("score"), T.icu(F.col("dst_ref"))))
    return final.select("src_ref", "dst_ref", "score", rank.alias("rank")).where(F.col("rank") <= top)


def _members(own: DataFrame, top: int) -> DataFrame:
    """(sid, members): of equal sets the first ``top`` + 1 refs, which are enough for anyone's best."""
    n = F.row_number().over(Window.partitionBy("sid").orderBy(T.icu(F.col("ref"))))
    return own.select("sid", "ref", n.alias("n")).where(F.col("n") <= top + 1).groupBy("sid").agg(F.array_sort(F.collect_list(F.struct("n", "ref"))).alias("members"))


def _named(own: DataFrame) -> DataFrame:
    return own.withColumn("sid", F.sha2(F.array_join(F.transform("items", lambda x: x.cast("string")), ","), 256))


def _searched(sets: DataFrame, least: float, top: int, asked: DataFrame | None) -> tuple[DataFrame, DataFrame]:
    """Refs with their sets, and what is offered to each set, by search among all distinct sets."""
    own = _named(sets.groupBy("ref").agg(F.sort_array(F.collect_set("item")).alias("items")))
    first = shared.written(own, "own-sets")
    own = first.select("ref", "sid")
    members = shared.written(_members(own, top).withColumn("first", F.col("members")[0]["ref"]), "members")
    # a number for each set in the order of its first ref, by which ties are settled
    order = T.icu(F.col("first"))
    numbers = members.select("sid", "first").repartitionByRange(order).sortWithinPartitions(order).select("sid", F.monotonically_increasing_id().alias("ordinal"))
    one = first.join(members.select("sid", F.col("first").alias("ref")), ["sid", "ref"], "left_semi").select("sid", "items")
    ordered = one.join(numbers, "sid").repartitionByRange(F.size("items"), "ordinal").sortWithinPartitions(F.size("items"), "ordinal")
    distinct = shared.written(ordered.select("ordinal", "sid", "items"), "distinct-sets")
    wanted = distinct if asked is None else distinct.join(own.join(asked.select("ref").distinct(), "ref", "left_semi").select("sid").distinct(), "sid", "left_semi")
    near = similar.nearest(distinct, wanted, least, top + 1)
    name = lambda c: distinct.select(F.col("ordinal").alias(c), F.col("sid").alias(f"{c}_sid"))
    offered = near.join(name("x"), "x").join(name("y"), "y").join(members.select(F.col("sid").alias("y_sid"), "members"), "y_sid")
    return own, offered.select("x_sid", "score", F.explode(F.col("members.ref")).alias("dst_ref"))


def _joined(sets: DataFrame, top: int, heavy: int) -> tuple[DataFrame, DataFrame]:
    """The same without a threshold, by a join along items that few sets have."""
    df = sets.groupBy("item").agg(F.count("*").alias("df"))
    own = sets.join(df, "item").groupBy("ref").agg(F.array_sort(F.collect_list(F.struct("df", "item"))).alias("counted"))
    own = _named(own.select("ref", F.transform("counted", lambda x: x["item"]).alias("items"), F.size(F.filter("counted", lambda x: x["df"] <= heavy)).alias("rare")))
    distinct = own.groupBy("sid").agg(F.first("items").alias("items"), F.first("rare").alias("rare"))
    side = distinct.withColumn("head", F.slice("items", F.lit(1), F.col("rare"))).select("*", F.explode("head").alias("item"))
    x, y = (side.select("item", *[F.col(c).alias(f"{s}_{c}") for c in ("sid", "items", "head")]) for s in "xy")
    # each pair once, at the first item that both have
    near = x.join(y, "item").where("x_sid < y_sid").where(F.element_at(F.array_intersect("x_head", "y_head"), 1) == F.col("item"))
    both = F.size(F.array_intersect("x_items", "y_items"))
    near = near.select("x_sid", "y_sid", (both / (F.size("x_items") + F.size("y_items") - both)).alias("score"))
    pairs = near.unionByName(near.select(F.col("y_sid").alias("x_sid"), F.col("x_sid").alias("y_sid"), "score")).unionByName(distinct.select(F.col("sid").alias("x_sid"), F.col("sid").alias("y_sid"), F.lit(1.0).alias("score")))
    offered = pairs.join(_members(own, top).withColumnRenamed("sid", "y_sid"), "y_sid").select("x_sid", "score", F.explode(F.col("members.ref")).alias("dst_ref"))
    return own, offered.unionByName(_by_signature(own, distinct, top)).groupBy("x_sid", "dst_ref").agg(F.max("score").alias("score"))


def _by_signature(own: DataFrame, distinct: DataFrame, top: int) -> DataFrame:
    """(x_sid, dst_ref, score): the best others by frequent items alone.

    A set's frequent items are its signature. If two sets share nothing else, their
    similarity follows from the signatures and sizes, and falls with the other's
    size: of each signature the ``top`` + 1 smallest sets, by ref, are enough.
    Where more is shared the score here is too low, and the true one comes from the rare item."""
    tail = F.slice("items", F.col("rare") + 1, F.greatest(F.lit(0), F.size("items") - F.col("rare")))
    named = lambda df: df.where("rare < size(items)").withColumns({"tail": tail, "size": F.size("items")}).withColumn("sign", F.sha2(F.array_join(F.transform("tail", lambda x: x.cast("string")), ","), 256))
    sets = named(distinct)
    signs = sets.groupBy("sign").agg(F.first("tail").alias("tail"))
    smallest = F.row_number().over(Window.partitionBy("sign").orderBy("size", T.icu(F.col("ref"))))
    offers = named(own).withColumn("n", smallest).where(F.col("n") <= top + 1).select(F.col("sign").alias("y_sign"), F.col("ref").alias("dst_ref"), F.col("size").alias("y_size"))
    x, y = (signs.select(F.col("sign").alias(f"{s}_sign"), F.col("tail").alias(f"{s}_tail"), F.explode("tail").alias("item")) for s in "xy")
    met = x.join(y, "item").where(F.element_at(F.array_intersect("x_tail", "y_tail"), 1) == F.col("item")).select("x_sign", "y_sign", F.size(F.array_intersect("x_tail", "y_tail")).alias("both"))
    # once for each signature and size, not for each set
    kinds = sets.select(F.col("sign").alias("x_sign"), F.col("size").alias("x_size")).distinct()
    rated = kinds.join(met, "x_sign").join(offers, "y_sign").withColumn("score", F.col("both") / (F.col("x_size") + F.col("y_size") - F.col("both")))
    best = F.row_number().over(Window.partitionBy("x_sign", "x_size").orderBy(F.desc("score"), T.icu(F.col("dst_ref"))))
    rated = rated.withColumn("n", best).where(F.col("n") <= top + 1).select("x_sign", "x_size", "dst_ref", "score")
    return sets.select(F.col("sid").alias("x_sid"), F.col("sign").alias("x_sign"), F.col("size").alias("x_size")).join(rated, ["x_sign", "x_size"]).select("x_sid", "score", "dst_ref")


def keyword_overlap(units: DataFrame, asked: DataFrame | None = None) -> DataFrame:
    return overlap(keyword_sets(units), KEYWORD_LEAST, asked=asked).select("src_ref", "dst_ref", F.lit(3).alias("kind"), F.lit("keyword_overlap").alias("edge_type"), "rank", "score")


def symbol_overlap(sections: DataFrame, asked: DataFrame | None = None) -> DataFrame:
    return overlap(symbol_sets(sections), 0.0, asked=asked).select("src_ref", "dst_ref", F.lit(4).alias("kind"), F.lit("symbol_overlap").alias("edge_type"), "rank", "score")


def edges(sections: DataFrame, units: DataFrame, asked: DataFrame | None = None) -> DataFrame:
    """All edges, or those of the refs in ``asked`` (ref): src_ref, dst_ref, kind (order of kinds), edge_type, rank."""
    out = adjacent(sections).unionByName(links(sections))
    if asked is not None:
        out = out.join(asked.select(F.col("ref").alias("src_ref")).distinct(), "src_ref", "left_semi")
    return out.unionByName(keyword_overlap(units, asked).select(EDGE)).unionByName(symbol_overlap(sections, asked).select(EDGE))
