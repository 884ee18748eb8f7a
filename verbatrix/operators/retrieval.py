"""Lexical retrieval with transparent scores under token budgets, for batches of queries.

Every unit is a candidate of every query. Each task sorts its units in the order that
settles ties and takes them in chunks, which meet all queries of a block:
a query's weights are added along the postings of its tokens, for all units of
the chunk at once, and only the keys of the task's best units of each query leave it. The
sums run in the order of the query's tokens, as the column expressions below do,
so that both give the same score to the last digit.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from verbatrix.functions import text as T
from verbatrix.sources import shared

BUDGET, MAX_ITEMS, DEPTH = 600, 5, 20
MAX_SIMILARITY = 0.85
UNIT = ["unit_id", "doc_id", "anchor", "ref", "line_start", "line_end", "type", "text", "text_hash", "citation_id", "token_estimate", "source_path"]
#: Units of a chunk and queries of a block at most, about.
CHUNK, BLOCK = 1 << 16, 512
#: Keys of chosen units that are broadcast at most.
BROADCAST = 1 << 16


def profiles(queries: DataFrame) -> DataFrame:
    """``queries`` (query_id, query; budget, max_items, refs if given) with their
    tokens, flags and intent. Missing or non-positive limits get the defaults."""
    def limit(name: str, default: int) -> Column:
        given = F.col(name).cast("int") if name in queries.columns else F.lit(None).cast("int")
        return F.when(given > 0, given).otherwise(default).alias(name)

    refs = F.col("refs") if "refs" in queries.columns else F.lit(None).cast("array<string>")
    text = F.coalesce("query", F.lit(""))
    return queries.select("query_id", "query", limit("budget", BUDGET), limit("max_items", MAX_ITEMS), refs.alias("refs"), *T.query_profile(text))


def token_df(units: DataFrame) -> DataFrame:
    """(token, df): in how many units each token occurs."""
    return units.select(F.explode(F.array_distinct("keywords")).alias("token")).groupBy("token").agg(F.count("*").alias("df"))


def weighted(profiled: DataFrame, df: DataFrame, units: DataFrame) -> DataFrame:
    """Profiles with ``terms``: (position, token, weight) in order of the query."""
    total = units.agg(F.greatest(F.lit(1), F.count("*")).alias("n_units"))
    terms = profiled.select("query_id", F.posexplode("tokens").alias("at", "token"))
    # only the statistics of asked tokens travel
    asked = df.join(terms.select("token").distinct(), "token", "left_semi")
    weight = F.log(1 + F.col("n_units") / (F.coalesce("df", F.lit(0)) + 1))
    own = terms.join(asked, "token", "left").crossJoin(total).groupBy("query_id").agg(F.array_sort(F.collect_list(F.struct("at", "token", weight.alias("w")))).alias("terms"))
    return profiled.join(own, "query_id", "left").withColumn("terms", F.coalesce("terms", F.expr("cast(array() as array<struct<at: int, token: string, w: double>>)")))


def prepared(units: DataFrame, sections: DataFrame) -> DataFrame:
    """Units with what scoring needs of them and of their section."""
    return marked(located(units, sections))


def located(units: DataFrame, sections: DataFrame) -> DataFrame:
    """Units with the ``source_path`` of their section; best asked for those that are chosen only."""
    # of sections with one reference the last one counts
    own = sections.select("doc_id", "anchor", "source_path", "line_start").groupBy("doc_id", "anchor").agg(F.max_by("source_path", F.struct("line_start", T.icu(F.col("source_path")))).alias("source_path"))
    return units.drop("source_path").join(own, ["doc_id", "anchor"], "left").withColumn("source_path", F.coalesce("source_path", F.lit("")))


def unlocated(units: DataFrame) -> DataFrame:
    """``marked`` without a look at the sections."""
    return marked(units.withColumn("source_path", F.lit("")))


def marked(units: DataFrame) -> DataFrame:
    heading = F.array_distinct(T.tokenize(F.coalesce("heading", F.lit(""))))
    return units.select(
        *UNIT, F.array_distinct("keywords").alias("words"), heading.alias("heading_words"),
        F.col("text").rlike(T.SYMBOL_ANYWHERE).alias("has_symbol"), T.is_low_signal(F.col("text")).alias("low_signal"),
        cost().alias("cost"),
    )


def cost() -> Column:
    return F.least(F.lit(1.0), F.greatest(F.lit(0.0), F.col("token_estimate") / 120))


def _overlap(words: str) -> Column:
    total = F.aggregate("terms", F.lit(0.0), lambda s, t: s + t["w"])
    hit = F.aggregate("terms", F.lit(0.0), lambda s, t: s + F.when(F.array_contains(words, t["token"]), t["w"]).otherwise(0.0))
    return F.when((F.size("terms") == 0) | (F.size(words) == 0) | (total <= 0), 0.0).otherwise(hit / total)


def _flag_matched() -> Column:
    low = F.lower("text")
    return F.exists("flags", lambda f: low.contains(f))


def _boosts(flagged: Column) -> tuple[Column, Column]:
    action = F.col("intent") == "action"
    symbol = F.when(flagged | (action & F.col("has_symbol") & F.col("has_letter")), 1.0).otherwise(0.0)
    command = F.when(action, F.when(F.col("type").isin("command", "step") & F.col("acts"), 1.0).otherwise(0.0)).when(F.col("type").isin("definition", "constraint"), 0.5).otherwise(0.0)
    return symbol, command


def _base(lexical, heading, symbol, command, cost) -> Column:
    return 0.55 * lexical + 0.15 * heading + 0.1 * symbol + 0.1 * command - 0.25 * cost


def scored(pairs: DataFrame) -> DataFrame:
    """Pairs of a unit and a query with the parts of the score and the base score."""
    flagged = F.col("flagged")
    mild = (F.col("intent") == "explain") & (F.col("type") == "command") & F.col("low_signal") & ~flagged
    symbol, command = _boosts(flagged)
    parts = pairs.withColumn("flagged", _flag_matched())
    parts = parts.withColumns({"lexical": _overlap("words") * F.when(mild, 0.7).otherwise(1.0), "heading_boost": _overlap("heading_words") * F.when(mild, 0.8).otherwise(1.0), "symbol_boost": symbol, "command_boost": command})
    return parts.withColumn("base_score", T.fixed(_base(*map(F.col, ("lexical", "heading_boost", "symbol_boost", "command_boost", "cost")))))


def why() -> Column:
    words = F.transform(F.filter("tokens", lambda t: F.array_contains("words", t)), lambda t: F.concat(F.lit("token:"), t))
    heading = F.transform(F.filter("tokens", lambda t: F.array_contains("heading_words", t)), lambda t: F.concat(F.lit("heading:"), t))
    low = F.lower("text")
    flags = F.transform(F.filter("flags", lambda f: low.contains(f)), lambda f: F.concat(F.lit("flag:"), f))
    none = F.array().cast("array<string>")
    kind = F.when(F.col("type") == "command", F.array(F.lit("command:type"))).otherwise(none)
    symbol = F.when(F.col("has_symbol"), F.array(F.lit("symbol:text"))).otherwise(none)
    return F.slice(F.array_distinct(F.concat(words, heading, flags, kind, symbol)), 1, 8)


def _order(score: str) -> list[Column]:
    return [F.desc(score), T.icu(F.col("doc_id")), T.icu(F.col("anchor")), F.col("line_start"), F.col("unit_id"), F.col("text_hash"), F.col("line_end")]


def _rounded(x: np.ndarray) -> np.ndarray:
    """``T.fixed`` to four digits."""
    a = np.abs(x)
    t = a * 134217729.0
    high = t - (t - a)
    p = a * 10000.0
    err = (high * 10000.0 - p) + (a - high) * 10000.0
    whole = np.floor(p)
    frac = p - whole
    return np.sign(x) * (whole + ((frac > 0.5) | ((frac == 0.5) & (err >= 0)))) / 10000.0 + 0.0


def _postings(lists: pa.Array, tokens: pa.Array) -> list[np.ndarray]:
    """For each token the numbers of the lists that have it."""
    code = pc.index_in(lists.flatten(), tokens)
    row = np.repeat(np.arange(len(lists)), pc.fill_null(pc.list_value_length(lists), 0).to_numpy(zero_copy_only=False))
    some = code.is_valid().to_numpy(zero_copy_only=False)
    code, row = code.drop_null().to_numpy().astype(np.int64), row[some]
    order = np.argsort(code, kind="stable")
    return np.split(row[order], np.searchsorted(code[order], np.arange(1, len(tokens))))


def _best_of(asked: list[dict], columns: list[str], bound: bool) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """The best units of a task for each query, from units in the order that settles
    ties. What it holds are a chunk of units and each query's best so far."""
    number = {t: i for i, t in enumerate(sorted({t["token"] for q in asked for t in q["terms"]}))}
    place = {q["query_id"]: i for i, q in enumerate(asked)}

    def rated(units: pa.Table, best: list[tuple[np.ndarray, pa.Table] | None]) -> None:
        n = units.num_rows
        col = lambda c: units[c].combine_chunks() if units[c].num_chunks != 1 else units[c].chunk(0)
        tokens = pa.array(list(number), pa.string())
        own, heads = (_postings(col(c), tokens) if number else [] for c in ("words", "heading_words"))
        some, some_heads = (pc.list_value_length(col(c)).to_numpy(zero_copy_only=False) > 0 for c in ("words", "heading_words"))
        kind = lambda *k: pc.is_in(col("type"), pa.array(k)).to_numpy(zero_copy_only=False)
        command, acting, stating = kind("command"), kind("command", "step"), kind("definition", "constraint")
        symbol, low, cost = (col(c).to_numpy(zero_copy_only=False) for c in ("has_symbol", "low_signal", "cost"))
        open_to = _postings(col("query_ids"), pa.array(list(place), pa.string())) if bound else None
        for i, q in enumerate(asked):
            hit, head, total = np.zeros(n), np.zeros(n), 0.0
            for t in q["terms"]:
                total += t["w"]
                hit[own[number[t["token"]]]] += t["w"]
                head[heads[number[t["token"]]]] += t["w"]
            share = lambda x, there: np.where(there, x / total, 0.0) if total > 0 else np.zeros(n)  # noqa: E731, B023
            flagged, action = np.zeros(n, bool), q["intent"] == "action"
            for f in q["flags"]:
                flagged |= pc.fill_null(pc.match_substring(col("dashed"), f), False).to_numpy(zero_copy_only=False)
            mild = command & low & ~flagged if not action else np.zeros(n, bool)
            lexical, heading = share(hit, some) * np.where(mild, 0.7, 1.0), share(head, some_heads) * np.where(mild, 0.8, 1.0)
            symbols = np.where(flagged | (symbol & (action and q["has_letter"])), 1.0, 0.0)
            commands = np.where(acting & q["acts"], 1.0, 0.0) if action else np.where(stating, 0.5, 0.0)
            score = _rounded(0.55 * lexical + 0.15 * heading + 0.1 * symbols + 0.1 * commands - 0.25 * cost)
            where = open_to[i] if bound else np.arange(n)
            score = score[where]
            if best[i] is not None and len(best[i][0]) == q["most"]:
                # an equal score comes later in order
                above = score > best[i][0][-1]
                score, where = score[above], where[above]
            if not len(score):
                continue
            first = np.argsort(-score, kind="stable")[: q["most"]]
            score, rows = score[first], units.select(columns).take(pa.array(where[first]))
            if best[i] is not None:
                score, rows = np.concatenate([best[i][0], score]), pa.concat_tables([best[i][1], rows])
                first = np.argsort(-score, kind="stable")[: q["most"]]
                score, rows = score[first], rows.take(pa.array(first)).combine_chunks()
            best[i] = score, rows

    def run(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        best, held, n = [None] * len(asked), [], 0
        for batch in it:
            held.append(batch)
            n += batch.num_rows
            if n >= CHUNK:
                rated(pa.Table.from_batches(held), best)
                held, n = [], 0
        if n:
            rated(pa.Table.from_batches(held), best)
        for q, b in zip(asked, best, strict=True):
            if b is not None:
                yield from b[1].append_column("query_id", pa.array([q["query_id"]] * len(b[0]), pa.string())).append_column("near_score", pa.array(b[0])).combine_chunks().to_batches()

    return run


#: What a unit is found by, and what it is scored by.
KEY = ["doc_id", "anchor", "line_start", "unit_id", "text_hash", "line_end", "type"]
SCORED = ["words", "heading_words", "has_symbol", "low_signal", "cost"]


def best_units(units: DataFrame, queries: DataFrame, within: DataFrame | None = None) -> DataFrame:
    """Units (``marked``) with the queries (``weighted``) whose best they are, ``most`` of each at most. With
    ``within`` (query_id, ref) a query sees these references only.

    Units are rated where they lie, and what leaves a task are keys: units themselves
    aren't shuffled, and those that are chosen are looked up by their keys at the end."""
    rows = queries.select(F.col("query_id").cast("string").alias("query_id"), "terms", "flags", "intent", "acts", "has_letter", (F.col("max_items") * DEPTH).alias("most")).collect()
    asked = [r.asDict(recursive=True) for r in rows]
    order = _order("cost")[1:]
    rated = units.select(*KEY, "ref", *SCORED, F.when(F.col("text").contains("--"), F.lower("text")).alias("dashed"))
    if within is not None:
        rated = rated.join(within.groupBy("ref").agg(F.collect_set(F.col("query_id").cast("string")).alias("query_ids")), "ref")
    near = rated.drop("ref").sortWithinPartitions(*order)
    schema = near.select(*KEY).schema.add("query_id", "string").add("near_score", "double")
    best = None
    for at in range(0, max(1, len(asked)), BLOCK):
        part = near.mapInArrow(_best_of(asked[at : at + BLOCK], KEY, within is not None), schema)
        best = part if best is None else best.unionByName(part)
    limit = queries.select(F.col("query_id").cast("string").alias("query_id"), (F.col("max_items") * DEPTH).alias("most"))
    rank = F.row_number().over(Window.partitionBy("query_id").orderBy(*_order("near_score")))
    most = max([q["most"] for q in asked], default=1)
    best = shared.written(best.withColumn("n", rank).where(F.col("n") <= most).join(limit, "query_id").where("n <= most").select("query_id", *KEY), "best")
    # of bounded size, else Spark chooses
    small = F.broadcast if sum(q["most"] for q in asked) <= BROADCAST else lambda df: df
    whole = units.join(small(best.select(*KEY).distinct()), KEY, "left_semi")
    named = queries.withColumn("own_id", F.col("query_id")).withColumn("query_id", F.col("query_id").cast("string"))
    return whole.join(small(best), KEY).join(named, "query_id").withColumn("query_id", F.col("own_id")).drop("own_id")


def candidates(units: DataFrame, queries: DataFrame, within: DataFrame | None = None) -> DataFrame:
    """Best units of each query, 20 for each item asked for. ``units`` are
    ``marked``, ``queries`` are ``weighted``. Queries with ``refs`` see the units of these references only.
    References too many for an array come as a table ``within`` (query_id, ref), which then binds every query."""
    if within is not None:
        return _ranked(best_units(units, queries, within))
    if "refs" in queries.columns and queries.where("refs is not null").limit(1).count():
        free, bound = queries.where("refs is null"), queries.where("refs is not null")
        named = units.join(bound.withColumn("ref", F.explode(F.array_distinct("refs"))), "ref")
        pairs = best_units(units, free) if free.limit(1).count() else None
        return _ranked(named if pairs is None else pairs.unionByName(named.select(pairs.columns)))
    return _ranked(best_units(units, queries))


def _ranked(pairs: DataFrame) -> DataFrame:
    ranked = scored(pairs).withColumn("rank", F.row_number().over(Window.partitionBy("query_id").orderBy(*_order("base_score"))))
    return ranked.where(F.col("rank") <= F.col("max_items") * DEPTH).withColumn("why_matched", why())


def all_scores(units: DataFrame, queries: DataFrame) -> DataFrame:
    """Scores of every unit for every query, for small batches and tests. The queries travel to the units: their size
    can't be estimated, and a plan that sends the units or pairs partitions reads all units again and again."""
    return scored(units.crossJoin(F.broadcast(queries)))


def _final(novelty: Column) -> Column:
    return T.fixed(0.55 * F.col("lexical") + 0.15 * F.col("heading_boost") + 0.1 * F.col("symbol_boost") + 0.1 * F.col("command_boost") + 0.1 * novelty - 0.25 * F.col("cost"))


CARRIED = [*UNIT, "words", "lexical", "heading_boost", "symbol_boost", "command_boost", "cost", "base_score", "why_matched"]


def select_by_budget(ranked: DataFrame) -> DataFrame:
    """Greedy choice in order of rank for each query: no text twice, none that is
    too similar to one already chosen, none that exceeds what is left of the
    budget. One row for each chosen unit, with ``position`` from 1."""
    grouped = ranked.groupBy("query_id").agg(
        F.first("budget").alias("budget"), F.first("max_items").alias("max_items"),
        F.array_sort(F.collect_list(F.struct("rank", "text_hash", "words", "token_estimate"))).alias("todo"),
    )
    zero = F.expr("named_struct('chosen', cast(array() as array<struct<rank: int, nearest: double, words: array<string>, text_hash: string>>), 'spent', 0L)")

    def step(state: Column, c: Column) -> Column:
        chosen, spent = state["chosen"], state["spent"]
        nearest = F.aggregate(chosen, F.lit(0.0), lambda m, x: F.greatest(m, T.jaccard(x["words"], c["words"])))
        taken = (
            (F.size(chosen) < F.col("max_items"))
            # similarity is looked at last, for what has passed the rest
            & ~F.exists(chosen, lambda x: x["text_hash"] == c["text_hash"])
            & (spent + c["token_estimate"] <= F.col("budget"))
            & (nearest <= MAX_SIMILARITY)
        )
        item = F.struct(c["rank"].alias("rank"), nearest.alias("nearest"), c["words"].alias("words"), c["text_hash"].alias("text_hash"))
        return F.when(taken, F.struct(F.concat(chosen, F.array(item)).alias("chosen"), (spent + c["token_estimate"]).alias("spent"))).otherwise(state)

    done = grouped.withColumn("state", F.aggregate("todo", zero, step))
    picked = done.select("query_id", F.col("state.spent").alias("spent_tokens"), F.greatest(F.lit(0), F.col("budget") - F.col("state.spent")).alias("remaining_tokens"), F.posexplode("state.chosen").alias("at", "c"))
    picked = picked.select("query_id", (F.col("at") + 1).alias("position"), F.col("c.rank").alias("rank"), T.fixed(1 - F.col("c.nearest")).alias("novelty"), "spent_tokens", "remaining_tokens")
    return picked.join(ranked.drop("budget", "max_items"), ["query_id", "rank"]).withColumn("score", _final(F.col("novelty")))


def find(ranked: DataFrame) -> DataFrame:
    """Best references of each query with up to two units each: rows ``query_id,
    position, ref, est_tokens, ref_score, why_matched, top_units, spent_tokens, remaining_tokens``."""
    unit = F.struct("rank", *[c for c in CARRIED if c != "words"])
    refs = ranked.groupBy("query_id", "ref").agg(F.first("budget").alias("budget"), F.first("max_items").alias("max_items"), F.slice(F.array_sort(F.collect_list(unit)), 1, 2).alias("top"))
    second = F.when(F.size("top") > 1, F.element_at("top", 2)["base_score"]).otherwise(0.0)
    refs = refs.withColumn("ref_score", T.fixed(F.element_at("top", 1)["base_score"] + second * 0.35))
    refs = refs.withColumn("est_tokens", F.aggregate("top", F.lit(0), lambda s, u: s + u["token_estimate"]))
    refs = refs.withColumn("why_matched", F.slice(F.array_distinct(F.flatten(F.transform("top", lambda u: u["why_matched"]))), 1, 8))
    refs = refs.withColumn("place", F.row_number().over(Window.partitionBy("query_id").orderBy(F.desc("ref_score"), T.icu(F.col("ref"))))).where("place <= max_items")
    zero = F.expr("named_struct('chosen', cast(array() as array<int>), 'spent', 0L)")

    def step(state: Column, c: Column) -> Column:
        fits = state["spent"] + c["est_tokens"] <= F.col("budget")
        return F.when(fits, F.struct(F.concat(state["chosen"], F.array(c["place"])).alias("chosen"), (state["spent"] + c["est_tokens"]).alias("spent"))).otherwise(state)

    done = refs.groupBy("query_id").agg(F.first("budget").alias("budget"), F.array_sort(F.collect_list(F.struct("place", "est_tokens"))).alias("todo")).withColumn("state", F.aggregate("todo", zero, step))
    picked = done.select("query_id", F.col("state.spent").alias("spent_tokens"), F.greatest(F.lit(0), F.col("budget") - F.col("state.spent")).alias("remaining_tokens"), F.posexplode("state.chosen").alias("at", "place"))
    return picked.join(refs.drop("budget", "max_items"), ["query_id", "place"]).select("query_id", (F.col("at") + 1).alias("position"), "ref", "est_tokens", "ref_score", "why_matched", F.col("top").alias("top_units"), "spent_tokens", "remaining_tokens")


def expand(units: DataFrame, asked: DataFrame) -> DataFrame:
    """All units of a reference, short ones first, under a budget. ``asked`` has
    query_id and ref (budget and max_items if given); ``units`` are ``marked``."""
    limits = profiles(asked.withColumn("query", F.lit(""))).select("query_id", "budget", "max_items")
    wanted = asked.select("query_id", F.trim("ref").alias("ref")).join(limits, "query_id")
    parts = units.join(wanted, "ref").withColumns({
        "lexical": F.lit(0.0), "heading_boost": F.lit(0.0), "symbol_boost": F.col("has_symbol").cast("double"), "command_boost": F.col("type").isin("command", "step").cast("double"),
        "base_score": T.fixed(1 / F.greatest(F.lit(1), F.col("token_estimate"))), "why_matched": F.array(F.lit("expand:anchor")),
    })
    return select_by_budget(parts.withColumn("rank", F.row_number().over(Window.partitionBy("query_id").orderBy(*_order("base_score")))))


def neighbors(graph: DataFrame, asked: DataFrame) -> DataFrame:
    """Edges of the references in ``asked`` (query_id, ref), in the order previous,
    next, links, keyword and symbol overlap; no reference is left out for being there twice."""
    return asked.select("query_id", F.trim("ref").alias("src_ref")).join(graph, "src_ref").withColumn("position", F.row_number().over(Window.partitionBy("query_id").orderBy("kind", "rank")))
