"""Multi-hop retrieval of context for evaluation cases, and the run that scores it.

A batch of cases passes each hop at once: a search by question, one for each
expected citation, the units around what these found, the neighbours of that,
and an extraction from all references met. What a case keeps along the way are a
few references and blocks, so that the choice among them is made on arrays.

``cases``: case_id, question, required_points, acceptable_citations, and
max_context_tokens, forbidden_claims where given.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from verbatrix.functions import text as T
from verbatrix.index import Index
from verbatrix.operators import evaluation as E
from verbatrix.sources import shared

MAX_BLOCKS, MAX_TOKENS = 8, 1200
BLOCK = "array<struct<text: string, citation: string, ref: string>>"
CITATION = "^[A-Za-z0-9_.-]+@[A-Za-z0-9_.-]+:[A-Za-z0-9_./-]+#[A-Za-z0-9_./-]+:\\d+-\\d+$"


def _none(kind: str) -> Column:
    return F.expr(f"cast(array() as {kind})")


def _given(cases: DataFrame, max_tokens: int) -> DataFrame:
    """Cases with all their columns; missing lists are empty."""
    lists = lambda c: F.coalesce(F.col(c), _none("array<string>")) if c in cases.columns else _none("array<string>")
    budget = F.coalesce(F.col("max_context_tokens").cast("int"), F.lit(max_tokens)) if "max_context_tokens" in cases.columns else F.lit(max_tokens)
    return cases.select("case_id", F.coalesce("question", F.lit("")).alias("question"), *[lists(c).alias(c) for c in ("required_points", "acceptable_citations", "forbidden_claims")], budget.alias("budget_tokens"))


def covers(text: Column, phrase: Column) -> Column:
    """Share of a phrase's words that a normalized text has; 0 for a phrase without words."""
    return F.coalesce(E.coverage(text, phrase), F.lit(0.0))


def required_hits(text: Column, points: Column) -> Column:
    """How many points a normalized text covers; ``||`` parts a point's alternatives."""
    return F.size(F.filter(points, lambda p: F.exists(F.split(p, "\\|\\|"), lambda a: covers(text, a) >= E.POINT_COVERAGE)))


def coverage_score(text: Column, points: Column) -> Column:
    """Share of the points that a text covers, 1 where there are none."""
    hits = F.element_at(F.transform(F.array(E.normalize(text)), lambda t: required_hits(t, points)), 1)
    return F.when(F.size(points) == 0, 1.0).otherwise(T.fixed(hits / F.size(points)))


def ranked_blocks(blocks: Column, question: Column, points: Column, expected: Column) -> Column:
    """Blocks by what they cover of the points and expected citations, then by citation and place."""
    low = F.lower(question)
    route, json = low.contains("route"), low.contains("json")

    def score(b: Column) -> Column:
        text = E.normalize(b["text"])
        met = F.element_at(F.transform(F.array(text), lambda t: required_hits(t, points)), 1) * 3.0
        cited = F.size(F.filter(expected, lambda e: F.lower(b["citation"]).contains(F.lower(e)))) * 2.0
        hints = F.when(route & b["text"].rlike("(?i)/[a-z0-9/_-]+"), 2.0).otherwise(0.0) + F.when(json & b["text"].rlike("(?i)structured|--json|json"), 1.5).otherwise(0.0) - F.when(route & b["text"].rlike("(?i)secret|api[_\\\\s-]?key"), 1.5).otherwise(0.0)
        return met + cited + hints

    rated = F.transform(blocks, lambda b, i: F.struct((-score(b)).alias("low"), T.icu(b["citation"]).alias("by"), i.alias("i"), b.alias("b")))
    return F.transform(F.array_sort(rated), lambda x: x["b"])


def chosen_blocks(blocks: Column, limit: int, preferred: Column) -> Column:
    """Up to ``limit`` blocks: the first of each preferred reference, then the first of
    each other reference, then the rest; none twice."""
    none = _none(BLOCK)
    same = lambda x, b: (x["citation"] == b["citation"]) & (x["text"] == b["text"])
    add = lambda acc, b: F.concat(acc, F.array(b))

    def of_ref(acc: Column, ref: Column) -> Column:
        free = F.filter(blocks, lambda b: (b["ref"] == ref) & ~F.exists(acc, lambda x: same(x, b)))
        return F.when((F.size(acc) < limit) & (F.size(free) > 0), F.concat(acc, F.slice(free, 1, 1))).otherwise(acc)

    first = F.aggregate(F.array_distinct(preferred), none, of_ref)
    spread = F.aggregate(blocks, first, lambda acc, b: F.when((F.size(acc) < limit) & ~F.exists(acc, lambda x: (x["ref"] == b["ref"]) | same(x, b)), add(acc, b)).otherwise(acc))
    return F.aggregate(blocks, spread, lambda acc, b: F.when((F.size(acc) < limit) & ~F.exists(acc, lambda x: same(x, b)), add(acc, b)).otherwise(acc))


def first_hop_precision(items: Column, expected: Column, k: int) -> Column:
    """Share of the first ``k`` items (ref, citations) that an expected citation names."""
    top, wanted = F.slice(items, 1, k), F.transform(expected, F.lower)
    hit = lambda i: F.exists(F.concat(F.array(F.lower(i["ref"])), F.transform(i["citations"], F.lower)), lambda h: F.exists(wanted, lambda w: h.contains(w)))
    return F.when(F.size(top) == 0, 0.0).when(F.size(expected) == 0, 1.0).otherwise(T.fixed(F.size(F.filter(top, hit)) / F.size(top)))


def _texts(blocks: Column) -> Column:
    return F.array_join(F.transform(blocks, lambda b: b["text"]), "\n")


def _in_order(df: DataFrame, by: str, order: list[str], value: Column, name: str) -> DataFrame:
    """Values of each key as one array in order."""
    own = F.array_sort(F.collect_list(F.struct(*[F.col(o) for o in order], value.alias("v"))))
    return df.groupBy(by).agg(F.transform(own, lambda x: x["v"]).alias(name))


def _found(index: Index, asked: DataFrame) -> DataFrame:
    """(query_id, items): what ``find`` gives each query, in order, with its blocks."""
    unit = lambda u: F.struct(u["text"].alias("text"), u["citation_id"].alias("citation"), u["ref"].alias("ref"))
    item = F.struct("ref", F.transform("top_units", lambda u: u["citation_id"]).alias("citations"), F.filter(F.transform("top_units", unit), lambda b: b["text"] != "").alias("blocks"))
    return _in_order(index.find(asked), "query_id", ["position"], item, "items")


def multi_hop(index: Index, cases: DataFrame, max_blocks: int = MAX_BLOCKS, max_tokens: int = MAX_TOKENS) -> DataFrame:
    """One row for each case: ``case_id, context_blocks`` (text, citation, ref) and how they were
    found: precision of the first hop, coverage after two and three, repeats, precise citations, searches."""
    limit = max(2, min(max_blocks, 3))
    given = shared.written(_given(cases, max_tokens), "cases")
    items_kind = "array<struct<ref: string, citations: array<string>, blocks: " + BLOCK + ">>"
    # first hop: the question itself
    share = lambda least, part: F.greatest(F.lit(least), F.floor(F.col("budget_tokens") * part)).cast("int")
    first = _found(index, given.select(F.col("case_id").alias("query_id"), F.col("question").alias("query"), share(200, 0.35).alias("budget"), F.lit(max_blocks).alias("max_items")))
    # one search for each expected citation; its best references are seeds
    needles = given.select("case_id", "question", "required_points", F.posexplode("acceptable_citations").alias("n", "needle")).withColumn("query_id", F.concat_ws("\x01", F.col("case_id").cast("string"), "n"))
    aimed = _found(index, needles.select("query_id", F.col("needle").alias("query"), F.lit(120).alias("budget"), F.lit(4).alias("max_items"))).join(needles, "query_id")
    hint = F.regexp_replace(F.lower("needle"), "(?i)[.]md$", "")

    def aim(i: Column) -> Column:
        points = lambda t: F.array_max(F.concat(F.array(F.lit(0.0)), F.transform("required_points", lambda p: covers(t, p))))
        rate = lambda t: T.fixed(F.when(F.lower(i["ref"]).contains(hint), 0.6).otherwise(0.0) + covers(t, F.col("question")) * 1.2 + points(t) * 0.8)
        score = F.element_at(F.transform(F.array(E.normalize(_texts(i["blocks"]))), rate), 1)
        return F.struct((-score).alias("low"), T.icu(i["ref"]).alias("by"), i["ref"].alias("ref"))

    rated = aimed.select("case_id", "n", F.array_sort(F.transform("items", aim)).alias("rated"))
    good = F.filter("rated", lambda x: x["low"] < 0)
    picked = F.transform(F.when(F.size(good) > 0, F.slice(good, 1, 3)).otherwise(F.slice("rated", 1, 2)), lambda x: x["ref"])
    seeds = _in_order(rated.withColumn("picked", picked), "case_id", ["n"], F.col("picked"), "lists").select("case_id", F.flatten("lists").alias("seeds"))
    hop = given.join(first.withColumnRenamed("query_id", "case_id"), "case_id", "left").join(seeds, "case_id", "left")
    hop = hop.withColumns({"items": F.coalesce("items", _none(items_kind)), "seeds": F.coalesce("seeds", _none("array<string>"))}).withColumn("initial", F.transform("items", lambda i: i["ref"]))
    hop = hop.withColumns({
        "targets": F.slice(F.array_distinct(F.concat(F.slice("seeds", 1, 3), F.slice("initial", 1, 2))), 1, 3),
        "starts": F.array_distinct(F.concat(F.slice("initial", 1, 1), F.slice("seeds", 1, 3))),
    })
    hop = shared.written(hop, "first-hop")
    # second hop: units around the targets, neighbours of the starts
    numbered = lambda c: hop.select("case_id", "budget_tokens", F.posexplode(c).alias("n", "ref")).withColumn("query_id", F.concat_ws("\x01", F.col("case_id").cast("string"), "n"))
    wanted = numbered("targets")
    wide = index.expand(wanted.select("query_id", "ref", share(120, 0.2).alias("budget"), F.lit(max(3, max_blocks // 2)).alias("max_items")))
    block = F.struct("text", F.col("citation_id").alias("citation"), "ref")
    expanded = _in_order(wide.where("text <> ''").join(wanted.select("query_id", "case_id", "n"), "query_id"), "case_id", ["n", "position"], block, "expanded")
    begun = numbered("starts")
    around = index.neighbors(begun.select("query_id", "ref")).join(begun.select("query_id", "case_id", "n"), "query_id")
    near = _in_order(around, "case_id", ["n", "position"], F.col("dst_ref"), "near")
    hop = hop.join(expanded, "case_id", "left").join(near, "case_id", "left").withColumns({"expanded": F.coalesce("expanded", _none(BLOCK)), "near": F.coalesce("near", _none("array<string>"))})
    hop = hop.withColumn("refs", F.slice(F.array_distinct(F.concat("seeds", "initial", "near")), 1, 10))
    hop = shared.written(hop, "second-hop")
    # third hop: extraction, which fails where a reference doesn't exist
    met = hop.select("case_id", F.explode("refs").alias("ref"))
    there = index.sections.select(F.concat_ws("#", "doc_id", "anchor").alias("ref")).union(index.docs.select("doc_id")).distinct()
    broken = met.join(there, "ref", "left_anti").select("case_id").distinct()
    sound = hop.where(F.size("refs") > 0).join(broken, "case_id", "left_anti")
    last = index.extract(sound.select(F.col("case_id").alias("query_id"), F.col("question").alias("query"), F.col("budget_tokens").alias("budget"), F.lit(max_blocks).alias("max_items"), "refs"))
    final = _in_order(last.where("text <> ''"), "query_id", ["position"], block, "final").withColumnRenamed("query_id", "case_id")
    two = F.concat(F.flatten(F.transform("items", lambda i: i["blocks"])), F.col("expanded"))
    done = hop.join(final, "case_id", "left").withColumn("two", two).withColumn("all", F.concat(F.coalesce("final", _none(BLOCK)), "two"))
    done = done.withColumn("ranked", ranked_blocks(F.col("all"), F.col("question"), F.col("required_points"), F.col("acceptable_citations")))
    done = done.withColumn("context_blocks", chosen_blocks(F.col("ranked"), limit, F.slice("seeds", 1, 1)))
    keys = F.filter(F.transform("context_blocks", lambda b: E.normalize(b["text"])), lambda k: k != "")
    n = F.size("context_blocks")
    return done.select(
        "case_id", "context_blocks", first_hop_precision(F.col("items"), F.col("acceptable_citations"), min(5, max_blocks)).alias("first_hop_precision_at_k"),
        coverage_score(_texts(F.col("two")), F.col("required_points")).alias("coverage_after_2_hops"), coverage_score(_texts(F.col("context_blocks")), F.col("required_points")).alias("coverage_after_3_hops"),
        T.fixed((F.size(keys) - F.size(F.array_distinct(keys))) / F.greatest(F.lit(1), n)).alias("duplicate_context_ratio"),
        F.when(n == 0, 0.0).otherwise(T.fixed(F.size(F.filter("context_blocks", lambda b: b["citation"].rlike(CITATION))) / n)).alias("citation_precision_line_level"),
        F.when(n == 0, 1.0).otherwise(0.0).alias("abstain_when_unknown_rate"),
        (1 + F.size("acceptable_citations") + F.size("targets") + F.size("starts") + (F.size("refs") > 0).cast("int")).alias("command_count"),
    )


META = ("first_hop_precision_at_k", "coverage_after_2_hops", "coverage_after_3_hops", "duplicate_context_ratio", "citation_precision_line_level", "abstain_when_unknown_rate")


def mock_answer(question: Column, blocks: Column) -> Column:
    """The deterministic stand-in for an answering model: the first lines of two blocks and three citations."""
    line = lambda i: F.split_part(F.get(blocks, F.lit(i))["text"], F.lit("\n"), F.lit(1))
    cited = F.slice(F.filter(F.transform(blocks, lambda b: b["citation"]), lambda c: c != ""), 1, 3)
    second = F.when((F.size(blocks) > 1) & (F.get(blocks, F.lit(1))["text"] != ""), F.concat(F.lit(" "), line(1))).otherwise("")
    first = F.when(F.size(blocks) > 0, line(0)).otherwise("No context found.")
    marks = F.when(F.size(blocks) == 0, "[none]").when(F.size(cited) > 0, F.array_join(F.transform(cited, lambda c: F.concat(F.lit("["), c, F.lit("]"))), ", ")).otherwise("[none]")
    return T.js_trim(F.concat(F.lit("Based on the retrieved documentation, "), question, F.lit(" "), first, second, F.lit("\n\nCitations: "), marks))


def run(cases: DataFrame, blocks: DataFrame, tool: str, meta: DataFrame | None = None, passes: int = 1, run_id: str = "run", profile: str = "batch", max_tokens: int = MAX_TOKENS) -> DataFrame:
    """Records of a tool: one for each case and pass. ``blocks`` (case_id, position, text,
    citation) is what it retrieved, ``meta`` (case_id and any of ``META``) how. A case without blocks is a failure
    with zeros for scores; the others are trimmed to their budget, answered and scored."""
    given = _given(cases, max_tokens)
    trimmed = E.trim_blocks(blocks.join(given.select("case_id", "budget_tokens"), "case_id"), F.col("budget_tokens"))
    context = _in_order(trimmed, "case_id", ["position"], F.struct("text", "citation"), "blocks").join(blocks.select("case_id").distinct(), "case_id", "right")
    own = given.join(context.withColumn("ok", F.lit(True)), "case_id", "left").withColumns({"ok": F.coalesce("ok", F.lit(False)), "blocks": F.coalesce("blocks", _none("array<struct<text: string, citation: string>>"))})
    tokens = F.aggregate("blocks", F.lit(0), lambda s, b: s + E.count_tokens(b["text"]) + E.count_tokens(b["citation"]))
    own = own.withColumns({"retrieval_tokens": F.when(F.col("ok"), tokens).otherwise(0), "answer_text": F.when(F.col("ok"), mock_answer(F.col("question"), F.col("blocks"))).otherwise("")})
    scored = E.score_answers(own).withColumn("hits", F.element_at(F.transform(F.array(E.normalize(F.col("answer_text"))), lambda t: required_hits(t, F.col("required_points"))), 1))
    if meta is not None:
        scored = scored.join(meta.select("case_id", *[c for c in META if c in meta.columns]), "case_id", "left")
    zero = lambda c: F.when(F.col("ok"), F.col(c)).otherwise(0.0).alias(c)
    told = lambda c: F.coalesce(F.col(c), F.lit(0.0)).alias(c) if meta is not None and c in meta.columns else F.lit(0.0).alias(c)
    return scored.withColumn("pass_index", F.explode(F.sequence(F.lit(1), F.lit(passes)))).select(
        F.lit(run_id).alias("run_id"), F.lit(profile).alias("profile"), F.lit(tool).alias("tool"), "case_id", "pass_index", "retrieval_tokens", F.col("retrieval_tokens").alias("total_tokens"), "answer_text",
        F.when(F.col("ok"), F.col("answer_citations")).otherwise(_none("array<string>")).alias("answer_citations"), *[told(c) for c in META],
        F.when(F.col("ok") & (F.col("hits") > 0), T.fixed(F.col("retrieval_tokens") / F.col("hits"))).otherwise(0.0).alias("tokens_per_required_point"),
        *[zero(c) for c in ("required_points_score", "citation_score", "forbidden_claims_penalty", "judge_score", "comprehension_score")],
        "ok", F.lit(False).alias("skipped"), F.when(F.col("ok"), "").otherwise(F.lit(f"{tool} returned no context")).alias("error"),
    )
