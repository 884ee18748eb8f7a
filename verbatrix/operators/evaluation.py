"""Evaluation of retrieval tools: scores of answers, aggregates of runs, gates."""

from __future__ import annotations

import re
from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import IntegerType, StructField, StructType

from verbatrix.functions import text as T
from verbatrix.sources import shared

#: What normalizing takes for white space.
MARKS = "`*_#>\\[\\](){},.:;!?\"'"
TOKEN = "[A-Za-z0-9_]+|[^\\sA-Za-z0-9_]"
POINT_COVERAGE, CLAIM_COVERAGE = 0.6, 0.75
WORD = re.compile("[a-z0-9_]{3,}")
#: Cases of a block, words a task remembers, and keys of lines that are broadcast at most.
CASES, KNOWN, BROADCAST = 1 << 12, 1 << 18, 1 << 16
GREP_STOP = ("what", "when", "where", "which", "does", "with", "from", "that", "this")
AVERAGED = (
    ("first_hop_precision_at_k", "mean_first_hop_precision_at_k"), ("coverage_after_2_hops", "mean_coverage_after_2_hops"), ("coverage_after_3_hops", "mean_coverage_after_3_hops"),
    ("duplicate_context_ratio", "mean_duplicate_context_ratio"), ("citation_precision_line_level", "mean_citation_precision_line_level"),
)


def normalize(c: Column) -> Column:
    return F.trim(F.regexp_replace(F.lower(F.coalesce(c, F.lit(""))), f"[{MARKS}{T.WS}]+", " "))


def count_tokens(c: Column) -> Column:
    return F.when(c.isNull(), 0).otherwise(F.regexp_count(c, F.lit(TOKEN)))


def coverage(haystack: Column, needle: Column) -> Column:
    """Share of the needle's words that occur in the normalized haystack; null if it has no words."""
    words = F.filter(F.split(normalize(needle), " "), lambda t: F.length(t) > 1)
    return F.when(F.size(words) > 0, F.size(F.filter(words, lambda t: haystack.contains(t))) / F.size(words))


def _bound(c: Column, f: Callable[[Column], Column]) -> Column:
    """``f`` of ``c``, which is bound as the only element of an array and so computed once, however often ``f`` reads it."""
    return F.element_at(F.transform(F.array(c), f), 1)


def _share(hits: Column, of: Column, empty: float) -> Column:
    # rounding reads the share more than once
    return F.when(F.coalesce(F.size(of), F.lit(0)) <= 0, empty).otherwise(_bound(hits / F.size(of), lambda x: T.fixed(x)))


def score_required(text: Column, points: Column) -> Column:
    """Share of the points that an answer covers; ``||`` parts the alternatives of a point.
    ``text`` is the normalized answer; it should be a column, for it is read for each word."""
    hit = lambda p: F.exists(F.filter(F.transform(F.split(p, "\\|\\|"), T.js_trim), lambda a: a != ""), lambda a: F.coalesce(coverage(text, a) >= POINT_COVERAGE, F.lit(False)))
    return _share(F.size(F.filter(points, hit)), points, 1.0)


def _run(of: str) -> str:
    """A run of such characters, which is tried from its start or from the end of the match before only, not again
    from each of its characters: what the run's start doesn't match none of them does."""
    return f"(?:\\G|(?<![{of}]))[{of}]+"


def extract_citations(answer: Column) -> Column:
    """Bracketed texts, citation ids and markdown paths in an answer, each once."""
    text = F.coalesce(answer, F.lit(""))
    brackets = F.filter(F.transform(F.regexp_extract_all(text, F.lit("\\[([^\\]]+)\\]"), F.lit(1)), T.js_trim), lambda x: T.js_length(x) >= 4)
    ids = F.regexp_extract_all(text, F.lit(f"{_run('A-Za-z0-9_.-')}+@[A-Za-z0-9_.-]+:[A-Za-z0-9_./-]+#[A-Za-z0-9_./-]+:\\d+-\\d+"), F.lit(0))
    paths = F.regexp_extract_all(text, F.lit(f"{_run('A-Za-z0-9_./-')}\\.md(?::\\d+(?:-\\d+)?)?"), F.lit(0))
    return F.array_distinct(F.concat(brackets, ids, paths))


def score_citations(citations: Column, expected: Column, answer: Column) -> Column:
    whole = F.lower(F.concat_ws("\n", F.array_join(F.coalesce(citations, F.array().cast("array<string>")), "\n"), F.coalesce(answer, F.lit(""))))
    return _share(_bound(whole, lambda w: F.size(F.filter(expected, lambda e: w.contains(F.lower(e))))), expected, 1.0)


def score_forbidden(text: Column, claims: Column) -> Column:
    """Share of the claims that an answer makes; ``text`` as for ``score_required``."""
    return _share(F.size(F.filter(claims, lambda c: F.coalesce(coverage(text, c) >= CLAIM_COVERAGE, F.lit(False)))), claims, 0.0)


def mock_judge(required: Column, citations: Column) -> Column:
    """The deterministic stand-in for a judging model."""
    return T.fixed(F.least(F.lit(1.0), F.greatest(F.lit(0.0), required * 0.7 + citations * 0.3)))


def final_score(required: Column, citations: Column, judge: Column, forbidden: Column) -> Column:
    finite = lambda c: F.when(c.isNull() | F.isnan(c) | (F.abs(c) == float("inf")), 0.0).otherwise(c)
    base = finite(required) * 0.45 + finite(citations) * 0.2 + finite(judge) * 0.35
    return T.fixed(F.greatest(F.lit(0.0), F.least(F.lit(1.0), base - finite(forbidden) * 0.2)))


def score_answers(answers: DataFrame) -> DataFrame:
    """``answers`` (answer_text, required_points, acceptable_citations,
    forbidden_claims and others) with their citations and scores."""
    a = F.col("answer_text")
    out = answers.withColumns({"answer_citations": extract_citations(a), "__text": normalize(a)})
    out = out.withColumns({"required_points_score": score_required(F.col("__text"), F.col("required_points")), "citation_score": score_citations(F.col("answer_citations"), F.col("acceptable_citations"), a), "forbidden_claims_penalty": score_forbidden(F.col("__text"), F.col("forbidden_claims"))}).drop("__text")
    out = out.withColumn("judge_score", mock_judge(F.col("required_points_score"), F.col("citation_score")))
    return out.withColumn("comprehension_score", final_score(*map(F.col, ("required_points_score", "citation_score", "judge_score", "forbidden_claims_penalty"))))


def trim_blocks(blocks: DataFrame, max_tokens: int | Column) -> DataFrame:
    """Context blocks (case_id, position, text, citation) cut to a token budget, one number or a column of ``blocks``:
    whole blocks in order, the first that doesn't fit in part, none after it."""
    most = max_tokens if isinstance(max_tokens, Column) else F.lit(max_tokens)
    clean = blocks.select("case_id", "position", most.alias("most"), T.js_trim(F.coalesce("text", F.lit(""))).alias("text"), T.js_trim(F.coalesce("citation", F.lit(""))).alias("citation")).where("text <> ''")
    full = F.when(F.col("citation") != "", F.concat("text", F.lit("\n[citation] "), F.col("citation"))).otherwise(F.col("text"))
    used = clean.withColumn("tokens", count_tokens(full)).withColumn("through", F.sum("tokens").over(Window.partitionBy("case_id").orderBy("position")))
    used = used.withColumn("before", F.col("through") - F.col("tokens")).withColumn("overflow", (F.col("through") > F.col("most")).cast("int"))
    used = used.withColumn("overflows", F.sum("overflow").over(Window.partitionBy("case_id").orderBy("position")))
    # all blocks before the first that overflows fit; of that one the rest of the budget is filled
    kept = used.where((F.col("overflows") == 0) | ((F.col("overflows") == 1) & (F.col("overflow") == 1) & (F.col("most") - F.col("before") > 0)))
    part = F.concat(F.array_join(F.slice(F.regexp_extract_all("text", F.lit(TOKEN), F.lit(0)), F.lit(1), F.greatest(F.lit(8), F.col("most") - F.col("before") - 8).cast("int")), " "), F.lit(" ..."))
    return kept.select("case_id", "position", F.when(F.col("overflow") == 1, part).otherwise(F.col("text")).alias("text"), "citation")


def duplicate_ratio(blocks: DataFrame) -> DataFrame:
    """(case_id, duplicate_context_ratio): repeats among the normalized texts."""
    key = F.nullif(normalize(F.col("text")), F.lit(""))
    # a distinct count by two aggregations, spread over keys
    keyed = blocks.select("case_id", key.alias("key")).groupBy("case_id", "key").agg(F.count("*").alias("n"))
    return keyed.groupBy("case_id").agg(T.fixed((F.coalesce(F.sum(F.when(F.col("key").isNotNull(), F.col("n"))), F.lit(0)) - F.count("key")) / F.greatest(F.lit(1), F.sum("n"))).alias("duplicate_context_ratio"))


def first_hop_precision(expected: Column, cited: Column) -> Column:
    """Share of retrieved citations that contain an expected one."""
    hits = F.size(F.filter(cited, lambda x: F.exists(expected, lambda e: F.lower(x).contains(F.lower(e)))))
    return F.when((F.size(cited) <= 0) | (F.size(expected) <= 0), 0.0).otherwise(T.fixed(hits / F.size(cited)))


def _numeric(name: str) -> Column:
    c = F.col(name).cast("double")
    return F.when(c.isNull() | F.isnan(c), 0.0).otherwise(c)


def _mean(c: Column) -> Column:
    """Average to four digits, 0 for no values. Sums are taken in decimals, so
    that they don't depend on the order of the rows."""
    return F.coalesce(T.fixed(F.sum(c.cast("decimal(30,10)")).cast("double") / F.count(c)), F.lit(0.0))


def tool_aggregates(records: DataFrame) -> DataFrame:
    """One row for each tool: runs, success, and means, median and p95 of successful runs."""
    ok = F.coalesce(F.col("ok"), F.lit(False))
    of_ok = lambda name: F.when(ok, _numeric(name))
    tokens = of_ok("tokens_per_required_point")
    typed = records.withColumns({"__tokens": of_ok("total_tokens"), "__latency": of_ok("total_latency_ms"), "__score": of_ok("comprehension_score")})
    # nearest rank: the least value that so many of the values don't exceed
    p95 = lambda c: F.coalesce(T.fixed(F.expr(f"percentile_disc(0.95) WITHIN GROUP (ORDER BY {c})")), F.lit(0.0))
    return typed.groupBy(F.coalesce("tool", F.lit("unknown")).alias("tool")).agg(
        F.count("*").alias("runs"), F.count_if(ok).alias("successful_runs"), T.fixed(F.count_if(ok) / F.count("*")).alias("success_rate"),
        _mean(F.col("__score")).alias("mean_comprehension"), F.coalesce(T.fixed(F.percentile("__score", 0.5)), F.lit(0.0)).alias("median_comprehension"),
        _mean(F.col("__tokens")).alias("mean_total_tokens"), p95("__tokens").alias("p95_total_tokens"), _mean(F.col("__latency")).alias("mean_total_latency_ms"), p95("__latency").alias("p95_total_latency_ms"),
        *[_mean(of_ok(a)).alias(b) for a, b in AVERAGED],
        _mean(F.when(tokens > 0, tokens)).alias("mean_tokens_per_required_point"), _mean(_numeric("abstain_when_unknown_rate")).alias("mean_abstain_when_unknown_rate"),
    )


def pairwise(records: DataFrame, aggregates: DataFrame) -> DataFrame:
    """For each two tools (left: the better mean, then by name) the differences of
    their means and the win rates over the cases in which both succeeded."""
    order = aggregates.select("tool", "mean_comprehension", "mean_total_tokens", "mean_total_latency_ms", F.row_number().over(Window.orderBy(F.desc("mean_comprehension"), "tool")).alias("n"))
    own = records.withColumn("tool", F.coalesce("tool", F.lit("unknown")))
    # of records of one case and pass the last by its id counts
    last = own.withColumn("copy", F.row_number().over(Window.partitionBy("tool", "case_id", "pass_index").orderBy(F.desc("run_id")))).where("copy = 1 and ok").select("tool", "case_id", "pass_index", _numeric("comprehension_score").alias("score"))
    a, b = order.alias("a"), order.alias("b")
    pairs = a.join(b, F.col("a.n") < F.col("b.n")).select(
        F.concat_ws(" vs ", "a.tool", "b.tool").alias("pair"), F.col("a.tool").alias("lt"), F.col("b.tool").alias("rt"),
        *[T.fixed(F.col(f"a.{c}") - F.col(f"b.{c}")).alias(d) for c, d in (("mean_comprehension", "mean_comprehension_delta"), ("mean_total_tokens", "mean_tokens_delta"), ("mean_total_latency_ms", "mean_latency_ms_delta"))],
    )
    left, right = last.select(F.col("tool").alias("lt"), "case_id", "pass_index", F.col("score").alias("ls")), last.select(F.col("tool").alias("rt"), "case_id", "pass_index", F.col("score").alias("rs"))
    met = left.join(right, ["case_id", "pass_index"]).where("lt <> rt").groupBy("lt", "rt").agg(F.count("*").alias("n"), F.count_if(F.col("ls") > F.col("rs")).alias("lw"), F.count_if(F.col("rs") > F.col("ls")).alias("rw"))
    rate = lambda c: F.coalesce(T.fixed(F.col(c) / F.col("n")), F.lit(0.0))
    return pairs.join(met, ["lt", "rt"], "left").select("pair", F.coalesce("n", F.lit(0)).alias("compared_cases"), "mean_comprehension_delta", "mean_tokens_delta", "mean_latency_ms_delta", rate("lw").alias("left_win_rate"), rate("rw").alias("right_win_rate"))


def summary(records: DataFrame) -> tuple[DataFrame, DataFrame]:
    per_tool = tool_aggregates(records)
    return per_tool, pairwise(records, per_tool)


def report(per_tool: DataFrame, pairs: DataFrame) -> str:
    """Summary tables as markdown. One row for each tool and pair is gathered."""
    def table(rows: list, names: list[str]) -> list[str]:
        return ["| " + " | ".join(names) + " |", "|" + "---|" * len(names), *["| " + " | ".join(str(r[n]) for n in names) + " |" for r in rows], ""]

    tools = per_tool.orderBy(F.desc("mean_comprehension"), "tool").collect()
    return "\n".join(["# Evaluation report", "", "## Tools", "", *table(tools, per_tool.columns), "## Pairs", "", *table(pairs.orderBy("pair").collect(), pairs.columns)])


def gates(current: DataFrame, baseline: DataFrame, tool: str, rival: str | None = None, previous: DataFrame | None = None, require_rival: bool = False) -> DataFrame:
    """(gate, passed): a tool's aggregates held against a baseline, a rival and
    the run before."""
    own = lambda df, name, prefix: df.where(F.col("tool") == name).select(*[F.col(c).alias(f"{prefix}_{c}") for c in ("mean_comprehension", "mean_total_tokens", "success_rate", "mean_duplicate_context_ratio", "mean_citation_precision_line_level", "p95_total_latency_ms")])
    row = own(current, tool, "c").crossJoin(own(baseline, tool, "b"))
    c, b, r, p = ((lambda n, x=x: F.col(f"{x}_{n}")) for x in "cbrp")
    checks = {
        "comprehension_plus_0_08": c("mean_comprehension") >= b("mean_comprehension") + 0.08,
        "tokens_minus_20pct": c("mean_total_tokens") <= b("mean_total_tokens") * 0.8,
        "success_rate_gte_0_99": c("success_rate") >= 0.99,
        "duplicate_ratio_minus_40pct": c("mean_duplicate_context_ratio") <= b("mean_duplicate_context_ratio") * 0.6,
        "citation_precision_gte_baseline": c("mean_citation_precision_line_level") >= F.coalesce(b("mean_citation_precision_line_level"), F.lit(0.0)),
    }
    if rival is not None:
        row = row.join(own(current, rival, "r").where("r_success_rate > 0"), F.lit(True), "left")
        there = r("success_rate").isNotNull()
        checks |= {
            "rival_checks_available": there | F.lit(not require_rival),
            "rival_comprehension_gap_lte_0_03": ~there | (r("mean_comprehension") - c("mean_comprehension") <= 0.03),
            "rival_tokens_minus_15pct": ~there | (c("mean_total_tokens") <= r("mean_total_tokens") * 0.85),
            "rival_p95_latency_lower": ~there | (c("p95_total_latency_ms") < r("p95_total_latency_ms")),
        }
    if previous is not None:
        row = row.join(own(previous, tool, "p"), F.lit(True), "left")
        near = [F.abs(c(n) - p(n)) <= 1e-4 for n in ("mean_comprehension", "mean_total_tokens", "success_rate")]
        checks["two_consecutive_runs_stable"] = p("success_rate").isNull() | (near[0] & near[1] & near[2])
    return row.select(F.explode(F.array(*[F.struct(F.lit(n).alias("gate"), x.alias("passed")) for n, x in checks.items()])).alias("g")).select("g.gate", "g.passed")


def grep_terms(question: Column) -> Column:
    """Up to eight words of three or more characters."""
    words = F.filter(F.regexp_extract_all(F.lower(F.coalesce(question, F.lit(""))), F.lit("[a-z0-9_]{3,}"), F.lit(0)), lambda w: ~w.isin(*GREP_STOP))
    return F.slice(F.array_distinct(words), 1, 8)


def _first_lines(asked: list[tuple[int, list[str]]], most: int, per_file: int) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """The first lines of a task for each case (number, terms), from files in order of their paths; lines of one path are
    taken together. A file's words are looked up once each; a case that has its lines looks for nothing more."""
    cases_of: dict[str, list[int]] = {}
    for case, terms in asked:
        for t in terms:
            cases_of.setdefault(t, []).append(case)
    lengths = sorted({len(t) for t in cases_of})

    def terms_in(run: str) -> list[str]:
        return list({run[i : i + n] for n in lengths for i in range(len(run) - n + 1)} & cases_of.keys())

    def run(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        left = {case: most for case, _ in asked}
        # terms and cases that are still looked for
        wanted, empty = {t: list(c) for t, c in cases_of.items()}, [case for case, terms in asked if not terms]
        known: dict[str, list[str]] = {}
        out: list[tuple[int, str, int]] = []
        path, own = None, {}

        def close() -> None:
            nonlocal wanted, empty
            filled = False
            for case, ns in own.items():
                taken = sorted(ns)[: min(per_file, left[case])]
                out.extend((case, path, n) for n in taken)
                left[case] -= len(taken)
                filled |= left[case] == 0
            if filled:
                wanted = {t: some for t, c in wanted.items() if (some := [x for x in c if left[x]])}
                empty = [c for c in empty if left[c]]

        def read(content: str) -> None:
            ns: dict[int, set[int]] = {}
            if empty:
                some = [n for n, line in zip(range(1, len(content) + 2), content.split("\n")) if line][:most]
                for case in empty:
                    ns[case] = set(some)
            low = content.lower()
            met: dict[str, list[str]] = {}
            for w in set(WORD.findall(low)) if wanted else ():
                terms = known.get(w)
                if terms is None:
                    if len(known) >= KNOWN:
                        known.clear()
                    terms = known[w] = terms_in(w)
                if terms and (some := [t for t in terms if t in wanted]):
                    met[w] = some
            if met:
                full = 0
                looked = {c for terms in met.values() for t in terms for c in wanted[t]}
                for n, line in enumerate(low.split("\n"), 1):
                    for case in {c for w in set(WORD.findall(line)) & met.keys() for t in met[w] for c in wanted[t]}:
                        mine = ns.setdefault(case, set())
                        if len(mine) < most:
                            mine.add(n)
                            full += len(mine) == most
                    if full == len(looked):
                        break
            for case, some in ns.items():
                own.setdefault(case, set()).update(some)

        for batch in it:
            for at in range(batch.num_rows):
                here = batch.column(0)[at].as_py()
                if here != path:
                    close()
                    path, own = here, {}
                if wanted or empty:
                    read(batch.column(1)[at].as_py())
        close()
        if out:
            yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*out), (pa.int32(), pa.string(), pa.int32()))], ["case", "rel_path", "n"])

    return run


def grep_hits(files: DataFrame, asked: DataFrame, most: int, per_file: int) -> DataFrame:
    """(case_id, rel_path, n): the first ``most`` lines, and of a file ``per_file``, that contain one of a case's
    ``terms``, or that aren't empty where it has none.

    Files are read where they lie, in one pass for all cases of a block; what leaves a task are keys, ``most``
    for each case at most. The cases of a batch are collected to the driver."""
    spark = files.sparkSession
    rows = [tuple(r) for r in asked.select("case_id", "terms").collect()]
    near = files.select("rel_path", "content").sortWithinPartitions(T.icu(F.col("rel_path")), "rel_path")
    numbered = [(i, terms or []) for i, (_, terms) in enumerate(rows)]
    found = None
    for at in range(0, max(1, len(rows)), CASES):
        part = near.mapInArrow(_first_lines(numbered[at : at + CASES], most, per_file), "case int, rel_path string, n int")
        found = part if found is None else found.unionByName(part)
    rank = F.row_number().over(Window.partitionBy("case").orderBy(T.icu(F.col("rel_path")), "n"))
    first = found.distinct().withColumn("in_file", F.row_number().over(Window.partitionBy("case", "rel_path").orderBy("n"))).where(F.col("in_file") <= per_file)
    first = first.withColumn("position", rank).where(F.col("position") <= most)
    names = spark.createDataFrame([(i, c) for i, (c, _) in enumerate(rows)], StructType([StructField("case", IntegerType()), StructField("case_id", asked.schema["case_id"].dataType)]))
    return first.join(F.broadcast(names), "case").select("case_id", "rel_path", "n", "position")


def grep_retrieve(files: DataFrame, cases: DataFrame, max_blocks: int = 8, window: int = 5, per_file: int = 60, preview: int = 12) -> DataFrame:
    """Blocks around the lines of ``files`` (rel_path, content) that contain a
    word of a case's question (case_id, question), in order of path and line:
    ``case_id, position, text, citation``. A case without a hit gets the start of
    the first file. The blocks of a case are as many as asked for, so that only
    their files are read again for the lines around the hits."""
    there = files.where("content is not null")
    asked = cases.select("case_id", grep_terms(F.col("question")).alias("terms"))
    # the hits are written once: they are few, and files are then read for them without a shuffle where they are known to be
    hit = shared.written(grep_hits(there, asked, max_blocks, per_file), "grep-hits")
    small = F.broadcast if asked.count() * max_blocks <= BROADCAST else lambda df: df
    around = there.join(small(hit), "rel_path").withColumn("all", F.split("content", "\n", -1))
    first, last = F.greatest(F.lit(1), F.col("n") - window), F.least(F.size("all"), F.col("n") + window)
    found = around.select("case_id", "position", T.js_trim(F.array_join(F.slice("all", first, last - first + 1), "\n")).alias("text"), F.concat(F.col("rel_path"), F.lit(":"), first, F.lit("-"), last).alias("citation")).where("text <> ''")
    without = asked.select("case_id").join(found.select("case_id").distinct(), "case_id", "left_anti")
    start = there.orderBy(T.icu(F.col("rel_path"))).limit(1)
    fallback = without.crossJoin(F.broadcast(start)).select("case_id", F.lit(1).alias("position"), F.array_join(F.slice(F.split("content", "\n", -1), 1, preview), "\n").alias("text"), F.concat(F.col("rel_path"), F.lit(f":1-{preview}")).alias("citation"))
    return found.unionByName(fallback)
