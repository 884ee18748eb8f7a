"""Evaluation operators over driver tables: line items as runs, documents as answers."""

from __future__ import annotations

from pyspark.sql import functions as F

from verbatrix.functions import text as T
from verbatrix.operators import evaluation as E
from verbatrix.operators import hops
from verbatrix.plans import corpus, sql

_POINTS = ("run the job || execute the task", "token data", "the")
_CLAIMS = ("never the data", "and of the")


def records(spark, d):
    """Line items as evaluation records: ship flag and status name the tool, the
    order is the case, the line number the pass."""
    li = spark.read.parquet(f"{d}/lineitem.parquet")
    return li.select(
        F.format_string("%012d%012d", "l_partkey", "l_suppkey").alias("run_id"), F.concat("l_returnflag", "l_linestatus").alias("tool"), F.col("l_orderkey").cast("string").alias("case_id"), F.col("l_linenumber").alias("pass_index"),
        (F.col("l_discount") * 10).alias("comprehension_score"), F.col("l_quantity").alias("total_tokens"), F.col("l_extendedprice").alias("total_latency_ms"), F.col("l_discount").alias("first_hop_precision_at_k"),
        F.col("l_tax").alias("coverage_after_2_hops"), (F.col("l_tax") * 2).alias("coverage_after_3_hops"), F.when(F.col("l_quantity") > 10, F.col("l_quantity")).otherwise(0.0).alias("tokens_per_required_point"),
        F.col("l_tax").alias("duplicate_context_ratio"), F.col("l_discount").alias("citation_precision_line_level"), F.col("l_tax").alias("abstain_when_unknown_rate"), (F.col("l_quantity") > 5).alias("ok"),
    )


def eval_tool_agg(spark, d):
    return E.tool_aggregates(records(spark, d))


def eval_pairwise(spark, d):
    r = records(spark, d)
    return E.pairwise(r, E.tool_aggregates(r))


def eval_gates(spark, d):
    """The tool AF held against NO as its baseline and RF as its rival."""
    a = E.tool_aggregates(records(spark, d))
    return E.gates(a, a.where("tool = 'NO'").withColumn("tool", F.lit("AF")), "AF", rival="RF", previous=a)


def answers(spark, d):
    docs = spark.read.parquet(f"{d}/documents.parquet")
    text = F.concat("text", F.lit(" See [guide.md:1-2], corpus@1.0.0:d1#"), "lang", F.lit(":1-2 and docs/"), "source", F.lit(".md:3."))
    arr = lambda xs: F.array(*map(F.lit, xs))
    return docs.select("doc_id", text.alias("answer_text"), arr(_POINTS).alias("required_points"), F.array(F.lit("GUIDE.md:1-2"), F.lit("corpus@1.0.0:d1#en:1-2")).alias("acceptable_citations"), arr(_CLAIMS).alias("forbidden_claims"))


_SCORES = ["required_points_score", "citation_score", "forbidden_claims_penalty", "judge_score", "comprehension_score"]


def eval_scores(spark, d):
    return E.score_answers(answers(spark, d)).select("doc_id", *_SCORES)


def eval_citations(spark, d):
    return answers(spark, d).select("doc_id", F.array_join(E.extract_citations(F.col("answer_text")), "|").alias("citations"))


def eval_tokens(spark, d):
    return spark.read.parquet(f"{d}/documents.parquet").select("doc_id", E.count_tokens(F.col("text")).alias("tokens"))


def _blocks(spark, d):
    """Documents of a source as the context blocks of one case."""
    return spark.read.parquet(f"{d}/documents.parquet").select(F.col("source").alias("case_id"), F.col("doc_id").alias("position"), "text", F.format_string("d%d", "doc_id").alias("citation"))


def eval_trim(spark, d):
    return E.trim_blocks(_blocks(spark, d), 1200)


def eval_dup_ratio(spark, d):
    return E.duplicate_ratio(_blocks(spark, d))


def _cases(spark, d):
    return spark.read.parquet(f"{d}/benchmark.parquet").select(F.col("item_id").alias("case_id"), F.col("text").alias("question"))


def grep_retrieve(spark, d):
    return E.grep_retrieve(corpus.files(spark, d), _cases(spark, d))


def eval_first_hop(spark, d):
    cited = E.grep_retrieve(corpus.files(spark, d), _cases(spark, d)).groupBy("case_id").agg(F.collect_list("citation").alias("cited"))
    return cited.select("case_id", E.first_hop_precision(F.array(F.lit("D0000000"), F.lit("5.md")), F.col("cited")).alias("precision"))


def _full_cases(spark, d):
    """Benchmark texts as cases with points, citations and claims to look for."""
    arr = lambda *xs: F.array(*map(F.lit, xs))
    return _cases(spark, d).withColumns({"required_points": arr(*_POINTS), "acceptable_citations": arr("d00000002.md", "5-7"), "forbidden_claims": arr(*_CLAIMS), "max_context_tokens": F.lit(300)})


def eval_run(spark, d):
    """Records of the grep tool over all cases, answered and judged by the stand-ins."""
    cases = _full_cases(spark, d)
    out = hops.run(cases, E.grep_retrieve(corpus.files(spark, d), cases), "grep")
    return out.select("case_id", "tool", "pass_index", "retrieval_tokens", "answer_text", F.array_join("answer_citations", "|").alias("answer_citations"), "tokens_per_required_point", *_SCORES, "ok", "error")


def eval_multi_hop(spark, d):
    """Every case through all hops over the whole corpus."""
    out = hops.multi_hop(corpus.stored(spark, d), _full_cases(spark, d))
    return out.select("case_id", F.array_join(F.transform("context_blocks", lambda b: b["citation"]), "|").alias("citations"), F.array_join(F.transform("context_blocks", lambda b: b["text"]), "\n").alias("text"), *hops.META, "command_count")


_NAMES = (eval_run, eval_multi_hop, eval_tool_agg, eval_pairwise, eval_gates, eval_scores, eval_citations, eval_tokens, eval_trim, eval_dup_ratio, grep_retrieve, eval_first_hop)


def queries() -> dict:
    return {f.__name__: f for f in _NAMES}


_R = """WITH r AS (SELECT lpad(CAST(l_partkey AS VARCHAR), 12, '0') || lpad(CAST(l_suppkey AS VARCHAR), 12, '0') AS run_id, l_returnflag || l_linestatus AS tool, l_orderkey AS case_id, l_linenumber AS pass_index, l_discount * 10 AS score, l_quantity AS tokens, l_extendedprice AS latency, l_discount AS hop, l_tax AS c2, l_tax * 2 AS c3, CASE WHEN l_quantity > 10 THEN l_quantity ELSE 0 END AS per_point, l_quantity > 5 AS ok FROM lineitem)"""


def _mean(x: str, where: str = "ok") -> str:
    return f"coalesce(CAST(sum(CAST({x} AS DECIMAL(30, 10))) FILTER (WHERE {where}) AS DOUBLE) / count({x}) FILTER (WHERE {where}), 0e0)"


_AGG = {
    "success_rate": "count(*) FILTER (WHERE ok)::DOUBLE / count(*)", "mean_comprehension": _mean("score"), "median_comprehension": "coalesce(quantile_cont(score, 0.5) FILTER (WHERE ok), 0e0)",
    "mean_total_tokens": _mean("tokens"), "p95_total_tokens": "coalesce(quantile_disc(tokens, 0.95) FILTER (WHERE ok), 0e0)", "mean_total_latency_ms": _mean("latency"), "p95_total_latency_ms": "coalesce(quantile_disc(latency, 0.95) FILTER (WHERE ok), 0e0)",
    "mean_first_hop_precision_at_k": _mean("hop"), "mean_coverage_after_2_hops": _mean("c2"), "mean_coverage_after_3_hops": _mean("c3"), "mean_duplicate_context_ratio": _mean("c2"), "mean_citation_precision_line_level": _mean("hop"),
    "mean_tokens_per_required_point": _mean("per_point", "ok AND per_point > 0"), "mean_abstain_when_unknown_rate": _mean("c2", "TRUE"),
}
_TOOLS = _R + f""", raw AS (SELECT tool, count(*) AS runs, count(*) FILTER (WHERE ok) AS successful_runs, {', '.join(f'{x} AS {n}' for n, x in _AGG.items())} FROM r GROUP BY tool),
tools AS (SELECT tool, runs, successful_runs, {', '.join(f'{sql.fixed(n)} AS {n}' for n in _AGG)} FROM raw)"""
_COV = "len(list_filter({w}, lambda t: contains(h, t)))::DOUBLE / len({w})"


def _normalize(x: str) -> str:
    return sql.squeeze(f"translate(lower({x}), '`*_#>[](){{}},.:;!?\"''', '                   ')")


def _words(point: str) -> str:
    return "[" + ", ".join(f"'{w}'" for w in point.split() if len(w) > 1) + "]"


_HIT = lambda point, least: "(" + " OR ".join(f"{_COV.format(w=_words(alt))} >= {least}" for alt in point.split("||")) + ")"
_CITES = "list_concat(list_filter(list_transform(regexp_extract_all(a, '\\[([^\\]]+)\\]', 1), lambda x: " + sql.trim("x") + "), lambda x: length(x) >= 4), regexp_extract_all(a, '[A-Za-z0-9_.-]+@[A-Za-z0-9_.-]+:[A-Za-z0-9_./-]+#[A-Za-z0-9_./-]+:\\d+-\\d+'), regexp_extract_all(a, '[A-Za-z0-9_./-]+\\.md(?::\\d+(?:-\\d+)?)?'))"
_ANSWERS = f"WITH answers AS (SELECT doc_id, text || ' See [guide.md:1-2], corpus@1.0.0:d1#' || lang || ':1-2 and docs/' || source || '.md:3.' AS a FROM documents), cited AS (SELECT doc_id, a, {_CITES} AS c FROM answers)"
_GREP = rf"""WITH files AS ({sql.FILES}), lines AS (SELECT path AS rel_path, unnest(string_split(content, chr(10))) AS line, unnest(range(1, len(string_split(content, chr(10))) + 1)) AS n FROM files),
words AS (SELECT item_id AS case_id, list_filter(regexp_extract_all(lower(text), '[a-z0-9_]{{3,}}'), lambda w: w NOT IN ({', '.join(repr(w) for w in E.GREP_STOP)})) AS ws FROM benchmark),
asked AS (SELECT case_id, '(?i)' || coalesce(nullif(array_to_string({sql.first_distinct('ws')}[1:8], '|'), ''), '.') AS pattern FROM words),
hits AS (SELECT case_id, rel_path, n, row_number() OVER (PARTITION BY case_id, rel_path ORDER BY n) AS k FROM lines, asked WHERE regexp_matches(line, pattern)),
top AS (SELECT * FROM (SELECT case_id, rel_path, n, row_number() OVER (PARTITION BY case_id ORDER BY rel_path, n) AS position FROM hits WHERE k <= 60) WHERE position <= 8),
ends AS (SELECT rel_path, max(n) AS last FROM lines GROUP BY rel_path),
found AS (SELECT t.case_id, t.position, {sql.trim("string_agg(l.line, chr(10) ORDER BY l.n)")} AS text, t.rel_path || ':' || greatest(1, t.n - 5) || '-' || least(max(e.last), t.n + 5) AS citation FROM top t JOIN lines l ON l.rel_path = t.rel_path AND l.n BETWEEN t.n - 5 AND t.n + 5 JOIN ends e ON e.rel_path = t.rel_path GROUP BY t.case_id, t.position, t.rel_path, t.n),
blocks AS (SELECT * FROM found WHERE text <> '' UNION ALL SELECT case_id, 1, (SELECT string_agg(line, chr(10) ORDER BY n) FROM lines WHERE n <= 12 AND rel_path = (SELECT min(rel_path) FROM lines)), (SELECT min(rel_path) FROM lines) || ':1-12' FROM asked WHERE case_id NOT IN (SELECT case_id FROM found WHERE text <> ''))"""


def oracle_sql() -> dict[str, str]:
    token = "[A-Za-z0-9_]+|[^\\sA-Za-z0-9_]"
    n = f"len(regexp_extract_all(text, '{token}'))"
    required = "(" + " + ".join(f"CAST({_HIT(p, '6e-1')} AS INT)" for p in _POINTS) + f")::DOUBLE / {len(_POINTS)}"
    forbidden = "(" + " + ".join(f"CAST({_HIT(c, '75e-2')} AS INT)" for c in _CLAIMS) + f")::DOUBLE / {len(_CLAIMS)}"
    citation = "(CAST(contains(l, 'guide.md:1-2') AS INT) + CAST(contains(l, 'corpus@1.0.0:d1#en:1-2') AS INT))::DOUBLE / 2"
    return {
        "eval_tool_agg": f"{_TOOLS} SELECT * FROM tools",
        "eval_pairwise": f"""{_TOOLS}, o AS (SELECT *, row_number() OVER (ORDER BY mean_comprehension DESC, tool) AS n FROM tools), p AS (SELECT a.tool AS lt, b.tool AS rt, a.mean_comprehension - b.mean_comprehension AS dc, a.mean_total_tokens - b.mean_total_tokens AS dt, a.mean_total_latency_ms - b.mean_total_latency_ms AS dl FROM o a JOIN o b ON a.n < b.n),
            last AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY tool, case_id, pass_index ORDER BY run_id DESC) AS copy FROM r) WHERE copy = 1 AND ok),
            m AS (SELECT a.tool AS lt, b.tool AS rt, count(*) AS n, count(*) FILTER (WHERE a.score > b.score) AS lw, count(*) FILTER (WHERE b.score > a.score) AS rw FROM last a JOIN last b ON a.case_id = b.case_id AND a.pass_index = b.pass_index AND a.tool <> b.tool GROUP BY a.tool, b.tool)
            SELECT p.lt || ' vs ' || p.rt AS pair, coalesce(m.n, 0) AS compared_cases, {sql.fixed('dc')} AS mean_comprehension_delta, {sql.fixed('dt')} AS mean_tokens_delta, {sql.fixed('dl')} AS mean_latency_ms_delta, coalesce(round(lw::DOUBLE / m.n, 4), 0e0) AS left_win_rate, coalesce(round(rw::DOUBLE / m.n, 4), 0e0) AS right_win_rate FROM p LEFT JOIN m USING (lt, rt)""",
        "eval_gates": f"""{_TOOLS}, c AS (SELECT * FROM tools WHERE tool = 'AF'), b AS (SELECT * FROM tools WHERE tool = 'NO'), v AS (SELECT * FROM tools WHERE tool = 'RF')
            SELECT unnest(['comprehension_plus_0_08', 'tokens_minus_20pct', 'success_rate_gte_0_99', 'duplicate_ratio_minus_40pct', 'citation_precision_gte_baseline', 'rival_checks_available', 'rival_comprehension_gap_lte_0_03', 'rival_tokens_minus_15pct', 'rival_p95_latency_lower', 'two_consecutive_runs_stable']) AS gate,
            unnest([c.mean_comprehension >= b.mean_comprehension + 8e-2, c.mean_total_tokens <= b.mean_total_tokens * 8e-1, c.success_rate >= 99e-2, c.mean_duplicate_context_ratio <= b.mean_duplicate_context_ratio * 6e-1, c.mean_citation_precision_line_level >= b.mean_citation_precision_line_level, TRUE,
            v.mean_comprehension - c.mean_comprehension <= 3e-2, c.mean_total_tokens <= v.mean_total_tokens * 85e-2, c.p95_total_latency_ms < v.p95_total_latency_ms, TRUE]) AS passed FROM c, b, v""",
        "eval_scores": f"""{_ANSWERS}, n AS (SELECT doc_id, {_normalize('a')} AS h, lower(array_to_string({sql.first_distinct('c')}, chr(10)) || chr(10) || a) AS l FROM cited), s AS (SELECT doc_id, {required} AS r0, {citation} AS c0, {forbidden} AS f0 FROM n), f AS (SELECT doc_id, {sql.fixed('r0')} AS r, {sql.fixed('c0')} AS c, {sql.fixed('f0')} AS f FROM s),
            j AS (SELECT *, least(1e0, greatest(0e0, r * 7e-1 + c * 3e-1)) AS j0 FROM f), k AS (SELECT *, {sql.fixed('j0')} AS j FROM j), z AS (SELECT *, greatest(0e0, least(1e0, r * 45e-2 + c * 2e-1 + j * 35e-2 - f * 2e-1)) AS t0 FROM k)
            SELECT doc_id, r AS required_points_score, c AS citation_score, f AS forbidden_claims_penalty, j AS judge_score, {sql.fixed('t0')} AS comprehension_score FROM z""",
        "eval_citations": f"{_ANSWERS} SELECT doc_id, array_to_string({sql.first_distinct('c')}, '|') AS citations FROM cited",
        "eval_tokens": f"SELECT doc_id, CASE WHEN text IS NULL THEN 0 ELSE {n} END AS tokens FROM documents",
        "eval_trim": f"""WITH b AS (SELECT source AS case_id, doc_id AS position, {sql.trim('text')} AS text, 'd' || doc_id AS citation FROM documents WHERE {sql.trim('text')} <> ''), t AS (SELECT *, len(regexp_extract_all(text || chr(10) || '[citation] ' || citation, '{token}')) AS n FROM b),
            u AS (SELECT *, sum(n) OVER (PARTITION BY case_id ORDER BY position) AS through FROM t), v AS (SELECT *, through - n AS before, sum(CAST(through > 1200 AS INT)) OVER (PARTITION BY case_id ORDER BY position) AS k FROM u)
            SELECT case_id, position, CASE WHEN k = 0 THEN text ELSE array_to_string(regexp_extract_all(text, '{token}')[1:greatest(8, 1200 - before - 8)], ' ') || ' ...' END AS text, citation FROM v WHERE k = 0 OR (k = 1 AND through > 1200 AND 1200 - before > 0)""",
        "eval_dup_ratio": f"WITH k AS (SELECT source AS case_id, nullif({_normalize('text')}, '') AS key FROM documents), a AS (SELECT case_id, (count(key) - count(DISTINCT key))::DOUBLE / greatest(1, count(*)) AS x FROM k GROUP BY case_id) SELECT case_id, {sql.fixed('x')} AS duplicate_context_ratio FROM a",
        "grep_retrieve": f"{_GREP} SELECT * FROM blocks",
        "eval_run": f"""{_GREP}, b AS (SELECT case_id, position, {sql.trim('text')} AS text, citation FROM blocks), t AS (SELECT *, len(regexp_extract_all(CASE WHEN citation <> '' THEN text || chr(10) || '[citation] ' || citation ELSE text END, '{token}')) AS n FROM b WHERE text <> ''),
            u AS (SELECT *, sum(n) OVER (PARTITION BY case_id ORDER BY position) AS through FROM t), v AS (SELECT *, through - n AS before, sum(CAST(through > 300 AS INT)) OVER (PARTITION BY case_id ORDER BY position) AS k FROM u),
            w AS (SELECT case_id, position, CASE WHEN k = 0 THEN text ELSE array_to_string(regexp_extract_all(text, '{token}')[1:greatest(8, 300 - before - 8)], ' ') || ' ...' END AS text, citation FROM v WHERE k = 0 OR (k = 1 AND through > 300 AND 300 - before > 0)),
            g AS (SELECT case_id, list(text ORDER BY position) AS ts, list(citation ORDER BY position) AS cs, CAST(sum(len(regexp_extract_all(text, '{token}')) + len(regexp_extract_all(citation, '{token}'))) AS INT) AS tokens FROM w GROUP BY case_id),
            s0 AS (SELECT case_id, tokens, {sql.trim("'Based on the retrieved documentation, ' || q.text || ' ' || split_part(ts[1], chr(10), 1) || CASE WHEN len(ts) > 1 THEN ' ' || split_part(ts[2], chr(10), 1) ELSE '' END || chr(10) || chr(10) || 'Citations: ' || array_to_string(list_transform(cs[1:3], lambda c: '[' || c || ']'), ', ')")} AS a FROM g JOIN benchmark q ON q.item_id = g.case_id),
            s1 AS (SELECT *, {sql.first_distinct(_CITES)} AS c, {_normalize('a')} AS h FROM s0), s2 AS (SELECT *, lower(array_to_string(c, chr(10)) || chr(10) || a) AS l, {' + '.join(f"CAST({_HIT(p, '6e-1')} AS INT)" for p in _POINTS)} AS hits, {forbidden} AS f0 FROM s1),
            s3 AS (SELECT *, hits::DOUBLE / {len(_POINTS)} AS r0, (CAST(contains(l, 'd00000002.md') AS INT) + CAST(contains(l, '5-7') AS INT))::DOUBLE / 2 AS c0, CASE WHEN hits > 0 THEN tokens::DOUBLE / hits ELSE 0e0 END AS p0 FROM s2), s4 AS (SELECT *, {sql.fixed('r0')} AS r, {sql.fixed('c0')} AS cc, {sql.fixed('f0')} AS f, {sql.fixed('p0')} AS per FROM s3),
            s5 AS (SELECT *, least(1e0, greatest(0e0, r * 7e-1 + cc * 3e-1)) AS j0 FROM s4), s6 AS (SELECT *, {sql.fixed('j0')} AS j FROM s5), s7 AS (SELECT *, greatest(0e0, least(1e0, r * 45e-2 + cc * 2e-1 + j * 35e-2 - f * 2e-1)) AS t0 FROM s6)
            SELECT case_id, 'grep' AS tool, 1 AS pass_index, tokens AS retrieval_tokens, a AS answer_text, array_to_string(c, '|') AS answer_citations, per AS tokens_per_required_point, r AS required_points_score, cc AS citation_score, f AS forbidden_claims_penalty, j AS judge_score, {sql.fixed('t0')} AS comprehension_score, TRUE AS ok, '' AS error FROM s7""",
        "eval_first_hop": f"{_GREP}, p AS (SELECT case_id, count(*) FILTER (WHERE contains(lower(citation), 'd0000000') OR contains(lower(citation), '5.md'))::DOUBLE / count(*) AS x FROM blocks GROUP BY case_id) SELECT case_id, {sql.fixed('x')} AS precision FROM p",
    }
