from pyspark.sql import functions as F

from verbatrix.operators import evaluation as E


def test_answer_scores(spark):
    a = spark.createDataFrame([("Uses [guide.md:3-4] tokens and retries fast", ["tokens", "retries||backoff", "webhook secret"], ["GUIDE.md:3-4"], ["tokens retries"]), (None, [], [], [])], "answer_text string, required_points array<string>, acceptable_citations array<string>, forbidden_claims array<string>")
    one, two = E.score_answers(a).collect()
    assert (one.required_points_score, one.citation_score, one.forbidden_claims_penalty) == (0.6667, 1.0, 1.0)
    assert one.answer_citations == ["guide.md:3-4"] and one.judge_score == 0.7667
    assert (two.required_points_score, two.citation_score, two.forbidden_claims_penalty) == (1.0, 1.0, 0.0)


def test_trim_keeps_a_part_of_the_first_that_overflows(spark):
    blocks = spark.createDataFrame([("c", 1, "one two three four five", ""), ("c", 2, "six seven eight nine ten eleven twelve thirteen fourteen", ""), ("c", 3, "z", "")], "case_id string, position int, text string, citation string")
    rows = E.trim_blocks(blocks, 12).orderBy("position").collect()
    assert [r.text for r in rows] == ["one two three four five", "six seven eight nine ten eleven twelve thirteen ..."]
    assert E.trim_blocks(blocks, 5).count() == 1


def records(spark):
    rows = [("r", t, c, p, s, tok, 10.0 * tok, ok) for t, c, p, s, tok, ok in (("a", "x", 1, 0.9, 10, True), ("a", "y", 1, 0.5, 30, True), ("a", "z", 1, 0.1, 99, False), ("b", "x", 1, 0.8, 20, True), ("b", "y", 1, 0.6, 40, True), ("c", "x", 1, 0.0, 1, False))]
    df = spark.createDataFrame(rows, "run_id string, tool string, case_id string, pass_index int, comprehension_score double, total_tokens int, total_latency_ms double, ok boolean")
    for c in ("first_hop_precision_at_k", "coverage_after_2_hops", "coverage_after_3_hops", "tokens_per_required_point", "duplicate_context_ratio", "citation_precision_line_level", "abstain_when_unknown_rate"):
        df = df.withColumn(c, F.lit(None).cast("double"))
    return df


def test_aggregates_and_pairs(spark):
    tools, pairs = E.summary(records(spark))
    by = {r.tool: r for r in tools.collect()}
    assert (by["a"].runs, by["a"].successful_runs, by["a"].success_rate, by["a"].mean_comprehension, by["a"].p95_total_tokens) == (3, 2, 0.6667, 0.7, 30.0)
    assert by["c"].mean_comprehension == 0.0 and by["c"].p95_total_latency_ms == 0.0
    assert {r.pair: (r.compared_cases, r.left_win_rate, r.right_win_rate) for r in pairs.collect()} == {"a vs b": (2, 0.5, 0.5), "a vs c": (0, 0.0, 0.0), "b vs c": (0, 0.0, 0.0)}
    text = E.report(tools, pairs)
    assert "a vs b" in text and text.startswith("# ")


def test_gates(spark):
    tools, _ = E.summary(records(spark))
    got = {r.gate: r.passed for r in E.gates(tools, tools, "a", rival="c", previous=tools).collect()}
    assert got["comprehension_plus_0_08"] is False and got["rival_checks_available"] is True and got["two_consecutive_runs_stable"] is True
    assert {r.gate: r.passed for r in E.gates(tools, tools, "a", rival="c", require_rival=True).collect()}["rival_checks_available"] is False


def test_grep_falls_back_to_the_first_file(spark):
    files = spark.createDataFrame([("b.md", "x\nneedle here\ny"), ("a.md", "start\nnothing")], "rel_path string, content string")
    cases = spark.createDataFrame([("hit", "Where is the needle?"), ("miss", "qqqqq zzzzz"), ("any", "is it")], "case_id string, question string")
    rows = {(r.case_id, r.position): (r.text, r.citation) for r in E.grep_retrieve(files, cases).collect()}
    assert rows["hit", 1] == ("x\nneedle here\ny", "b.md:1-3") and rows["miss", 1] == ("start\nnothing", "a.md:1-12")
    assert rows["any", 1][1] == "a.md:1-2"


def test_shares_are_computed_once(spark):
    """Rounding reads a share many times; the words of the points are looked for once all the same."""
    a = spark.createDataFrame([("x", ["a"], ["b"], ["c"])], "answer_text string, required_points array<string>, acceptable_citations array<string>, forbidden_claims array<string>")
    plan = E.score_answers(a)._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("exists(") == 1 and plan.count(">= 0.75") == 1


def test_citations_are_those_of_plain_patterns(spark):
    import re

    plain = ("[A-Za-z0-9_.-]+@[A-Za-z0-9_.-]+:[A-Za-z0-9_./-]+#[A-Za-z0-9_./-]+:\\d+-\\d+", "[A-Za-z0-9_./-]+\\.md(?::\\d+(?:-\\d+)?)?")
    texts = ["a@b:c#d:1-2x@y:z#w:3-4", "a.mdb.md:3-4c/d.md x.md.", "..md .md a@@b:c#d:1-2 a@b@c:d#e:1-22-3@f:g#h:4-5", "-a@b:c/d.md#e:1-2.md:7md.md:8-"]
    rows = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "i int, t string").select("i", E.extract_citations(F.col("t")).alias("c")).collect()
    assert {r.i: r.c for r in rows} == {i: list(dict.fromkeys(x for p in plain for x in re.findall(p, t))) for i, t in enumerate(texts)}


def test_normalized_text_has_no_marks(spark):
    t = "`A*b_c#d>e[f](g){h},i.j:k;l!m?n\"o'p\u00a0 \u2003Q.\n"
    assert spark.createDataFrame([(t,)], "t string").select(E.normalize(F.col("t"))).first()[0] == "a b c d e f g h i j k l m n o p q"


def test_grep_takes_the_first_lines_of_all_files(spark):
    """Lines that a file gives beyond its share leave room for those of the next file; a plain search gives the same."""
    import random

    rng = random.Random(3)
    words = ["alpha", "beta", "Gamma_ray", "delta", "omega", "xalphax", "no", ""]
    files = [(f"{'aB'[i % 2]}{i:02d}.md", "\n".join(" ".join(rng.choice(words) for _ in range(rng.randrange(4))) for _ in range(30))) for i in range(12)] + [("none.md", None)]
    cases = [(1, "which alpha?"), (2, "gamma or BETA"), (3, "is it"), (4, "ray"), (5, "zzz")]
    terms = {1: ["alpha"], 2: ["gamma", "beta"], 3: None, 4: ["ray"]}
    df, asked = spark.createDataFrame(files, "rel_path string, content string").repartition(5), spark.createDataFrame(cases, "case_id int, question string")
    for most, per_file in ((5, 2), (8, 60), (40, 3)):
        want = {}
        for case, ts in terms.items():
            lines = [(p, n) for p, c in sorted(files, key=lambda f: f[0].lower()) if c for n, line in [(n, x) for n, x in enumerate(c.split("\n"), 1) if (any(t in x.lower() for t in ts) if ts else x)][:per_file]]
            want |= {(case, i): f"{p}:{n}-{n}" for i, (p, n) in enumerate(lines[:most], 1)}
        got = {(r.case_id, r.position): r.citation for r in E.grep_retrieve(df, asked, max_blocks=most, window=0, per_file=per_file).collect()}
        assert got == want | {(5, 1): "a00.md:1-12"}


def test_grep_keeps_lines_where_they_are(spark):
    """No line or word of the files is shuffled for a search."""
    files = spark.createDataFrame([("a.md", "one two")], "rel_path string, content string")
    asked = spark.createDataFrame([(1, ["two"])], "case_id int, terms array<string>")
    hits = E.grep_hits(files, asked, 8, 60)
    assert "Generate" not in hits._jdf.queryExecution().optimizedPlan().toString() and [tuple(r) for r in hits.collect()] == [(1, "a.md", 1, 1)]
