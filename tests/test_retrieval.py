import pytest
from pyspark.sql import functions as F

from verbatrix.errors import EngineError
from verbatrix.index import Index
from verbatrix.operators import graph, retrieval

FILES = [
    ("auth.md", "# Tokens\nRefresh the token before it expires. Tokens are short.\n\n## Rotate\n```\nrotate --key old\n```\nRotate keys daily.\n"),
    ("hooks.md", "# Hooks\nVerify the signature of each hook.\n\n- Verify the signature of each hook.\n\n## Token use\nA token is a secret. See [tokens](auth.md#tokens).\n"),
    ("copy.md", "# Hooks copy\nVerify the signature of each hook.\n"),
]


@pytest.fixture(scope="module")
def index(spark):
    return Index.of(spark.createDataFrame(FILES, "rel_path string, content string"), "lib", "1").materialized()


def ask(spark, *queries, **limits):
    df = spark.createDataFrame([(f"q{i}", q) for i, q in enumerate(queries)], "query_id string, query string")
    for k, v in limits.items():
        df = df.withColumn(k, F.lit(v))
    return df


QUERIES = ("refresh token", "how to use it", "rotate --key", "What is a token?", "verify signature hook", "")


def test_candidates_are_the_best_of_all_scores(spark, index):
    q = ask(spark, *QUERIES, max_items=1)
    weighted = index.weighted(q)
    every = retrieval.all_scores(index.marked(), weighted).collect()
    got = {(r.query_id, r.unit_id): r.base_score for r in retrieval.candidates(index.marked(), weighted).collect()}
    assert got == {(r.query_id, r.unit_id): r.base_score for r in every}  # 20 for each query are more than there are


def test_extract_keeps_to_its_limits(spark, index):
    for budget, items in ((25, 5), (600, 2), (1, 5)):
        rows = index.extract(ask(spark, *QUERIES, budget=budget, max_items=items)).collect()
        for q in {r.query_id for r in rows}:
            own = [r for r in rows if r.query_id == q]
            assert sum(r.token_estimate for r in own) == own[0].spent_tokens <= budget and len(own) <= items
            assert len({r.text_hash for r in own}) == len(own) and all(0 <= r.novelty <= 1 for r in own)


def test_extract_only_from_refs(spark, index):
    rows = index.extract(ask(spark, "token", refs=["hooks#token-use"])).collect()
    assert rows and {r.ref for r in rows} == {"hooks#token-use"}


def test_find_orders_refs(spark, index):
    rows = index.find(ask(spark, "rotate keys")).orderBy("position").collect()
    assert rows[0].ref == "auth#rotate" and "heading:rotate" in rows[0].why_matched
    assert all(len(r.top_units) <= 2 for r in rows)


def test_results_do_not_depend_on_partitions(spark, index):
    from dataclasses import replace

    other = replace(index, units=index.units.repartition(5, "text"), sections=index.sections.repartition(3, "heading"))
    q = ask(spark, *QUERIES)
    assert sorted(map(str, index.find(q).collect())) == sorted(map(str, other.find(q).collect()))


def test_neighbors_and_lookups(spark, index):
    asked = spark.createDataFrame([("a", "hooks#token-use")], "query_id string, ref string")
    assert [(r.dst_ref, r.edge_type) for r in index.neighbors(asked).orderBy("position").collect()][:2] == [("hooks#hooks", "heading_adjacent"), ("auth#tokens", "intra_doc_link")]
    assert index.open(asked).first().heading == "Token use"
    assert index.cite(asked).first().citation_id == "lib@1:hooks#token-use:6-8"
    assert index.open(spark.createDataFrame([("a", "hooks")], "query_id string, ref string")).first().anchor == "hooks"
    with pytest.raises(EngineError) as e:
        index.require_refs(spark.createDataFrame([("a", "no#where")], "query_id string, ref string"))
    assert e.value.exit_status == 5


def test_expand_prefers_short_units(spark, index):
    rows = index.expand(spark.createDataFrame([("a", "auth#rotate", 120, 3)], "query_id string, ref string, budget int, max_items int")).orderBy("position").collect()
    assert [r.token_estimate for r in rows] == sorted(r.token_estimate for r in rows) and rows[0].why_matched == ["expand:anchor"]


@pytest.mark.parametrize("least", [0.0, 0.2, 0.5])
def test_overlap_equals_brute_force(spark, least):
    import random

    rng = random.Random(5)
    sets = {f"r{i:03d}": frozenset(rng.choice("abcdefghij") * (1 + (rng.random() < 0.5)) for _ in range(rng.randrange(1, 7))) for i in range(60)}
    df = spark.createDataFrame([(r, x) for r, s in sets.items() for x in s], "ref string, item string")
    got = {}
    for r in graph.overlap(df, least).collect():
        got.setdefault(r.src_ref, {})[r.rank] = (r.dst_ref, round(r.score, 9))
    for a, s in sets.items():
        near = sorted(((-len(s & t) / len(s | t), b) for b, t in sets.items() if b != a and s & t and len(s & t) / len(s | t) >= least))[:5]
        assert [got.get(a, {}).get(i + 1) for i in range(len(near))] == [(b, round(-j, 9)) for j, b in near] and len(got.get(a, {})) == len(near)


def test_store_and_read(spark, index, tmp_path):
    stored = index.write(str(tmp_path / "ix"))
    assert stored.stats().first() == index.stats().first()
    assert stored.graph.count() == index.graph.count()
    with pytest.raises(EngineError) as e:
        Index.read(spark, str(tmp_path / "none"))
    assert e.value.code == "INDEX_UNREADABLE"


def test_extract_all_reads_every_section(spark):
    from verbatrix.plans import corpus

    d = "/root/testdata/sf0.001"
    ix = corpus.stored(spark, d)
    queries, refs = corpus.by_lang(spark, d, ix)
    assert refs.select("ref").distinct().count() == ix.sections.select("doc_id", "anchor").distinct().count()
    langs = {"d" + str(r.doc_id).rjust(8, "0"): r.lang or "" for r in spark.read.parquet(f"{d}/documents.parquet").collect()}
    best = {}
    for r in retrieval.all_scores(ix.marked(), ix.weighted(queries)).select("query_id", *retrieval.UNIT, "base_score").collect():
        if r.query_id.split(":")[1] == langs[r.doc_id]:
            best[r.query_id] = max(best.get(r.query_id, -9), r.base_score)
    ranked = ix.candidates(queries, refs).select("query_id", "doc_id", "anchor", "rank", "base_score").collect()
    assert {r.query_id: r.base_score for r in ranked if r.rank == 1} == best
    assert all(r.query_id.split(":")[1] == langs[r.doc_id] for r in ranked)
    got = corpus.extract_all(spark, d).collect()
    assert len({r.ref.split("#")[0] for r in got} - {f"d0000000{n}" for n in range(1, 6)}) > 0
    assert any(r.ref.split("#")[1] not in langs.values() for r in got)


def test_searched_overlap_writes_no_pairs(spark):
    """Sets that all share an item: a few rows for each leave a task, those asked for get the edges that they have among all."""
    from verbatrix.operators import similar
    from verbatrix.sources import shared

    sets = spark.range(300).selectExpr("format_string('r%03d', id) ref", "explode(array('all', 'a' || id % 3, 'b' || id % 7, 'c' || id % 40)) item")
    every = {(r.src_ref, r["rank"]): (r.dst_ref, r.score) for r in graph.overlap(sets, 0.2).collect()}
    some = {(r.src_ref, r["rank"]): (r.dst_ref, r.score) for r in graph.overlap(sets, 0.2, asked=spark.createDataFrame([("r007",), ("r100",), ("none",)], "ref string")).collect()}
    assert some == {k: v for k, v in every.items() if k[0] in ("r007", "r100")} and len(some) == 10
    numbers = shared.written(spark.range(200).selectExpr("id ordinal", "array(-1L, id % 5, 100 + id % 9) items"), "test-sets")
    near = similar.nearest(numbers, numbers, 0.2, 6, chunk=16).collect()
    want = {i: sorted((-len(x & y) / len(x | y), j) for j, y in own.items())[:6] for own in [{i: {-1, i % 5, 100 + i % 9} for i in range(200)}] for i, x in own.items()}
    assert len(near) == 1200 and {i: sorted((-r.score, r.y) for r in near if r.x == i) for i in range(200)} == want


def test_units_stay_where_they_are(spark, index):
    """Candidates are keys until they are chosen: no text of the corpus is shuffled for them, nor for a choice among sections."""
    near = retrieval.best_units(retrieval.unlocated(index.units), index.weighted(ask(spark, *QUERIES)))
    plan = near._jdf.queryExecution().optimizedPlan().toString()
    assert "RepartitionByExpression" not in plan and "FlatMapCoGroupsInArrow" not in plan and "text_hash" in plan
    asked = spark.createDataFrame([("a", "hooks"), ("b", "hooks#token-use"), ("c", "hooks#none"), ("d", "none")], "query_id string, ref string")
    assert "Window" not in index.select_sections(asked)._jdf.queryExecution().optimizedPlan().toString()
    assert sorted(r.query_id for r in index.missing_refs(asked).collect()) == ["c", "d"]
    assert "body:" not in index.missing_refs(asked)._jdf.queryExecution().executedPlan().toString()


def test_candidates_of_a_table_of_refs(spark, index):
    q = ask(spark, *QUERIES, max_items=1)
    within = spark.createDataFrame([("q0", "auth#rotate"), ("q0", "hooks#hooks"), ("q3", "hooks#token-use"), ("q3", "no#where")], "query_id string, ref string")
    weighted = index.weighted(q)
    every = retrieval.all_scores(index.marked(), weighted).join(within, ["query_id", "ref"]).collect()
    got = index.candidates(q, within).collect()
    assert {(r.query_id, r.unit_id, r.base_score, r.source_path) for r in got} == {(r.query_id, r.unit_id, r.base_score, r.source_path) for r in every} and got


def test_queries_travel_to_the_units(spark, index):
    plan = retrieval.all_scores(index.marked(), index.weighted(ask(spark, *QUERIES)))._jdf.queryExecution().executedPlan().toString()
    assert "CartesianProduct" not in plan and "BroadcastNestedLoopJoin BuildLeft" not in plan and "BuildRight, Cross" in plan


def test_expand_of_all_sections_needs_no_index(spark, monkeypatch):
    from verbatrix.plans import corpus

    def built(*_):
        raise AssertionError("an index was built")

    monkeypatch.setattr(corpus, "stored", built)
    df = corpus.expand(spark, "/root/testdata/sf0.001")
    plan = df._jdf.queryExecution().executedPlan().toString()
    assert "Join" not in plan and df.count() > 0


def test_expand_from_files_equals_expand_of_an_index(spark):
    """Files that share a document id, units that are equal but for case, ties, near copies, odd characters, commands and a heading that defines."""
    from verbatrix.operators import expansion

    long = " ".join(f"Sentence {i} tells of part {i % 7}. It goes on." for i in range(60))
    docs = [
        ("a.md", f"# Top\n\nRun it now. Then go.\nRUN IT NOW. THEN GO.\n\n- Run it now. Then go.\n- run it now. then go.\n\n## Overview of x\n\nPlain words here.\n\n{long}\n\n## Empty\n"),
        ("a/index.md", "# Top\n\nRUN it now. Then go.\nrun it now. Then go.\n\n## Other\n\nYou MUST do it. İstanbul K \U0001f600 means x. Next `npm run x --flag` and `'git' log`, `x.json`, `a/b --c`, `verbatrix`, `foo --bar baz`."),
        ("b.md", "# B\n\none two three four five six seven eight nine ten.\n\none two three four five six seven eight nine ten eleven.\n\nONE two three four five six seven eight nine ten!\n\nx.y(z) and f(a)\n\n```\nmake all\n```\n\n```\nMAKE ALL\n```\n" + "\n\n".join(f"Item {c}." for c in "zyxwvut")),
        ("readme.md", "no heading\nat all `curl -s x`"), ("c.md", ""), ("d.md", None),
    ]
    files = spark.createDataFrame(docs, "rel_path string, content string")
    ix = Index.of(files)
    for budget, most in ((600, 5), (30, 9), (8, 2)):
        asked = graph.refs(ix.sections).select(F.col("ref").alias("query_id"), "ref").distinct().withColumns({"budget": F.lit(budget), "max_items": F.lit(most)})
        want, got = ix.expand(asked), expansion.of_files(files, budget, most)
        same = [c for c in got.columns if c in want.columns]
        assert len(same) == 21 and got.select(same).dtypes == want.select(same).dtypes
        assert sorted(map(str, got.select(same).collect())) == sorted(map(str, want.select(same).collect())) != []


def test_symbol_overlap_needs_no_index(spark, monkeypatch):
    from verbatrix.plans import corpus

    def built(*_):
        raise AssertionError("an index was built")

    monkeypatch.setattr(corpus, "stored", built)
    assert corpus.graph_symbol_overlap(spark, "/root/testdata/sf0.001").count() > 0


def test_symbols_are_found_at_their_joints():
    import random
    import re

    from verbatrix.functions import text as T
    from verbatrix.operators import markdown

    rng, pattern = random.Random(7), re.compile(T.SYMBOL_WORD)
    for n in range(40000):
        text = "".join(rng.choice("ab1_.:( )é\n" if n % 2 else "a1.:()") for _ in range(rng.randrange(16)))
        assert markdown.symbols_in(text) == list(dict.fromkeys(pattern.findall(text))), text
    # what never closes is not read again from each bracket, nor a long word from each letter
    assert markdown.symbols_in("f(x) " + "g(" * 300_000 + "h" * 300_000) == ["f(x)"]


def test_symbols_of_files_equal_those_of_sections(spark):
    """Of two sections with one reference the last counts, symbols or none; an argument list may span lines, and what never closes is none."""
    from verbatrix.operators import markdown

    docs = [
        ("a.md", "# Top\nx.y and f(a\nb)\n## Next\np.q(r) 3a.b(c)\n"), ("a/index.md", "# Top\n\n## Next\n\nnothing\n"), ("b.md", "# B\nopen( here\n```\nrun(x\n```\n```\nz.w\n```\n"),
        ("c.md", "# C\nx.y z.w\n"), ("d.md", None), ("e.md", "plain x.y\nf(a\nb)"),
    ]
    files = spark.createDataFrame(docs, "rel_path string, content string")
    own, stored = graph.symbol_sets(markdown.symbols(files)), graph.symbol_sets(markdown.sections(files))
    got = sorted(map(tuple, own.collect()))
    assert got == sorted(map(tuple, stored.collect()))
    sets = {ref: {i for r, i in got if r == ref} for ref in ("a#top", "a#next", "b#b", "c#c", "e#document")}
    assert sets == {"a#top": set(), "a#next": {"p.q", "b(c)"}, "b#b": {"z.w"}, "c#c": {"x.y", "z.w"}, "e#document": {"f(a\nb)"}}
