import random

import pytest
from pyspark.sql import functions as F

from verbatrix.index import Index
from verbatrix.operators import evaluation as E
from verbatrix.operators import hops

FILES = [
    ("auth.md", "# Tokens\nRefresh the token before it expires. Tokens are short.\n\n## Rotate\n```\nrotate --key old\n```\nRotate keys daily. See [hooks](hooks.md#hooks).\n"),
    ("hooks.md", "# Hooks\nVerify the signature of each hook.\n\n## Routes\nThe route is /v1/hooks and it takes json.\n"),
    ("other.md", "# Other\nNothing of interest here.\n"),
]
CASE = "case_id string, question string, required_points array<string>, acceptable_citations array<string>, forbidden_claims array<string>"
BLOCK = "id int, question string, points array<string>, expected array<string>, preferred array<string>, blocks array<struct<text: string, citation: string, ref: string>>"


def words(text):
    for c in "`*_#>[](){},.:;!?\"'":
        text = text.lower().replace(c, " ")
    return " ".join(text.split())


def covers(text, phrase):
    asked = [w for w in words(phrase).split() if len(w) > 1]
    return sum(w in words(text) for w in asked) / len(asked) if asked else 0


def plain_ranked(blocks, question, points, expected):
    def score(b):
        s = 3 * sum(any(covers(b[0], a) >= 0.6 for a in p.split("||")) for p in points) + 2 * sum(e.lower() in b[1].lower() for e in expected)
        if "route" in question.lower():
            s += 2 * ("/" in b[0]) - 1.5 * ("secret" in b[0].lower())
        return s + 1.5 * ("json" in question.lower() and "json" in b[0].lower())
    return sorted(blocks, key=lambda b: (-score(b), b[1]))


def plain_chosen(blocks, limit, preferred):
    out = []
    for ref in dict.fromkeys(preferred):
        out += [b for b in blocks if b[2] == ref and b[:2] not in [x[:2] for x in out]][:1] if len(out) < limit else []
    for b in blocks:
        if len(out) < limit and b[2] not in [x[2] for x in out] and b[:2] not in [x[:2] for x in out]:
            out.append(b)
    for b in blocks:
        if len(out) < limit and b[:2] not in [x[:2] for x in out]:
            out.append(b)
    return out


def test_blocks_are_ranked_and_chosen_as_one_by_one(spark):
    rng, rows = random.Random(4), []
    texts = ["route /v1/a takes json", "a secret key at /x", "token expires soon", "rotate the key", "token", "nothing"]
    for i in range(60):
        blocks = [(rng.choice(texts), f"l@1:d#{rng.choice('abc')}:{rng.randrange(3)}-9", rng.choice("pqrs")) for _ in range(rng.randrange(0, 9))]
        rows.append((i, rng.choice(["which route?", "json of a route", "why"]), rng.sample(["token expires || rotate key", "secret", "json route", ""], 2), rng.sample(["#a", "#B:1", "zz"], 2), rng.sample("pqz", 2), blocks))
    ranked = hops.ranked_blocks(F.col("blocks"), F.col("question"), F.col("points"), F.col("expected"))
    got = {r.id: r for r in spark.createDataFrame(rows, BLOCK).withColumn("ranked", ranked).withColumn("chosen", hops.chosen_blocks(F.col("ranked"), 3, F.col("preferred"))).collect()}
    for i, question, points, expected, preferred, blocks in rows:
        want = plain_ranked(blocks, question, points, expected)
        assert [tuple(b) for b in got[i].ranked] == want
        assert [tuple(b) for b in got[i].chosen] == plain_chosen(want, 3, preferred)


@pytest.fixture(scope="module")
def found(spark):
    index = Index.of(spark.createDataFrame(FILES, "rel_path string, content string"), "lib", "1").materialized()
    cases = spark.createDataFrame([("c1", "How do I rotate keys?", ["rotate keys daily"], ["auth.md", "hooks"], ["never"]), ("c2", "zzz", [], [], [])], CASE)
    return cases, hops.multi_hop(index, cases)


def test_hops_reach_what_is_expected(found):
    rows = {r.case_id: r for r in found[1].collect()}
    one = rows["c1"]
    assert 0 < len(one.context_blocks) <= 3 and one.coverage_after_3_hops == one.coverage_after_2_hops == 1.0
    assert {b.ref.split("#")[0] for b in one.context_blocks} & {"auth", "hooks"} and one.first_hop_precision_at_k > 0
    assert one.citation_precision_line_level == 1.0 and one.duplicate_context_ratio == 0.0 and one.abstain_when_unknown_rate == 0.0
    assert rows["c2"].coverage_after_2_hops == 1.0 and len(rows["c2"].context_blocks) <= 3


def test_records_of_a_run(spark, found):
    cases, hop = found
    blocks = hop.select("case_id", F.posexplode("context_blocks").alias("position", "b")).select("case_id", "position", "b.text", "b.citation").where("case_id = 'c1'")
    rows = hops.run(cases, blocks, "hops", hop, passes=2)
    by = {(r.case_id, r.pass_index): r for r in rows.collect()}
    assert set(by) == {(c, p) for c in ("c1", "c2") for p in (1, 2)}
    one, none = by["c1", 1], by["c2", 1]
    assert one.ok and one.answer_text.startswith("Based on the retrieved documentation, How do I rotate keys?") and one.answer_citations and one.required_points_score == 1.0
    assert one.tokens_per_required_point == one.retrieval_tokens and one.first_hop_precision_at_k > 0
    assert not none.ok and none.error and none.comprehension_score == 0.0 and none.retrieval_tokens == 0 and none.answer_text == ""
    tools, _ = E.summary(rows.withColumn("total_latency_ms", F.lit(0.0)))
    assert tools.first().success_rate == 0.5
