import random

from pyspark.sql import functions as F

from verbatrix.operators import graph, lookups


def test_runs_contain_needles(spark):
    rng = random.Random(1)
    word = lambda least: "".join(rng.choice("abc") for _ in range(rng.randrange(least, 7)))
    runs, needles = {word(1) for _ in range(120)}, {word(1) for _ in range(40)}
    got = lookups.runs_with(spark.createDataFrame([(r,) for r in runs], "run string"), spark.createDataFrame([(n,) for n in [*needles, ""]], "needle string"))
    assert {(r.needle, r.run) for r in got.collect()} == {(n, r) for n in needles for r in runs if n in r}


def test_running_sums_pass_over_partitions(spark):
    rows = [(f"p{i:03d}", (i * 37) % 11) for i in range(200)]
    df = spark.createDataFrame(rows, "path string, bytes bigint").repartition(7)
    got = lookups.running(df, [F.col("path")], {"through": "bytes"}).collect()
    total, want = 0, {}
    for n, (p, b) in enumerate(rows, 1):
        total += b
        want[p] = (n, total)
    assert {r.path: (r.number, r.through) for r in got} == want
    assert lookups.running(df.limit(0), [F.col("path")], {"through": "bytes"}).count() == 0


def test_overlap_by_signature_equals_all_pairs(spark):
    rng = random.Random(3)
    sets = {f"r{i:02d}": {rng.choice("xyz") for _ in range(3)} | {f"i{rng.randrange(40)}" for _ in range(rng.randrange(0, 4))} for i in range(60)}
    df = spark.createDataFrame([(r, x) for r, s in sets.items() for x in s], "ref string, item string")
    got = {(r.src_ref, r["rank"]): (r.dst_ref, round(r.score, 9)) for r in graph.overlap(df, 0.0, top=3, heavy=2).collect()}
    want = {}
    for a, x in sets.items():
        near = sorted((-len(x & y) / len(x | y), b) for b, y in sets.items() if b != a and x & y)
        want |= {(a, n): (b, round(-s, 9)) for n, (s, b) in enumerate(near[:3], 1)}
    assert got == want
