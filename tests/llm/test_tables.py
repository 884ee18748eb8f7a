import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from verbatrix.llm import ann, mixing, packing, tokens, url_filter

DOCS = "doc_id bigint, text string, lang string, source string, n_chars bigint"


# nearest neighbours ------------------------------------------------------------


def test_neighbours_recall_against_brute_force(spark):
    rng = np.random.default_rng(1)
    v = (rng.normal(0, 1, (20, 32))[rng.integers(0, 20, 900)] + rng.normal(0, 0.5, (900, 32))).astype(np.float32)
    df = spark.createDataFrame([(i, x.tolist()) for i, x in enumerate(v)], "vec_id bigint, embedding array<float>")
    got = {}
    for r in ann.nearest(df, base=400, queries=300).collect():
        got.setdefault(r.vec_id, {})[r.rank] = (r.neighbor_id, r.distance)
    d = np.sqrt(((v[:, None].astype(float) - v[None]) ** 2).sum(2))
    np.fill_diagonal(d, np.inf)
    hits = 0
    for i in range(900):
        assert sorted(got[i]) == list(range(1, 11))
        assert all(got[i][k][1] == pytest.approx(d[i, got[i][k][0]], rel=1e-5) for k in got[i])
        hits += len({n for n, _ in got[i].values()} & set(np.argsort(d[i])[:10]))
    assert hits >= 0.9 * 9000


def test_queries_are_the_ids_that_a_number_divides(spark):
    rng = np.random.default_rng(6)
    v = rng.normal(size=(400, 16)).astype(np.float32)
    df = spark.createDataFrame([(i, x.tolist()) for i, x in enumerate(v)], "vec_id bigint, embedding array<float>")
    rows = ann.nearest(df, base=150, queries=7, every=20).collect()
    assert {r.vec_id for r in rows} == set(range(0, 400, 20)) and len(rows) == 200
    assert {r.neighbor_id % 20 for r in rows} > {0}  # all vectors are searched
    d = np.sqrt(((v[:, None].astype(float) - v[None]) ** 2).sum(2))
    np.fill_diagonal(d, np.inf)
    near = {i: set(np.argsort(d[i])[:10].tolist()) for i in range(0, 400, 20)}
    assert sum(r.neighbor_id in near[r.vec_id] for r in rows) >= 180


def test_collisions_equal_their_definition():
    rng = np.random.default_rng(2)
    v = rng.normal(size=(300, 8)).astype(np.float32)
    a = rng.normal(size=(8, 16)).astype(np.float32)
    block = ann.Block(np.arange(300), v, a)
    p = v @ a
    for width in (0.01, 0.5, 2.0, 50.0):
        for q in (0, 17):
            want = (np.abs(p.astype(np.float64) - p[q]) <= width).sum(1)
            assert np.abs(block.collisions(p[q], width).astype(int) - want).max() <= 1  # an end may fall on a value
    assert block.collisions(p[0], 1e6).min() == 16


def test_search_level_does_not_depend_on_the_guess():
    rng = np.random.default_rng(3)
    v = rng.normal(size=(500, 16)).astype(np.float32)
    a = rng.normal(size=(16, 64)).astype(np.float32)
    block = ann.Block(np.arange(500), v, a)
    for q in range(5):
        out = [block.search(q, v[q], v[q] @ a, 10, 0.1, ann.threshold(), ann.HALF, ann.FACTOR, g) for g in (0, 7, 30, 60)]
        assert len({(tuple(f), level) for f, _, level in out}) == 1


def test_neighbour_edge_cases(spark):
    one = [1.0, 2.0]
    rows = [(1, one), (2, one), (2, one), (3, [5.0, 5.0]), (None, one), (4, None), (5, [1.0]), (6, [float("nan"), 1.0]), (7, [None, 1.0]), (8, [])]
    df = spark.createDataFrame(rows, "vec_id bigint, embedding array<float>").withColumn("block", F.lit(1)).withColumn("id", F.lit("x"))
    got = {(r.vec_id, r.rank): (r.neighbor_id, round(r.distance, 3)) for r in ann.nearest(df).collect()}
    assert got == {(1, 1): (2, 0.0), (1, 2): (3, 5.0), (2, 1): (1, 0.0), (2, 2): (3, 5.0), (3, 1): (1, 5.0), (3, 2): (2, 5.0)}
    assert ann.nearest(df.limit(0)).count() == 0
    assert ann.nearest(df.where("vec_id = 3")).count() == 0


# URL filters -------------------------------------------------------------------


def test_cascade_is_exact_over_the_universe():
    rng = np.random.default_rng(4)
    keys = [rng.integers(0, 1 << 63, 20000, dtype=np.uint64) for _ in range(2)]
    for n in (0, 1, 500, 10000, 20000):
        levels = url_filter.cascade((keys[0][:n], keys[1][:n]), (keys[0][n:], keys[1][n:]))
        assert np.array_equal(url_filter.member(levels, *keys), np.arange(20000) < n)


@pytest.mark.parametrize("room", [1 << 30, 0])
def test_urls_equal_a_semi_join(spark, room):
    rng = random.Random(5)
    urls = [f"k{rng.randrange(3000)}" for _ in range(4000)] + [None, "", None]
    df = spark.createDataFrame([(i, u) for i, u in enumerate(urls)], "id bigint, u string").withColumn("shard", F.lit("s")).withColumn("h1", F.lit(1.5)).withColumn("listed", F.lit("old"))
    listed = {u for u in urls if u and u.endswith("7")} | {""}
    levels, shards = url_filter.build_filter(df.select("u"), spark.createDataFrame([(x,) for x in [*listed, None, "outside"]], "k string"), shard_keys=500)
    assert shards > 1
    got = url_filter.filter_urls(df, "u", levels, shards, broadcast_bytes=room)
    assert {(r.id, r.listed) for r in got.collect()} == {(i, u in listed) for i, u in enumerate(urls)}
    assert {r.h1 for r in got.collect()} == {1.5}


def test_url_edge_cases(spark):
    none = spark.createDataFrame([], "u string")
    levels, shards = url_filter.build_filter(none, none)
    assert url_filter.filter_urls(none, "u", levels, shards).count() == 0
    rows = spark.createDataFrame([("HTTPS://WWW.Ab.c/x/?q=1#f",), ("ab.c/x",), (None,)], "u string")
    assert [r[0] for r in rows.select(url_filter.url_key("u")).collect()] == ["ab.c/x", "ab.c/x", None]


# mixing ------------------------------------------------------------------------


def corpus(spark, n=300):
    rng = random.Random(6)
    rows = []
    for i in range(n):
        text = " ".join(rng.choice(["alpha", "beta", "gammas", "délta", "x"]) for _ in range(rng.choice([3, 40, 300])))
        rows.append((i, text, "en", rng.choice(["a", "a", "a", "b", "c"]), len(text)))
    return spark.createDataFrame(rows, DOCS)


def test_blocks_make_up_each_source(spark):
    df = corpus(spark)
    tok = tokens.tokenizer()
    out = mixing.mix(df, {"a": 1.0, "b": 2.0}, block=128, slots=900, shard_slots=100, bucket_docs=50).collect()
    assert len(out) == 900 and {(r.shard, r.slot) for r in out} == {(s, i) for s in range(9) for i in range(100)}
    assert {r.source for r in out} == {"a", "b"}
    assert abs(sum(r.source == "b" for r in out) / 900 - 2 / 3) < 0.06
    for source in "ab":
        blocks = {r.block: r for r in out if r.source == source}
        own = [r for r in df.where(F.col("source") == source).collect()]
        total = sum(tok.count(r.text) for r in own)
        # a source that starts again has given all its blocks
        n = -(-total // 128)
        if max(r.turn for r in out if r.source == source) > 0:
            assert set(blocks) == set(range(n))
            text = {}
            for b in sorted(blocks):
                assert sum(p.n_tokens for p in blocks[b].pieces) == blocks[b].n_tokens == (128 if b < n - 1 else total - 128 * (n - 1))
                for p in blocks[b].pieces:
                    text[p.doc_id] = text.get(p.doc_id, "") + p.text
            assert text == {r.doc_id: r.text for r in own}
        turns = {}
        for r in (x for x in out if x.source == source):
            assert r.block not in turns.setdefault(r.turn, set())
            turns[r.turn].add(r.block)


def test_permutations():
    for n in (1, 2, 7, 100, 4097):
        assert sorted(mixing.permute(np.arange(n), n, 5)) == list(range(n))
    assert list(mixing.permute(np.arange(100), 100, 5)) != list(mixing.permute(np.arange(100), 100, 6))


def test_draws_equal_a_plain_version(spark):
    df, tok, wide = corpus(spark), tokens.tokenizer(), (1 << 64) - 1
    weights, slots, side, block = {"a": 1.0, "b": 2.0, "c": 0.5}, 250, 64, 128

    def mixed(h, seed):
        h = (h + 0x9E3779B97F4A7C15 * (seed + 1)) & wide
        h = ((h ^ (h >> 30)) * 0xBF58476D1CE4E5B9) & wide
        h = ((h ^ (h >> 27)) * 0x94D049BB133111EB) & wide
        return h ^ (h >> 31)

    def image(x, n, seed):
        bits = 1
        while 1 << 2 * bits < n:
            bits += 1
        low = (1 << bits) - 1
        while True:
            left, right = x >> bits, x & low
            for r in range(6):
                left, right = right, left ^ (mixed(right ^ mixed(seed, r), r) & low)
            x = left << bits | right
            if x < n:
                return x

    total = {}
    for r in df.collect():
        total[r.source] = total.get(r.source, 0) + tok.count(r.text)
    names, before, want = sorted(total), {s: 0 for s in total}, set()
    share = np.array([weights[s] for s in names])
    for shard in range(-(-slots // side)):
        size, place = min(side, slots - shard * side), 0
        for k, count in enumerate(np.random.default_rng([mixing.SEED, shard]).multinomial(size, share / share.sum()).tolist()):
            own, n = names[k], -(-total[names[k]] // block)
            for _ in range(count):
                turn, index = divmod(before[own], n)
                want.add((shard, image(place, size, shard + mixing.SEED + 1), own, image(index, n, (mixing.SEED << 32) + (turn << 16) + k), turn))
                before[own], place = before[own] + 1, place + 1
    got = mixing.mix(df, weights, block=block, slots=slots, shard_slots=side, bucket_docs=50).select("shard", "slot", "source", "block", "turn").collect()
    assert len(got) == slots and {tuple(r) for r in got} == want


def test_mixing_edge_cases(spark):
    rows = [(1, None, "en", "a", 0), (2, "", "en", "a", 0), (None, "word one", "en", None, 1), (3, "long " * 60_000, None, "a", 1), (4, "same", "en", "a", 1), (4, "same", "en", "a", 1)]
    df = spark.createDataFrame(rows, DOCS).withColumn("bucket", F.lit("z")).withColumn("block", F.lit(1)).withColumn("key", F.lit(2)).withColumn("slot", F.lit(3))
    out = mixing.mix(df, {"a": 1.0, "": 1.0}).collect()
    assert {r.source for r in out} <= {"a", ""} and out
    whole = mixing.mix(df, {"a": 1.0}, block=1 << 20, slots=1).first()
    assert [p.doc_id for p in whole.pieces] == [3, 4, 4]
    for empty in (mixing.mix(df.limit(0)), mixing.mix(df, {}), mixing.mix(df, {"none": 1.0}), mixing.mix(df, slots=0)):
        assert empty.count() == 0
    assert mixing.mixed_documents(df).columns == ["doc_id", "text", "lang", "source", "n_chars"]


# packing -----------------------------------------------------------------------


def test_placement_minimises_the_sum_of_squares():
    rng = random.Random(7)
    levels, n = packing.LevelArray(20), [0] * 21
    for _ in range(2000):
        s = rng.randrange(1, 21)

        def after(h):
            m = list(n)
            if h:
                m[h] -= 1
            if h + s < 20:
                m[h + s] += 1
            return sum(x * x for x in m[1:20])

        choice = [h for h in range(0, 20 - s + 1) if h == 0 or n[h]]
        least = min(map(after, choice))
        _, h = levels.place(s)
        assert h in choice and after(h) == least and h == max(x for x in choice if after(x) == least)
        if h:
            n[h] -= 1
        if h + s < 20:
            n[h + s] += 1
        assert list(levels.count[1:20]) == n[1:20]


def test_windows_hold_each_token_once(spark):
    df = corpus(spark)
    rows = packing.pack(df, window=128, shard_docs=100).collect()
    count = {r.doc_id: tokens.tokenizer().count(r.text) for r in df.collect()}
    for doc, n in count.items():
        own = sorted((r.token_start, r.n_tokens) for r in rows if r.doc_id == doc)
        assert own == packing.pieces_of(n, 128)
    spans = {}
    for r in rows:
        spans.setdefault(r.window, []).append((r.window_offset, r.window_offset + r.n_tokens))
    for s in spans.values():
        s.sort()
        assert s[0][0] == 0 and s[-1][1] <= 128 and all(a[1] == b[0] for a, b in zip(s, s[1:]))
    assert sum(count.values()) / (128 * len(spans)) > 0.9


def test_packing_edge_cases(spark):
    df = spark.createDataFrame([(1, None), (2, ""), (None, "a b"), (3, "word " * 60_000), (4, "x"), (4, "x")], "doc_id bigint, text string").withColumn("shard", F.lit("s")).withColumn("window", F.lit(1))
    rows = packing.pack(df).collect()
    assert {(r.doc_id, r.n_tokens, r.window) for r in rows if r.doc_id in (1, 2)} == {(1, 0, None), (2, 0, None)}
    assert len([r for r in rows if r.doc_id == 4]) == 2 and any(r.doc_id is None for r in rows)
    assert len([r for r in rows if r.doc_id == 3]) == -(-tokens.tokenizer().count("word " * 60_000) // packing.WINDOW)
    assert packing.pack(df.limit(0)).count() == 0
