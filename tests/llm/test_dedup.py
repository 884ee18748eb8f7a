import math
import random
import time

import numpy as np
import pytest
from pyarrow import fs as pafs
from pyspark.sql import functions as F

from verbatrix.llm import components, exact_dedup, line_dedup, simhash

DOCS = "doc_id bigint, text string, lang string, source string, n_chars bigint"


def docs(spark, *texts, ids=None):
    ids = ids or range(1, len(texts) + 1)
    return spark.createDataFrame([(i, t, "en", "web", len(t) if t is not None else None) for i, t in zip(ids, texts)], DOCS)


def clashing(df):
    """Columns with the names that operators use themselves."""
    for c in ("key", "fp", "rep", "bucket", "label", "pos", "kept", "listed", "shard"):
        df = df.withColumn(c, F.lit(1))
    return df


# exact dedup -------------------------------------------------------------------


def test_exact_edge_cases(spark):
    long = "x" * 2_000_000
    df = clashing(docs(spark, "a", "a", "", "", None, None, long, long, "b", "a", ids=[5, 3, 1, 2, 7, 8, 9, 10, None, None]))
    got = sorted(((r.doc_id, r.keep_id, r.copies, r.kept) for r in exact_dedup.exact_duplicates(df).collect()), key=str)
    want = [(5, 3, 3, False), (3, 3, 3, True), (None, 3, 3, False), (1, 1, 2, True), (2, 1, 2, False), (7, 7, 1, True), (8, 8, 1, True), (9, 9, 2, True), (10, 9, 2, False), (None, None, 1, True)]
    assert got == sorted(want, key=str)
    assert exact_dedup.exact_duplicates(docs(spark)).collect() == []


def index_in(folder, capacity, pages=4):
    return exact_dedup.ExtendibleHash(exact_dedup.Log(pafs.LocalFileSystem(), str(folder)), capacity, pages)


def test_index_splits_doubles_and_chains(tmp_path):
    index, rng = index_in(tmp_path / "pages", 4), random.Random(1)
    keys = [rng.getrandbits(64) for _ in range(3000)] + [7 | (i << 60) for i in range(16)]
    for i, k in enumerate(keys):
        index.add(k, (i, 1, (0, i, 1)))
    assert len(index.held) <= 4 and (tmp_path / "pages").exists()
    assert all([x[0] for x in index.chain(k)] == [i] for i, k in enumerate(keys))
    assert len(index.directory) == 1 << index.depth <= 64 * (len(keys) + 4)
    for number in range(len(index.at)):
        bucket = index.page(number)
        assert len(bucket.chains) <= 4 or bucket.depth == index.depth
        assert len({k & ((1 << bucket.depth) - 1) for k in bucket.chains}) <= 1
        assert np.count_nonzero(index.directory == number) == 1 << (index.depth - bucket.depth)
    index.add(keys[0], (9, 1, (0, 0, 1)))
    assert len(index.chain(keys[0])) == 2
    index.close(str(tmp_path / "directory"))
    again = exact_dedup.ExtendibleHash.opened(exact_dedup.Log(pafs.LocalFileSystem(), str(tmp_path / "pages")), str(tmp_path / "directory"))
    assert all([x[0] for x in again.chain(k)][0] == i for i, k in enumerate(keys))
    assert again.chain(12345) == []


def test_texts_are_read_back_from_files(tmp_path):
    store = exact_dedup.Texts(pafs.LocalFileSystem(), str(tmp_path / "texts"))
    at = [store.append(t) for t in (b"one", b"two" * 100, b"")]
    store.log.flush()
    more = store.append(b"three")
    assert [store.read(a) for a in (*at, more)] == [b"one", b"two" * 100, b"", b"three"]


@pytest.mark.parametrize("bits", [0, 1, 64])
def test_collisions_of_keys_are_compared_by_bytes(spark, tmp_path, bits):
    """All texts, or halves of them, share one key; the operator must tell them apart."""
    rng = random.Random(bits)
    rows = [(i, None if i % 31 == 0 else f"text {rng.randrange(60)}" if i % 3 else "hot") for i in range(900)]
    df = spark.createDataFrame(rows, "doc_id bigint, text string").repartition(5)
    key = None if bits == 64 else F.lit(0) if not bits else F.length("text") % 2
    got = {r.doc_id: (r.keep_id, r.copies, r.kept) for r in exact_dedup.exact_duplicates(df, key=key, capacity=2, owner_rows=20, keep_files=f"file://{tmp_path}/index").collect()}
    same = {}
    for i, t in rows:
        same.setdefault(t, []).append(i)
    assert got == {i: (i, 1, True) if t is None else (same[t][0], len(same[t]), i == same[t][0]) for i, t in rows}
    # what the owners left finds every text again
    found = 0
    for folder in (tmp_path / "index").iterdir():
        log = exact_dedup.Log(pafs.LocalFileSystem(), str(folder / "pages"))
        index, texts = exact_dedup.ExtendibleHash.opened(log, str(folder / "directory")), exact_dedup.Texts(pafs.LocalFileSystem(), str(folder / "texts"))
        texts.log.number = 1 << 32
        for number in range(len(index.at)):
            for chain in index.page(number).chains.values():
                read = [texts.read(at).decode() for _, _, at in chain]
                assert len(set(read)) == len(read)
                found += len(read)
    assert found == len(same) - 1


# line dedup --------------------------------------------------------------------


def brute_lines(rows, least):
    """Later places of all repeated runs with enough words."""
    seqs = sorted((i, t.split("\n")) for i, t in rows if i is not None and t is not None)
    gone = set()
    for n, (a, la) in enumerate(seqs):
        for b, lb in seqs[n:]:
            for i in range(len(la)):
                for j in range(len(lb)):
                    if (a, i) < (b, j) and la[i] == lb[j] and not (i and j and la[i - 1] == lb[j - 1]):
                        k = 0
                        while i + k < len(la) and j + k < len(lb) and la[i + k] == lb[j + k]:
                            k += 1
                        if sum(len(x.split()) for x in lb[j : j + k]) >= least:
                            gone |= {(b, j + x) for x in range(k)}
    return gone


@pytest.mark.parametrize("seed", range(4))
def test_lines_equal_brute_force(spark, seed):
    rng = random.Random(seed)
    rows = [(i, "\n".join(rng.choice(["a b", "c", "d e f", "", "g h"]) for _ in range(rng.randrange(0, 14)))) for i in range(25)]
    df = spark.createDataFrame([(i, t, "en", "s", len(t)) for i, t in rows], DOCS)
    got = {(r.doc, r.pos) for r in line_dedup.repeated_lines(df, min_words=6).collect()}
    assert got == brute_lines(rows, 6)
    kept = {r.doc_id: r.text for r in line_dedup.dedup_lines(df, min_words=6).collect()}
    for i, t in rows:
        lines = [x for p, x in enumerate(t.split("\n")) if (i, p) not in got]
        assert kept.get(i) == ("\n".join(lines) if lines else None)


def test_lines_edge_cases(spark):
    run = "\n".join(f"line {i} has some words" for i in range(12))
    df = clashing(docs(spark, run, "own\n" + run + "\nend", run, None, "", "", run, ids=[1, 2, 3, 4, 5, 6, None]))
    rows = {r.doc_id: r.text for r in line_dedup.dedup_lines(df).collect()}
    assert rows == {1: run, 2: "own\nend", 4: None, 5: "", 6: "", None: run}
    assert {r.n_chars for r in line_dedup.dedup_lines(df).where("doc_id = 2").collect()} == {7}
    assert line_dedup.dedup_lines(df).columns == df.columns
    assert line_dedup.dedup_lines(docs(spark)).count() == 0
    twice = docs(spark, run, run, ids=[1, 1])
    assert line_dedup.dedup_lines(twice).count() == 2  # rows that repeat are one document
    long = "\n".join("w" + str(i % 7) for i in range(30000))
    assert line_dedup.dedup_lines(docs(spark, long, ids=[1])).first().text.count("\n") < 200


# near duplicates ---------------------------------------------------------------


def vocabulary(rng, n):
    return [rng.choice(W) for _ in range(n)]


W = [f"w{i}" for i in range(4000)]


def test_near_copies_are_grouped_and_others_left(spark):
    rng = random.Random(2)
    rows, truth, i = [], {}, 0
    for g in range(60):
        base = vocabulary(rng, rng.choice([40, 120, 600]))
        for k in range(rng.choice([1, 1, 2, 5])):
            words = list(base)
            for _ in range(int(len(words) * 0.05) if k else 0):
                words[rng.randrange(len(words))] = rng.choice(W)
            i += 1
            rows.append((i, " ".join(words)))
            truth[i] = g
    got = {r.doc_id: r.group_id for r in simhash.near_duplicates(docs(spark, *[t for _, t in rows])).collect()}
    pairs = [(a, b) for a in truth for b in truth if a < b]
    same = [p for p in pairs if truth[p[0]] == truth[p[1]]]
    assert sum(got[a] == got[b] for a, b in same) >= 0.9 * len(same)
    assert not [p for p in pairs if truth[p[0]] != truth[p[1]] and got[p[0]] == got[p[1]]]


def test_simhash_equals_brute_force_over_distances(spark):
    rng = np.random.default_rng(4)
    base = rng.integers(0, 1 << 63, (40, 4), dtype=np.uint64)
    fp = np.repeat(base, 6, axis=0)
    flips = rng.random((240, 256)) < 0.04
    fp ^= np.packbits(flips, axis=1).view(np.uint64)
    root = simhash.bucket_edges(fp, 71)
    distance = np.bitwise_count(fp[:, None] ^ fp[None]).sum(2)
    near = distance <= 71
    assert all((root[a] == root[b]) == near[a, b] for a in range(240) for b in range(240))
    assert np.array_equal(simhash.bucket_edges(fp, 71, 64), root)
    # two blocks: their own pairs are left to others
    across = simhash.bucket_edges(fp, 71, 64, split=100)
    linked = near[:100, 100:]
    assert all(across[a] == across[100 + b] for a, b in zip(*np.nonzero(linked)))
    assert all(across[a] == a for a in range(100) if not linked[a].any())


def test_simhash_edge_cases(spark):
    df = clashing(docs(spark, "one two three", "one two three", "", "  ", None, "word", "word", "one two three", ids=[4, 2, 5, 6, 7, 9, 8, None]))
    got = {(r.doc_id, r.group_id, r.group_size, r.kept) for r in simhash.near_duplicates(df).collect()}
    assert got == {(4, 2, 2, False), (2, 2, 2, True), (5, 5, 1, True), (6, 6, 1, True), (7, 7, 1, True), (9, 8, 2, False), (8, 8, 2, True), (None, None, 1, True)}
    kept = simhash.drop_near_duplicates(df)
    assert kept.columns == df.columns and kept.count() == 6
    assert simhash.near_duplicates(docs(spark)).count() == 0
    many = docs(spark, *["same text again"] * 2000)
    assert simhash.near_duplicates(many).where("kept").count() == 1


def test_plan_meets_its_recall():
    for n in (10, 10**6, 10**9):
        sample, tables = simhash.plan(n)
        assert 1 - (1 - simhash.PLANNED_AGREEMENT**sample) ** tables >= simhash.RECALL


def test_components_equal_union_find(spark):
    rng = random.Random(6)
    edges = [(rng.randrange(300), rng.randrange(300)) for _ in range(220)] + [(1000 + i, 1001 + i) for i in range(60)]
    parent = {x: x for e in edges for x in e}

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for a, b in edges:
        a, b = find(a), find(b)
        parent[max(a, b)] = min(a, b)
    linked = {x for a, b in edges if a != b for x in (a, b)}
    got = {r.node: r.label for r in components.min_labels(spark.createDataFrame(edges, "a bigint, b bigint")).collect()}
    assert got == {x: find(x) for x in linked}


def test_oversized_buckets_are_compared_exactly():
    rng = np.random.default_rng(8)
    fp = rng.integers(0, 1 << 64, (8192, 4), dtype=np.uint64)
    for i, d in enumerate([54] * 300 + [71] * 300 + [72] * 300):
        flip = np.zeros(256, np.uint8)
        flip[rng.permutation(256)[:d]] = 1
        fp[4096 + i] = fp[i] ^ np.packbits(flip).view(np.uint64)
    root = simhash.bucket_edges(fp, 71, 512)
    assert (root[:600] == root[4096:4696]).all()
    assert len(np.unique(root)) == 8192 - 600
    one = simhash.bucket_edges(np.repeat(fp[:3], 2000, axis=0), 71, 512)
    assert np.array_equal(one, np.repeat([0, 2000, 4000], 2000))


def test_a_bucket_of_nearly_equal_fingerprints_ends_soon():
    rng = np.random.default_rng(9)
    fp = np.repeat(rng.integers(0, 1 << 64, (1, 4), dtype=np.uint64), 2000, axis=0) ^ np.packbits(rng.random((2000, 256)) < 0.02, axis=1).view(np.uint64)
    start = time.process_time()
    root = simhash.bucket_edges(fp, simhash.MAX_DISTANCE)
    assert (root == 0).all() and time.process_time() - start < 2


def test_blocks_of_big_buckets_lose_no_link(spark):
    rng, texts = random.Random(12), []
    for k in range(150):
        base = vocabulary(rng, 60)
        copy = list(base)
        for at in rng.sample(range(60), 1 + k % 4):
            copy[at] = rng.choice(W)
        texts += [" ".join(base), " ".join(copy)]
    whole, parted = ({r.doc_id: r.group_id for r in simhash.near_duplicates(docs(spark, *texts), cap=64, recall=0.5, big=b).collect()} for b in (simhash.BIG, 2))
    assert whole == parted and len(set(whole.values())) < 300


def test_recall_by_distance_up_to_the_limit(spark):
    rng, texts = random.Random(11), []
    for k in range(700):
        base = vocabulary(rng, 300)
        copy = list(base)
        for at in rng.sample(range(300), 6 + k % 36):
            copy[at] = rng.choice(W)
        texts += [" ".join(base), " ".join(copy)]
    raw = [t.encode() for t in texts]
    fp, _ = simhash.fingerprints(np.frombuffer(b"".join(raw), np.uint8), np.r_[0, np.cumsum([len(x) for x in raw])])
    distance = np.bitwise_count(fp[:, None] ^ fp[None]).sum(2, dtype=np.int64)
    a, b = np.nonzero(np.triu(distance <= simhash.MAX_DISTANCE, 1))
    # one fingerprint a bucket: 11 bits are sampled where 10 would do
    got = {r.doc_id: r.group_id for r in simhash.near_duplicates(docs(spark, *texts), cap=1).collect()}
    met = np.array([got[x + 1] == got[y + 1] for x, y in zip(a, b)])
    d = distance[a, b]
    for least, most in ((0, 44), (45, 54), (55, simhash.MAX_DISTANCE)):
        band = met[(d >= least) & (d <= most)]
        assert len(band) >= 100 and band.mean() >= 0.92, (least, most, len(band), band.mean())


@pytest.mark.parametrize("n", [10, 10**6, 10**8, 10**10])
def test_plan_covers_the_acceptance_limit(n):
    sample, tables = simhash.plan(n)
    same = math.comb(simhash.BITS - simhash.MAX_DISTANCE, sample) / math.comb(simhash.BITS, sample)
    assert 1 - (1 - same) ** tables >= simhash.RECALL


@pytest.mark.parametrize("words", range(1, 7))
def test_unrelated_short_texts_lie_apart(words):
    raw = [" ".join(f"u{words}x{i}x{k}" for k in range(words)).encode() for i in range(4000)]
    fp, _ = simhash.fingerprints(np.frombuffer(b"".join(raw), np.uint8), np.r_[0, np.cumsum([len(x) for x in raw])])
    distance = np.concatenate([np.bitwise_count(fp[i, None] ^ fp[i + 1 :]).sum(1, dtype=np.int64) for i in range(len(fp))])
    assert (distance <= simhash.MAX_DISTANCE).sum() == 0
    assert abs(distance.mean() - 128) < 1
    assert abs(np.unpackbits(fp.view(np.uint8)).mean() - 0.5) < 0.01


def test_a_text_of_ties_needs_little_memory():
    raw = b"one two " * 150_000 + b"one"
    fp, _ = simhash.fingerprints(np.frombuffer(raw, np.uint8), np.array([0, len(raw)]))
    assert abs(np.unpackbits(fp.view(np.uint8)).mean() - 0.5) < 0.15
