import math
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from verbatrix.llm import chat_format, langid, license_scan, tokens

DOCS = "doc_id bigint, text string, lang string"
SAMPLES = {
    "en": "the quick brown fox jumps over the lazy dog and then it sleeps for the whole day", "de": "der schnelle braune Fuchs springt über den faulen Hund und schläft dann den ganzen Tag",
    "fr": "le rapide renard brun saute par dessus le chien paresseux et puis il dort toute la journée", "es": "el rápido zorro marrón salta sobre el perro perezoso y luego duerme todo el día",
}


def corpus(spark, n=160):
    rng = random.Random(1)
    rows = []
    for i in range(n):
        lang = rng.choice(list(SAMPLES))
        words = SAMPLES[lang].split()
        rows.append((i, " ".join(rng.choice(words) for _ in range(30)), lang))
    return spark.createDataFrame(rows, DOCS)


def test_language_held_out_accuracy(spark):
    df = corpus(spark)
    hidden = df.withColumn("lang", F.when(F.col("doc_id") < 100, F.col("lang")))
    rows = langid.identify(hidden).join(df.withColumnRenamed("lang", "truth"), "doc_id").where("doc_id >= 100").collect()
    assert np.mean([r.lang_pred == r.truth for r in rows]) >= 0.95


def test_language_edge_cases(spark):
    extra = spark.createDataFrame([(900, None, "en"), (901, "", "de"), (902, "12 34 !!", "fr"), (None, SAMPLES["de"], None), (903, SAMPLES["fr"] * 5000, None), (903, SAMPLES["fr"] * 5000, None)], DOCS)
    df = corpus(spark).unionByName(extra).withColumn("key", F.lit("x")).withColumn("grams", F.lit(1))
    got = [(r.doc_id, r.lang_pred, r.rejected) for r in langid.identify(df).where("doc_id >= 900 or doc_id is null").collect()]
    assert sorted(got, key=str) == sorted([(900, None, True), (901, None, True), (902, None, True), (None, "de", False), (903, "fr", False), (903, "fr", False)], key=str)
    kept = langid.keep_identified(df)
    assert kept.columns == df.columns and kept.count() == 163
    assert langid.identify(spark.createDataFrame([], DOCS)).count() == 0 and langid.keep_identified(spark.createDataFrame([], DOCS)).count() == 0
    unlabelled = df.withColumn("lang", F.lit(None).cast("string"))
    assert langid.identify(unlabelled).where("not rejected").count() == 0


def test_temperature_lowers_the_loss():
    rng = np.random.default_rng(0)
    y = rng.integers(0, 3, 400)
    logits = rng.normal(0, 1, (400, 3)) + np.eye(3)[y]
    t = langid.calibrate(logits * 5, y)
    loss = lambda s: -np.log(langid.softmax(logits * 5 / s)[np.arange(400), y]).mean()
    assert t > 1 and loss(t) <= min(loss(1.0), loss(t * 1.3), loss(t / 1.3)) + 1e-9


def test_grams_are_those_of_each_text_alone():
    texts = ["Ab c", "", "xé  1", "12"]
    g, off = langid.grams(texts)
    for i, t in enumerate(texts):
        one, _ = langid.grams([t])
        assert sorted(g[off[i] : off[i + 1]]) == sorted(one)


# licences ----------------------------------------------------------------------


def lcs(a, b):
    best = [[0] * (len(b) + 1) for _ in range(len(a) + 1)]
    for i, x in enumerate(a):
        for j, y in enumerate(b):
            best[i + 1][j + 1] = best[i][j] + 1 if x == y else max(best[i][j + 1], best[i + 1][j])
    return best[-1][-1]


def test_patience_alignment_is_a_common_subsequence():
    rng = random.Random(3)
    for _ in range(200):
        a, b = ([rng.choice("abcdefghijklm") for _ in range(rng.randrange(0, 14))] for _ in range(2))
        pairs = license_scan.align(a, b)
        assert all(a[i] == b[j] for i, j in pairs) and all(p[0] < q[0] and p[1] < q[1] for p, q in zip(pairs, pairs[1:]))
        assert len(pairs) <= lcs(a, b)
    seq = [rng.randrange(50) for _ in range(60)]
    own = [seq[i] for i in license_scan.increasing(seq)]
    assert own == sorted(set(own))


def test_licences_are_found_with_edits(spark):
    mit = dict((t[0], t[2]) for t in license_scan.TEMPLATES)["mit-text"]
    edited = mit.replace("free of charge", "at no cost").replace("sublicense, ", "")
    rows = [(1, "intro\n" + mit + "\nend"), (2, "x " * 50_000 + edited), (3, "Released under the MIT License."), (4, "the license of the software is free"), (5, ""), (6, None), (None, "Licensed under CC BY-NC 4.0."), (3, "Released under the MIT License.")]
    df = spark.createDataFrame(rows, "doc_id bigint, text string").withColumn("license", F.lit("q")).withColumn("coverage", F.lit(0))
    got = sorted(((r.doc_id, r.license, r.template) for r in license_scan.scan_licenses(df).collect()), key=str)
    assert got == sorted([(1, "MIT", "mit-text"), (2, "MIT", "mit-text"), (3, "MIT", "mit-line"), (3, "MIT", "mit-line"), (None, "CC-BY-NC-4.0", "cc-by-nc-line")], key=str)
    assert license_scan.scan_licenses(df.limit(0)).count() == 0


# chats and tokens --------------------------------------------------------------


def test_masks_equal_brute_force(spark):
    rng = random.Random(5)
    rows = [(c, t, rng.choice(["user", "assistant", "system"]), rng.choice(["héllo  wörld 😀", "a\nb", "", "<|im_end|>", "plain text here"])) for c in range(20) for t in range(rng.randrange(1, 6))]
    df = spark.createDataFrame(rows, "conv_id bigint, turn bigint, role string, text string").withColumn("talk", F.lit(1))
    tok = tokens.tokenizer()
    for r in chat_format.format_chats(df).collect():
        talk = sorted((t, role, text) for c, t, role, text in rows if c == r.conv_id)
        data, spans = chat_format.render([(a, b) for _, a, b in talk])
        assert tok.encoding.decode_bytes(r.token_ids) == data
        at, want = 0, []
        for i in r.token_ids:
            end = at + int(tok.size[i])
            want.append(int(any(at < e and end > s for s, e in spans)))
            at = end
        assert r.mask == want and r.n_trained == sum(want) and r.n_tokens == len(want)


def test_chat_edge_cases(spark):
    schema = "conv_id bigint, turn bigint, role string, text string"
    df = spark.createDataFrame([(1, None, None, None), (1, 2, "assistant", "x" * 300_000), (1, 2, "assistant", "x" * 300_000), (None, 1, "user", "gone"), (2, 1, "user", "no answer")], schema)
    got = {r.conv_id: (r.n_turns, r.n_trained) for r in chat_format.format_chats(df).collect()}
    assert set(got) == {1, 2} and got[1][0] == 2 and got[1][1] > 0 and got[2] == (1, 0)
    assert chat_format.format_chats(spark.createDataFrame([], schema)).count() == 0


@pytest.mark.parametrize("text", ["", "a", "two  spaces here", "héllo wörld " * 500, "one " * 3000 + "😀 end", " lead", "trail ", "a\nb c\n\n d"])
def test_counts_and_cuts_are_exact(text):
    tok = tokens.tokenizer()
    n, chars, passed = tok.anchored(text)
    assert n == tok.count(text) == len(tok.encode(text))
    at = sorted({max(1, n // 3), max(1, n - 1)}) if n > 2 else []
    parts = tok.cut(text, at)
    assert "".join(parts) == text and parts == tok.cut_anchored(text, at, chars, passed)
    for c, p in zip(chars, passed):
        assert len(tok.encode(text[c:])) == n - p


def test_training_equals_a_plain_version():
    rng = np.random.default_rng(8)
    rows = []
    for _ in range(40):
        f = np.unique(rng.integers(0, 30, 6)).astype(np.uint32)
        rows.append((f, rng.integers(1, 4, len(f)).astype(np.uint32)))
    y, idf = rng.integers(0, 3, 40), np.ones(langid.SIZE) + rng.random(langid.SIZE)
    w, bias = langid.train(rows, y, 3, idf, epochs=2)
    z, n, bz, bn = {}, {}, [0.0] * 3, [0.0] * 3

    def weight(f, k):
        v = z.get((f, k), 0.0)
        if abs(v) <= langid.L1:
            return 0.0
        return -(v - math.copysign(langid.L1, v)) / ((langid.BETA + math.sqrt(n[f, k])) / langid.RATE + langid.L2)

    def offset(k):
        return -bz[k] / ((langid.BETA + math.sqrt(bn[k])) / langid.RATE + langid.L2)

    for _ in range(2):
        for (f, c), label in zip(rows, y):
            x = {int(a): int(b) / int(c.sum()) * idf[a] * langid.SCALE for a, b in zip(f, c)}
            scores = [sum(x[a] * weight(a, k) for a in x) + offset(k) for k in range(3)]
            top = max(scores)
            total = sum(math.exp(s - top) for s in scores)
            for k in range(3):
                g = math.exp(scores[k] - top) / total - (k == label)
                for a in x:
                    old, had, grad = weight(a, k), n.get((a, k), 0.0), x[a] * g
                    n[a, k] = had + grad**2
                    z[a, k] = z.get((a, k), 0.0) + grad - (math.sqrt(n[a, k]) - math.sqrt(had)) / langid.RATE * old
                b, had = offset(k), bn[k]
                bn[k] += g**2
                bz[k] += g - (math.sqrt(bn[k]) - math.sqrt(had)) / langid.RATE * b
    for a in range(30):
        for k in range(3):
            assert w[a, k] == pytest.approx(weight(a, k), abs=1e-9)
    assert bias == pytest.approx([offset(k) for k in range(3)], abs=1e-9)
    assert not w[30:].any()
