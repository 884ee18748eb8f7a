"""Language identification by sparse multinomial logistic regression.

Features are hashed character n-grams (1 to 3 characters, lower case, digits
folded, runs of other characters as one space), weighted by TF-IDF: relative
frequency in the whole text times an inverse document frequency counted over
all documents. The weights are trained with follow-the-regularised-leader
(proximal) under an L1 and an L2 penalty on a bounded sample of labelled rows;
the temperature of the softmax is fitted on a held-out part of that sample.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from verbatrix.llm import common

BITS = 18
SIZE = 1 << BITS
ORDERS = (1, 2, 3)
#: Labelled rows used for fitting and calibration at most; all statistics cover all documents.
FIT_ROWS = 4000
HELD_OUT = 0.2
EPOCHS = 2
L1, L2, RATE, BETA = 0.02, 0.02, 0.5, 1.0
#: A document whose most probable language has less than this is rejected.
MIN_PROBABILITY = 0.6
SCALE = 64.0
#: Bytes of text whose grams are made at once; they take some hundred bytes each.
TEXT = 1 << 19
#: Grams whose weights are looked up at once.
PIECE = 1 << 18
RESULT = "doc_id bigint, lang_pred string, probability double, rejected boolean"

_FOLD = np.arange(0x3000, dtype=np.uint32)
for _c in range(0x3000):
    _s = chr(_c)
    _FOLD[_c] = ord(_s.lower()) if _s.isalpha() and len(_s.lower()) == 1 else 32


def grams(texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
    """Hashed n-grams of all texts in turn, and the n+1 offsets of the texts."""
    code = np.frombuffer("".join(f" {t} " for t in texts).encode("utf-32-le", "replace"), np.uint32)
    length = np.array([len(t) + 2 for t in texts], np.int64)
    low = np.where(code < len(_FOLD), _FOLD[np.minimum(code, len(_FOLD) - 1)], code)
    text = np.repeat(np.arange(len(texts), dtype=np.int32), length)
    keep = np.ones(len(low), bool)
    keep[1:] = (low[1:] != 32) | (low[:-1] != 32) | (text[1:] != text[:-1])
    low, text = low[keep], text[keep]
    h1 = low.astype(np.uint32) * np.uint32(0x9E3779B1)
    codes, owners = [], []
    h = np.zeros(len(low), np.uint32)
    for n in ORDERS:
        if len(low) < n:
            break
        # hash of the n characters from each place, from that of n - 1
        h = (h[: len(low) - n + 1] * np.uint32(0x85EBCA6B) + h1[n - 1 :]) ^ np.uint32(n)
        mixed = h ^ (h >> np.uint32(15))
        mixed = mixed * np.uint32(0xC2B2AE35)
        inside = text[n - 1 :] == text[: len(text) - n + 1]
        if n == 1:
            inside = inside & (low != 32)
        codes.append((mixed >> np.uint32(32 - BITS))[inside])
        owners.append(text[n - 1 :][inside])
    if not codes:
        return np.zeros(0, np.uint32), np.zeros(len(texts) + 1, np.int64)
    if len(texts) == 1:
        out = np.concatenate(codes)
        return out, np.array([0, len(out)])
    # texts are interleaved by order: gather each text's grams
    counts = [np.bincount(o, minlength=len(texts)) for o in owners]
    ends = np.cumsum(np.sum(counts, axis=0))
    offsets = np.r_[0, ends]
    out, at = np.empty(offsets[-1], np.uint32), offsets[:-1].copy()
    for c, o, k in zip(codes, owners, counts):
        first = np.r_[0, np.cumsum(k)[:-1]]
        out[at[o] + np.arange(len(o)) - first[o]] = c
        at = at + k
    return out, offsets


def _document_frequency(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    df, mark, n = np.zeros(SIZE, np.int64), np.zeros(SIZE, bool), 0
    for batch in it:
        for part in common.batches_of(iter([batch]), "text", TEXT):
            g, off = grams(part.column("text").to_pylist())
            for i in range(part.num_rows):
                own = g[off[i] : off[i + 1]]
                mark[own] = True
                found = np.flatnonzero(mark) if len(own) > SIZE // 64 else np.unique(own)
                df[found] += 1
                mark[found] = False
            n += part.num_rows
    some = np.flatnonzero(df)
    yield pa.RecordBatch.from_arrays([pa.array(np.r_[some, -1]), pa.array(np.r_[df[some], n])], ["feature", "df"])


def _gram_counts(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in it:
        for part in common.batches_of(iter([batch]), "text", TEXT):
            g, off = grams(part.column("text").to_pylist())
            own = [np.unique(g[s:e], return_counts=True) for s, e in zip(off[:-1], off[1:])]
            yield pa.RecordBatch.from_arrays([part.column("lang"), part.column("key"), pa.array([f.tobytes() for f, _ in own], pa.binary()), pa.array([c.astype(np.uint32).tobytes() for _, c in own], pa.binary())], ["lang", "key", "grams", "counts"])


class Model:
    """Weights (features x languages), temperature, and the languages' names."""

    def __init__(self, langs: list[str], idf: np.ndarray, weights: np.ndarray, bias: np.ndarray, temperature: float):
        self.langs, self.temperature, self.bias = langs, temperature, bias.astype(np.float64)
        self.idf = idf
        self.table = (idf[:, None] * weights * SCALE).astype(np.float32)

    def logits(self, g: np.ndarray, off: np.ndarray) -> np.ndarray:
        n = len(off) - 1
        out = np.zeros((n, len(self.langs)))
        # in pieces, so that a long text needs no more memory than a short one
        for start in range(0, len(g), PIECE):
            end = min(start + PIECE, len(g))
            first, last = np.searchsorted(off, start, side="right") - 1, np.searchsorted(off, end, side="left")
            some = first + np.flatnonzero(np.minimum(off[first + 1 : last + 1], end) > np.maximum(off[first:last], start))
            out[some] += np.add.reduceat(self.table[g[start:end]], np.maximum(off[some], start) - start, axis=0, dtype=np.float64)
        return out / np.maximum(np.diff(off), 1)[:, None] + self.bias

    def probabilities(self, g: np.ndarray, off: np.ndarray) -> np.ndarray:
        return softmax(self.logits(g, off) / self.temperature)


def softmax(z: np.ndarray) -> np.ndarray:
    e = np.exp(z - z.max(axis=-1, keepdims=True))
    return e / e.sum(axis=-1, keepdims=True)


def train(rows: list[tuple[np.ndarray, np.ndarray]], y: np.ndarray, classes: int, idf: np.ndarray, epochs: int = EPOCHS, l1: float = L1, l2: float = L2) -> tuple[np.ndarray, np.ndarray]:
    """FTRL-proximal over the rows (grams, counts) in turn; (weights, bias)."""
    z, n, w = (np.zeros((SIZE, classes)) for _ in range(3))
    bz, bn, bias = np.zeros(classes), np.zeros(classes), np.zeros(classes)
    for _ in range(epochs):
        for i, (f, count) in enumerate(rows):
            if not len(f):
                continue
            x = count / count.sum() * idf[f] * SCALE
            zf, nf = z[f], n[f]
            wf = np.where(np.abs(zf) <= l1, 0.0, -(zf - np.sign(zf) * l1) / ((BETA + np.sqrt(nf)) / RATE + l2))
            p = softmax(x @ wf + bias)
            p[y[i]] -= 1
            grad = x[:, None] * p
            step = (np.sqrt(nf + grad**2) - np.sqrt(nf)) / RATE
            z[f], n[f] = zf + grad - step * wf, nf + grad**2
            bstep = (np.sqrt(bn + p**2) - np.sqrt(bn)) / RATE
            bz, bn = bz + p - bstep * bias, bn + p**2
            bias = -bz / ((BETA + np.sqrt(bn)) / RATE + l2)
    some = np.flatnonzero(n.any(axis=1))
    zf, nf = z[some], n[some]
    w[some] = np.where(np.abs(zf) <= l1, 0.0, -(zf - np.sign(zf) * l1) / ((BETA + np.sqrt(nf)) / RATE + l2))
    return w, bias


def calibrate(logits: np.ndarray, y: np.ndarray) -> float:
    """Temperature with the least negative log-likelihood, by golden section on
    its logarithm. The targets are smoothed by one row of each other language, so that
    a separable sample sharpens the model only as far as its number of rows supports."""
    n, k = logits.shape
    target = np.full((n, k), 1 / (n + k))
    target[np.arange(n), y] = (n + 1) / (n + k)
    target /= target.sum(1, keepdims=True)

    def loss(t: float) -> float:
        return float(-(target * np.log(np.maximum(softmax(logits / np.exp(t)), 1e-300))).sum(1).mean())

    a, b, r = np.log(0.02), np.log(20.0), (5**0.5 - 1) / 2
    for _ in range(40):
        c, d = b - r * (b - a), a + r * (b - a)
        a, b = (a, d) if loss(c) < loss(d) else (c, b)
    return float(np.exp((a + b) / 2))


def fit(docs: DataFrame, text_col: str = "text", lang_col: str = "lang", id_col: str = "doc_id", fit_rows: int = FIT_ROWS) -> Model | None:
    """Model from all documents' n-gram statistics and up to ``fit_rows``
    labelled rows, or one for each language where these are more: of each language the same
    number at most, those with the smallest hash of id and text. None if no row has both a text and a label."""
    texts = docs.where(F.col(text_col).isNotNull()).select(F.col(text_col).alias("text"))
    counts = texts.mapInArrow(_document_frequency, "feature bigint, df bigint").groupBy("feature").agg(F.sum("df").alias("df")).toPandas()
    df = np.zeros(SIZE)
    feature = counts["feature"].to_numpy(np.int64)
    total = counts["df"].to_numpy(np.float64)[feature < 0].sum()
    df[feature[feature >= 0]] = counts["df"].to_numpy(np.float64)[feature >= 0]
    idf = np.log((1 + total) / (1 + df)) + 1
    key = common.text_key(id_col, text_col)
    labelled = docs.where(F.col(lang_col).isNotNull() & (F.length(text_col) > 0)).select(F.col(lang_col).cast("string").alias("lang"), F.col(text_col).alias("text"), key.alias("key"))
    # the sample is chosen by keys alone; texts become gram counts where they lie
    names = labelled.select("lang").distinct().count()
    if not names:
        return None
    # the same number of rows for each language, so that a rare one has its class as well
    quota = max(1, fit_rows // names)
    nth = F.row_number().over(Window.partitionBy("lang").orderBy("key"))
    last = labelled.select("lang", "key").distinct().withColumn("n", nth).where(F.col("n") <= quota).groupBy("lang").agg(F.max("key").alias("last"))
    last = {r.lang: r["last"] for r in last.collect()}
    chosen = F.create_map(*[F.lit(x) for pair in last.items() for x in pair])
    sample = labelled.where(F.col("key") <= F.element_at(chosen, F.col("lang"))).mapInArrow(_gram_counts, "lang string, key bigint, grams binary, counts binary").dropDuplicates(["key", "lang"])
    # in an order that is independent of the choice by key: what is held out has all languages
    rows = sorted(sample.collect(), key=lambda r: (int(common.mix64(np.array([r.key]).view(np.uint64), 23)[0]), r.key, r.lang))
    langs = sorted({r.lang for r in rows})
    y = np.array([langs.index(r.lang) for r in rows])
    held = max(1, int(len(rows) * HELD_OUT)) if len(rows) > 4 else 0
    found = [(np.frombuffer(r.grams, np.uint32), np.frombuffer(r.counts, np.uint32)) for r in rows]
    w, bias = train(found[: len(rows) - held], y[: len(rows) - held], len(langs), idf)
    model = Model(langs, idf, w, bias, 1.0)
    if held:
        logits = np.array([(model.table[f].astype(np.float64) * c[:, None]).sum(0) / max(1, int(c.sum())) + bias for f, c in found[len(rows) - held :]])
        model.temperature = calibrate(logits, y[len(rows) - held :])
    return model


def _predict(model: Model, least: float):
    def run(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in it:
            for part in common.batches_of(iter([batch]), "text", TEXT):
                texts = [x or "" for x in part.column("text").to_pylist()]
                g, off = grams(texts)
                p = model.probabilities(g, off)
                best, some = p.argmax(1), np.diff(off) > 0
                top = p[np.arange(len(p)), best]
                lang = [model.langs[b] if s else None for b, s in zip(best, some)]
                probability = pa.array(np.where(some, top, np.nan), pa.float64(), mask=~some)
                yield pa.RecordBatch.from_arrays([*(part.column(c) for c in part.schema.names if c != "text"), pa.array(lang, pa.string()), probability, pa.array(~(some & (top >= least)))], [*(c for c in part.schema.names if c != "text"), "lang_pred", "probability", "rejected"])

    return run


def identify(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang", fit_rows: int = FIT_ROWS, min_probability: float = MIN_PROBABILITY) -> DataFrame:
    """One row for each row of ``docs``: ``doc_id, lang_pred, probability, rejected``.

    The whole text counts. A text that is null or has no letters has null
    language and probability and is rejected; so is one whose most probable
    language has less than ``min_probability``. Rows with null label are
    identified but not used for fitting; where no row is labelled, all are rejected.
    Null ids stay null. Rows that repeat get the same answer. Of equally probable languages
    the first by name counts. No rows: no rows. Further columns aren't read.
    """
    rows = docs.select(F.col(id_col).cast("bigint").alias("doc_id"), F.col(text_col).alias("text"))
    model = fit(docs, text_col, lang_col, id_col, fit_rows)
    if model is None:
        return rows.select("doc_id", F.lit(None).cast("string").alias("lang_pred"), F.lit(None).cast("double").alias("probability"), F.lit(True).alias("rejected"))
    return rows.mapInArrow(_predict(model, min_probability), RESULT)


def _accepted(model: Model, least: float, text_col: str):
    """Rows that aren't rejected, all columns."""
    def run(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in it:
            for part in common.batches_of(iter([batch]), text_col, TEXT):
                g, off = grams([x or "" for x in part.column(part.schema.get_field_index(text_col)).to_pylist()])
                ok = (np.diff(off) > 0) & (model.probabilities(g, off).max(1) >= least)
                yield part.filter(pa.array(ok))

    return run


def keep_identified(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang", fit_rows: int = FIT_ROWS, min_probability: float = MIN_PROBABILITY) -> DataFrame:
    """The rows of ``docs``, all columns, that ``identify`` doesn't reject."""
    model = fit(docs, text_col, lang_col, id_col, fit_rows)
    if model is None:
        return docs.limit(0)
    return docs.mapInArrow(_accepted(model, min_probability, text_col), docs.schema)


def op3_langid(spark, sf_dir: str) -> DataFrame:
    return identify(common.documents(spark, sf_dir))
