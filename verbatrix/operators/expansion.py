"""What ``expand`` chooses for every section of a corpus, straight from its files.

A request for each section needs no index: a section's units come from the files of one
document id. These are dealt by that id and read together in one task, which holds the passages of one id at a time.
Short units come first, so that of most passages only the length and the line are looked
at; type, identity and words are made for those that are tried. No unit is written or joined. For requests of
its own kind, with their limits, ``retrieval.expand`` reads the units of an index.
"""

from __future__ import annotations

import hashlib
from collections.abc import Callable, Iterator
from functools import lru_cache
from itertools import groupby

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from verbatrix.functions import text as T
from verbatrix.operators import markdown, retrieval

CHOSEN = "doc_id string, anchor string, position int, unit_id string, line_start int, line_end int, type string, text string, token_estimate int, nearest double, spent_tokens bigint"
#: Rows of a batch that leaves a task, about.
ROWS = 1 << 13


@lru_cache(1 << 12)
def _base(estimate: int) -> float:
    return float(retrieval._rounded(np.array([1 / max(1, estimate)]))[0])


class _Unit:
    """A passage as a unit of its section; what is costly is made when it is asked for."""

    __slots__ = ("heading", "start", "end", "step", "kind", "text", "low", "estimate", "_type", "_words")

    def __init__(self, heading: str, start: int, end: int, step: bool, kind: int, text: str, low: str):
        self.heading, self.start, self.end, self.step, self.kind, self.text, self.low = heading, start, end, step, kind, text, low
        n = len(text) if text.isascii() else len(text.encode("utf-16-le")) // 2
        self.estimate = max(1, -(-n // 4))
        self._type = self._words = None

    @property
    def type(self) -> str:
        if self._type is None:
            self._type = markdown.unit_type(self.text, self.heading, self.step) if self.kind == 1 else "command"
        return self._type

    @property
    def words(self) -> set[str]:
        if self._words is None:
            self._words = set(markdown.words_of(self.low))
        return self._words

    def unit_id(self, doc_id: str, anchor: str) -> str:
        return "unit_" + hashlib.sha256(f"{doc_id}|{anchor}|{self.start}|{self.type}|{self.text}".encode()).hexdigest()[:12]


def _units(contents: list[str]) -> dict[str, list[_Unit]]:
    """Units by anchor, of the files of one document id in their order; of equal units the first stays."""
    out: dict[str, list[_Unit]] = {}
    seen: dict[tuple, list[_Unit]] = {}
    for content in contents:
        # as units are settled in an index: by section, kind, place in its block and text
        for _, anchor, heading, start, end, step, kind, _, text in sorted(markdown._passages_of(markdown._sections_of(content)), key=lambda p: (p[0], p[6], p[7], p[8])):
            if kind == 2:
                if not markdown.is_command(text):
                    continue
                text = markdown._truncated(text, 440)
            unit = _Unit(heading, start, end, step, kind, text, text.lower())
            same = seen.setdefault((anchor, start, end, unit.low), [])
            if not same or unit.type not in [u.type for u in same]:
                same.append(unit)
                out.setdefault(anchor, []).append(unit)
    return out


def _ordered(units: list[_Unit], doc_id: str, anchor: str) -> Iterator[tuple[_Unit, str]]:
    """Units and their ids, best first; ids settle ties and are made as far as the order is read."""
    place = lambda u: (-_base(u.estimate), u.start)
    for _, tied in groupby(sorted(units, key=place), key=place):
        named = [(u.unit_id(doc_id, anchor), u) for u in tied]
        if len(named) > 1:
            named.sort(key=lambda x: (x[0], hashlib.sha256(x[1].low.encode()).digest(), x[1].end))
        for name, u in named:
            yield u, name


def _chosen(units: list[_Unit], doc_id: str, anchor: str, budget: int, max_items: int) -> list[tuple]:
    """``retrieval.select_by_budget`` for one section: the units taken with their ids and nearest similarity."""
    out, spent = [], 0
    for u, name in _ordered(units, doc_id, anchor):
        if spent + u.estimate > budget or any(x.low == u.low for x, _, _ in out):
            continue
        nearest = 0.0
        for x, _, _ in out:
            both = len(x.words & u.words)
            nearest = max(nearest, both / (len(x.words) + len(u.words) - both) if both else 0.0)
        if nearest > retrieval.MAX_SIMILARITY:
            continue
        out.append((u, name, nearest))
        spent += u.estimate
        if len(out) == max_items:
            break
    return [(doc_id, anchor, n, name, u.start, u.end, u.type, u.text, u.estimate, nearest, spent) for n, (u, name, nearest) in enumerate(out, 1)]


def _run(budget: int, max_items: int) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    kinds = pa.schema([("doc_id", pa.string()), ("anchor", pa.string()), ("position", pa.int32()), ("unit_id", pa.string()), ("line_start", pa.int32()), ("line_end", pa.int32()), ("type", pa.string()), ("text", pa.string()), ("token_estimate", pa.int32()), ("nearest", pa.float64()), ("spent_tokens", pa.int64())])

    def run(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rows = ((doc_id.as_py(), content.as_py()) for batch in it for doc_id, content in zip(batch.column(0), batch.column(1), strict=True))
        out = []
        for doc_id, own in groupby(rows, key=lambda r: r[0]):
            for anchor, units in _units([content for _, content in own]).items():
                out += _chosen(units, doc_id, anchor, budget, max_items)
            if len(out) >= ROWS:
                yield markdown._batch(out, kinds)
                out = []
        if out:
            yield markdown._batch(out, kinds)

    return run


def of_files(files: DataFrame, budget: int = retrieval.BUDGET, max_items: int = retrieval.MAX_ITEMS) -> DataFrame:
    """One row for each unit that ``expand`` chooses for a section of ``files`` (rel_path, content), for all sections, each under the same limits."""
    docs = files.where("content is not null").select(T.to_doc_id(F.col("rel_path")).alias("doc_id"), "content", T.icu(F.col("rel_path")).alias("path"))
    dealt = docs.repartition(int(files.sparkSession.conf.get("spark.sql.shuffle.partitions")), "doc_id").sortWithinPartitions("doc_id", "path")
    rows = dealt.select("doc_id", "content").mapInArrow(_run(budget, max_items), CHOSEN)
    return rows.withColumns({
        "ref": F.concat_ws("#", "doc_id", "anchor"), "text_hash": T.hash_text(F.lower("text")), "remaining_tokens": F.greatest(F.lit(0), budget - F.col("spent_tokens")),
        "base_score": T.fixed(1 / F.greatest(F.lit(1), F.col("token_estimate"))), "novelty": T.fixed(1 - F.col("nearest")), "lexical": F.lit(0.0), "heading_boost": F.lit(0.0),
        "symbol_boost": F.col("text").rlike(T.SYMBOL_ANYWHERE).cast("double"), "command_boost": F.col("type").isin("command", "step").cast("double"), "cost": retrieval.cost(),
    }).withColumn("score", retrieval._final(F.col("novelty"))).drop("nearest")
