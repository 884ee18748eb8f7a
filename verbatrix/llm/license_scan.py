"""License scans by patience alignment against template texts.

Words that are unique in a template and in the part of the text under
consideration are anchors; their longest increasing subsequence is aligned and
the gaps between its members are aligned in the same way. A gap without anchors
gets its longest common subsequence (Hunt and Szymanski). Coverage is the share
of the template's words that are aligned.
"""

from __future__ import annotations

import bisect
import re
from collections import Counter, defaultdict
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from verbatrix.llm import common

MIN_COVERAGE = 0.8
RESULT = "doc_id bigint, license string, template string, coverage double, aligned int, start_char int, end_char int"
WORD = re.compile(r"[^\W_]+(?:[.'-][^\W_]+)*")
COMMON = frozenset("a an and any are as at be by can do each for from has have if in is it its may must no not of on one or other shall so such that the their then there this to under was which who will with without you your all".split())

#: (template, licence, text): short notices and the standard notices of common licences.
TEMPLATES: tuple[tuple[str, str, str], ...] = (
    ("apache-line", "Apache-2.0", "Licensed under the Apache License, Version 2.0."),
    ("apache-notice", "Apache-2.0", 'Licensed under the Apache License, Version 2.0 (the "License"); you may not use this file except in compliance with the License. You may obtain a copy of the License at http://www.apache.org/licenses/LICENSE-2.0 Unless required by applicable law or agreed to in writing, software distributed under the License is distributed on an "AS IS" BASIS, WITHOUT WARRANTIES OR CONDITIONS OF ANY KIND, either express or implied. See the License for the specific language governing permissions and limitations under the License.'),
    ("mit-line", "MIT", "Released under the MIT License."),
    ("mit-text", "MIT", 'Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the "Software"), to deal in the Software without restriction, including without limitation the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the Software, and to permit persons to whom the Software is furnished to do so, subject to the following conditions: The above copyright notice and this permission notice shall be included in all copies or substantial portions of the Software. THE SOFTWARE IS PROVIDED "AS IS", WITHOUT WARRANTY OF ANY KIND, EXPRESS OR IMPLIED, INCLUDING BUT NOT LIMITED TO THE WARRANTIES OF MERCHANTABILITY, FITNESS FOR A PARTICULAR PURPOSE AND NONINFRINGEMENT. IN NO EVENT SHALL THE AUTHORS OR COPYRIGHT HOLDERS BE LIABLE FOR ANY CLAIM, DAMAGES OR OTHER LIABILITY, WHETHER IN AN ACTION OF CONTRACT, TORT OR OTHERWISE, ARISING FROM, OUT OF OR IN CONNECTION WITH THE SOFTWARE OR THE USE OR OTHER DEALINGS IN THE SOFTWARE.'),
    ("gpl3-line", "GPL-3.0", "This work is licensed under the GNU General Public License, version 3."),
    ("gpl3-notice", "GPL-3.0-or-later", "This program is free software: you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation, either version 3 of the License, or (at your option) any later version. This program is distributed in the hope that it will be useful, but WITHOUT ANY WARRANTY; without even the implied warranty of MERCHANTABILITY or FITNESS FOR A PARTICULAR PURPOSE. See the GNU General Public License for more details."),
    ("cc-by-nc-line", "CC-BY-NC-4.0", "Licensed under CC BY-NC 4.0."),
    ("cc-by-line", "CC-BY-4.0", "Licensed under a Creative Commons Attribution 4.0 International License."),
    ("isc-text", "ISC", "Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted, provided that the above copyright notice and this permission notice appear in all copies."),
    ("bsd-text", "BSD", "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met: Redistributions of source code must retain the above copyright notice, this list of conditions and the following disclaimer. Redistributions in binary form must reproduce the above copyright notice, this list of conditions and the following disclaimer in the documentation and/or other materials provided with the distribution."),
)


def words_of(text: str) -> list[str]:
    return WORD.findall(text.lower())


def increasing(seq: list[int]) -> list[int]:
    """Indices of a longest strictly increasing subsequence, by patience sorting."""
    tops: list[int] = []
    piles: list[int] = []
    back: list[int] = []
    for i, x in enumerate(seq):
        k = bisect.bisect_left(tops, x)
        if k == len(tops):
            tops.append(x)
            piles.append(i)
        else:
            tops[k], piles[k] = x, i
        back.append(piles[k - 1] if k else -1)
    out, i = [], piles[-1] if piles else -1
    while i >= 0:
        out.append(i)
        i = back[i]
    return out[::-1]


def common_subsequence(a: list[str], b: list[str]) -> list[tuple[int, int]]:
    """A longest common subsequence as index pairs."""
    places = defaultdict(list)
    for j in range(len(b) - 1, -1, -1):
        places[b[j]].append(j)
    pairs = [(i, j) for i, x in enumerate(a) for j in places.get(x, ())]
    return [pairs[k] for k in increasing([j for _, j in pairs])]


def align(a: list[str], b: list[str]) -> list[tuple[int, int]]:
    """Patience alignment of two word lists as increasing index pairs."""
    out: list[tuple[int, int]] = []
    todo = [(0, len(a), 0, len(b))]
    while todo:
        a0, a1, b0, b1 = todo.pop()
        while a0 < a1 and b0 < b1 and a[a0] == b[b0]:
            out.append((a0, b0))
            a0, b0 = a0 + 1, b0 + 1
        while a0 < a1 and b0 < b1 and a[a1 - 1] == b[b1 - 1]:
            a1, b1 = a1 - 1, b1 - 1
            out.append((a1, b1))
        if a0 >= a1 or b0 >= b1:
            continue
        in_a, in_b = Counter(a[a0:a1]), Counter(b[b0:b1])
        at_b = {x: j for j, x in enumerate(b[b0:b1], b0) if in_b[x] == 1}
        both = [(i, at_b[x]) for i, x in enumerate(a[a0:a1], a0) if in_a[x] == 1 and x in at_b]
        anchors = [both[k] for k in increasing([j for _, j in both])]
        if not anchors:
            out += [(a0 + i, b0 + j) for i, j in common_subsequence(a[a0:a1], b[b0:b1])]
            continue
        out += anchors
        edges = [(a0 - 1, b0 - 1), *anchors, (a1, b1)]
        todo += [(i + 1, k, j + 1, m) for (i, j), (k, m) in zip(edges, edges[1:])]
    return sorted(out)


class Template:
    def __init__(self, name: str, license: str, text: str, least: float):
        self.name, self.license, self.words, self.least = name, license, words_of(text), least
        self.need = max(1, -int(-least * len(self.words) // 1))
        self.rare = frozenset(w for w in self.words if w not in COMMON) or frozenset(self.words)

    def regions(self, words: list[str]) -> Iterator[tuple[int, int]]:
        """Stretches of the text around the template's rare words, parted where
        none occurs for as long as the template is."""
        n, start, last = len(self.words), None, 0
        for i, w in enumerate(words):
            if w in self.rare:
                if start is None:
                    start = i
                elif i - last > n:
                    yield max(0, start - n), min(len(words), last + n + 1)
                    start = i
                last = i
        if start is not None:
            yield max(0, start - n), min(len(words), last + n + 1)

    def best(self, words: list[str]) -> tuple[int, int, int] | None:
        """(aligned words, first, last word in the text) of the best region with
        enough coverage, the first of equals."""
        found = None
        for s, e in self.regions(words):
            here = Counter(words[s:e])
            if sum(min(k, here[w]) for w, k in Counter(self.words).items()) < self.need:
                continue
            pairs = align(self.words, words[s:e])
            if len(pairs) >= self.need and (found is None or len(pairs) > found[0]):
                found = (len(pairs), s + pairs[0][1], s + pairs[-1][1])
        return found


def scan_text(text: str, templates: list[Template], rare: frozenset) -> list[tuple]:
    """(license, template, coverage, aligned, start, end) of each licence found, by its best template."""
    words = words_of(text)
    if rare.isdisjoint(words):
        return []
    best: dict[str, tuple] = {}
    places = None
    for t in templates:
        if t.rare.isdisjoint(words):
            continue
        found = t.best(words)
        if found:
            if places is None:
                places = [m.span() for m in WORD.finditer(text.lower())]
            n, first, last = found
            row = (t.license, t.name, n / len(t.words), n, places[first][0], places[last][1])
            if t.license not in best or row[2:4] > best[t.license][2:4]:
                best[t.license] = row
    return sorted(best.values())


def _scan(templates: tuple, least: float):
    def run(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        compiled = [Template(*t, least) for t in templates]
        rare = frozenset().union(*(t.rare for t in compiled))
        kinds = (pa.int64(), pa.string(), pa.string(), pa.float64(), pa.int32(), pa.int32(), pa.int32())
        names = [x.split()[0] for x in RESULT.split(", ")]
        for batch in it:
            for part in common.batches_of(iter([batch]), "text"):
                out = [(doc, *row) for doc, text in zip(part.column("doc_id").to_pylist(), part.column("text").to_pylist()) if text for row in scan_text(text, compiled, rare)]
                if out:
                    yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*out), kinds)], names)

    return run


def scan_licenses(docs: DataFrame, templates: tuple = TEMPLATES, id_col: str = "doc_id", text_col: str = "text", min_coverage: float = MIN_COVERAGE) -> DataFrame:
    """One row for each licence found in each row of ``docs``: ``doc_id, license,
    template, coverage, aligned, start_char, end_char``. Of several templates of a
    licence the one with the largest coverage counts, then the one with more aligned
    words, then the first. Offsets count characters of the lower-case text.

    Null and empty texts have none, so no rows. Null ids stay null. Rows that
    repeat are scanned each. A notice that occurs more than once is one row.
    No rows: no rows. Further columns of ``docs`` are not read.
    """
    return docs.select(F.col(id_col).cast("bigint").alias("doc_id"), F.col(text_col).alias("text")).mapInArrow(_scan(templates, min_coverage), RESULT)


def op5_license_scan(spark, sf_dir: str) -> DataFrame:
    return scan_licenses(common.documents(spark, sf_dir))
