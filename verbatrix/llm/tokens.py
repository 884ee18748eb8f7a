"""Token counts and cuts with a public byte-level BPE vocabulary.

Texts are cut before single spaces: the pretokeniser never joins what lies on
both sides of such a cut, so the tokens of a text are those of its parts, and
the counts of common parts are looked up. A text with two spaces in a row is
encoded as a whole. A part's count is exact in either case.
"""

from __future__ import annotations

import base64
import bisect
from functools import lru_cache

import numpy as np
import tiktoken

VOCABULARY = "/opt/tokenizers/byte_bpe_50k.tiktoken"
PATTERN = r"'(?:[sdmt]|ll|ve|re)| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"
KNOWN = 400_000
#: Tokens between two places of a text from which it can be encoded anew.
EVERY = 256


class Tokenizer:
    def __init__(self, path: str):
        with open(path, "rb") as lines:
            ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, lines)}
        self.encoding = tiktoken.Encoding("own", pat_str=PATTERN, mergeable_ranks=ranks, special_tokens={})
        self.encode = self.encoding.encode_ordinary
        self.size = np.zeros(max(ranks.values()) + 1, np.int64)
        for token, rank in ranks.items():
            self.size[rank] = len(token)
        encode = self.encode

        class Known(dict):
            def __missing__(self, part: str) -> int:
                if len(self) >= KNOWN:
                    self.clear()
                self[part] = n = len(encode(" " + part))
                return n

        self.known = Known()

    def count(self, text: str) -> int:
        if not text:
            return 0
        if "  " in text:
            return len(self.encode(text))
        first, *rest = text.split(" ")
        return len(self.encode(first)) + sum(map(self.known.__getitem__, rest))

    def anchored(self, text: str, every: int = EVERY) -> tuple[int, list[int], list[int]]:
        """Count of the tokens, and characters and tokens passed at places from which
        the rest can be encoded on its own, one for about ``every`` tokens."""
        if len(text) <= every or "  " in text:
            return self.count(text), [], []
        first, *rest = text.split(" ")
        total, char, last, chars, passed = len(self.encode(first)), len(first), 0, [], []
        known = self.known
        for part in rest:
            if total - last >= every:
                chars.append(char)
                passed.append(total)
                last = total
            total += known[part]
            char += len(part) + 1
        return total, chars, passed

    def cut_anchored(self, text: str, at: list[int], chars: list[int], passed: list[int]) -> list[str]:
        """``cut``, with the anchors of ``anchored``: only what lies between the anchors
        around a mark is encoded again."""
        if not chars:
            return self.cut(text, at)
        marks = []
        for k in at:
            i = bisect.bisect_right(passed, k) - 1
            s, e = (chars[i] if i >= 0 else 0), (chars[i + 1] if i + 1 < len(chars) else len(text))
            char, total = s, passed[i] if i >= 0 else 0
            parts = text[s:e].split(" ")
            units = [" " + p for p in parts[1:]] if i >= 0 else [parts[0], *(" " + p for p in parts[1:])]
            for unit in units:
                n = self.known[unit[1:]] if unit[:1] == " " else len(self.encode(unit))
                if total + n > k:
                    if total < k:
                        char += len(unit.encode()[: int(self.sizes(unit)[: k - total].sum())].decode("utf-8", "ignore"))
                    break
                total, char = total + n, char + len(unit)
            marks.append(char)
        return [text[s:e] for s, e in zip([0, *marks], [*marks, len(text)])]

    def sizes(self, text: str) -> np.ndarray:
        """Bytes of each token."""
        return self.size[np.array(self.encode(text), np.int64)]

    def cut(self, text: str, at: list[int]) -> list[str]:
        """``text`` in len(at) + 1 pieces: piece i ends before token at[i]. A
        character whose bytes belong to two pieces goes to the later one;
        the pieces always make up the text."""
        if not at:
            return [text]
        if "  " in text:
            ends = np.cumsum(self.sizes(text))
            data = text.encode()
            marks = [len(data[: ends[k - 1] if k else 0].decode("utf-8", "ignore")) for k in at]
        else:
            first, *rest = text.split(" ")
            counts = [len(self.encode(first)), *map(self.known.__getitem__, rest)]
            tokens = np.r_[0, np.cumsum(counts)]
            chars = np.r_[0, np.cumsum([len(first), *[len(x) + 1 for x in rest]])]
            marks = []
            for k in at:
                u = int(np.searchsorted(tokens, k, side="right")) - 1
                mark, inside = int(chars[min(u, len(counts))]), k - int(tokens[u])
                if inside > 0 and u < len(counts):
                    part = first if u == 0 else " " + rest[u - 1]
                    mark += len(part.encode()[: int(self.sizes(part)[:inside].sum())].decode("utf-8", "ignore"))
                marks.append(mark)
        return [text[s:e] for s, e in zip([0, *marks], [*marks, len(text)])]


@lru_cache(maxsize=2)
def tokenizer(path: str = VOCABULARY) -> Tokenizer:
    """One tokenizer for each process and vocabulary file. The file's place is
    the same on all executors."""
    return Tokenizer(path)
