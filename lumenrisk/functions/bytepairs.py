"""A byte-pair tokenizer with character offsets, from ranks that are given; nothing is trained here.

One encoding of a text gives all its tokens; the tokens of any piece are found by searching the offsets, so spans cost
a logarithm each instead of an encoding of the text before them.
"""

from __future__ import annotations

import base64
import heapq
from bisect import bisect_left, bisect_right
from dataclasses import dataclass

import regex

#: Words with the space before them, numbers, marks and white space: pieces that merges don't cross.
PIECES = r"'(?:[sdmt]|ll|ve|re)| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"


@dataclass(frozen=True)
class Tokens:
    """Tokens of one text: their ids, and the characters in which each begins and ends (a token of a part of a
    character has that character)."""

    ids: list[int]
    starts: list[int]
    ends: list[int]

    def span(self, a: int, b: int) -> tuple[int, int]:
        """(first, number) of the tokens that hold a character of text[a:b]."""
        first = bisect_right(self.ends, a)
        return first, max(bisect_left(self.starts, b) - first, 0) if b > a else 0


class BytePairs:
    """``ranks``: bytes of a token to its rank, which is its id and the order of the merges; every byte must be there."""

    def __init__(self, ranks: dict[bytes, int], pattern: str = PIECES) -> None:
        if missing := [b for b in range(256) if bytes([b]) not in ranks]:
            raise ValueError(f"{len(missing)} bytes have no rank")
        self.ranks, self.pattern = ranks, regex.compile(pattern)
        self._known: dict[bytes, list[int]] = {}

    @classmethod
    def from_file(cls, path: str, pattern: str = PIECES) -> BytePairs:
        """Lines of a token in base 64 and its rank."""
        with open(path, "rb") as f:
            return cls({base64.b64decode(t): int(r) for t, r in (line.split() for line in f if line.strip())}, pattern)

    def sizes(self, piece: bytes) -> list[int]:
        """Bytes of each token: neighbours are merged, those of the lowest rank first and of equal ones the leftmost.

        A heap holds the possible merges; one whose parts have changed since is passed over. A piece of n bytes takes
        n log n steps.
        """
        if piece in self._known:
            return self._known[piece]
        n = len(piece)
        size, ahead, behind = [1] * n, list(range(1, n + 1)), list(range(-1, n - 1))
        heap: list[tuple[int, int, int]] = []

        def offer(i: int) -> None:
            j = ahead[i]
            if j < n and (rank := self.ranks.get(piece[i : j + size[j]])) is not None:
                heapq.heappush(heap, (rank, i, size[i] + size[j]))

        for i in range(n - 1):
            offer(i)
        while heap:
            _, i, whole = heapq.heappop(heap)
            j = ahead[i]
            if not size[i] or j >= n or size[i] + size[j] != whole:
                continue
            size[i], size[j] = whole, 0
            ahead[i] = ahead[j]
            if ahead[i] < n:
                behind[ahead[i]] = i
            offer(i)
            if behind[i] >= 0:
                offer(behind[i])
        out = [s for s in size if s]
        if n <= 64 and len(self._known) < 1 << 16:
            self._known[piece] = out
        return out

    def encode(self, text: str) -> Tokens:
        ids, starts, ends = [], [], []
        for m in self.pattern.finditer(text):
            raw = m[0].encode("utf-8", "surrogatepass")
            chars = None if len(raw) == len(m[0]) else [i for i, c in enumerate(m[0]) for _ in c.encode("utf-8", "surrogatepass")]
            at = 0
            for s in self.sizes(raw):
                ids.append(self.ranks[raw[at : at + s]])
                starts.append(m.start() + (at if chars is None else chars[at]))
                at += s
                ends.append(m.start() + (at if chars is None else chars[at - 1] + 1))
        return Tokens(ids, starts, ends)

    def __call__(self, text: str) -> list[int]:
        return self.encode(text).ids
