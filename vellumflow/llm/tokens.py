"""Exact byte-level BPE ids by backtracking over longest matches (problem 7).

A text is split by the public pre-token pattern. Each new pre-token becomes bytes, mapped to
Latin-1 so that pyahocorasick can find every vocabulary entry in one pass; from the longest
entry at each place the encoder steps forward, and back when two neighbours could not stand
side by side after the merges. Whether two may is decided from their merge trees and memoised,
so a piece takes linear time and gives the ids of the merge loop exactly. Pre-tokens repeat, so
their ids are kept in a bounded memo.

Null and empty texts have an empty list. The vocabulary file is read on the driver (its size is
fixed by the tokenizer) and broadcast; nothing of it is stored in the repository.
"""

from __future__ import annotations

import json
from functools import lru_cache
from pathlib import Path

import pandas as pd
import regex
from pyspark.sql import Column, SparkSession
from pyspark.sql import functions as F

VOCABULARY = "/opt/tokenizers/byte_bpe_50k.json"
#: Fixed value: the public pattern that splits a text before the merges.
PATTERN = r"""'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"""
MEMO_SIZE = 200_000


def _byte_alphabet() -> dict[str, int]:
    """The printable stand-in of each byte in vocabulary files of this kind."""
    plain = [*range(33, 127), *range(161, 173), *range(174, 256)]
    other = [b for b in range(256) if b not in set(plain)]
    return {chr(b): b for b in plain} | {chr(256 + i): b for i, b in enumerate(other)}


class BacktrackingEncoder:
    def __init__(self, raw: bytes) -> None:
        import ahocorasick

        model = json.loads(raw)["model"]
        alphabet = _byte_alphabet()
        ids = {word: i for word, i in model["vocab"].items() if all(c in alphabet for c in word)}
        latin = {word: bytes(alphabet[c] for c in word).decode("latin-1") for word in ids}
        # by rank: single bytes first, then the merges in order; a rank's place decides which merge comes first
        pairs = [tuple(m.split(" ")) if isinstance(m, str) else tuple(m) for m in model["merges"]]
        singles = [w for w in ids if len(w) == 1]
        merged = [a + b for a, b in pairs]
        rank = {w: r for r, w in enumerate(dict.fromkeys([*singles, *merged]))}
        self.ids = [0] * len(rank)
        self.sizes = [0] * len(rank)
        self.parts = [(r, r) for r in range(len(rank))]
        self.whole: dict[str, int] = {}
        self.joined: dict[tuple[int, int], int] = {}
        self.automaton = ahocorasick.Automaton()
        for word, r in rank.items():
            self.ids[r], self.sizes[r] = ids[word], len(word)
            self.whole[latin[word]] = r
            self.automaton.add_word(latin[word], r)
        for (a, b), word in zip(pairs, merged, strict=True):
            r = rank[word]
            if self.parts[r] == (r, r):
                self.parts[r] = (rank[a], rank[b])
            self.joined[rank[a], rank[b]] = r
        self.automaton.make_automaton()
        self.shorter = [self._shorter(word) for word in (latin[w] for w in rank)]
        self.splitter = regex.compile(PATTERN)
        self.memo: dict[str, tuple[int, ...]] = {}
        self.may_stand = lru_cache(1 << 17)(self._may_stand)

    def _shorter(self, word: str) -> int:
        """The longest entry that is a proper prefix; -1 if there is none."""
        return next((self.whole[word[:n]] for n in range(len(word) - 1, 0, -1) if word[:n] in self.whole), -1)

    def _may_stand(self, left: int, right: int) -> bool:
        """Would the merges leave these two side by side? Walks down both merge trees at the seam."""
        before = len(self.parts)
        while True:
            if self.joined.get((left, right), before) < before:
                return False
            if left > right:
                before, left = left, self.parts[left][1]
                if left == before:
                    return True
            else:
                before, down = right + 1, self.parts[right][0]
                if down != right:
                    right = down
                    continue
                before, down = left, self.parts[left][1]
                if down == left:
                    return True
                left = down

    def piece(self, piece: str) -> tuple[int, ...]:
        text = piece.encode().decode("latin-1")
        if (known := self.whole.get(text)) is not None:
            return (self.ids[known],)
        size, sizes = len(text), self.sizes
        longest = [-1] * size
        for end, r in self.automaton.iter(text):
            start = end - sizes[r] + 1
            if longest[start] < 0 or sizes[longest[start]] < sizes[r]:
                longest[start] = r
        open_ends = bytearray(b"\x01") * (size + 1)  # cleared where no way leads on
        path: list[int] = []
        at, r = 0, longest[0]
        while at < size:
            left = path[-1] if path else -1
            while r >= 0 and not (open_ends[at + sizes[r]] and (left < 0 or self.may_stand(left, r))):
                r = self.shorter[r]
            if r >= 0:
                path.append(r)
                at += sizes[r]
                r = longest[at] if at < size else -1
            else:
                open_ends[at] = 0
                r = path.pop()
                at -= sizes[r]
        return tuple(self.ids[r] for r in path)

    def encode(self, text: str | None) -> list[int]:
        out: list[int] = []
        memo = self.memo
        for piece in self.splitter.findall(text or ""):
            found = memo.get(piece)
            if found is None:
                if len(memo) >= MEMO_SIZE:
                    memo.clear()
                found = self.piece(piece)
                if len(piece) <= 64:
                    memo[piece] = found
            out += found
        return out


_encoders: dict[int, BacktrackingEncoder] = {}


def encoder(raw: bytes) -> BacktrackingEncoder:
    """One encoder a Python worker and vocabulary."""
    key = hash(raw)
    if key not in _encoders:
        _encoders[key] = BacktrackingEncoder(raw)
    return _encoders[key]


def token_ids(spark: SparkSession, text: str | Column, vocabulary: str = VOCABULARY) -> Column:
    """array<int> of a text column."""
    shared = spark.sparkContext.broadcast(Path(vocabulary).read_bytes())

    @F.pandas_udf("array<int>")
    def ids(texts: pd.Series) -> pd.Series:
        own = encoder(shared.value)
        return pd.Series([own.encode(t) for t in texts])

    return ids(text)


def token_count(spark: SparkSession, text: str | Column, vocabulary: str = VOCABULARY) -> Column:
    """bigint, the number of ids of a text column."""
    shared = spark.sparkContext.broadcast(Path(vocabulary).read_bytes())

    @F.pandas_udf("long")
    def count(texts: pd.Series) -> pd.Series:
        own = encoder(shared.value)
        return pd.Series([len(own.encode(t)) for t in texts], dtype="int64")

    return count(text)
