"""Token counts by rank-synchronous array merging.

Pre-tokens of a slice of rows lie in one flat numpy array of symbol ids with the row each belongs to.  In a
round every sequence looks up the ranks of its neighbouring pairs, takes its own least rank and merges all
non-overlapping places of that pair at once, left to right; sequences without a mergeable pair leave.  A merge
that uses a symbol comes after the one that makes it, so a round can't create a pair that should have gone
first, and the result is that of merging one pair at a time.  Counts of distinct pre-tokens are remembered by
the worker up to a bound.

Edge cases: null and empty texts have 0 tokens and 0 bytes; repeated rows are counted each; an empty table gives
an empty result; special strings in a text count as one token each, as the library has it by default.
"""

from __future__ import annotations

import json
import unicodedata

import numpy as np
import regex
from pyspark.sql import DataFrame

from murmurlake.llm.common import ids_and_texts, map_rows

REMEMBERED = 400_000
_NONE = np.int64(1 << 40)
#: Lower case by the library where Python's str.lower() differs (final sigma; two letters of a newer Unicode).
_LOWER = {0x03A3: 0x03C3, 0xA7CB: 0x0264, 0xA7DC: 0x019B}


def byte_symbols() -> list[str]:
    """The printable character that stands for each byte in byte-level vocabularies."""
    plain = {*range(33, 127), *range(161, 173), *range(174, 256)}
    shifted = iter(range(256, 512))
    return [chr(b) if b in plain else chr(next(shifted)) for b in range(256)]


class MergeTable:
    """Pairs of symbol ids, sorted for binary search, with their ranks and results."""

    def __init__(self, vocab: dict[str, int], merges: list, end: str):
        self.size = np.int64(max(vocab.values()) + 1)
        pairs = [m.split(" ", 1) if isinstance(m, str) else m for m in merges]
        keys = np.array([vocab[a] * int(self.size) + vocab[b] for a, b in pairs], dtype=np.int64)
        order = np.argsort(keys, kind="stable")
        self.keys, self.ranks = keys[order], order.astype(np.int64)
        self.made = np.array([vocab[a + b] for a, b in pairs], dtype=np.int64)
        symbols = byte_symbols()
        self.inner = np.array([vocab[c] for c in symbols], dtype=np.int64)
        self.last = np.array([vocab[c + end] for c in symbols], dtype=np.int64)

    def pair_ranks(self, left: np.ndarray, right: np.ndarray) -> np.ndarray:
        key = left * self.size + right
        at = np.minimum(np.searchsorted(self.keys, key), len(self.keys) - 1)
        return np.where(self.keys[at] == key, self.ranks[at], _NONE)

    def count(self, pieces: list[bytes]) -> np.ndarray:
        """Symbols left of each non-empty byte sequence after all merges."""
        lengths = np.array([len(p) for p in pieces], dtype=np.int64)
        result = lengths.copy()
        if not len(pieces):
            return result
        ids = self.inner[np.frombuffer(b"".join(pieces), dtype=np.uint8)]
        ends = np.cumsum(lengths)
        ids[ends - 1] = self.last[np.frombuffer(b"".join(p[-1:] for p in pieces), dtype=np.uint8)]
        owner = np.repeat(np.arange(len(pieces)), lengths)
        while len(ids) > 1:
            ranks = self.pair_ranks(ids[:-1], ids[1:])
            ranks[owner[:-1] != owner[1:]] = _NONE
            ranks = np.append(ranks, _NONE)
            starts = np.flatnonzero(np.append(True, owner[1:] != owner[:-1]))
            least = np.minimum.reduceat(ranks, starts)
            per_symbol = np.repeat(least, np.diff(np.append(starts, len(ids))))
            hit = (ranks == per_symbol) & (ranks < _NONE)
            if not hit.any():
                break
            # Of places that overlap (a run of one symbol), each second one goes.
            at = np.flatnonzero(hit)
            fresh = np.append(True, (np.diff(at) > 1) | (owner[at[1:]] != owner[at[:-1]]))
            run_start = at[np.maximum.accumulate(np.where(fresh, np.arange(len(at)), 0))]
            at = at[(at - run_start) % 2 == 0]
            ids[at] = self.made[ranks[at]]
            keep = np.ones(len(ids), dtype=bool)
            keep[at + 1] = False
            np.subtract.at(result, owner[at], 1)
            keep &= np.repeat(least < _NONE, np.diff(np.append(starts, len(ids))))  # finished ones leave
            ids, owner = ids[keep], owner[keep]
        return result


class WordBpe:
    """Counts as the library does for a vocabulary with lower-casing, white-space removal and word ends."""

    def __init__(self, path: str):
        with open(path, encoding="utf-8") as f:
            whole = json.load(f)
        model = whole["model"]
        self.table = MergeTable(model["vocab"], model["merges"], model["end_of_word_suffix"])
        parts = whole["pre_tokenizer"]["pretokenizers"]
        self.find = regex.compile(parts[0]["pattern"]["Regex"]).findall
        special = [t["content"] for t in whole["added_tokens"]]
        self.special = regex.compile("|".join(map(regex.escape, special)))
        self.known: dict[str, int] = {}

    @staticmethod
    def normal(text: str) -> str:
        if not text.isascii():
            # The library lower-cases each character by itself: no final sigma.
            text = unicodedata.normalize("NFC", text).translate(_LOWER)
        return text.lower()

    def pieces(self, text: str) -> tuple[list[str], int]:
        """Pre-tokens, and how many special strings stood between them."""
        parts = self.special.split(text) if "<|" in text else [text]
        return [p for part in parts for p in self.find(self.normal(part))], len(parts) - 1

    def count_all(self, texts: list[str]) -> list[int]:
        split = [self.pieces(t) for t in texts]
        if new := list({p for ps, _ in split for p in ps if p not in self.known}):
            self.known.update(zip(new, self.table.count([p.encode() for p in new]).tolist(), strict=True))
        got = self.known.__getitem__
        counts = [sum(map(got, ps)) + extra for ps, extra in split]
        if len(self.known) > REMEMBERED:
            self.known.clear()
        return counts


def token_counts(docs: DataFrame, tokenizer_path: str, limit: int = 2048) -> DataFrame:
    """Per row: doc_id, n_bytes (UTF-8), n_tokens, over_limit (n_tokens > limit)."""

    def make():
        words = WordBpe(tokenizer_path)

        def work(columns: list) -> list:
            texts = [t or "" for t in columns[1]]
            n = words.count_all(texts)
            return [columns[0], [len(t.encode()) for t in texts], n, [x > limit for x in n]]

        return work

    return map_rows(ids_and_texts(docs), make, "doc_id long, n_bytes long, n_tokens long, over_limit boolean")
