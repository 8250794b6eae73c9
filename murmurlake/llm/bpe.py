"""Byte-level BPE encoding and decoding by monoid tree reduction.

Encodings of byte strings form a monoid under a *join*: the encoding of ``x + y`` follows from those of ``x``
and ``y`` by encoding anew a window of tokens around the seam.  A token sequence is the encoding of its bytes
exactly if every two neighbours are, together, the encoding of their own bytes; inside ``x`` and inside ``y``
that holds already, so a window whose outer edges pass this test against the tokens beside it proves that no
token outside can change.  A window that fails is doubled.  Pieces (matches of the split pattern) that aren't tokens are halved down to
leaves of at most ``LEAF`` bytes, which are merged directly, and joined again up the tree, so a piece without any break costs O(n log n)
and no quadratic merge loop sees it.  Whether two tokens stay side by side is remembered by the pair, and so are the windows' encodings
(by the two tokens at the seam for the smallest window) and halves of up to ``HALF`` bytes.  Decoding concatenates halves up the same tree, down to ``LEAF`` tokens.

Edge cases: null and empty texts give zero tokens and the digest of the empty string; repeated rows and ties
are answered row by row; an empty table gives an empty result; other columns are ignored.
"""

from __future__ import annotations

import base64
import hashlib
from operator import itemgetter

import regex
from pyspark.sql import DataFrame

from murmurlake.llm.common import ids_and_texts, map_rows

LEAF = 4
_NONE = 1 << 60
#: Pieces remembered by a worker before it starts afresh; a bound on memory, not on results.
REMEMBERED = 200_000
#: Pairs of tokens remembered in the same way.
PAIRS = 400_000
#: Halves of at most so many bytes, which recur in many pieces, are remembered in the same way, as many as pairs.
HALF = 8


def load_ranks(path: str) -> dict[bytes, int]:
    with open(path, "rb") as lines:
        return {base64.b64decode(a): int(b) for a, b in map(bytes.split, lines)}


class TreeBpe:
    def __init__(self, ranks: dict[bytes, int], pattern: str):
        self.ranks = ranks
        self.bytes_of = {i: b for b, i in ranks.items()}
        self.split = regex.compile(pattern)
        self._seams: dict[tuple[int, int], list[int] | None] = {}
        self._halves: dict[bytes, list[int]] = {}

    def leaf(self, data: bytes) -> list[int]:
        """Merge the leftmost pair of least rank until none is left."""
        rank, parts = self.ranks.get, [data[i : i + 1] for i in range(len(data))]
        pairs = [rank(data[i : i + 2], _NONE) for i in range(len(data) - 1)]  # of each part and the next
        while pairs and (best := min(pairs)) != _NONE:
            at = pairs.index(best)
            parts[at : at + 2] = [merged := parts[at] + parts[at + 1]]
            del pairs[at]
            if at < len(pairs):
                pairs[at] = rank(merged + parts[at + 1], _NONE)
            if at:
                pairs[at - 1] = rank(parts[at - 1] + merged, _NONE)
        return [self.ranks[p] for p in parts]

    def seam(self, a: int, b: int) -> list[int] | None:
        """The encoding of the bytes of two tokens, None if they stay as they are."""
        known = self._seams.get((a, b), 0)
        if known == 0:
            if len(self._seams) > PAIRS:
                self._seams.clear()
            known = self.leaf(self.bytes_of[a] + self.bytes_of[b])
            known = self._seams[a, b] = None if known == [a, b] else known
        return known

    def fits(self, a: int, b: int) -> bool:
        """Whether tokens a, b stay as they are next to each other."""
        return self.seam(a, b) is None

    def join(self, left: list[int], right: list[int]) -> list[int]:
        """The encoding of both parts' bytes from their encodings: the window at the seam grows until its edges hold."""
        if not left or not right or (middle := self.seam(left[-1], right[0])) is None:
            return left + right
        k = 1
        while True:
            a, b = min(k, len(left)), min(k, len(right))
            if k > 1:
                middle = self.leaf(self.decode(left[len(left) - a :] + right[:b]))
            stable = (a == len(left) or self.fits(left[-a - 1], middle[0])) and (
                b == len(right) or self.fits(middle[-1], right[b])
            )
            if stable:
                return left[: len(left) - a] + middle + right[b:]
            k *= 2

    def encode_piece(self, data: bytes) -> list[int]:
        size = len(data)
        if size <= HALF and (known := self._halves.get(data)) is not None:
            return known
        if size <= LEAF:
            made = self.leaf(data)
        else:
            made = self.join(self.encode_piece(data[: size // 2]), self.encode_piece(data[size // 2 :]))
        if size <= HALF:
            if len(self._halves) > PAIRS:
                self._halves.clear()
            self._halves[data] = made
        return made

    def piece(self, data: bytes) -> list[int]:
        """A whole match of the pattern; one that is a token stays a token."""
        own = self.ranks.get(data)
        return [own] if own is not None else self.encode_piece(data)

    def encode(self, text: str) -> list[int]:
        return [i for p in self.split.findall(text) for i in self.piece(p.encode())]

    def decode(self, ids: list[int]) -> bytes:
        if len(ids) <= LEAF:
            return b"".join(map(self.bytes_of.__getitem__, ids))
        half = len(ids) // 2
        return self.decode(ids[:half]) + self.decode(ids[half:])


class _Pieces(dict):
    """Piece -> (number of tokens, decimal ids, bytes decoded from the ids)."""

    def __init__(self, bpe: TreeBpe):
        super().__init__()
        self.bpe = bpe

    def __missing__(self, piece: str) -> tuple[int, str, bytes]:
        ids = self.bpe.piece(piece.encode())
        made = len(ids), " ".join(map(str, ids)), self.bpe.decode(ids)
        if len(piece) < 64:
            self[piece] = made
        return made


def encode_digests(docs: DataFrame, ranks_path: str, pattern: str) -> DataFrame:
    """Per row: doc_id, n_tokens, ids_sha256 (decimal ids joined by a space), decoded_sha256 (decoded bytes)."""

    def make():
        bpe = TreeBpe(load_ranks(ranks_path), pattern)
        known = _Pieces(bpe)
        split, count, ids, data = bpe.split.findall, itemgetter(0), itemgetter(1), itemgetter(2)

        def work(columns: list) -> list:
            n, a, b = [], [], []
            for text in columns[1]:
                pieces = list(map(known.__getitem__, split(text or "")))
                n.append(sum(map(count, pieces)))
                a.append(hashlib.sha256(" ".join(map(ids, pieces)).encode()).hexdigest())
                b.append(hashlib.sha256(b"".join(map(data, pieces))).hexdigest())
            if len(known) > REMEMBERED:
                known.clear()
            return [columns[0], n, a, b]

        return work

    return map_rows(
        ids_and_texts(docs), make, "doc_id long, n_tokens long, ids_sha256 string, decoded_sha256 string"
    )


def encode_ids(docs: DataFrame, ranks_path: str, pattern: str) -> DataFrame:
    """The operator's own output: doc_id, ids array<int>, decoded string (equal to the text)."""

    def make():
        bpe = TreeBpe(load_ranks(ranks_path), pattern)

        def work(columns: list) -> list:
            ids = [bpe.encode(t or "") for t in columns[1]]
            return [columns[0], ids, [bpe.decode(x).decode("utf-8", "replace") for x in ids]]

        return work

    return map_rows(ids_and_texts(docs), make, "doc_id long, ids array<int>, decoded string")
