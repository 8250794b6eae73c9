"""Word shingles of texts as 64-bit numbers.

Words are hashed by XXH3 over their bytes, one call for each different word of a slice, so no word of any length has a partner that is easy to
write; shingles mix the hashes of their words.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

_SEED = 0xD1B54A32D192ED03
#: Up to so many rows of a few numbers each are told to all tasks (50 MB); tables beyond it are joined by shuffle.
MAX_BROADCAST = 1_000_000
#: Odd numbers that tell orders, places and lengths apart.
TURN = [0xBF58476D1CE4E5B9, 0x94D049BB133111EB, 0xD6E8FEB86659FD93 | 1, 0xA0761D6478BD642F, 0xE7037ED1A0B428DB]

_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32
_WHITE = np.zeros(256, dtype=bool)
_WHITE[[9, 10, 11, 12, 13, 32]] = True


def mix(x: np.ndarray) -> np.ndarray:
    """A bijection of 64-bit numbers without visible order."""
    x = x ^ (x >> np.uint64(30))
    x = x * np.uint64(TURN[0])
    x = x ^ (x >> np.uint64(27))
    x = x * np.uint64(TURN[1])
    return x ^ (x >> np.uint64(31))


def word_hashes(texts: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
    """The hash of every word of all texts, and the places where each text's words begin and end."""
    data = _LOWER[np.frombuffer(b" ".join([*texts, b""]) + b" ", dtype=np.uint8)]
    white = _WHITE[data]
    edge = np.flatnonzero(np.diff(white.astype(np.int8), prepend=1, append=1))
    starts, ends = edge[::2], edge[1::2]
    offsets = np.concatenate([[0], np.cumsum(ends - starts)]).astype(np.int64)
    raw = pa.LargeBinaryArray.from_buffers(pa.large_binary(), len(starts), [None, pa.py_buffer(offsets), pa.py_buffer(data[~white].tobytes())])
    told = raw.dictionary_encode()
    digests = b"".join([xxhash.xxh3_128_digest(w) for w in told.dictionary.to_pylist()])
    own = np.frombuffer(digests, dtype=np.uint64)[::2]
    bounds = np.concatenate([[0], np.cumsum([len(t) + 1 for t in texts])])
    return own[told.indices.to_numpy(zero_copy_only=False)], np.searchsorted(starts, bounds)


def shingles(texts: list[bytes], words: int) -> list[np.ndarray]:
    """The sorted distinct shingle hashes of each text; of a text with fewer words, its whole sequence as one."""
    word, first = word_hashes(texts)
    turns = [np.uint64(t) for t in TURN]
    whole = np.zeros(max(0, len(word) - words + 1), dtype=np.uint64)
    for k in range(words):
        whole = mix(whole * turns[2] + mix(word[k : k + len(whole)] + turns[3]))
    out = []
    for a, b in zip(first[:-1], first[1:], strict=True):
        if b - a >= words:
            out.append(np.unique(whole[a : b - words + 1]))
        elif b > a:
            h = np.array([b - a], dtype=np.uint64)
            for w in word[a:b]:
                h = mix(h * turns[4] + w)
            out.append(h)
        else:
            out.append(np.zeros(0, dtype=np.uint64))
    return out


def _summed(tokens: np.ndarray, turn: int) -> np.ndarray:
    with np.errstate(over="ignore"):
        return mix(np.array([np.sum(mix(tokens ^ np.uint64(turn)), dtype=np.uint64) + np.uint64(len(tokens)) * np.uint64(TURN[3])]))


def class_of(tokens: np.ndarray) -> int:
    """A signed 64-bit name of a set."""
    return int(_summed(tokens, _SEED).view(np.int64)[0]) if len(tokens) else 0


def class_key(tokens: np.ndarray) -> bytes:
    """A name of a set of 128 bits."""
    return _summed(tokens, TURN[2]).tobytes() + _summed(mix(tokens), TURN[4]).tobytes()


def encoded(texts: list) -> list[bytes]:
    return [(t or "").encode() for t in texts]


def rows_of(docs: DataFrame) -> DataFrame:
    """doc_id, row (hash of the text), text; null texts as empty ones."""
    text = F.coalesce(F.col("text").cast("string"), F.lit(""))
    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.xxhash64(text).alias("row"), text.alias("text"))


def told_to_tasks(table: DataFrame) -> DataFrame:
    """The table, to be broadcast if it has few rows of a few numbers each; else joins shuffle."""
    return F.broadcast(table) if table.count() <= MAX_BROADCAST else table
