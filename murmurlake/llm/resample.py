"""Importance resampling towards a target distribution, from hashed n-grams found in word-id suffix arrays.

Tasks read their partition in blocks of whole documents.  A block's words become ids of its own dictionary, the ids' suffixes are sorted by
their first ``longest`` words, and neighbours' common prefixes (LCP) cut the sorted suffixes into runs: for each n, a run of suffixes that
share n words is one n-gram with all its occurrences.  It is hashed once, and its bucket is scattered back to where it occurs.  Buckets of
all occurrences are written by document; two sums over them, of the documents and of the target, give every bucket a gain, and a second pass
over the buckets alone scores the documents.  What tasks share is a table of ``BUCKETS`` gains, whatever the size of the corpus.  The draw
is a Gumbel top-k: scores are ranked by ranges, so no task holds them all.

Features are all runs of 1 to ``longest`` words, joined by one space, repeats counted; words are runs of digits, letters a-z after
lower-casing A-Z, and characters from U+0080 on.  A feature's bucket is the unsigned crc32 of its UTF-8 bytes modulo ``BUCKETS``.

Edge cases: null texts and texts without words have no features and weight 0; only documents of at least ``LEAST_WORDS`` words are drawn; rows that
repeat a doc_id are rows of their own; a null doc_id counts as an empty name and comes last among ties; with an empty target every gain
follows from the corpus alone; an empty table gives an empty result; other columns are ignored.
"""

from __future__ import annotations

import math
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from murmurlake.functions.stored import numbered
from murmurlake.llm.common import forget, ids_and_texts, written

LONGEST, BUCKETS, SEED = 1, 10_000, "2024"
LEAST_WORDS = 20
#: Of the documents that may be drawn, SHARE in PER are.
SHARE, PER = 10, 100
#: Text that a task indexes at once; a longer document is a block of its own.
BLOCK_BYTES = 4_000_000

_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32
_IN_WORD = np.zeros(256, dtype=bool)
_IN_WORD[48:58] = _IN_WORD[97:123] = _IN_WORD[128:] = True


def word_ids(texts: list[bytes]) -> tuple[np.ndarray, np.ndarray, list[bytes]]:
    """Word ids of all texts, how many words each text has, and the words by id."""
    data = _LOWER[np.frombuffer(b" ".join([*texts, b""]) + b" ", dtype=np.uint8)]
    inside = _IN_WORD[data]
    edge = np.flatnonzero(np.diff(inside.astype(np.int8), prepend=0, append=0))
    starts, ends = edge[::2], edge[1::2]
    offsets = np.concatenate([[0], np.cumsum(ends - starts)]).astype(np.int64)
    raw = pa.LargeBinaryArray.from_buffers(pa.large_binary(), len(starts), [None, pa.py_buffer(offsets), pa.py_buffer(data[inside].tobytes())])
    told = raw.dictionary_encode()
    bounds = np.concatenate([[0], np.cumsum([len(t) + 1 for t in texts])])
    return told.indices.to_numpy(zero_copy_only=False).astype(np.int64), np.diff(np.searchsorted(starts, bounds)), told.dictionary.to_pylist()


def suffix_array(ids: np.ndarray, left: np.ndarray, longest: int) -> tuple[np.ndarray, np.ndarray]:
    """The suffixes in the order of their first ``longest`` words (a document's end before any word), and each one's LCP with the one before,
    at most ``longest``.  ``left`` tells how many words a document has from a position on."""
    padded = np.concatenate([ids, np.full(longest, -1, dtype=np.int64)])
    words = [np.where(left > j, padded[j : j + len(ids)], -1) for j in range(longest)]
    order = np.lexsort(words[::-1]) if longest > 1 else np.argsort(words[0], kind="stable")
    lcp, same = np.zeros(len(ids), dtype=np.int64), np.ones(max(0, len(ids) - 1), dtype=bool)
    for w in words:
        sorted_words = w[order]
        same &= (sorted_words[1:] == sorted_words[:-1]) & (sorted_words[1:] >= 0)
        lcp[1:] += same
    return order, lcp


def feature_buckets(ids: np.ndarray, counts: np.ndarray, words: list[bytes], longest: int, buckets: int) -> list[np.ndarray]:
    """The buckets of all features of each document."""
    ends = np.cumsum(counts)
    left = np.repeat(ends, counts) - np.arange(len(ids))
    order, lcp = suffix_array(ids, left, longest)
    found: list[list[np.ndarray]] = [[] for _ in counts]
    for n in range(1, longest + 1):
        whole = left[order] >= n
        place, apart = order[whole], (lcp < n)[whole]  # suffixes that are too short stand apart from all others
        heads = np.flatnonzero(apart)
        hashes = np.array([zlib.crc32(b" ".join([words[i] for i in ids[p : p + n]])) % buckets for p in place[heads].tolist()] if n > 1 else [zlib.crc32(words[i]) % buckets for i in ids[place[heads]].tolist()], dtype=np.int64)
        at = np.full(len(ids), -1, dtype=np.int64)
        at[place] = np.repeat(hashes, np.diff(np.append(heads, len(place))))
        for own, a, b in zip(found, ends - counts, ends, strict=True):
            own.append(at[a : max(a, b - n + 1)])
    return [np.concatenate(own) for own in found]


def features(docs: DataFrame, longest: int = LONGEST, buckets: int = BUCKETS) -> DataFrame:
    """doc_id, n_words, n_features, buckets (binary, four bytes for each feature) of every row."""
    names = ["doc_id", "n_words", "n_features", "buckets"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def out(ids: list, texts: list[bytes]) -> pa.RecordBatch:
            words, counts, told = word_ids(texts)
            made = feature_buckets(words, counts, told, longest, buckets)
            columns = [pa.array(ids, pa.int64()), pa.array(counts, pa.int64()), pa.array(list(map(len, made)), pa.int64())]
            return pa.RecordBatch.from_arrays([*columns, pa.array([m.astype("<u4").tobytes() for m in made], pa.binary())], names=names)

        held: tuple[list, list] = ([], [])
        size = 0
        for batch in batches:
            for doc_id, text in zip(batch.column(0), batch.column(1), strict=True):
                data = text.as_buffer().to_pybytes()
                if held[0] and size + len(data) > BLOCK_BYTES:
                    yield out(*held)
                    held, size = ([], []), 0
                held[0].append(doc_id.as_py())
                held[1].append(data)
                size += len(data)
        if held[0]:
            yield out(*held)

    return ids_and_texts(docs).mapInArrow(run, "doc_id long, n_words long, n_features long, buckets binary")


def _slices(batch: pa.RecordBatch, column: int) -> Iterator[tuple[int, int, np.ndarray]]:
    """Slices [start, stop) of a batch with their buckets, one after another."""
    for start in range(0, batch.num_rows, 256):
        part = batch.column(column).slice(start, 256)
        yield start, start + len(part), np.frombuffer(b"".join(part.to_pylist()), dtype="<u4")


def bucket_counts(made: DataFrame, buckets: int = BUCKETS) -> np.ndarray:
    """How many features fall into each bucket; tasks count their own first, and the driver gets one number a bucket."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        n = np.zeros(buckets, dtype=np.int64)
        for batch in batches:
            for _, _, found in _slices(batch, 0):
                n += np.bincount(found, minlength=buckets)
        at = np.flatnonzero(n)
        yield pa.RecordBatch.from_arrays([pa.array(at), pa.array(n[at])], names=["bucket", "n"])

    told = made.select("buckets").mapInArrow(run, "bucket long, n long").groupBy("bucket").agg(F.sum("n").alias("n")).toArrow()
    out = np.zeros(buckets, dtype=np.int64)
    out[told.column("bucket").to_numpy()] = told.column("n").to_numpy()
    return out


def gains(corpus: np.ndarray, target: np.ndarray) -> np.ndarray:
    """floor(1000 ln((t + 1)(S + B) / ((s + 1)(T + B)))) for each of the B buckets, in doubles."""
    b = len(corpus)
    more, less = float(corpus.sum() + b), float(target.sum() + b)
    return np.array([math.floor(1000 * math.log(float(t + 1) * more / (float(s + 1) * less))) for s, t in zip(corpus.tolist(), target.tolist(), strict=True)], dtype=np.int64)


def weighed(made: DataFrame, gain: np.ndarray) -> DataFrame:
    """doc_id, n_words, n_features, weight: the floored mean of the features' gains."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            n = batch.column(2).to_numpy(zero_copy_only=False)
            weight = np.zeros(batch.num_rows, dtype=np.int64)
            for start, stop, found in _slices(batch, 3):
                sums = np.concatenate([[0], np.cumsum(gain[found])])
                ends = np.cumsum(n[start:stop])
                weight[start:stop] = (sums[ends] - sums[ends - n[start:stop]]) // np.maximum(1, n[start:stop])
            yield pa.RecordBatch.from_arrays([*batch.columns[:3], pa.array(weight)], names=["doc_id", "n_words", "n_features", "weight"])

    return made.mapInArrow(run, "doc_id long, n_words long, n_features long, weight long")


def resample(docs: DataFrame, target: DataFrame, longest: int = LONGEST, buckets: int = BUCKETS, seed: str = SEED, share: int = SHARE, per: int = PER) -> DataFrame:
    """Per row of ``docs``: doc_id, n_features, weight, score, rank (of the drawn; else null).  ``target`` needs a text column."""
    made = written(features(docs, longest, buckets), "resample-features")
    wanted = features(target.select(F.lit(None).cast("long").alias("doc_id"), "text"), longest, buckets)
    gain = gains(bucket_counts(made, buckets), bucket_counts(wanted, buckets))
    name = F.concat(F.lit(f"{seed}:"), F.coalesce(F.col("doc_id").cast("string"), F.lit("")))
    h = F.conv(F.substring(F.sha2(name.cast("binary"), 256), 1, 8), 16, 10).cast("long")
    noise = F.floor(-1000 * F.log(-F.log((h + 0.5) / 4294967296))).cast("long")
    scored = written(weighed(made, gain).withColumn("score", F.col("weight") + noise), "resample-scores")
    forget(made)
    able = scored.filter(F.col("n_words") >= LEAST_WORDS)
    drawn = able.count() * share // per
    order = [F.desc("score"), F.col("doc_id").asc_nulls_last(), F.col("n_features"), F.col("weight")]
    ranked = numbered(able.select("doc_id", "n_features", "weight", "score"), order, "rank")
    ranked = ranked.withColumn("rank", F.when(F.col("rank") <= drawn, F.col("rank")))
    rest = scored.filter(F.col("n_words") < LEAST_WORDS).select("doc_id", "n_features", "weight", "score", F.lit(None).cast("long").alias("rank"))
    return ranked.select("doc_id", "n_features", "weight", "score", "rank").unionByName(rest)
