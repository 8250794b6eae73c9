"""Suffix-array dedup with a run-length index.

A byte goes if it is covered by a string of ``length`` bytes that also starts anywhere else.  The corpus is cut for indexing, without
loss: every window of ``length`` bytes is dealt by its *anchor*, the ``k``-byte substring of least hash in it (the leftmost).  The
anchor depends on the window's bytes alone, so equal windows meet wherever they stand.  Neighbouring windows
with one anchor make a *fragment*; fragments with equal bytes are combined in the map tasks and counted.  A fragment that occurs
twice is repeated as a whole, one whose anchor occurs once is not; what is left, mostly the borders of repeated passages, is
indexed: owner tasks take ranges of anchors and build, for a block of fragments, the run-compressed Burrows-Wheeler transform with the
suffix array sampled at both ends of each run.  Between two samples, in text order, the match with the neighbouring suffix shortens by one a step, so
streaming over the samples gives every position's matching statistics, its longest match elsewhere in the block, from one
comparison a run: cheap where texts repeat.  Matches of at least ``length`` mark windows.

An anchor with more than ``HOT`` different fragments (a common passage amid other texts) would overfill its owner; its fragments are dealt anew
by longer anchors (``LADDER``), which lie in the same passage for ever fewer windows; at ``k = length`` a window is its own anchor.

Edge cases: null texts are empty; texts shorter than ``length`` lose nothing; rows that repeat doc_id and text are separate
occurrences of each other and both go; a null doc_id is a name like others; an empty table gives an empty result; other columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from murmurlake.llm.common import map_rows, written
from murmurlake.llm.shingling import mix

LENGTH = 200
#: Anchor lengths, as shares of the window; the last is the window itself.
LADDER = (0.16, 0.6, 0.9, 1.0)
HOT = 3000
BLOCK_BYTES = 2_000_000


# ---- anchors ----

_BYTE = mix(np.arange(1, 257, dtype=np.uint64) * np.uint64(0xD1B54A32D192ED03))


def _rolling(codes: np.ndarray, k: int) -> np.ndarray:
    """Hashes of all substrings of length k, by doubling."""
    done, size, out, rest = codes, 1, None, 0
    while True:
        if k & size:
            out, rest = (done, size) if out is None else (out[: len(done) - rest] * np.uint64(0x9FB21C651E98DF25) + done[rest:], rest + size)
        if size * 2 > k:
            return out
        done = done[:-size] * np.uint64(0xD6E8FEB86659FD93 + 2 * size) + done[size:]
        size *= 2


def _sliding_min(values: np.ndarray, width: int) -> np.ndarray:
    size = 1
    while size * 2 <= width:
        values = np.minimum(values[:-size], values[size:])
        size *= 2
    return np.minimum(values[: len(values) - (width - size)], values[width - size :]) if width > size else values


def anchors(units: list[bytes], k: int, length: int) -> tuple[np.ndarray, ...]:
    """unit, lo, windows, anchor hash, fragment hash (XXH3 of its bytes) for each run of windows with one anchor."""
    lengths = np.array([len(u) for u in units], dtype=np.int64)
    joined = memoryview(b"".join(units))
    data = np.frombuffer(joined, dtype=np.uint8)
    empty = np.zeros(0, dtype=np.int64)
    if not (lengths >= length).any():
        return empty, empty, empty, empty.view(np.uint64), empty.view(np.uint64)
    hashes = mix(_rolling(_BYTE[data], k))
    keyed = (hashes & np.uint64(0xFFFFFFFF00000000)) | np.arange(len(hashes), dtype=np.uint64)
    least = (_sliding_min(keyed, length - k + 1) & np.uint64(0xFFFFFFFF)).astype(np.int64)
    ends = np.cumsum(lengths)
    unit = np.repeat(np.arange(len(units)), lengths)[: len(least)]
    at = np.flatnonzero(np.arange(len(least)) + length <= ends[unit])
    own, place = unit[at], least[at]
    first = np.flatnonzero(np.append(True, (own[1:] != own[:-1]) | (place[1:] != place[:-1])))
    windows = np.diff(np.append(first, len(at)))
    start = at[first]
    stop = start + windows + length - 1
    digests = b"".join([xxhash.xxh3_128_digest(joined[a:b]) for a, b in zip(start.tolist(), stop.tolist(), strict=True)])
    whole = np.frombuffer(digests, dtype=np.uint64)[::2] + windows.astype(np.uint64)
    return own[first], start - (ends - lengths)[own[first]], windows, hashes[place[first]], whole


# ---- the run-length index ----


class RunIndex:
    """Burrows-Wheeler transform of byte strings as runs, with suffix-array samples at both ends of every run."""

    def __init__(self, strings: list[bytes]):
        self.text = np.frombuffer(b"\0".join([*strings, b""]) + b"\0" * 8, dtype=np.uint8)
        lengths = np.array([len(s) for s in strings], dtype=np.int64)
        self.starts = np.concatenate([[0], np.cumsum(lengths + 1)[:-1]]).astype(np.int64)
        self.owner = np.repeat(np.arange(len(strings)), lengths + 1)
        self.left = np.repeat(self.starts + lengths, lengths + 1) - np.arange(len(self.owner))  # bytes up to the string's end
        order = self._suffixes()
        before = np.where(np.isin(order, self.starts), -1, self.text[order - 1].astype(np.int64))
        fresh = np.append(True, (before[1:] != before[:-1]) | (before[1:] < 0))
        heads = np.flatnonzero(fresh)
        tails = np.append(heads[1:] - 1, len(order) - 1)
        self.symbols, self.sizes = before[heads], tails - heads + 1
        self.head_sample, self.tail_sample = order[heads], order[tails]
        self.above = np.where(heads > 0, order[heads - 1], -1)  # the suffix before a run's first
        self.below = np.where(tails + 1 < len(order), order[np.minimum(tails + 1, len(order) - 1)], -1)

    def _suffixes(self) -> np.ndarray:
        """Suffix array by prefix doubling; a string's end is smaller than any byte, ends are ordered by string."""
        n = len(self.owner)
        code = np.where(self.left > 0, self.text[:n].astype(np.int64) + 1, 0)
        code = np.append(code, np.zeros(8, dtype=np.int64))
        key, alive = np.zeros(n, dtype=np.int64), np.ones(n, dtype=bool)
        for j in range(7):
            c = np.where(alive, code[j : n + j], 0)
            alive &= c > 0
            key = key << 9 | c
        order = np.argsort(key, kind="stable")
        ended = ~alive[order]
        fresh = np.append(True, np.diff(key[order]) != 0) | ended
        rank = np.empty(n, dtype=np.int64)
        rank[order] = np.maximum.accumulate(np.where(fresh, np.arange(n), 0))
        alone = fresh & np.append(fresh[1:], True)
        todo, h = order[~alone], 7
        while len(todo):
            group = rank[todo]
            second = rank[todo + h]
            by = np.argsort(group * (n + 1) + second, kind="stable")
            todo, group, second = todo[by], group[by], second[by]
            head = np.append(True, np.diff(group) != 0)
            fresh = head | np.append(True, np.diff(second) != 0)
            place = np.arange(len(todo))
            inside = place - np.maximum.accumulate(np.where(head, place, 0))
            rank[todo] = group + np.maximum.accumulate(np.where(fresh, place, 0)) - (place - inside)
            alone = fresh & np.append(fresh[1:], True)
            todo, h = todo[~alone], 2 * h
        order = np.empty(n, dtype=np.int64)
        order[rank] = np.arange(n)
        return order

    def _common(self, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        """Lengths of the common prefixes of the suffixes at a and b, within their strings."""
        most = np.minimum(self.left[a], self.left[b])
        size = np.zeros(len(a), dtype=np.int64)
        eight = np.lib.stride_tricks.sliding_window_view(self.text, 8)
        todo = np.flatnonzero(most > 0)
        while len(todo):
            same = eight[a[todo] + size[todo]] == eight[b[todo] + size[todo]]
            run = np.where(same.all(axis=1), 8, same.argmin(axis=1))
            size[todo] += run
            todo = todo[(run == 8) & (size[todo] < most[todo])]
        return np.minimum(size, most)

    def matching_statistics(self) -> tuple[np.ndarray, np.ndarray]:
        """(position, length) at the samples: from a sample on, the longest match with the suffix above, or below, it
        in sorted order shortens by one a position, until the next sample tells anew."""
        at = np.concatenate([self.head_sample[self.above >= 0], self.tail_sample[self.below >= 0]])
        other = np.concatenate([self.above[self.above >= 0], self.below[self.below >= 0]])
        return at, self._common(at, other)

    def long_matches(self, length: int) -> list[list[tuple[int, int]]]:
        """For each string the [start, stop) ranges of positions that start a match of at least ``length``."""
        at, size = self.matching_statistics()
        keep = size >= length
        at, stop = at[keep], (at + size - length + 1)[keep]
        by = np.argsort(at, kind="stable")
        at, stop = at[by], stop[by]
        out: list[list[tuple[int, int]]] = [[] for _ in self.starts]
        if len(at):
            reach = np.maximum.accumulate(stop)
            first = np.flatnonzero(np.append(True, at[1:] > reach[:-1]))
            for a, b in zip(at[first].tolist(), reach[np.append(first[1:] - 1, len(at) - 1)].tolist(), strict=True):
                # A range ends where its string has less than `length` bytes left, so it lies in one string.
                i = int(self.owner[a])
                out[i].append((a - int(self.starts[i]), b - int(self.starts[i])))
        return out


# ---- distribution ----


def _units(docs: DataFrame) -> DataFrame:
    """doc_id, rid (hash of the text), lo (0), m (1), data: rows and their bytes."""
    data = F.coalesce(F.col("text").cast("string"), F.lit("")).cast("binary")
    return docs.select(
        F.col("doc_id").cast("long").alias("doc_id"), F.xxhash64(data).alias("rid"), F.lit(0).alias("lo"), F.lit(1).alias("m"), data.alias("data")
    )


_RUN = "anchor long, frag long, windows int, doc_id long, rid long, lo int, m long"


def _runs(units: DataFrame, k: int, length: int, combine: bool) -> DataFrame:
    """Fragments of the units.  ``combine``: equal ones of a task are one row, m sums their units'."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, size = [], 0
        names = ["anchor", "frag", "windows", "doc_id", "rid", "lo", "m"]
        types = [pa.int64(), pa.int64(), pa.int32(), pa.int64(), pa.int64(), pa.int32(), pa.int64()]

        def out(parts: list) -> pa.RecordBatch:
            a, f, w, lo, m, row = (np.concatenate(x) for x in list(zip(*parts, strict=True))[:6])
            ids = pa.concat_arrays([p[6] for p in parts])
            rids = pa.concat_arrays([p[7] for p in parts])
            if combine and len(a):
                order = np.lexsort((f, a))
                a, f, w, lo, m, row = a[order], f[order], w[order], lo[order], m[order], row[order]
                first = np.flatnonzero(np.append(True, (a[1:] != a[:-1]) | (f[1:] != f[:-1])))
                m = np.add.reduceat(m, first)
                a, f, w, lo, row = a[first], f[first], w[first], lo[first], row[first]
            columns = [a.view(np.int64), f.view(np.int64), w, ids.take(pa.array(row)), rids.take(pa.array(row)), lo, m]
            return pa.RecordBatch.from_arrays([c if isinstance(c, pa.Array) else pa.array(c).cast(t) for c, t in zip(columns, types, strict=True)], names=names)

        rows = 0
        for batch in batches:
            for start in range(0, batch.num_rows, 128):
                part = batch.slice(start, 128)
                unit, lo, windows, anchor, frag = anchors(part.column(4).to_pylist(), k, length)
                base, mult = (part.column(i).to_numpy(zero_copy_only=False).astype(np.int64) for i in (2, 3))
                held.append((anchor, frag, windows, lo + base[unit], mult[unit], unit + rows, part.column(0), part.column(1)))
                rows += part.num_rows
                size += len(unit)
                if size >= (400_000 if combine else 50_000):
                    yield out(held)
                    held, size, rows = [], 0, 0
        if held:
            yield out(held)

    return units.mapInArrow(run, _RUN)


def _told(runs: DataFrame) -> DataFrame:
    """Different fragments of anchors that occur more than once: with m (occurrences) and kinds (different fragments of the anchor)."""
    dealt = runs.repartition("anchor")
    frags = dealt.groupBy("anchor", "frag", "windows").agg(F.sum("m").alias("m"), *[F.first(c).alias(c) for c in ("doc_id", "rid", "lo")])
    kinds = dealt.groupBy("anchor").agg(F.count("*").alias("rows"), F.sum("m").alias("all"), F.min("frag").alias("x"), F.max("frag").alias("y"))
    held = frags.join(kinds.filter("all > 1").select("anchor", (F.col("x") != F.col("y")).alias("mixed"), F.col("rows").alias("kinds")), "anchor")
    return held


def _fragments(docs: DataFrame, told: DataFrame, length: int) -> DataFrame:
    """The bytes of fragments: doc_id, rid, lo, m, data, anchor, kinds."""
    asked = told.groupBy("doc_id", "rid").agg(F.collect_list(F.struct("anchor", "lo", "windows", "m", "kinds")).alias("asked"))
    units = _units(docs).select("doc_id", "rid", "data")
    mine = asked.select(F.col("doc_id").alias("asked_id"), F.col("rid").alias("asked_rid"), "asked")
    rows = units.join(mine, F.col("doc_id").eqNullSafe(F.col("asked_id")) & (F.col("rid") == F.col("asked_rid")))
    one = F.explode("asked").alias("q")
    return rows.select("doc_id", "rid", "data", one).select(
        "doc_id",
        "rid",
        F.col("q.lo").alias("lo"),
        F.col("q.m").alias("m"),
        F.expr(f"substring(data, q.lo + 1, q.windows + {length - 1})").alias("data"),
        F.col("q.anchor").alias("anchor"),
        F.col("q.kinds").alias("kinds"),
    )


def _indexed(fragments: DataFrame, length: int) -> DataFrame:
    """doc_id, rid, lo, windows: repeated windows of the fragments that occur once, from indexes over blocks of whole anchors."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names = ["doc_id", "rid", "lo", "windows"]
        types = [pa.int64(), pa.int64(), pa.int32(), pa.int32()]
        held: list[tuple] = []
        size = 0

        def out() -> pa.RecordBatch:
            found = RunIndex([h[4] for h in held]).long_matches(length)
            made = [(h[0], h[1], h[2] + a, b - a) for h, ranges in zip(held, found, strict=True) if h[3] == 1 for a, b in ranges]
            return pa.RecordBatch.from_arrays([pa.array([m[i] for m in made], type=t) for i, t in enumerate(types)], names=names)

        for batch in batches:
            for row in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                if held and size >= BLOCK_BYTES and held[-1][5] != row[5]:
                    yield out()
                    held, size = [], 0
                held.append(row)
                size += len(row[4])
        if held:
            yield out()

    # Rows that repeat a document bring each fragment twice; one is enough, as m tells.
    dealt = fragments.select("doc_id", "rid", "lo", "m", "data", "anchor").repartition("anchor").sortWithinPartitions("anchor")
    return dealt.mapInArrow(run, "doc_id long, rid long, lo int, windows int")


def repeated_windows(docs: DataFrame, length: int = LENGTH, hot: int = HOT) -> DataFrame:
    """doc_id, rid, lo, windows: runs of window starts whose string starts elsewhere too."""
    units, found = _units(docs), []
    ladder = sorted({min(length, max(1, int(length * share))) for share in LADDER})
    for level, k in enumerate(ladder):
        told = written(_told(_runs(units, k, length, combine=True)), "repeats-fragments")
        twice = told.filter("m > 1")
        if level == 0:
            rows = _runs(_units(docs), k, length, combine=False)
            found.append(
                written(
                    rows.join(twice.select("anchor", "frag", "windows"), ["anchor", "frag", "windows"]).select("doc_id", "rid", "lo", "windows"),
                    "repeats-whole",
                )
            )
        else:
            # Fragments of this level stand for one occurrence each unless they were whole before.
            rows = _runs(units.filter("m = 1"), k, length, combine=False)
            found.append(
                written(
                    rows.join(twice.select("anchor", "frag", "windows"), ["anchor", "frag", "windows"]).select("doc_id", "rid", "lo", "windows"),
                    "repeats-whole",
                )
            )
        mixed = told.filter("mixed")
        few = written(_fragments(docs, mixed.filter(F.col("kinds") <= hot), length), "repeats-bytes")
        found.append(written(_indexed(few, length), "repeats-indexed"))
        many = mixed.filter(F.col("kinds") > hot)
        if k == length or many.isEmpty():
            break
        units = written(_fragments(docs, many, length).select("doc_id", "rid", "lo", F.col("m").cast("int").alias("m"), "data"), "repeats-hot")
    made = found[0]
    for part in found[1:]:
        made = made.unionByName(part)
    return made


def remove_repeats(docs: DataFrame, length: int = LENGTH, hot: int = HOT) -> DataFrame:
    """Per row: doc_id, kept (binary, what remains), spans array of (start, stop) removed, n_bytes."""
    marks = repeated_windows(docs, length, hot).groupBy("doc_id", "rid").agg(F.collect_set(F.struct("lo", "windows")).alias("marks"))
    mine = marks.select(F.col("doc_id").alias("marks_id"), F.col("rid").alias("marks_rid"), "marks")
    rows = _units(docs).select("doc_id", "rid", "data")
    rows = rows.join(mine, F.col("doc_id").eqNullSafe(F.col("marks_id")) & (F.col("rid") == F.col("marks_rid")), "left")

    def make():
        def work(columns: list) -> list:
            kept, spans = [], []
            for data, marks in zip(columns[1], columns[2], strict=True):
                own: list[list[int]] = []
                for lo, stop in sorted((m["lo"], m["lo"] + m["windows"] + length - 1) for m in marks or ()):
                    if own and lo <= own[-1][1]:
                        own[-1][1] = max(own[-1][1], stop)
                    else:
                        own.append([lo, stop])
                edges = [0, *(x for span in own for x in span), len(data)]
                kept.append(b"".join(data[a:b] for a, b in zip(edges[::2], edges[1::2], strict=True)))
                spans.append([{"start": a, "stop": b} for a, b in own])
            return [columns[0], kept, spans, list(map(len, columns[1]))]

        return work

    return map_rows(rows.select("doc_id", "data", "marks"), make, "doc_id long, kept binary, spans array<struct<start:int,stop:int>>, n_bytes long")


def digests(done: DataFrame) -> DataFrame:
    """Per row of ``remove_repeats``: doc_id, n_bytes, n_removed, n_spans, kept_sha256."""
    return done.select(
        "doc_id",
        "n_bytes",
        (F.col("n_bytes") - F.length("kept")).cast("long").alias("n_removed"),
        F.size("spans").cast("long").alias("n_spans"),
        F.sha2("kept", 256).alias("kept_sha256"),
    )


