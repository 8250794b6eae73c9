"""Benchmark decontamination by CGK embedding and bit-sampling LSH.

The CGK random walk reads a string and, at each of its steps, emits the symbol under the cursor and moves on or stays as a fixed random
bit for (step, symbol) says.  Two strings at a small edit distance soon walk in step again, so their embeddings differ in few
places.  A window of a text and a window of an item are candidates if they agree in all ``SAMPLED`` random places of one of ``REPEATS``
draws.  Windows are sized by the item: the largest of ``SIZES`` bytes that fits into it (longer windows lost recall: at 96 bytes
half of the items with 15 % edits were found, at 48 nearly all).  An item offers its windows at every word start, a
text its windows at every ``STRIDE``-th word, so long passages are met at several alignments, each with ``REPEATS`` chances.

Windows alone miss copies of items that hold only one, and many edited ones, so all places of a text are also looked up by the item's grams
(``Grams``): a text and an item are candidates where enough grams of ``gram_size`` bytes agree near one diagonal.  Below ``SIZES[0]`` bytes
the number is what a passage of the least similarity must still share (an edit takes away at most as many grams as overlap it), so
none is missed; above it is ``SHARE`` of the item's bytes, which an exact copy always has.  Every candidate is verified: the least
edit distance between the item and any substring around the place (Myers' bit-parallel algorithm) must leave a similarity of at
least 0.8.  Items too short for a window must occur from a word's start to a word's end, with as many edits as that similarity allows.

Texts and items are compared in lower case with white space folded.  Items are taken in blocks of at most ``MAX_ITEMS`` (by hash of the id),
each block one pass over all texts, so what a task holds is bounded however many items there are.

Edge cases: null, empty and white-space texts and items match nothing; repeated items or rows give one pair for each different
(doc_id, item_id), with the least distance; items without an id count as one item of null id; empty tables give an empty result; other columns are ignored (``keep_clean`` keeps them).
"""

from __future__ import annotations

from collections import defaultdict
from collections.abc import Iterator

import ahocorasick
import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from murmurlake.llm.common import chunks, ids_and_texts, map_rows, written

SIMILARITY = 0.8
SIZES = (48, 24, 12)
STRIDE = 2
SAMPLED = 12
REPEATS = 16
MAX_ITEMS = 20_000
SEED = 20_240_917
#: Grams that agree, as a share of the item's bytes, for items of ``SIZES[0]`` bytes or more.
SHARE = 0.12
#: Items whose grams are looked up at once, bytes of text that are looked up at once, and bytes of a diagonal band.
GRAM_ITEMS, GRAM_BYTES, BAND = 400, 1 << 18, 32
#: Candidates whose pieces are compared at once.
LANES = 256
#: Windows that walk at once; so many stay in the processor's cache.
WALKS = 8192


def normal(text: str | None) -> str:
    return " ".join((text or "").lower().split())


def infix_distance(pattern: str, text: str) -> int:
    """Least edit distance between the pattern and any substring of the text."""
    m = len(pattern)
    if not m:
        return 0
    masks: dict[str, int] = defaultdict(int)
    for i, c in enumerate(pattern):
        masks[c] |= 1 << i
    full, high = (1 << m) - 1, 1 << (m - 1)
    up, down, now, best = full, 0, m, m
    get = masks.get
    for c in text:
        eq = get(c, 0)
        diagonal = (((eq & up) + up) ^ up) | eq | down
        plus, minus = down | (full & ~(diagonal | up)), up & diagonal
        if plus & high:
            now += 1
        elif minus & high:
            now -= 1
            if now < best:
                best = now
        plus, minus = (plus << 1) & full, (minus << 1) & full  # a match may start anywhere: no cost on the left
        up, down = minus | (full & ~(diagonal | plus)), plus & diagonal
    return best


def bounded_distance(pattern: str, text: str, most: int) -> int:
    """Least edit distance between the pattern and any substring of the text from a word's start to a word's end; more than ``most`` if above it."""
    size, best = len(pattern), most + 1
    before = [not c.isalnum() for c in " " + text]
    after = [not c.isalnum() for c in text + " "]
    for a in (i for i, c in enumerate(text) if before[i] and c != " "):
        row = list(range(size + 1))
        for b in range(a, min(len(text), a + size + most)):
            last, row[0] = row[0], b - a + 1
            for i, c in enumerate(pattern, 1):
                last, row[i] = row[i], min(row[i] + 1, row[i - 1] + 1, last + (c != text[b]))
            if after[b + 1]:
                best = min(best, row[-1])
            if min(row) >= best:
                break
    return best


class Pieces:
    """Items cut into pieces of at most 64 characters, whose least distances to a region sum up to no more than the item's own.

    Pieces of many candidates are compared at once, one machine word each, by the low byte of their characters: a lower bound."""

    def __init__(self, items: list[str]):
        self.edits = np.array([most_edits(len(t)) for t in items], dtype=np.int64)
        self.first, self.sizes, rows = [0], [], []
        for text in items:
            n = -(-len(text) // 64)
            for k in range(n):
                codes = _codes(text)[k * len(text) // n : (k + 1) * len(text) // n]
                row = np.zeros(257, dtype=np.uint64)
                np.bitwise_or.at(row, codes, np.uint64(1) << np.arange(len(codes), dtype=np.uint64))
                rows.append(row)
                self.sizes.append(len(codes))
            self.first.append(len(rows))
        self.masks = np.array(rows).reshape(-1, 257)

    def may_match(self, items: list[int], regions: list[str]) -> np.ndarray:
        """For each item and region, False where the region can't be similar enough."""
        out = np.zeros(len(items), dtype=bool)
        order = sorted(range(len(items)), key=lambda i: len(regions[i]))  # regions of one length waste least
        for part in chunks(order, LANES):
            lane = np.concatenate([np.arange(self.first[items[i]], self.first[items[i] + 1]) for i in part])
            own = np.repeat(np.arange(len(part)), [self.first[items[i] + 1] - self.first[items[i]] for i in part])
            codes = np.full((max(len(regions[i]) for i in part), len(part)), 256, dtype=np.int64)
            for k, i in enumerate(part):
                codes[: len(regions[i]), k] = _codes(regions[i])
            low = np.zeros(len(part), dtype=np.int64)
            np.add.at(low, own, self._distances(lane, codes, own))
            out[part] = low <= self.edits[[items[i] for i in part]]
        return out

    def _distances(self, lane: np.ndarray, codes: np.ndarray, own: np.ndarray) -> np.ndarray:
        """Myers' algorithm on all lanes; a match may start anywhere."""
        masks, one = self.masks[lane].ravel(), np.uint64(1)
        now = np.array(self.sizes, dtype=np.int64)[lane]
        high = (now - 1).astype(np.uint64)
        up, down, best = np.full(len(lane), ~np.uint64(0)), np.zeros(len(lane), dtype=np.uint64), now.copy()
        base = np.arange(len(lane)) * 257
        for column in codes:
            eq = masks.take(base + column.take(own))
            diagonal = (((eq & up) + up) ^ up) | eq | down
            plus, minus = down | ~(diagonal | up), up & diagonal
            now += (plus >> high & one).astype(np.int64) - (minus >> high & one).astype(np.int64)
            np.minimum(best, now, out=best)
            plus, minus = plus << one, minus << one
            up, down = minus | ~(diagonal | plus), plus & diagonal
        return best


def _codes(text: str) -> np.ndarray:
    return (np.frombuffer(text.encode("utf-32-le", "surrogatepass"), dtype=np.uint32) & 255).astype(np.int64)


class Embedding:
    """Walks and samples; the same for items and texts, from a fixed seed."""

    def __init__(self):
        rng = np.random.default_rng(SEED)
        self.moves = rng.integers(0, 2, size=(2 * SIZES[0], 256), dtype=np.int32)
        self.moves[:, 0] = 0
        self.places = {w: np.sort(rng.integers(0, 2 * w, size=(REPEATS, SAMPLED)), axis=1) for w in SIZES}

    def keys(self, data: np.ndarray, starts: np.ndarray, ends: np.ndarray, sizes: list[int]) -> dict[int, np.ndarray]:
        """For each window size: (REPEATS, windows) keys of the walks from ``starts``; ``data[ends]`` is 0."""
        wanted = defaultdict(list)
        for w in sizes:
            for r in range(REPEATS):
                for k, j in enumerate(self.places[w][r]):
                    wanted[int(j)].append((w, r, k))
        parts = [self._block(data, starts[i : i + WALKS], ends[i : i + WALKS], sizes, wanted) for i in range(0, max(1, len(starts)), WALKS)]
        return {w: np.concatenate([p[w] for p in parts], axis=1) for w in sizes}

    def _block(self, data: np.ndarray, starts: np.ndarray, ends: np.ndarray, sizes: list[int], wanted: dict) -> dict[int, np.ndarray]:
        symbols = {w: np.zeros((REPEATS, len(starts), -(-SAMPLED // 8) * 8), dtype=np.uint8) for w in sizes}
        at, ends = starts.astype(np.int32), ends.astype(np.int32)
        for j in range(max(wanted, default=-1) + 1):
            symbol = data.take(at)
            for w, r, k in wanted.get(j, ()):
                symbols[w][r, :, k] = symbol
            at += self.moves[j].take(symbol)
            np.minimum(at, ends, out=at)
        keys = {}
        for w, own in symbols.items():
            x = np.zeros(own.shape[:2], dtype=np.uint64)
            for word in np.moveaxis(own.view(np.uint64), 2, 0):
                x = (x ^ word) * np.uint64(0x9E3779B97F4A7C15)
                x ^= x >> np.uint64(32)
            keys[w] = x * np.uint64(0xBF58476D1CE4E5B9)
        return keys


def _word_starts(data: np.ndarray) -> np.ndarray:
    """Places after a space or end mark that don't hold one."""
    gap = (data == 32) | (data == 0)
    return np.flatnonzero(~gap & np.append(True, gap[:-1]))


def most_edits(size: int) -> int:
    """Edits that leave a text of so many characters similar enough."""
    return next(d for d in range(size, -1, -1) if size - d >= SIMILARITY * size)


def gram_size(size: int) -> int:
    """Bytes of a gram for an item of so many bytes."""
    return 7 if size >= 80 else 6 if size >= SIZES[0] else 3 if size >= SIZES[-1] else 2


def least_grams(text: str) -> int:
    """How many grams must agree for a candidate."""
    size = len(text.encode())
    if size >= SIZES[0]:
        return int(SHARE * size)
    edits, q = most_edits(len(text)), gram_size(size)
    widest = sorted((len(c.encode()) for c in text), reverse=True)[:edits]
    return max(1, size - q + 1 - (q - 1) * edits - sum(widest))


class Grams:
    """The places of all grams of some items, all of one gram size."""

    def __init__(self, items: list[tuple[int, str]], q: int):
        self.q, self.names = q, np.array([n for n, _ in items])
        self.least = np.array([least_grams(t) for _, t in items])
        texts = [t.encode() for _, t in items]
        lengths = np.array([len(t) for t in texts])
        self.longest = int(lengths.max())
        begins = np.concatenate([[0], np.cumsum(lengths + 1)[:-1]])
        made = self._hashed(b"\0".join([*texts, b""]))
        item = np.repeat(np.arange(len(texts)), lengths + 1)
        offset = np.arange(len(made)) - begins[item]
        whole = np.flatnonzero(offset + q <= lengths[item])
        order = whole[np.argsort(made[whole], kind="stable")]
        self.item, self.offset = item[order], offset[order]
        self.held = np.bincount(made[order], minlength=1 << 20).astype(np.int32)
        self.known = self.held > 0
        self.first = np.cumsum(self.held, dtype=np.int64) - self.held

    def _hashed(self, data: bytes) -> np.ndarray:
        """A number below 2**20 for the gram at each byte."""
        eight = np.ndarray(len(data), dtype="<u8", buffer=data + bytes(8), strides=(1,))
        return ((eight & np.uint64((1 << 8 * self.q) - 1)) * np.uint64(0x9E3779B97F4A7C15) >> np.uint64(44)).astype(np.int64)

    def candidates(self, texts: list[bytes]) -> set[tuple[int, int, int]]:
        """(text, item, band of the byte place where the item would start) where enough grams agree in a band and the next one."""
        lengths = np.array([len(t) for t in texts])
        begins = np.concatenate([[0], np.cumsum(lengths + 1)[:-1]])
        data, doc = b"\0".join([*texts, b""]), np.repeat(np.arange(len(texts)), lengths + 1)
        bands = (int(lengths.max(initial=0)) + self.longest) // BAND + 3
        keys, counts = [], []
        for start in range(0, len(data), GRAM_BYTES):
            made = self._hashed(data[start : start + GRAM_BYTES + self.q - 1])[:GRAM_BYTES]
            at = np.flatnonzero(self.known.take(made))
            made = made.take(at)
            n = self.held.take(made)
            k = np.arange(int(n.sum())) + np.repeat(self.first.take(made) - (np.cumsum(n) - n), n)
            at = np.repeat(at + start, n)
            own = doc.take(at)
            band = (at - begins.take(own) - self.offset.take(k) + self.longest) // BAND
            key, count = np.unique((own * len(self.names) + self.item.take(k)) * bands + band, return_counts=True)
            keys.append(key)
            counts.append(count)
        if not keys:
            return set()
        key, where = np.unique(np.concatenate(keys), return_inverse=True)
        count = np.bincount(where, weights=np.concatenate(counts))
        follows = np.append(key[1:] == key[:-1] + 1, False)
        both = count + np.where(follows, np.append(count[1:], 0), 0)
        pair, band = np.divmod(key, bands)
        own, item = np.divmod(pair, len(self.names))
        enough = both >= self.least[item]
        place = band[enough] - self.longest // BAND - 1
        return set(zip(own[enough].tolist(), self.names[item[enough]].tolist(), place.tolist(), strict=True))


def _runs(places: set[tuple[int, int, int]]) -> Iterator[tuple[int, int, int, int]]:
    """(text, item, first, last band) of bands that stand together."""
    doc = n = first = last = None
    for a, b, place in sorted(places):
        if (a, b) == (doc, n) and place <= last + 2:
            last = place
            continue
        if doc is not None:
            yield doc, n, first, last
        doc, n, first, last = a, b, place, place
    if doc is not None:
        yield doc, n, first, last


class Searcher:
    def __init__(self, items: list[tuple[int, str]]):
        self.embedding = Embedding()
        cleaned = [(i, normal(t)) for i, t in items]
        self.items = [(i, t) for i, t in cleaned if t]
        by_size: dict[int, list[int]] = defaultdict(list)
        self.short: ahocorasick.Automaton | None = None
        shorts = defaultdict(list)
        for n, (_, t) in enumerate(self.items):
            size = next((w for w in SIZES if w <= len(t.encode())), None)
            if size is None:
                shorts[t].append(n)
            else:
                by_size[size].append(n)
        if shorts:
            self.short = ahocorasick.Automaton()
            for t, own in shorts.items():
                self.short.add_word(t, (len(t), own))
            self.short.make_automaton()
        by_gram: dict[int, list[tuple[int, str]]] = defaultdict(list)
        edited = [n for t, own in shorts.items() if most_edits(len(t)) for n in own]
        for own in [*by_size.values(), edited]:
            for n in own:
                by_gram[gram_size(len(self.items[n][1].encode()))].append((n, self.items[n][1]))
        self.grams = [Grams(part, q) for q, own in by_gram.items() for part in chunks(own, GRAM_ITEMS)]
        self.pieces = Pieces([t for _, t in self.items])
        # Per size: sorted keys of all repeats with item and byte offset, and a bitmap of key prefixes.
        self.tables = {}
        for size, own in by_size.items():
            texts = [self.items[n][1].encode() for n in own]
            data = np.frombuffer(b"\0".join([*texts, b""]), dtype=np.uint8)
            lengths = np.array([len(t) for t in texts])
            begins = np.concatenate([[0], np.cumsum(lengths + 1)[:-1]])
            starts = _word_starts(data)
            which = np.searchsorted(begins, starts, side="right") - 1
            offset = starts - begins[which]
            inside = (offset + size <= lengths[which]) | (offset == 0)
            starts, which, offset = starts[inside], which[inside], offset[inside]
            keys = self.embedding.keys(data, starts, begins[which] + lengths[which], [size])[size]
            for r in range(REPEATS):
                keys[r] = (keys[r] & ~np.uint64(15)) | np.uint64(r)
            flat = keys.ravel()
            order = np.argsort(flat, kind="stable")
            bitmap = np.zeros(1 << 22, dtype=bool)
            bitmap[flat >> np.uint64(42)] = True
            self.tables[size] = (flat[order], np.tile(np.array(own)[which], REPEATS)[order], np.tile(offset, REPEATS)[order], bitmap)

    def candidates(self, texts: list[bytes]) -> set[tuple[int, int, int]]:
        """(text, item, byte place where the item would start, rounded) for windows that agree."""
        data = np.frombuffer(b"\0".join([*texts, b""]), dtype=np.uint8)
        lengths = np.array([len(t) for t in texts])
        begins = np.concatenate([[0], np.cumsum(lengths + 1)[:-1]])
        words = _word_starts(data)
        firsts = np.searchsorted(words, begins)
        held = np.diff(np.append(firsts, len(words)))
        which = np.repeat(np.arange(len(begins)), held)
        chosen = (np.arange(len(words)) - np.repeat(firsts, held)) % STRIDE == 0
        starts, which = words[chosen], which[chosen]
        found = set()
        if not len(starts) or not self.tables:
            return found
        keys = self.embedding.keys(data, starts, begins[which] + lengths[which], list(self.tables))
        for size, (known, items, offsets, bitmap) in self.tables.items():
            for r in range(REPEATS):
                own = (keys[size][r] & ~np.uint64(15)) | np.uint64(r)
                maybe = np.flatnonzero(bitmap.take((own >> np.uint64(42)).view(np.int64)))
                if not len(maybe):
                    continue
                low = np.searchsorted(known, own[maybe])
                high = np.searchsorted(known, own[maybe], side="right")
                for lane, a, b in zip(maybe[high > low].tolist(), low[high > low].tolist(), high[high > low].tolist(), strict=True):
                    doc = int(which[lane])
                    for k in range(a, b):
                        found.add((doc, int(items[k]), (int(starts[lane] - begins[doc]) - int(offsets[k])) // BAND))
        return found

    def matches(self, texts: list[str | None]) -> list[dict[int, tuple[int, int]]]:
        """For each text: item id -> (distance, item characters) of items at least ``SIMILARITY`` alike."""
        cleaned = [normal(t) for t in texts]
        encoded = [t.encode() for t in cleaned]
        out: list[dict[int, tuple[int, int]]] = [{} for _ in texts]
        places = self.candidates(encoded).union(*(g.candidates(encoded) for g in self.grams))
        runs = []
        for doc, n, first, last in _runs(places):
            size = len(self.items[n][1].encode())
            slack = size // 4 + 40
            runs.append((doc, n, encoded[doc][max(0, first * BAND - slack) : (last + 3) * BAND + size + slack].decode("utf-8", "ignore")))
        may = self.pieces.may_match([n for _, n, _ in runs], [r for _, _, r in runs])
        for (doc, n, region), near in zip(runs, may.tolist(), strict=True):
            if near:
                item, pattern = self.items[n]
                long = len(pattern.encode()) >= SIZES[-1]
                distance = infix_distance(pattern, region) if long else bounded_distance(pattern, region, most_edits(len(pattern)))
                if len(pattern) - distance >= SIMILARITY * len(pattern) and distance < out[doc].get(item, (1 << 30, 0))[0]:
                    out[doc][item] = distance, len(pattern)
        if self.short is not None:
            for doc, text in enumerate(cleaned):
                for end, (size, own) in self.short.iter(text):
                    a = end - size + 1
                    if (a == 0 or not text[a - 1].isalnum()) and not text[end + 1 : end + 2].isalnum():
                        for n in own:
                            out[doc][self.items[n][0]] = 0, size
        return out


def _blocks(items: DataFrame) -> Iterator[tuple[list[tuple[int, str]], bool]]:
    """The items in blocks of at most about MAX_ITEMS, and whether there are several; then each pass is a written table, so that neither
    driver nor tasks hold more than one block."""
    rows = items.select(F.col("item_id").cast("long").alias("item_id"), F.col("text").cast("string").alias("text")).dropna(subset=["text"])
    n = max(1, -(-rows.count() // MAX_ITEMS))
    for block in range(n):
        yield [(r["item_id"], r["text"]) for r in rows.filter(F.pmod(F.xxhash64("item_id", "text"), F.lit(n)) == block).collect()], n > 1


def leaks(docs: DataFrame, items: DataFrame) -> DataFrame:
    """doc_id, item_id, distance, item_chars: every pair of a document and an item it holds."""
    made = None
    for block, several in _blocks(items):

        def make(block: list = block):
            searcher = Searcher(block)

            def work(columns: list) -> list:
                out: tuple[list, ...] = ([], [], [], [])
                for doc_id, found in zip(columns[0], searcher.matches(columns[1]), strict=True):
                    for item, (distance, size) in found.items():
                        for column, value in zip(out, (doc_id, item, distance, size), strict=True):
                            column.append(value)
                return list(out)

            return work

        part = map_rows(ids_and_texts(docs), make, "doc_id long, item_id long, distance int, item_chars int")
        part = written(part, "leaks") if several else part
        made = part if made is None else made.unionByName(part)
    return made.groupBy("doc_id", "item_id").agg(F.min("distance").alias("distance"), F.max("item_chars").alias("item_chars"))


def keep_clean(docs: DataFrame, items: DataFrame) -> DataFrame:
    """The rows of ``docs``, all columns, whose text holds no item."""
    kept = docs
    for block, several in _blocks(items):

        def run(batches, block: list = block):
            import pyarrow as pa

            searcher = Searcher(block)
            for batch in batches:
                for start in range(0, batch.num_rows, 256):
                    part = batch.slice(start, 256)
                    texts = part.column(part.schema.names.index("text")).to_pylist()
                    yield part.filter(pa.array([not m for m in searcher.matches(texts)], type=pa.bool_()))

        kept = kept.mapInArrow(run, docs.schema)
        kept = written(kept, "clean") if several else kept
    return kept
