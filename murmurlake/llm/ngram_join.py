"""N-gram Jaccard join by filtering under several global token orders.

A document is the set of its distinct three-word shingles, as 64-bit hashes.  Documents with one set are one *class*, named by 64 bits of
the set, and classes are joined.  Two sets with Jaccard similarity of at least t share a token among the first ``n - ceil(t * n) + 1``
tokens of each, under any total order of tokens, so a pair must do so under all of ``ORDERS`` orders; with k - 1 more tokens in both
prefixes it must share k (``depth_of``).  Every order puts rare tokens first and breaks ties by its own hash.  How frequent a token is comes from exact
counts over all documents (``token_levels``), kept in a table of bounded size where tokens may collide, which decides speed, never
results.  The first order deals classes to the tokens of their prefixes; candidates that differ too much in size, or don't share enough
under another order, go before any set is compared.

A token shared by more than ``SMALL`` classes doesn't make pairs; its classes are a group (``set_groups``).

Edge cases: texts without words (null, empty, white space) have an empty set and are linked with nothing; rows that repeat
a doc_id with other words are rows of their own; a row without doc_id links and connects others, and gets the least id of its
component if there is one; an empty table gives an empty result; other columns are ignored.  Sets are compared by the 64-bit hashes of their
shingles: a false link needs so many collisions that similarity passes the threshold, or one of two class names.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from murmurlake.llm.common import forget, map_rows, written
from murmurlake.llm.graph import components
from murmurlake.llm.set_groups import SMALL, as_set, buckets_of, group_links, pairs_of, parity
from murmurlake.llm.shingling import TURN, class_of, encoded, mix, rows_of, shingles, told_to_tasks

WORDS = 3
#: Jaccard similarity of at least TIMES/PER.
TIMES, PER = 90, 100
ORDERS = 3
#: Under the other orders prefixes are longer by up to so many tokens, and as many more must be shared.
DEPTH = 32
#: The table of frequencies has at least 2**SLOT_BITS slots of a byte, and at most a quarter as many tokens are entered; it grows up to
#: 2**MOST_SLOT_BITS (64 MB) until all tokens of level ``ENTERED`` (7 documents) are in it.
SLOT_BITS, MOST_SLOT_BITS = 22, 26
ENTERED = 22
#: Tokens that a task counts at once.
COUNTED = 2_000_000


def prefix_length(n: int) -> int:
    return n - -(-TIMES * n // PER) + 1


def depth_of(p: int) -> int:
    """How many tokens two sets must share in prefixes that are longer by one less."""
    return max(1, p // 3)


# ---- how frequent tokens are ----


def _slots(tokens: np.ndarray, bits: int) -> np.ndarray:
    return (tokens >> np.uint64(64 - bits)).astype(np.int64)


def _packed_counts(tokens: np.ndarray, bits: int) -> pa.RecordBatch:
    """part (leading bits), tokens (the next 40 bits of each), counts (two bytes each): one row for each part."""
    names, n = np.unique(tokens, return_counts=True)
    part = (names >> np.uint64(64 - bits)).astype(np.int64)
    first = np.flatnonzero(np.append(True, part[1:] != part[:-1]))
    rest = (names << np.uint64(bits)).view(np.uint8).reshape(-1, 8)[:, 3:]
    ends = np.append(first, len(names)).astype(np.int32)
    columns = [pa.array(part[first].astype(np.int32))]
    for data, width in ((rest, 5), (np.minimum(n, 65535).astype(np.uint16), 2)):
        columns.append(pa.BinaryArray.from_buffers(pa.binary(), len(first), [None, pa.py_buffer(ends * np.int32(width)), pa.py_buffer(data.tobytes())]))
    return pa.RecordBatch.from_arrays(columns, names=["part", "tokens", "counts"])


def _count_in_tasks(rows: DataFrame, bits: int) -> DataFrame:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, size = [], 0
        for batch in batches:
            for start in range(0, batch.num_rows, 256):
                sets = {s.tobytes(): s for s in shingles(encoded(batch.column(0).slice(start, 256).to_pylist()), WORDS)}
                held.extend(sets.values())
                size += sum(map(len, sets.values()))
                if size >= COUNTED:
                    yield _packed_counts(np.concatenate(held), bits)
                    held, size = [], 0
        if size:
            yield _packed_counts(np.concatenate(held), bits)

    return rows.select("text").mapInArrow(run, "part int, tokens binary, counts binary")


def _levels_of_parts(counted: DataFrame, bits: int) -> DataFrame:
    """slot (of the largest table), level (8 * log2 of the count) of every token that occurs twice; parts come whole, one after another."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, held = None, []

        def out() -> pa.RecordBatch:
            raw = np.frombuffer(b"".join(t for t, _ in held), dtype=np.uint8).reshape(-1, 5)
            wide = np.zeros((len(raw), 8), dtype=np.uint8)
            wide[:, 3:] = raw
            names = wide.view(np.uint64)[:, 0]
            n = np.frombuffer(b"".join(c for _, c in held), dtype=np.uint16).astype(np.int64)
            order = np.argsort(names)
            names, n = names[order], n[order]
            first = np.flatnonzero(np.append(True, names[1:] != names[:-1]))
            n = np.add.reduceat(n, first)
            names = names[first][n > 1]
            level = np.minimum(255, np.round(8 * np.log2(n[n > 1]))).astype(np.int16)
            slot = _slots(np.uint64(now) << np.uint64(64 - bits) | names >> np.uint64(bits), MOST_SLOT_BITS)
            return pa.RecordBatch.from_arrays([pa.array(slot.astype(np.int32)), pa.array(level)], names=["slot", "level"])

        for batch in batches:
            for part, tokens, counts in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                if held and part != now:
                    yield out()
                    held = []
                now = part
                held.append((tokens, counts))
        if held:
            yield out()

    return counted.repartition("part").sortWithinPartitions("part").mapInArrow(run, "slot int, level short")


def token_levels(docs: DataFrame) -> np.ndarray:
    """A level for every slot: how often the most frequent token of the slot occurs, by logarithm; 0 for rare ones.

    Tasks count their tokens first, so a token of all documents is one row a task.  Parts grow in number with the rows, up to 2**18.
    The table grows with the tokens: were frequent ones left out for want of room, prefixes would hold them, and groups of unlike documents
    would come of them.
    """
    bits = min(18, max(12, (docs.count() // 500).bit_length()))
    found = written(_levels_of_parts(_count_in_tasks(rows_of(docs), bits), bits), "ngram-counts")
    held = sorted(((r["level"], r["n"]) for r in found.groupBy("level").agg(F.count("*").alias("n")).collect()), reverse=True)
    size = min(MOST_SLOT_BITS, max(SLOT_BITS, 2 + (sum(n for level, n in held if level >= ENTERED) - 1).bit_length()))
    room, least = 1 << (size - 2), 256
    for level, n in held:
        room -= n
        if room < 0:
            break
        least = level
    slot = F.shiftright("slot", MOST_SLOT_BITS - size).alias("slot")
    told = found.filter(F.col("level") >= least).groupBy(slot).agg(F.max("level").alias("level")).toArrow()  # at most a quarter of the slots
    table = np.zeros(1 << size, dtype=np.uint8)
    table[told.column("slot").to_numpy()] = told.column("level").to_numpy().astype(np.uint8)
    forget(found)
    return table


# ---- signatures and sets ----


def _in_order(tokens: np.ndarray, levels: np.ndarray, turn: int, p: int) -> np.ndarray:
    """The first p tokens: rare ones first, then by a hash of the order's own."""
    if p >= len(tokens):
        return tokens
    key = levels[_slots(tokens, len(levels).bit_length() - 1)].astype(np.uint64) << np.uint64(56) | mix(tokens * np.uint64(TURN[turn] | 1)) >> np.uint64(8)
    return tokens[np.argpartition(key, p - 1)[:p]]


def signatures(docs: DataFrame, levels: np.ndarray) -> DataFrame:
    """doc_id, row, n_shingles, cls, k (tokens to share), prefix (under the first order; for a class only once a task, its other rows have none)."""
    #: Below this size only equal sets are similar enough, and those are one class.
    least_size = -(-TIMES // (PER - TIMES))

    def make():
        seen = set()

        def work(columns: list) -> list:
            sets = shingles(encoded(columns[2]), WORDS)
            names, prefixes, depths = list(map(class_of, sets)), [], []
            for s, name in zip(sets, names, strict=True):
                fresh = len(s) >= least_size and name not in seen
                p = prefix_length(len(s)) if len(s) else 0
                depths.append(depth_of(p))
                prefixes.append(_in_order(s, levels, 0, p + depths[-1] - 1).view(np.int64) if fresh else None)
                seen.add(name)
            if len(seen) > 500_000:
                seen.clear()
            return [columns[0], columns[1], list(map(len, sets)), names, depths, prefixes]

        return work

    return map_rows(rows_of(docs), make, "doc_id long, row long, n_shingles long, cls long, k int, prefix array<long>")


def _sets_of(docs: DataFrame, wanted: DataFrame, levels: np.ndarray) -> DataFrame:
    """cls, n, tokens (binary, sorted 64-bit hashes), sig (their parity), k and slack, p2.. (prefixes under the other orders, 32 bits of each token, longer by k;
    k tokens must be shared; slack of them collide) for the wanted (row, cls)."""

    def make():
        def work(columns: list) -> list:
            sets = shingles(encoded(columns[1]), WORDS)
            more: list[list] = [[] for _ in range(ORDERS - 1)]
            depth, slack = [], []
            for s in sets:
                p = prefix_length(len(s)) if len(s) else 0
                depth.append(min(p, DEPTH))
                lost = 0
                for turn, own in enumerate(more, 1):
                    early = _in_order(s, levels, turn, p + depth[-1] - 1)
                    short = np.unique(early.astype(np.uint32))
                    lost = max(lost, len(early) - len(short))
                    own.append(short.view(np.int32))
                slack.append(lost)
            return [columns[0], list(map(class_of, sets)), list(map(len, sets)), [s.tobytes() for s in sets], list(map(parity, sets)), depth, slack, *more]

        return work

    wanted = written(wanted.select("row", F.col("doc_id").alias("id"), F.col("cls").alias("wanted_cls")), "ngram-wanted")
    rows = rows_of(docs)
    here = (rows["row"] == wanted["row"]) & rows["doc_id"].eqNullSafe(wanted["id"])
    texts = rows.join(told_to_tasks(wanted), here).select("wanted_cls", "text")
    kinds = ", ".join(f"p{k} array<int>" for k in range(2, ORDERS + 1))
    made = map_rows(texts, make, f"wanted_cls long, cls long, n long, tokens binary, sig array<long>, k int, slack int, {kinds}")
    made = written(made.filter("cls = wanted_cls").drop("wanted_cls"), "ngram-sets")
    if made.count() > wanted.count():  # rows that are equal in id and text
        several, made = made, written(made.dropDuplicates(["cls"]), "ngram-sets")
        forget(several)
    forget(wanted)
    return made


def _verified(pairs: DataFrame, sets: DataFrame) -> DataFrame:
    """The pairs (a, b) that share enough under every other order, and whose sets link."""

    def make():
        def work(columns: list) -> list:
            a, b = [], []
            for x, y, s, t in zip(*columns, strict=True):
                one, two = as_set(s), as_set(t)
                both = len(np.intersect1d(one, two, assume_unique=True))
                if PER * both >= TIMES * (len(one) + len(two) - both):
                    a.append(x)
                    b.append(y)
            return [a, b]

        return work

    orders = [f"p{k}" for k in range(2, ORDERS + 1)]
    for side in ("a", "b"):
        own = sets.select(*[F.col(c).alias(side if c == "cls" else f"{c}{side}") for c in ("cls", "k", "slack", *orders)])
        pairs = pairs.join(own, side)
    shared = F.least("ka", "kb") - F.col("slacka") - F.col("slackb")
    for p in orders:
        pairs = pairs.filter(F.size(F.array_intersect(f"{p}a", f"{p}b")) >= shared)
    with_sets = (
        pairs.select("a", "b")
        .join(sets.select(F.col("cls").alias("a"), F.col("tokens").alias("s")), "a")
        .join(sets.select(F.col("cls").alias("b"), F.col("tokens").alias("t")), "b")
        .select("a", "b", "s", "t")
    )
    return map_rows(with_sets, make, "a long, b long")


def _depth(n: str) -> str:
    """``depth_of(prefix_length(n))`` in SQL."""
    return f"greatest(1, ({n} - ({TIMES} * {n} + {PER - 1}) DIV {PER} + 1) DIV 3)"


def links(docs: DataFrame, sigs: DataFrame, levels: np.ndarray) -> DataFrame:
    """a, b: links between classes; enough of them that every class that links with another is connected to it."""
    members = sigs.filter("prefix IS NOT NULL").select(F.explode("prefix").alias("token"), "cls", F.col("n_shingles").alias("n"), F.lit(False).alias("near"))
    buckets = written(buckets_of(members), "ngram-buckets")
    # A pair that shares a large token is told by its group; any other must share enough small ones.
    enough = F.col("shared") >= F.expr(f"least({_depth('n')}, {_depth('m')})")
    pairs = written(pairs_of(buckets, TIMES, PER).filter(enough).select("a", "b"), "ngram-pairs")
    large = written(buckets.filter(F.col("held") > SMALL).select(F.col("least").alias("grp"), "cls").distinct(), "ngram-large")
    forget(buckets)
    wanted = pairs.select(F.col("a").alias("cls")).union(pairs.select("b")).union(large.select("cls")).distinct()
    rows = sigs.filter("n_shingles > 0").groupBy("cls").agg(F.min(F.struct("row", "doc_id")).alias("one")).select("cls", "one.row", "one.doc_id")
    sets = _sets_of(docs, rows.join(wanted, "cls"), levels)
    found = written(_verified(pairs, sets), "ngram-links")
    forget(pairs)

    made = found.unionByName(group_links(large, sets, TIMES, PER))
    forget(sets, large)
    return made


def _classes(docs: DataFrame) -> tuple[DataFrame, DataFrame]:
    """The rows (doc_id, row, n_shingles, cls; all of them), and the roots (node, root; of classes that link with others)."""
    levels = token_levels(docs)
    sigs = written(signatures(docs, levels), "ngram-signatures")
    names = written(sigs.select("doc_id", "row", "n_shingles", "cls"), "ngram-names")
    roots = written(components(links(docs, sigs, levels)), "ngram-roots")
    forget(sigs)
    return names, roots


def near_duplicates(docs: DataFrame) -> DataFrame:
    """Per row: doc_id, n_shingles, component_id (least doc_id reachable by links)."""
    names, roots = _classes(docs)
    # By class first: a class or component with a large share of all rows is one row a task.
    held = names.filter("n_shingles > 0").groupBy("cls").agg(F.min("doc_id").alias("least"), F.count("*").alias("rows"))
    rooted = held.join(roots, F.col("cls") == F.col("node"), "left").select("cls", "least", "rows", "root")
    least = rooted.filter("root IS NOT NULL").groupBy("root").agg(F.min("least").alias("of_root"))
    several = rooted.filter("rows > 1 OR root IS NOT NULL").join(least, "root", "left")
    found = written(several.select(F.col("cls").alias("of"), F.coalesce("of_root", "least").alias("found")), "ngram-components")
    rows = names.join(told_to_tasks(found), (F.col("cls") == F.col("of")) & (F.col("n_shingles") > 0), "left")
    return rows.select("doc_id", "n_shingles", F.when(F.col("of").isNotNull(), F.col("found")).otherwise(F.col("doc_id")).alias("component_id"))


def one_of_each(docs: DataFrame) -> DataFrame:
    """The rows of ``docs``, all columns, of which every component keeps one: the row of least doc_id (null last), then of least text hash,
    and one of the rows that are equal in both.  Rows without words stay."""
    names, roots = _classes(docs)
    named = names.filter("n_shingles > 0").join(roots, F.col("cls") == F.col("node"), "left")
    named = written(named.select("doc_id", "row", F.coalesce("root", "cls").alias("root")), "ngram-named")
    rank = F.struct(F.col("doc_id").isNull().alias("none"), "doc_id", "row")
    keys = named.groupBy("root", "doc_id", "row").agg(F.count("*").alias("n"))
    keepers = named.groupBy("root").agg(F.min(rank).alias("keep"))
    stays = F.col("doc_id").eqNullSafe(F.col("keep.doc_id")) & (F.col("row") == F.col("keep.row"))
    # Only rows that go, and those of which several are equal, are looked up.
    odd = keys.join(keepers, "root").filter(~stays | (F.col("n") > 1))
    mark = "_".join(["odd", *docs.columns])  # no column has this name
    told = odd.select(F.struct(F.col("doc_id").alias("id"), "row", (~stays).alias("goes")).alias(mark))
    text = F.coalesce(F.col("text").cast("string"), F.lit(""))
    tagged = docs.join(told, F.col("doc_id").cast("long").eqNullSafe(F.col(f"{mark}.id")) & (F.xxhash64(text) == F.col(f"{mark}.row")), "left")
    alone = tagged.filter(F.col(mark).isNull()).drop(mark)
    several = tagged.filter(~F.col(f"{mark}.goes"))
    whole = F.struct(*[F.col(f"`{c}`").alias(f"c{i}") for i, c in enumerate(docs.columns)])
    one = several.groupBy(F.col(f"{mark}.id"), F.col(f"{mark}.row")).agg(F.first(whole).alias(mark))
    return alone.union(one.select(*[F.col(f"{mark}.c{i}").alias(c) for i, c in enumerate(docs.columns)]))
