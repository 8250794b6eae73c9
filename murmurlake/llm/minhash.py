"""MinHash near-duplicates by fast similarity sketching.

A document is the set of its distinct four-word shingles, as 64-bit hashes.  Documents with one set are one *class*, and classes are joined.
A class's sketch has ``BANDS * ROWS`` coordinates, filled in rounds: in each of the first T = BANDS * ROWS rounds every shingle is hashed to one
coordinate and to a value, and a coordinate keeps the least of (round, value); in round T + j all shingles go to coordinate j, so after 2T
rounds none is empty.  A set stops once all are filled, after about T ln T / n rounds for n shingles.  Two sketches agree in a coordinate with
probability J, as with T independent permutations, and how many agree is concentrated as if coordinates were independent, for sets of any size,
which one permutation with bins doesn't give for small ones.

Coordinates are cut into bands of ``ROWS``; classes that agree in a whole band share a bucket.  At J = 0.8 no band agrees with probability
(1 - 0.8 ** 4) ** 30 = 1.4e-7, at J = 0.9 1e-14.  Buckets of a few classes make pairs, larger ones are groups that are settled by differences to a
pivot (``set_groups``), and every link is confirmed on full sets.  Links are closed to components by alternating stars.

Edge cases: texts without words (null, empty, white space) have an empty set and are linked with nothing; rows that repeat a doc_id are rows of
their own; a row without doc_id links and connects others and gets the least id of its component if there is one, and is kept if there is none;
an empty table gives an empty result; other columns are ignored.  Shingles are told apart by 64 bits, sets by 128 bits.
"""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from murmurlake.llm.common import forget, map_rows, written
from murmurlake.llm.graph import components
from murmurlake.llm.set_groups import SMALL, as_set, buckets_of, group_links, may_be_near, pairs_of, parity
from murmurlake.llm.shingling import TURN, class_key, encoded, mix, rows_of, shingles, told_to_tasks

WORDS = 4
#: Jaccard similarity of at least TIMES/PER.
TIMES, PER = 80, 100
BANDS, ROWS = 30, 4
#: Below this size only equal sets are similar enough, and those are one class.
LEAST_SIZE = -(-TIMES // (PER - TIMES))
#: Sets that a task remembers to have told the bands of.
REMEMBERED = 500_000


def sketches(sets: list[np.ndarray], size: int = BANDS * ROWS) -> np.ndarray:
    """One row of ``size`` coordinates for each set that isn't empty, as 64-bit numbers: the round in the first ten bits, then the value."""
    lengths = np.array([len(s) for s in sets], dtype=np.int64)
    out = np.full((len(sets), size), np.iinfo(np.uint64).max, dtype=np.uint64)
    flat = out.reshape(-1)
    tokens, owner = np.concatenate([*sets, np.zeros(0, dtype=np.uint64)]), np.repeat(np.arange(len(sets)), lengths)
    for turn in range(2 * size):
        if not len(tokens):
            break
        hashed = mix(tokens + np.uint64((turn + 1) * TURN[3] & 0xFFFFFFFFFFFFFFFF))
        # The upper half tells the coordinate, a second mixing the value.
        place = ((hashed >> np.uint64(32)) * np.uint64(size) >> np.uint64(32)).astype(np.int64) if turn < size else np.int64(turn - size)
        value = np.uint64(turn << 54) | mix(hashed ^ np.uint64(TURN[1])) >> np.uint64(10)
        np.minimum.at(flat, owner * size + place, value)
        open_sets = (out == np.iinfo(np.uint64).max).any(axis=1)
        still = open_sets[owner]
        if not still.all():
            tokens, owner = tokens[still], owner[still]
    return out


def band_keys(sketch: np.ndarray, bands: int = BANDS) -> np.ndarray:
    """A signed 64-bit key for every band of each sketch."""
    cut = sketch.reshape(len(sketch), bands, -1)
    keys = np.broadcast_to(np.arange(1, bands + 1, dtype=np.uint64) * np.uint64(TURN[2]), cut.shape[:2]).copy()
    for row in range(cut.shape[2]):
        keys = mix(keys * np.uint64(TURN[4]) + cut[:, :, row])
    return keys.view(np.int64)


def signatures(docs: DataFrame) -> DataFrame:
    """doc_id, row, n_shingles, key (of the set), bands (for a set only once a task, its other rows have none)."""

    def make():
        seen = set()

        def work(columns: list) -> list:
            sets = shingles(encoded(columns[2]), WORDS)
            keys = list(map(class_key, sets))
            fresh = []
            for i, (s, key) in enumerate(zip(sets, keys, strict=True)):
                if len(s) >= LEAST_SIZE and key not in seen:
                    seen.add(key)
                    fresh.append(i)
            if len(seen) > REMEMBERED:
                seen.clear()
            bands: list = [None] * len(sets)
            for i, own in zip(fresh, band_keys(sketches([sets[i] for i in fresh])) if fresh else (), strict=True):
                bands[i] = own
            return [columns[0], columns[1], list(map(len, sets)), keys, bands]

        return work

    return map_rows(rows_of(docs), make, "doc_id long, row long, n_shingles long, key binary, bands array<long>")


def _classes(sigs: DataFrame) -> DataFrame:
    """cls (a number), key, n, least (doc_id), held (rows), one (row and doc_id of one of them): one row for each set that isn't empty."""
    found = sigs.filter("n_shingles > 0").groupBy("key").agg(
        F.first("n_shingles").alias("n"), F.min("doc_id").alias("least"), F.count("*").alias("held"), F.min(F.struct("row", "doc_id")).alias("one")
    )
    return written(found.withColumn("cls", F.monotonically_increasing_id()), "minhash-classes")


def _sets_of(docs: DataFrame, wanted: DataFrame) -> DataFrame:
    """cls, n, tokens (sorted 64-bit hashes), sig (their parity) of the wanted classes, from the text of one row each."""

    def make():
        def work(columns: list) -> list:
            sets = shingles(encoded(columns[2]), WORDS)
            ok = [i for i, (s, key) in enumerate(zip(sets, columns[1], strict=True)) if class_key(s) == key]
            return [[columns[0][i] for i in ok], [len(sets[i]) for i in ok], [sets[i].tobytes() for i in ok], [parity(sets[i]) for i in ok]]

        return work

    rows = rows_of(docs)
    asked = written(wanted, "minhash-wanted").select("cls", "key", F.col("one.row").alias("asked_row"), F.col("one.doc_id").alias("asked_id"))
    here = (rows["row"] == asked["asked_row"]) & rows["doc_id"].eqNullSafe(asked["asked_id"])
    made = map_rows(rows.join(told_to_tasks(asked), here).select("cls", "key", "text"), make, "cls long, n long, tokens binary, sig array<long>")
    return written(made.dropDuplicates(["cls"]), "minhash-sets")


def _verified(pairs: DataFrame, sets: DataFrame) -> DataFrame:
    """The pairs (a, b) whose sets link; whole sets meet only where their parities allow it."""

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

    close = pairs.select("a", "b")
    for side, n, sig in (("a", "n", "s"), ("b", "m", "t")):
        close = close.join(sets.select(F.col("cls").alias(side), F.col("n").alias(n), F.col("sig").alias(sig)), side)
    close = close.filter(may_be_near("n", "m", "s", "t", TIMES, PER)).select("a", "b")
    held = close.join(sets.select(F.col("cls").alias("a"), F.col("tokens").alias("s")), "a")
    return map_rows(held.join(sets.select(F.col("cls").alias("b"), F.col("tokens").alias("t")), "b").select("a", "b", "s", "t"), make, "a long, b long")


def links(docs: DataFrame, sigs: DataFrame, classes: DataFrame) -> DataFrame:
    """a, b: links between classes; enough of them that every class that links with another is connected to it."""
    told = sigs.filter("bands IS NOT NULL").select("key", "bands").join(classes.select("key", "cls", "n"), "key")
    members = told.select(F.explode("bands").alias("token"), "cls", "n", F.lit(False).alias("near"))
    buckets = written(buckets_of(members), "minhash-buckets")
    pairs = written(pairs_of(buckets, TIMES, PER).select("a", "b"), "minhash-pairs")
    # A bucket goes by its least class, so the buckets of one crowd in several bands are one group.
    large = written(buckets.filter(F.col("held") > SMALL).select(F.col("least").alias("grp"), "cls").distinct(), "minhash-large")
    forget(buckets)
    wanted = pairs.select(F.col("a").alias("cls")).union(pairs.select("b")).union(large.select("cls")).distinct()
    sets = _sets_of(docs, classes.join(wanted, "cls"))
    found = written(_verified(pairs, sets), "minhash-links")
    made = found.unionByName(group_links(large, sets, TIMES, PER))
    forget(pairs, large, sets)
    return made


def near_duplicates(docs: DataFrame) -> DataFrame:
    """Per row: doc_id, n_shingles, component_id (least doc_id reachable by links), kept (doc_id = component_id)."""
    sigs = written(signatures(docs), "minhash-signatures")
    classes = _classes(sigs)
    roots = components(links(docs, sigs, classes))
    # By class first: a class or component with a large share of all rows is one row a task.
    rooted = classes.join(roots, F.col("cls") == F.col("node"), "left").select("key", "least", "held", "root")
    least = rooted.filter("root IS NOT NULL").groupBy("root").agg(F.min("least").alias("of_root"))
    several = rooted.filter("held > 1 OR root IS NOT NULL").join(least, "root", "left")
    found = written(several.select(F.col("key").alias("of"), F.coalesce("of_root", "least").alias("found")), "minhash-components")
    names = written(sigs.select("doc_id", "n_shingles", "key"), "minhash-names")
    forget(sigs, classes)
    rows = names.join(found, (F.col("key") == F.col("of")) & (F.col("n_shingles") > 0), "left")
    component = F.when(F.col("of").isNotNull(), F.col("found")).otherwise(F.col("doc_id"))
    return rows.select("doc_id", "n_shingles", component.alias("component_id"), F.col("doc_id").eqNullSafe(component).alias("kept"))
