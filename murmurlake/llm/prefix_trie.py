"""The trie of conversation prefixes, built level by level.

Conversations are rebuilt turn by turn and numbered by ranges, so one of any length spans many tasks.  Those with one sequence of turns are a
*bundle*, named by its least conv_id and weighed by how many it holds.  A level takes the bundles that are still live, meets them with
their next turn, and groups them by (parent node, turn): a group is a node, named by its depth and its least conv_id.  A node of a single bundle
is the top of a *chain*: no other sequence will join it, so all that is left of the bundle is written at once and the bundle leaves.
Levels go on while two sequences share a node, so their number is that of the longest prefix two different sequences share, not that
of the longest conversation.  Then joins from the deepest level up give every node its children, its leaves and the tokens saved below it.

Rebuilding: conversation c takes the first h original turns of conversation c - c % 5 (all if it has fewer, none if it is absent), then its
own turns after its first h; h is the unsigned crc32 of the decimal c modulo 9, and % has the sign of c, as in SQL.

Edge cases: rows without a conv_id belong to no conversation; turns are ordered with null first, turns of one number by role and text, and
rows that are equal in all follow one another; null roles and texts are empty; a conversation that is left without turns is a member of
the root alone; an empty table has no root and gives an empty result; other columns are ignored.  Turns are compared by the SHA-256 of role
and text, whole sequences by 240 bits summed from SHA-256 of turns and places.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from functools import reduce

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from murmurlake.functions.stored import numbered
from murmurlake.llm.common import forget, written

FAMILY, MOST_SHARED = 5, 9
#: Bytes of the pieces in which the members of a bundle are joined before they are hashed.
PIECE_BYTES = 1 << 16
LANES = 4


def shared_turns(conv_id: Column) -> Column:
    """How many turns a conversation takes from the one that its family starts with."""
    return F.pmod(F.crc32(conv_id.cast("string").cast("binary")), F.lit(MOST_SHARED))


def original_turns(conversations: DataFrame) -> DataFrame:
    """conv_id, pos (1, 2, ...), turn_key (SHA-256 of role and text), n_bytes (of the text)."""
    role, text = (F.coalesce(F.col(c).cast("string"), F.lit("")) for c in ("role", "text"))
    rows = conversations.select(F.col("conv_id").cast("long").alias("conv_id"), F.col("turn").cast("long").alias("turn"), role.alias("role"), text.alias("text")).filter(
        "conv_id IS NOT NULL"
    )
    key = F.unhex(F.sha2(F.concat(F.length("role").cast("string"), F.lit(":"), "role", "text").cast("binary"), 256))
    keyed = rows.withColumns({"turn_key": key, "n_bytes": F.octet_length("text").cast("long")})
    order = [F.col("turn").asc_nulls_first()]
    return numbered(keyed, order, "pos", by=("conv_id",), ties=(F.col("role"), F.col("text")), drop=("turn", "role", "text"))


def rebuilt_turns(turns: DataFrame) -> tuple[DataFrame, DataFrame]:
    """The rebuilt turns (conv_id, pos, turn_key, n_bytes), and every conversation (conv_id, n, its number of rebuilt turns)."""
    own = turns.groupBy("conv_id").agg(F.max("pos").alias("own_n"))
    base, h = F.col("conv_id") - F.col("conv_id") % FAMILY, shared_turns(F.col("conv_id"))
    family = own.filter(F.col("conv_id") % FAMILY == 0).select(F.col("conv_id").alias("base"), F.col("own_n").alias("base_n"))
    convs = own.select("conv_id", "own_n", base.alias("base"), h.alias("h")).join(family, "base", "left")
    taken = F.least("h", F.coalesce("base_n", F.lit(0)))
    convs = written(convs.select("conv_id", "base", "h", taken.alias("taken"), (taken + F.greatest(F.col("own_n") - F.col("h"), F.lit(0))).alias("n")), "trie-convs")
    heads = turns.filter((F.col("conv_id") % FAMILY == 0) & (F.col("pos") < MOST_SHARED)).withColumnRenamed("conv_id", "base")
    given = convs.select("conv_id", "base", "taken").join(heads, "base").filter("pos <= taken").select("conv_id", "pos", "turn_key", "n_bytes")
    kept = turns.join(convs.select("conv_id", "h", "taken"), "conv_id").filter("pos > h")
    kept = kept.select("conv_id", (F.col("pos") - F.col("h") + F.col("taken")).alias("pos"), "turn_key", "n_bytes")
    return given.unionByName(kept), convs.select("conv_id", "n")


def _bundles(turns: DataFrame, convs: DataFrame) -> DataFrame:
    """conv_id, rep (least conversation of equal sequence), w (how many there are), n."""
    hashed = F.sha2(F.concat(F.col("pos").cast("string").cast("binary"), F.lit(":").cast("binary"), "turn_key"), 256)
    lanes = [F.conv(F.substring("_h", 1 + 15 * i, 15), 16, 10).cast("decimal(20,0)") for i in range(LANES)]
    names = [f"l{i}" for i in range(LANES)]
    sums = turns.withColumn("_h", hashed).groupBy("conv_id").agg(*[F.sum(x).alias(c) for x, c in zip(lanes, names, strict=True)])
    zero = F.lit(0).cast("decimal(30,0)")
    named = convs.join(sums, "conv_id", "left").select("conv_id", "n", *[F.coalesce(F.col(c), zero).alias(c) for c in names])
    named = written(named, "trie-names")
    found = named.groupBy("n", *names).agg(F.min("conv_id").alias("rep"), F.count("*").alias("w"))
    made = written(named.join(found, ["n", *names]).select("conv_id", "rep", "w", "n"), "trie-bundles")
    forget(named)
    return made


def _joined(rows: Iterator[tuple[int, int]]) -> Iterator[tuple[int, int, bytes]]:
    """(rep, first conversation, comma-joined conversations) in pieces, from rows in order."""
    now, first, held, size = None, 0, [], 0
    for rep, conv in rows:
        if held and (rep != now or size >= PIECE_BYTES):
            yield now, first, b",".join(held)
            held, size = [], 0
        if not held:
            now, first = rep, conv
        held.append(b"%d" % conv)
        size += len(held[-1]) + 1
    if held:
        yield now, first, b",".join(held)


def member_hashes(bundles: DataFrame) -> DataFrame:
    """rep, ends_sha256 of bundles of several conversations: members are joined to pieces where their range lies, and the pieces of a bundle
    run through one hash in order, so nothing of a bundle's size is ever held."""

    def pieces(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rows = (pair for b in batches for pair in zip(*(c.to_pylist() for c in b.columns), strict=True))
        for rep, first, data in _joined(rows):
            yield pa.RecordBatch.from_arrays([pa.array([rep], pa.int64()), pa.array([first], pa.int64()), pa.array([data], pa.binary())], names=["rep", "first", "data"])

    def hashes(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, state = None, None
        out: tuple[list, list] = ([], [])

        def close() -> None:
            out[0].append(now)
            out[1].append(state.hexdigest())

        for batch in batches:
            for rep, data in zip(batch.column(0).to_pylist(), batch.column(2).to_pylist(), strict=True):
                if state is not None and rep == now:
                    state.update(b"," + data)
                    continue
                if state is not None:
                    close()
                now, state = rep, hashlib.sha256(data)
            yield pa.RecordBatch.from_arrays([pa.array(out[0], pa.int64()), pa.array(out[1], pa.string())], names=["rep", "ends_sha256"])
            out = ([], [])
        if state is not None:
            close()
            yield pa.RecordBatch.from_arrays([pa.array(out[0], pa.int64()), pa.array(out[1], pa.string())], names=["rep", "ends_sha256"])

    members = bundles.filter("w > 1").select("rep", "conv_id").repartitionByRange("rep", "conv_id").sortWithinPartitions("rep", "conv_id")
    joined = members.mapInArrow(pieces, "rep long, first long, data binary")
    return joined.repartition("rep").sortWithinPartitions("rep", "first").mapInArrow(hashes, "rep long, ends_sha256 string")


_NODE = ["conv_id", "depth", "parent_conv_id", "n_convs", "n_children", "n_leaves", "saved_tokens", "ends_sha256"]


def prefix_trie(conversations: DataFrame) -> DataFrame:
    """One row a node: conv_id, depth, parent_conv_id, n_convs, n_children, n_leaves, saved_tokens, ends_sha256."""
    original = original_turns(conversations)
    turns, convs = rebuilt_turns(original)
    turns = written(turns, "trie-turns")
    bundles = _bundles(turns, convs)
    own_hash = F.sha2(F.col("rep").cast("string").cast("binary"), 256)
    hashed = member_hashes(bundles)
    reps = bundles.filter("conv_id = rep").drop("conv_id").join(hashed, "rep", "left")
    reps = written(reps.select("rep", "w", "n", F.coalesce("ends_sha256", own_hash).alias("ends_sha256")), "trie-reps")
    paths = turns.join(reps.select(F.col("rep").alias("conv_id")), "conv_id").select(F.col("conv_id").alias("rep"), "pos", "turn_key", "n_bytes")
    paths = written(paths.repartitionByRange("pos", "rep").sortWithinPartitions("pos"), "trie-paths")
    forget(turns)

    # Down: a level's groups, each a node with the number of bundles that share it.
    root = reps.agg(F.min("rep").alias("conv_id"), F.sum("w").alias("n_convs"))
    least = root.first()["conv_id"]  # null where there are no conversations
    top = root.filter("conv_id IS NOT NULL")
    nothing = F.lit(None).cast("long")
    levels = [written(top.select("conv_id", nothing.alias("parent_conv_id"), "n_convs", F.lit(0).cast("long").alias("n_bytes")), "trie-level")]
    live = reps.select("rep", "w", "n", "ends_sha256", F.lit(least).cast("long").alias("node"))
    ended, chains, spent = [], [], []
    while True:
        depth = len(levels)
        ended.append(live.filter(F.col("n") < depth).select(F.col("node").alias("conv_id"), F.lit(depth - 1).alias("depth"), "ends_sha256"))
        step = live.join(paths.filter(F.col("pos") == depth).select("rep", "turn_key", "n_bytes"), "rep")
        step = written(step, "trie-step")
        spent.append(step)
        groups = step.groupBy("node", "turn_key").agg(
            F.min("rep").alias("conv_id"), F.sum("w").alias("n_convs"), F.count("*").alias("held"), F.max("n_bytes").alias("n_bytes")
        )
        groups = written(groups, "trie-groups")
        spent.append(groups)
        single = groups.filter("held = 1").select(F.col("conv_id").alias("rep"), F.lit(depth).alias("top"), F.col("node").alias("parent"))
        chains.append(single)
        shared = groups.filter("held > 1")
        if shared.isEmpty():
            break
        levels.append(shared.select("conv_id", F.col("node").alias("parent_conv_id"), "n_convs", "n_bytes"))
        keys = shared.select("node", "turn_key", F.col("conv_id").alias("next"))
        live = step.join(keys, ["node", "turn_key"]).select("rep", "w", "n", "ends_sha256", F.col("next").alias("node"))

    # Chains: what is left of a bundle from the level on where it is alone.
    tops = reduce(DataFrame.unionByName, chains)
    left = tops.join(reps, "rep").join(paths.select("rep", "pos", "n_bytes"), "rep").filter("pos >= top")
    below = F.sum("n_bytes").over(Window.partitionBy("rep").orderBy(F.desc("pos")))
    parts = [left.filter("w = 1").withColumn("saved_tokens", F.lit(0).cast("long")), left.filter("w > 1").withColumn("saved_tokens", (F.col("w") - 1) * below)]
    at_end = F.col("pos") == F.col("n")
    chained = parts[0].unionByName(parts[1]).select(
        F.col("rep").alias("conv_id"),
        F.col("pos").cast("long").alias("depth"),
        F.when(F.col("pos") == F.col("top"), F.col("parent")).otherwise(F.col("rep")).alias("parent_conv_id"),
        F.col("w").alias("n_convs"),
        (~at_end).cast("long").alias("n_children"),
        F.lit(1).cast("long").alias("n_leaves"),
        "saved_tokens",
        F.when(at_end, F.col("ends_sha256")).alias("ends_sha256"),
        (F.col("pos") == F.col("top")).alias("is_top"),
    )
    chained = written(chained, "trie-chains")

    # Up: children add their leaves and what they save.
    ends = written(reduce(DataFrame.unionByName, ended), "trie-ends")
    made, deeper = [chained.select(*_NODE)], None
    for depth in reversed(range(len(levels))):
        tops_below = chained.filter(F.col("is_top") & (F.col("depth") == depth + 1)).select("parent_conv_id", "n_leaves", "saved_tokens")
        children = tops_below if deeper is None else tops_below.unionByName(deeper.select("parent_conv_id", "n_leaves", "saved_tokens"))
        sums = children.groupBy(F.col("parent_conv_id").alias("conv_id")).agg(F.count("*").alias("n_children"), F.sum("n_leaves").alias("n_leaves"), F.sum("saved_tokens").alias("below"))
        held = ends.filter(F.col("depth") == depth).select("conv_id", "ends_sha256")
        rolled = levels[depth].join(sums, "conv_id", "left").join(held, "conv_id", "left")
        own = (F.col("n_convs") - 1) * F.col("n_bytes")
        deeper = written(
            rolled.select(
                "conv_id",
                F.lit(depth).cast("long").alias("depth"),
                "parent_conv_id",
                "n_convs",
                F.coalesce("n_children", F.lit(0)).cast("long").alias("n_children"),
                F.coalesce("n_leaves", F.lit(1)).cast("long").alias("n_leaves"),
                (own + F.coalesce("below", F.lit(0))).cast("long").alias("saved_tokens"),
                "ends_sha256",
            ),
            "trie-nodes",
        )
        made.append(deeper)
    forget(ends, paths, reps, bundles, *spent)
    nobody = F.lit(hashlib.sha256(b"").hexdigest())
    return reduce(DataFrame.unionByName, made).withColumn("ends_sha256", F.coalesce("ends_sha256", nobody))
