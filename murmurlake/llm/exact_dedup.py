"""Exact dedup over an extendible-hash index on shared files; DataFrame functions only.

Texts are compared without the characters of ``[\\x20\\x09-\\x0D]``.  The index is addressed by the leading bits of a 64-bit
key of the normalised text.  Its directory starts with ``2**start_depth`` slots; while a bucket holds more than ``capacity``
distinct keys it is split on the next bit, and the directory doubles with the deepest bucket.  Doubling works on a histogram
of key prefixes, never on rows, and copies of one text, however many, are one key, so a hot group can't overfill a bucket.
The capacity grows with the number of keys once the directory would pass ``MAX_SLOTS``, which bounds its size.

Every row finds its bucket through the directory, by the slot of its key's leading bits, and entries belong to it: rows of a bucket with
equal keys are chained by their bytes.  Copies of a text are combined in the map tasks and then where all copies meet, by comparing the
normalised texts themselves, so texts that collide in the key stay apart.  The entries, now one small row a distinct text, are dealt to
owner tasks by ranges of buckets and keys; an owner chains the entries of each key and writes its buckets' folders of the index to the
shared files.  Rows look their group up in the folder of their bucket, by key; where a key's chain has several entries, by the SHA-256 that
each entry keeps of its text.  A slot that led to another bucket would lose its rows.

Edge cases: null texts count as empty, so all empty, null and white-space texts form one group; rows that repeat the doc_id that stays
are kept together with it; a null doc_id stays only if no other row is as long; an empty table gives an empty result; other
columns are ignored.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from murmurlake.llm.common import ids_and_texts, written

CAPACITY = 4_000
START_DEPTH = 1
MAX_SLOTS = 1 << 17
#: Characters that don't count when texts are compared.
WHITE = " \t\n\x0b\x0c\r"


def normalised(text: Column) -> Column:
    return F.translate(text, WHITE, "")


def default_key(norm: Column) -> Column:
    return F.xxhash64(norm)


def _leading(key: Column, bits: int) -> Column:
    return F.shiftrightunsigned(key, 64 - bits)


def directory(keys: DataFrame, capacity: int = CAPACITY, start_depth: int = START_DEPTH) -> tuple[int, DataFrame]:
    """The global depth g, and the directory: slot (g leading bits), bucket, depth of the bucket, n (its distinct keys)."""
    distinct = keys.select("key").distinct()
    total = distinct.count()
    capacity = max(capacity, 8 * total // MAX_SLOTS)
    finest = max(start_depth, (total // capacity).bit_length() + 3)
    histogram = written(distinct.groupBy(_leading(F.col("key"), finest).alias("fine")).agg(F.count("*").alias("n")), "exact-histogram")
    depth = start_depth
    # Local depth of each fine slot: it grows while the slot's bucket is overfull.
    slots = histogram.withColumn("depth", F.lit(start_depth))
    while depth < finest:
        prefix = F.shiftrightunsigned("fine", finest - depth)
        full = (
            slots.filter(F.col("depth") == depth).groupBy(prefix.alias("parent")).agg(F.sum("n").alias("held")).filter(F.col("held") > capacity)
        )
        if full.isEmpty():
            break
        slots = written(
            slots.join(full.select("parent"), (F.col("depth") == depth) & (prefix == F.col("parent")), "left").select(
                "fine", "n", F.when(F.col("parent").isNotNull(), depth + 1).otherwise(F.col("depth")).alias("depth")
            ),
            "exact-directory",
        )
        depth += 1
    bucket = F.expr(f"shiftright(fine, {finest} - depth) * 64 + depth")
    return finest, slots.select(F.col("fine").alias("slot"), bucket.alias("bucket"), "depth", "n")


def _rank(chars: Column, doc_id: Column) -> Column:
    """Longest original first, then least id, as one number that map tasks can combine in their hash tables."""
    rest = F.coalesce(F.lit(str(1 << 63)).cast("decimal(20,0)") - doc_id.cast("decimal(20,0)"), F.lit(0).cast("decimal(21,0)"))
    return chars.cast("decimal(11,0)") * F.lit(str(1 << 65)).cast("decimal(20,0)") + rest


def _id_of_rank(rank: Column) -> Column:
    rest = F.pmod(rank, F.lit(str(1 << 65)).cast("decimal(20,0)"))
    return F.when(rest > 0, (F.lit(str(1 << 63)).cast("decimal(20,0)") - rest).cast("long"))


def group_of_rows(
    docs: DataFrame,
    capacity: int = CAPACITY,
    key_of: Callable[[Column], Column] = default_key,
    start_depth: int = START_DEPTH,
) -> DataFrame:
    """Per row: doc_id, keep_id, group_size, kept, text_sha256."""
    texts = ids_and_texts(docs).select("doc_id", F.length("text").alias("chars"), normalised(F.col("text")).alias("norm"))
    keyed = texts.withColumn("key", key_of(F.col("norm")).cast("long"))
    entries = written(keyed.select("doc_id", "chars", "key", F.sha2("norm", 256).alias("text_sha256")), "exact-entries")
    depth, slots = directory(entries, capacity, start_depth)
    slots = F.broadcast(slots.select(F.col("slot").alias("leads"), "bucket"))  # at most MAX_SLOTS slots

    def placed(rows: DataFrame) -> DataFrame:
        """The rows with their bucket, through the directory."""
        return rows.join(slots, _leading(F.col("key"), depth) == F.col("leads")).drop("leads")

    chains = placed(keyed).groupBy("bucket", "key", "norm").agg(F.count("*").alias("group_size"), F.max(_rank(F.col("chars"), F.col("doc_id"))).alias("best"))
    owned = chains.select("bucket", "key", "group_size", "best", F.sha2("norm", 256).alias("chain_sha")).repartitionByRange("bucket", "key")
    chain = Window.partitionBy("bucket", "key")  # lies within the owner's range: no further exchange
    index = written(
        owned.select(
            "key",
            F.count("*").over(chain).alias("chains"),
            "chain_sha",
            "group_size",
            _id_of_rank(F.col("best")).alias("keep_id"),
            "bucket",
        ),
        "exact-index",
        "bucket",
    )
    made = ["doc_id", "keep_id", "group_size", F.col("doc_id").eqNullSafe(F.col("keep_id")).alias("kept"), "text_sha256"]
    alone = placed(entries).join(index.filter("chains = 1").select("bucket", "key", "keep_id", "group_size"), ["bucket", "key"]).select(*made)
    # Texts that share a key but not their bytes: their rows follow the key's chain to the entry of their own text.
    collided = index.filter("chains > 1").select("bucket", "key", F.col("chain_sha").alias("text_sha256"), "keep_id", "group_size")
    told = placed(entries).join(collided, ["bucket", "key", "text_sha256"]).select(*made)
    return alone.unionByName(told)
