"""Context windows, gaps and batches, which deal a chat by ranges of its messages; fixed batches and neighbours go by chat."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from murmurlake.functions.stored import stored

MIN_MESSAGES, MIN_CHARS = 2, 280


#: Ids (of messages or groups) that one task sums up at once, and characters that one task searches.
BLOCK, REACH = 4096, 1 << 16


def _told_by_block(rows: DataFrame, told: DataFrame, block: str) -> DataFrame:
    """The rows with what ``told`` says of their chat and block, where null is a chat and a block too."""
    theirs = told.withColumnsRenamed({"chat_id": "_their_chat", block: "_their_block"})
    same = F.col("chat_id").eqNullSafe(F.col("_their_chat")) & F.col(block).eqNullSafe(F.col("_their_block"))
    return rows.join(theirs, same).drop("_their_chat", "_their_block")


def running_total(rows: DataFrame, value: Column, at: str, total: str) -> DataFrame:
    """Adds ``total``: the sum of ``value`` over the rows of the chat up to this one, in the order of the whole number ``at``.

    Blocks of ``at`` are summed where they lie, and start from what stands before them, a row for each block; so a chat spans many tasks.
    Null is a chat of its own, and rows without ``at`` stand last in their chat."""
    blocked = rows.withColumns({"_value": value.cast("long"), "_block": F.floor(F.col(at) / BLOCK)})
    sums = blocked.groupBy("chat_id", "_block").agg(F.sum("_value").alias("_sum"))
    earlier = Window.partitionBy("chat_id").orderBy(F.asc_nulls_last("_block")).rowsBetween(Window.unboundedPreceding, -1)
    starts = sums.select("chat_id", "_block", F.coalesce(F.sum("_sum").over(earlier), F.lit(0)).alias("_start"))
    inside = Window.partitionBy("chat_id", "_block").orderBy(at).rowsBetween(Window.unboundedPreceding, Window.currentRow)
    made = _told_by_block(blocked, starts, "_block").withColumn(total, F.col("_start") + F.sum("_value").over(inside))
    return made.drop("_value", "_block", "_start")


def last_within(points: DataFrame, least: int) -> DataFrame:
    """For the points (chat_id, v, key, ask) with an ``ask``: the greatest key of the chat's points whose v is at most v - ``least``.

    Keys must not fall while v rises.  Points are dealt by (chat, stretch of v); a stretch also holds the points of the one before that
    it reaches back to, and one number for all that is further back.  Columns: chat_id, ask, found.
    """
    width = max(REACH, least)
    held = points.withColumn("_part", F.floor(F.col("v") / width))
    late = F.col("v") - F.col("_part") * width >= width - least
    tops = held.groupBy("chat_id", "_part").agg(F.max("key").alias("_top"), F.max(F.when(~late, F.col("key"))).alias("_early"))
    by_part = Window.partitionBy("chat_id").orderBy("_part")
    before = F.greatest(F.max("_top").over(by_part.rangeBetween(Window.unboundedPreceding, -2)), F.max("_early").over(by_part.rangeBetween(-1, -1)))
    carried = tops.select("chat_id", "_part", before.alias("_before"))
    halo = held.filter(late & F.col("key").isNotNull()).withColumns({"_part": F.col("_part") + 1, "ask": F.lit(None).cast(points.schema["ask"].dataType)})
    window = Window.partitionBy("chat_id", "_part").orderBy("v").rangeBetween(Window.unboundedPreceding, -least)
    told = held.unionByName(halo).join(carried, ["chat_id", "_part"]).withColumn("found", F.coalesce(F.max("key").over(window), F.col("_before")))
    return told.filter("ask IS NOT NULL").select("chat_id", "ask", "found")


def context_bounds(messages: DataFrame, min_messages: int = MIN_MESSAGES, min_chars: int = MIN_CHARS) -> DataFrame:
    """Adds first_id and last_id: on each side at least ``min_messages`` messages and ``min_chars`` characters, as far as there are any.

    Ids are dense by chat.  Both bounds are looked up among prefix sums of lengths, dealt by stretches of the chat's characters, so no row
    looks at its neighbours, and a chat takes time in proportion to its rows, in as many tasks as it is long.
    """
    size = F.coalesce(F.length("content"), F.lit(0)).cast("long")
    summed = running_total(messages.select("chat_id", "id", size.alias("_size")), F.col("_size"), "id", "_upto")
    before = F.col("_upto") - F.col("_size")
    low = last_within(summed.select("chat_id", before.alias("v"), F.col("id").alias("key"), F.col("id").alias("ask")), min_chars)
    high = last_within(summed.select("chat_id", (-F.col("_upto")).alias("v"), (-F.col("id")).alias("key"), F.col("id").alias("ask")), min_chars)
    lasts = messages.groupBy("chat_id").agg(F.max("id").alias("_last"))
    bounds = low.select("chat_id", F.col("ask").alias("id"), F.col("found").alias("_low")).join(
        high.select("chat_id", F.col("ask").alias("id"), (-F.col("found")).alias("_high")), ["chat_id", "id"]
    )
    bounded = messages.join(bounds, ["chat_id", "id"]).join(lasts, "chat_id")
    return bounded.select(
        *messages.columns,
        F.greatest(F.lit(0), F.least(F.col("id") - min_messages, F.coalesce("_low", F.lit(0)))).alias("first_id"),
        F.least(F.col("_last"), F.greatest(F.col("id") + min_messages, F.coalesce("_high", "_last"))).alias("last_id"),
    )


def with_context(rows: DataFrame, messages: DataFrame) -> DataFrame:
    """Adds context_before and context_after for rows with chat_id, message_id, first_id, last_id; a window spans few messages, which
    are joined by blocks of ids, not by whole chats."""
    block = 16
    wanted = rows.select("chat_id", "message_id", "first_id", "last_id").distinct()
    dealt = wanted.withColumn("_block", F.explode(F.sequence(F.expr(f"first_id div {block}"), F.expr(f"last_id div {block}"))))
    parts = messages.select("chat_id", "id", "sender", "content", "timestamp", F.expr(f"id div {block}").alias("_block"))
    near = dealt.join(parts, ["chat_id", "_block"]).filter("id BETWEEN first_id AND last_id AND id <> message_id")
    entry = F.struct("id", "sender", "content", "timestamp")
    found = near.groupBy("chat_id", "message_id").agg(
        F.array_sort(F.collect_list(F.when(F.col("id") < F.col("message_id"), entry))).alias("context_before"),
        F.array_sort(F.collect_list(F.when(F.col("id") > F.col("message_id"), entry))).alias("context_after"),
    )
    return rows.join(found, ["chat_id", "message_id"], "left")


def proximity_groups(rows: DataFrame, gap: int = 5) -> DataFrame:
    """Adds group_no: a group ends where the next message id of the chat is more than ``gap`` away.

    Rows meet the one before in their block of ids; the first of a block meets the last of the block before it that has any, so a chat spans
    many tasks.  Rows without chat are a chat of their own; rows without id stand last in their chat, each a group."""
    blocked = rows.withColumn("_range", F.floor(F.col("message_id") / BLOCK))
    lasts = rows.groupBy("chat_id", F.floor(F.col("message_id") / BLOCK).alias("_range")).agg(F.max("message_id").alias("_end"))
    earlier = lasts.select("chat_id", "_range", F.lag("_end").over(Window.partitionBy("chat_id").orderBy(F.asc_nulls_last("_range"))).alias("_before"))
    before = F.coalesce(F.lag("message_id").over(Window.partitionBy("chat_id", "_range").orderBy("message_id")), F.col("_before"))
    told = _told_by_block(blocked, earlier, "_range").withColumn("_fresh", F.coalesce((F.col("message_id") - before > gap).cast("int"), F.lit(1)))
    return running_total(told, F.col("_fresh"), "message_id", "group_no").select(*rows.columns, "group_no")


def fixed_batches(rows: DataFrame, size: int, order: Column) -> DataFrame:
    """Adds batch_no: ``size`` rows of a chat in order."""
    n = F.row_number().over(Window.partitionBy("chat_id").orderBy(order))
    return rows.withColumn("batch_no", F.floor((n - 1) / size).cast("long"))


def smart_batches(grouped: DataFrame, size: int) -> DataFrame:
    """batch_no by (chat_id, group_no): whole groups packed in order into batches of at most ``size``; larger groups fill batches of their own.
    Rows without chat are in no batch.

    Each group points at the first one that no longer fits into a batch that it starts.  The groups that do start one are those which the
    pointers reach from a chat's first: pointers are doubled until none is left, so it takes rounds in the logarithm of a chat's batches.
    """
    sizes = grouped.filter("chat_id IS NOT NULL").groupBy("chat_id", "group_no").agg(F.count("*").alias("held"))
    summed = stored(running_total(sizes, F.col("held"), "group_no", "upto"), "batch-groups")
    nothing = F.lit(None).cast("long")
    group, upto = F.col("group_no").cast("long"), F.col("upto")
    full = F.greatest(upto - F.col("held") + size, upto) + 1  # as much as a batch from this group on can't hold, the group itself at least
    points = summed.select("chat_id", (-upto).alias("v"), (-group).alias("key"), nothing.alias("ask")).unionByName(
        summed.select("chat_id", (-full).alias("v"), nothing.alias("key"), group.alias("ask"))
    )
    jumps = last_within(points, 0).filter("found IS NOT NULL").select("chat_id", F.col("ask").alias("at"), (-F.col("found")).alias("to"))
    jumps = stored(jumps, "batch-jumps")
    starts = stored(summed.groupBy("chat_id").agg(F.min(group).alias("at")), "batch-starts")
    while not jumps.isEmpty():
        reached = starts.join(jumps, ["chat_id", "at"]).select("chat_id", F.col("to").alias("at"))
        starts = stored(starts.unionByName(reached), "batch-starts")
        further = jumps.select("chat_id", F.col("at").alias("to"), F.col("to").alias("end"))
        jumps = stored(jumps.join(further, ["chat_id", "to"]).select("chat_id", "at", F.col("end").alias("to")), "batch-jumps")
    own = F.greatest(F.lit(1), F.ceil(F.col("held") / size)).cast("long")
    begun = summed.join(starts.select("chat_id", F.col("at").alias("group_no"), F.lit(1).alias("starts")), ["chat_id", "group_no"], "left")
    counted = running_total(begun, F.when(F.col("starts") == 1, own).otherwise(0), "group_no", "batches")
    return counted.select("chat_id", group.alias("group_no"), (F.col("batches") - own).alias("batch_no"))


def neighbours(messages: DataFrame, n: int = 2) -> DataFrame:
    """Adds before and after: up to ``n`` messages as ``sender: content``."""
    order = Window.partitionBy("chat_id").orderBy("id")
    said = F.concat_ws(": ", "sender", "content")
    return messages.withColumns({"before": F.collect_list(said).over(order.rowsBetween(-n, -1)), "after": F.collect_list(said).over(order.rowsBetween(1, n))})
