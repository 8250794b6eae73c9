"""Monthly fingerprints of chats, for uploads that repeat."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

SAMPLE = 10


def month_chunks(messages: DataFrame, sample: int = SAMPLE) -> DataFrame:
    """chat_id, month_key, month_start, message_count, fingerprint, first_message_at, last_message_at.

    The fingerprint covers month, count and the first ``sample`` messages without their times.  Only these rows are collected, so a busy
    month stays one aggregate.
    """
    keyed = messages.withColumn("month_key", F.date_format("timestamp", "yyyy-MM"))
    counts = keyed.groupBy("chat_id", "month_key").agg(
        F.count("*").alias("message_count"), F.min("timestamp").alias("first_message_at"), F.max("timestamp").alias("last_message_at")
    )
    order = Window.partitionBy("chat_id", "month_key").orderBy("timestamp", "id")
    first = keyed.withColumn("_n", F.row_number().over(order)).filter(F.col("_n") <= sample)
    text = first.groupBy("chat_id", "month_key").agg(F.array_sort(F.collect_list(F.struct("_n", F.concat_ws("\n", "sender", "content").alias("t")))).alias("_l"))
    made = F.concat(
        F.col("month_key"), F.lit("\n"), F.col("message_count").cast("string"), F.lit("\n"), F.array_join(F.transform("_l", lambda x: x["t"]), "\n---\n")
    )
    return counts.join(text, ["chat_id", "month_key"]).select(
        "chat_id",
        "month_key",
        F.date_trunc("month", "first_message_at").alias("month_start"),
        "message_count",
        F.sha2(made, 256).alias("fingerprint"),
        "first_message_at",
        "last_message_at",
    )


def dedup_plan(chunks: DataFrame, known: DataFrame) -> tuple[DataFrame, DataFrame]:
    """New chunks and those whose fingerprint is known."""
    return chunks.join(known.select("fingerprint").distinct(), "fingerprint", "left_anti"), chunks.join(known.select("fingerprint").distinct(), "fingerprint", "left_semi")
