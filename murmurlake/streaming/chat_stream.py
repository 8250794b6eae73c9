"""Chats that arrive as files, and months already seen."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from murmurlake.operators.fingerprint import month_chunks
from murmurlake.sources.chat import parse_chats

FILES = "path string, modificationTime timestamp, length long, content binary"


def read_chat_files(spark: SparkSession, folder: str) -> DataFrame:
    """A stream of chat_id, content: each new text file is one row."""
    files = spark.readStream.format("binaryFile").schema(FILES).option("pathGlobFilter", "*.txt").load(folder)
    return files.select(F.col("path").alias("chat_id"), F.col("content").cast("string").alias("content"))


def _exists(spark: SparkSession, path: str) -> bool:
    folder = spark._jvm.org.apache.hadoop.fs.Path(path)
    return folder.getFileSystem(spark._jsc.hadoopConfiguration()).exists(folder)


def _write(df: DataFrame, folder: str, batch_id: int) -> None:
    """The batch's own part of a table: a batch that runs again overwrites what it wrote before."""
    df.write.mode("overwrite").parquet(f"{folder}/batch={batch_id}")


def parse_stream(chats: DataFrame, messages_path: str, fingerprints_path: str, checkpoint: str) -> StreamingQuery:
    """Parse arriving chats; months whose fingerprint is known are not written again.

    A chat is complete in its file, so a batch parses it whole and no message stays open between batches.  Both tables are written in folders
    by batch id, and a batch asks only for the fingerprints of earlier batches: one that broke off anywhere and is run again finds what it
    found before and overwrites its own folders, so every month is written once.  Of equal months in one batch, that of the least chat_id is.
    """

    def batch(rows: DataFrame, batch_id: int) -> None:
        spark = rows.sparkSession
        messages = parse_chats(rows).persist()
        try:
            chunks = month_chunks(messages)
            if _exists(spark, fingerprints_path):
                known = spark.read.parquet(fingerprints_path).filter(F.col("batch") < batch_id)
                chunks = chunks.join(known.select("fingerprint", "month_key").distinct(), ["fingerprint", "month_key"], "left_anti")
            one = chunks.groupBy("fingerprint", "month_key").agg(F.min("chat_id").alias("chat_id"), F.first("message_count").alias("message_count")).persist()
            keyed = messages.withColumn("month_key", F.date_format("timestamp", "yyyy-MM"))
            _write(keyed.join(one.select("chat_id", "month_key"), ["chat_id", "month_key"], "left_semi"), messages_path, batch_id)
            _write(one, fingerprints_path, batch_id)
            one.unpersist()
        finally:
            messages.unpersist()

    return chats.writeStream.foreachBatch(batch).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def sessions(events: DataFrame, gap: str = "30 minutes", late: str = "1 hour") -> DataFrame:
    """Activity sessions by user on event time, with a watermark for late rows."""
    return events.withWatermark("ts", late).groupBy("user_id", F.session_window("ts", gap).alias("s")).agg(F.count("*").alias("n"), F.sum("value").alias("value"))
