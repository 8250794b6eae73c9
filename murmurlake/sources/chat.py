"""Chat exports as DataFrames: read, detect, parse, chunk."""

from __future__ import annotations

import io
import zipfile
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, StringType

from murmurlake.functions.stored import numbered, stored
from murmurlake.functions.text import matches, pattern, plain_apostrophes, urls_in
from murmurlake.operators.context import running_total

MAX_CHUNK, MIN_CHUNK, SNIFFED_LINES = 280, 32, 20

# Line headers, media placeholders and system lines of the supported exports.
IOS_HEADER = r"^\x{200E}?\[(\d{1,2}/\d{1,2}/\d{2,4}),\s*(\d{1,2}:\d{2}:\d{2}[\s\x{202F}]*[AP]M)\]\s*([^:]+):\s*(.*)$"
ANDROID_HEADER = r"^\x{200E}?(\d{1,2}/\d{1,2}/\d{2,4}),\s*(\d{1,2}:\d{2})\s*-\s*([^:]+):\s*(.*)$"
IMESSAGE_HEADER = r"^([A-Z][a-z]{2} \d{1,2}, \d{4})\s+(\d{1,2}:\d{2}:\d{2} [AP]M)(?:\s+\(Read .*\))?\s*$"
MEDIA = (
    ("image", "image omitted"),
    ("video", "video omitted"),
    ("audio", "audio omitted"),
    ("gif", "GIF omitted"),
    ("sticker", "sticker omitted"),
    ("document", "document omitted"),
    ("contact", "Contact card omitted"),
)
SYSTEM = (
    r"This message was deleted\.?$",
    r"You deleted this message\.?$",
    r"Messages and calls are end-to-end encrypted",
    r"Missed (voice|video) call$",
    r".*changed the subject from",
    r".*changed this group's icon$",
    r".*added you$",
    r".*left$",
    r".*removed",
    r".*created group",
    r".*changed the group description",
    r"Waiting for this message",
    r"You're now an admin$",
    r".*'s security code changed",
)


def read_chats(spark: SparkSession, path: str) -> DataFrame:
    """chat_id (file path), content: each ``.txt`` file, or the first text file of each ``.zip``, as one row."""
    files = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(path)

    def unpack(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            rows = []
            for name, data in zip(batch["path"], batch["content"], strict=True):
                if name.endswith(".zip"):
                    with zipfile.ZipFile(io.BytesIO(data)) as z:
                        inner = next((n for n in z.namelist() if n.endswith(".txt")), None)
                        data = z.read(inner) if inner else None
                if data is not None:
                    rows.append((name, bytes(data).decode("utf-8", "replace")))
            yield pd.DataFrame(rows, columns=["chat_id", "content"])

    plain = files.filter("path like '%.txt'").select(F.col("path").alias("chat_id"), F.col("content").cast("string").alias("content"))
    return plain.unionByName(files.filter("path like '%.zip'").select("path", "content").mapInPandas(unpack, "chat_id string, content string"))


def file_identity(spark: SparkSession, path: str) -> DataFrame:
    """path, modified, run_key: the first 16 hex digits of the hash of the bytes."""
    files = spark.read.format("binaryFile").load(path)
    return files.select("path", F.col("modificationTime").alias("modified"), F.substring(F.sha2("content", 256), 1, 16).alias("run_key"))


def source_of(content: Column) -> Column:
    """'imessage' or 'whatsapp', by how the text begins."""
    start = F.substring(F.ltrim(content), 1, 200)
    return F.when(start.rlike(r"^\x{200E}?\[?\d{1,2}/\d{1,2}/\d{2,4},"), "whatsapp").when(
        start.rlike(r"^[A-Z][a-z]{2} \d{1,2}, \d{4}\s+\d{1,2}:\d{2}:\d{2} [AP]M"), "imessage"
    ).otherwise("whatsapp")


def lines_of(chats: DataFrame) -> DataFrame:
    """chat_id, source, line_no, text: normalised lines."""
    text = F.regexp_replace(plain_apostrophes(F.col("content")), r"\r\n?", "\n")
    return chats.select("chat_id", source_of(F.col("content")).alias("source"), F.posexplode(F.split(text, "\n")).alias("line_no", "text"))


def read_chat_lines(spark: SparkSession, path: str) -> DataFrame:
    """chat_id (file path), source, line_no, text of text files of any size: Spark cuts them at ``spark.sql.files.maxPartitionBytes``.

    Lines are numbered where they lie, and a second pass adds how many lines the stretches of a file before have, a row for each.  A line ends at a line
    feed, a carriage return or both; what follows the last one is a line only if it isn't empty.
    """
    raw = spark.read.text(path).select("value", F.col("_metadata.file_path").alias("chat_id"), F.col("_metadata.file_block_start").alias("_from"))
    laid = stored(raw.withColumn("_at", F.monotonically_increasing_id()), "lines")
    held = laid.groupBy("chat_id", "_from").agg(F.count("*").alias("_n"), F.min("_at").alias("_first"))
    earlier = Window.partitionBy("chat_id").orderBy("_from").rowsBetween(Window.unboundedPreceding, -1)
    starts = held.select("chat_id", "_from", "_first", F.coalesce(F.sum("_n").over(earlier), F.lit(0)).alias("_before"))
    told = laid.join(starts, ["chat_id", "_from"])
    lines = told.select("chat_id", (F.col("_at") - F.col("_first") + F.col("_before")).alias("line_no"), plain_apostrophes(F.col("value")).alias("text"))
    first = lines.filter(F.col("line_no") < SNIFFED_LINES).groupBy("chat_id").agg(F.array_sort(F.collect_list(F.struct("line_no", "text"))).alias("_head"))
    start = F.array_join(F.transform("_head", lambda x: x["text"]), "\n")
    return lines.join(first.select("chat_id", source_of(start).alias("source")), "chat_id").select("chat_id", "source", "line_no", "text")


def media_type(content: Column) -> Column:
    made = None
    for kind, text in MEDIA:
        test = F.trim(content).rlike(rf"(?i)^\x{{200E}}?{text}$")
        made = F.when(test, kind) if made is None else made.when(test, kind)
    return made


def is_system(content: Column) -> Column:
    return matches(F.regexp_replace(content, r"^\s+|\s+$", ""), r"^\x{200E}?(?:" + "|".join(SYSTEM) + ")")


def _year(text: Column) -> Column:
    y = text.cast("int")
    return F.when(y < 100, y + 2000).otherwise(y)


def header_time(day: Column, clock: Column) -> Column:
    """Month/day/year and a 12- or 24-hour time; null where they aren't a time."""
    parts, hm = F.split(day, "/"), F.regexp_extract_all(clock, F.lit(r"(\d+)"), F.lit(1))
    hour = F.element_at(hm, 1).cast("int")
    hour = F.when(clock.rlike("PM$") & (hour < 12), hour + 12).when(clock.rlike("AM$") & (hour == 12), 0).otherwise(hour)
    second = F.coalesce(F.try_element_at(hm, F.lit(3)).cast("int"), F.lit(0))
    return F.try_make_timestamp(_year(parts[2]), parts[0].cast("int"), parts[1].cast("int"), hour, F.element_at(hm, 2).cast("int"), second.cast("decimal(8,6)"))


def split_text(text: str, most: int = MAX_CHUNK, least: int = MIN_CHUNK) -> list[str]:
    """Pieces of at most ``most`` characters, cut at a space of the later half where there is one, joined by ellipses."""
    if len(text) <= most:
        return [text]
    pieces, rest = [], text
    while True:
        lead = "…" if pieces else ""
        if len(rest) + len(lead) <= most:
            return [*pieces, lead + rest]
        room = most - 1 - len(lead)
        if len(rest) - room < least:
            return [*pieces, lead + rest]
        space = rest.rfind(" ", 0, room + 1)
        cut = space if space > room / 2 else room
        pieces.append(f"{lead}{rest[:cut].rstrip()}…")
        rest = rest[cut:].lstrip()


@F.pandas_udf(ArrayType(StringType()))
def chunked(content: pd.Series) -> pd.Series:
    return content.map(lambda t: split_text(t or ""))


def _assembled(lines: DataFrame, by_ranges: bool = False) -> DataFrame:
    """chat_id, source, line_no, timestamp, sender, content, raw_line of the messages, before system lines go."""
    ios, android, apple = (F.col("text").rlike(pattern(h)) for h in (IOS_HEADER, ANDROID_HEADER, IMESSAGE_HEADER))
    hits = lines.filter(F.col("line_no") < SNIFFED_LINES).groupBy("chat_id").agg(
        F.count_if(ios).alias("ios_hits"), F.count_if(android).alias("android_hits")
    )
    told = lines.join(hits, "chat_id", "left").withColumn(
        "header",
        F.when(F.col("source") == "imessage", F.when(apple, "imessage"))
        .when(F.coalesce("android_hits", F.lit(0)) > F.coalesce("ios_hits", F.lit(0)), F.when(android, "android"))
        .otherwise(F.when(ios, "ios")),
    )
    begins = F.col("header").isNotNull().cast("int")
    if by_ranges:
        numbered_messages = running_total(told, begins, "line_no", "island")
    else:
        numbered_messages = told.withColumn("island", F.sum(begins).over(Window.partitionBy("chat_id").orderBy("line_no")))
    island = numbered_messages.filter("island > 0")

    def part(i: int) -> Column:
        return F.when(F.col("header") == "ios", F.regexp_extract("text", pattern(IOS_HEADER), i)).otherwise(
            F.regexp_extract("text", pattern(ANDROID_HEADER), i)
        )

    grouped = island.groupBy("chat_id", "source", "island").agg(
        F.min("line_no").alias("line_no"),
        F.max("header").alias("header"),
        F.max(F.when(F.col("header").isNotNull(), F.col("text"))).alias("text"),
        F.array_sort(F.collect_list(F.when(F.col("header").isNull(), F.struct("line_no", "text")))).alias("more"),
    )
    rest = F.transform("more", lambda x: x["text"])
    filled = F.filter(rest, lambda t: F.length(F.trim(t)) > 0)
    apple_time = F.try_to_timestamp(
        F.concat_ws(" ", F.regexp_extract("text", pattern(IMESSAGE_HEADER), 1), F.regexp_extract("text", pattern(IMESSAGE_HEADER), 2)),
        F.lit("MMM d, yyyy h:mm:ss a"),
    )
    is_apple = F.col("header") == "imessage"
    return grouped.select(
        "chat_id",
        "source",
        "line_no",
        F.when(is_apple, apple_time).otherwise(header_time(part(1), part(2))).alias("timestamp"),
        F.when(is_apple, F.trim(F.try_element_at(filled, F.lit(1)))).otherwise(F.trim(part(3))).alias("sender"),
        F.when(is_apple, F.array_join(F.transform(F.slice(filled, 2, F.greatest(F.size(filled), F.lit(1))), lambda t: F.trim(t)), "\n"))
        .otherwise(F.array_join(F.concat(F.array(part(4)), rest), "\n"))
        .alias("content"),
        F.col("text").alias("raw_line"),
    ).filter(~is_apple | (F.length("content") > 0))


def parse_lines(lines: DataFrame, by_ranges: bool = False) -> DataFrame:
    """The messages of FIXTURES: system lines dropped, media typed, long texts in chunks, dense ids by chat.

    ``by_ranges`` deals a chat to many tasks by its lines, for chats that are too long for one; ids then take a written table."""
    found = _assembled(lines, by_ranges)
    whatsapp = F.col("source") == "whatsapp"
    kept = found.filter(~whatsapp | ~is_system(F.col("content")))
    short = F.length("content") <= MAX_CHUNK  # most rows never leave the JVM's form
    parts = kept.filter(short).withColumn("parts", F.array("content")).unionByName(kept.filter(~short).withColumn("parts", chunked("content")))
    rows = parts.select("*", F.posexplode("parts").alias("pos", "piece"))
    if by_ranges:
        placed = numbered(rows, [F.col("line_no"), F.col("pos")], "id", start=0, by=("chat_id",))
    else:
        order = Window.partitionBy("chat_id").orderBy("line_no", "pos")
        placed = rows.withColumn("id", (F.row_number().over(order) - 1).cast("long"))
    kind = F.when(whatsapp, media_type(F.col("content")))
    urls = urls_in(F.col("content"))
    return placed.select(
        "chat_id",
        "id",
        "timestamp",
        "sender",
        F.col("piece").alias("content"),
        F.when(F.col("pos") == 0, F.col("raw_line")).otherwise("").alias("raw_line"),
        kind.isNotNull().alias("has_media"),
        kind.alias("media_type"),
        F.when((F.col("pos") == 0) & (F.size(urls) > 0), urls).alias("urls"),
        "source",
        F.when(F.size("parts") > 1, F.col("pos")).alias("chunk_index"),
    )


def parse_chats(chats: DataFrame) -> DataFrame:
    """From chat_id, content to messages."""
    return parse_lines(lines_of(chats))


def parse_stats(messages: DataFrame) -> DataFrame:
    """Per chat: message_count, url_count, senders in order of first message, first and last time."""
    by_sender = messages.groupBy("chat_id", "sender").agg(F.min("id").alias("first_id"))
    senders = by_sender.groupBy("chat_id").agg(F.transform(F.array_sort(F.collect_list(F.struct("first_id", "sender"))), lambda x: x["sender"]).alias("senders"))
    return (
        messages.groupBy("chat_id")
        .agg(
            F.count("*").alias("message_count"),
            F.sum(F.when(F.col("urls").isNull(), 0).otherwise(F.size("urls"))).alias("url_count"),
            F.min("timestamp").alias("start_time"),
            F.max("timestamp").alias("end_time"),
        )
        .join(senders, "chat_id")
    )
