"""Counts that single stages report; each is one aggregate with partial sums."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from murmurlake.functions.text import token_estimate

# Sources of images as the statistics count them; messages this short aren't embedded; requests of an embedding batch.
IMAGE_SOURCES = ("media_library", "cdn", "google_places", "wikipedia", "pexels", "pixabay", "user_upload")
SHORT_MESSAGE, EMBEDDING_BATCH = 10, 100


def _long(column: Column, name: str) -> Column:
    return F.coalesce(column, F.lit(0)).cast("long").alias(name)


def parsed(messages: DataFrame) -> DataFrame:
    """By chat: messages, senders, messages that have addresses, times of the first and the last message by place."""
    return messages.groupBy("chat_id").agg(
        F.count("*").alias("message_count"),
        F.count_distinct("sender").alias("sender_count"),
        F.count_if(F.size("urls") > 0).alias("url_count"),
        F.min_by("timestamp", "id").alias("start_at"),
        F.max_by("timestamp", "id").alias("end_at"),
    )


def to_embed(messages: DataFrame) -> DataFrame:
    """Messages long enough to embed, those skipped, estimated tokens and batches."""
    long_ = F.length("content") > SHORT_MESSAGE
    made = messages.agg(
        F.count_if(long_).alias("to_embed"),
        (F.count("*") - F.count_if(long_)).alias("skipped"),
        _long(F.sum(F.when(long_, token_estimate(F.col("content")))), "total_tokens"),
    )
    return made.withColumn("batches", F.ceil(F.col("to_embed") / EMBEDDING_BATCH).cast("long"))


def places(activities: DataFrame) -> DataFrame:
    """Activities by where their coordinates come from (``place_lookup_source`` of the place cascade), and those without."""
    located = F.col("latitude").isNotNull() & F.col("longitude").isNotNull()
    source = F.col("place_lookup_source")
    return activities.agg(
        F.count("*").alias("processed"),
        F.count_if(located).alias("geocoded"),
        F.count_if(located & (source == "url")).alias("from_maps_url"),
        F.count_if(located & (source == "geocode")).alias("from_geocoding"),
        F.count_if(located & source.isin("places", "title")).alias("from_place_search"),
        F.count_if(~located).alias("failed"),
    )


def images(found: DataFrame) -> DataFrame:
    """Images by source; a null source is an activity without an image."""
    source = F.col("source")
    by_source = [F.count_if(source == s).alias(f"from_{s}") for s in IMAGE_SOURCES]
    return found.agg(F.count("*").alias("processed"), F.count(source).alias("found"), *by_source, F.count_if(source.isNull()).alias("failed"))


def links(activities: DataFrame, resolvable: tuple[str, ...]) -> DataFrame:
    """Links told, resolved, failed and skipped; columns has_link, link_type, resolved_url."""
    needed = F.coalesce(F.col("link_type").isin(*resolvable), F.lit(False)) & F.col("has_link")
    done = F.coalesce(F.col("resolved_url"), F.lit("")) != ""
    made = activities.agg(F.count("*").alias("processed"), F.count_if(F.col("has_link")).alias("with_hints"), F.count_if(needed).alias("_needed"), F.count_if(done).alias("resolved"))
    return made.select("processed", "with_hints", "resolved", (F.col("_needed") - F.col("resolved")).alias("failed"), (F.col("with_hints") - F.col("_needed")).alias("skipped"))


def usage_total(usage: DataFrame, counts: tuple[str, ...]) -> DataFrame:
    """Sum of the usage of many calls; nothing counts as 0."""
    return usage.agg(*[_long(F.sum(c), c) for c in counts])


def report_header(activities: DataFrame) -> DataFrame:
    """Activities, those with coordinates, distinct senders of their messages."""
    located = F.col("latitude").isNotNull() & F.col("longitude").isNotNull()
    # A row without messages still counts as an activity; its position of null is counted once.
    rows = activities.select(located.alias("located"), F.posexplode_outer(F.transform("messages", lambda m: m["sender"])).alias("n", "sender"))
    first = F.coalesce(F.col("n"), F.lit(0)) == 0
    return rows.agg(F.count_if(first).alias("total"), F.count_if(first & F.col("located")).alias("geocoded"), F.count_distinct("sender").alias("senders"))
