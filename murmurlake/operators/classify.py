"""Prompts for a classifier, and reading what it answers; the classifier itself is the caller's function."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from murmurlake.functions.text import activity_id, number_text
from murmurlake.operators.filters import combined_score

# Fixed values.
CATEGORIES = (
    "food nightlife nature arts culture music entertainment events sports fitness wellness shopping travel experiences hobbies gaming learning "
    "home work social family pets other"
).split()
LINK_TYPES = "movie tv_show media web_series video_game physical_game game book comic theatre album song podcast artist".split()
ITEM = (
    "array<struct<msg:string,off:string,title:string,fun:string,int:string,cat:string,wiki:string,placeName:string,placeQuery:string,city:string,"
    "region:string,country:string,image:struct<stock:string,mediaKey:string,preferStock:string>,link:struct<type:string,query:string>>>"
)
DEFAULT_SCORE, MAX_SCORE = 2.5, 5.0


def json_part(response: Column) -> Column:
    """The fenced block, else from the first [ to the last ]."""
    fenced = F.regexp_extract(response, r"(?s)```(?:json)?\s*(.*?)```", 1)
    bare = F.regexp_extract(response, r"(?s)(\[.*\])", 1)
    return F.coalesce(F.nullif(F.trim(fenced), F.lit("")), F.nullif(bare, F.lit("")))


def number(text: Column, fallback: float, most: float) -> Column:
    value = text.try_cast("double")
    return F.when(value.isNull(), fallback).otherwise(F.least(F.lit(most), F.greatest(F.lit(0.0), value)))


def text_or_null(text: Column) -> Column:
    return F.nullif(F.trim(text), F.lit(""))


def parse_responses(responses: DataFrame, strict_offsets: bool = False) -> DataFrame:
    """One row an item whose message was asked for: batch_id, message_id, offset, title, scores, category, places, link."""
    items = F.explode(F.from_json(json_part(F.col("response")), ITEM)).alias("x")
    rows = responses.select("batch_id", "expected_ids", items)
    offset = F.coalesce(F.col("x.off").try_cast("double").cast("int"), F.lit(0))
    category = F.lower(F.trim("x.cat"))
    made = rows.select(
        "batch_id",
        "expected_ids",
        F.col("x.msg").try_cast("double").cast("long").alias("message_id"),
        (F.greatest(F.lit(0), offset) if strict_offsets else offset).alias("offset"),
        text_or_null(F.col("x.title")).alias("title"),
        number(F.col("x.fun"), DEFAULT_SCORE, MAX_SCORE).alias("fun_score"),
        number(F.col("x.int"), DEFAULT_SCORE, MAX_SCORE).alias("interesting_score"),
        F.when(category.isin(*CATEGORIES), category).otherwise("other").alias("category"),
        *[text_or_null(F.col(f"x.{a}")).alias(b) for a, b in (("wiki", "wiki_name"), ("placeName", "place_name"), ("placeQuery", "place_query"), ("city", "city"), ("region", "region"), ("country", "country"))],
        text_or_null(F.col("x.image.mediaKey")).alias("media_key"),
        text_or_null(F.col("x.image.stock")).alias("stock"),
        F.when(F.col("x.link.type").isin(*LINK_TYPES) & text_or_null(F.col("x.link.query")).isNotNull(), F.col("x.link")).alias("link"),
    )
    return made.filter(F.array_contains("expected_ids", F.col("message_id"))).drop("expected_ids")


def failed_batches(responses: DataFrame) -> DataFrame:
    """batch_id, error of the responses that give nothing to go on: 'no_json' without a list, 'bad_json' where it can't be read, 'no_expected_id' where
    it has items, none of them of a message that was asked for.  An empty list is an answer."""
    part = json_part(F.col("response"))
    items = F.from_json(part, ITEM)
    asked = F.exists(items, lambda x: F.array_contains("expected_ids", x["msg"].try_cast("double").cast("long")))
    # What can't be read as a list comes back as nothing, or as one item without any field.
    broken = items.isNull() | (F.size(items) == 0) & ~F.trim(part).rlike(r"(?s)^\[\s*\]$") | F.exists(items, lambda x: x.isNull())
    error = F.when(part.isNull(), "no_json").when(broken, "bad_json").when((F.size(items) > 0) & ~F.coalesce(asked, F.lit(False)), "no_expected_id")
    return responses.select("batch_id", error.alias("error")).filter("error IS NOT NULL")


def to_activities(parsed: DataFrame) -> DataFrame:
    """Rows with a title: capitalised, scored, with an id."""
    title = F.concat(F.upper(F.substring("title", 1, 1)), F.substring("title", 2, 1 << 30))
    made = parsed.filter("title IS NOT NULL").withColumn("activity", title).withColumn("score", combined_score(F.col("fun_score"), F.col("interesting_score")))
    numbers = [number_text(F.col(c)) for c in ("fun_score", "interesting_score", "score")]
    texts = [F.col(c) for c in ("activity", "category", "wiki_name", "place_name", "place_query", "city", "region", "country")]
    fields = [texts[0], *numbers, *texts[1:]]
    return made.withColumn("activity_id", activity_id(*fields)).drop("title")


def at_offset(offset: Column, own: Column, before: Column, after: Column) -> Column:
    """The message an offset means: 0 the candidate, below 0 of the context before it, above 0 of that after it; null beyond."""
    return F.when(offset == 0, own).when(offset < 0, F.try_element_at(before, offset)).otherwise(F.try_element_at(after, offset))


def candidate_block(timestamp: Column, sender: Column, content: Column, before: Column, after: Column) -> Column:
    """Context lines around the candidate, which ``>>>`` marks."""

    def line(m: Column) -> Column:
        return F.concat(m["sender"], F.lit(": "), m["content"])

    own = F.concat(F.lit(">>> ["), F.date_format(timestamp, "MMM d, yyyy, h:mm a"), F.lit("] "), sender, F.lit(": "), content)
    return F.array_join(F.concat(F.transform(before, line), F.array(own), F.transform(after, line)), "\n")


def prompts(candidates: DataFrame, instructions: str) -> DataFrame:
    """batch_id (chat and batch number), prompt, expected_ids; ``candidates`` carries batch_no and contexts."""
    block = candidate_block(*[F.col(c) for c in ("timestamp", "sender", "content", "context_before", "context_after")])
    listed = candidates.groupBy("chat_id", "batch_no").agg(F.array_sort(F.collect_list(F.struct("message_id", block.alias("block")))).alias("l"))
    text = F.array_join(F.transform("l", lambda x: F.concat(F.lit("## "), x["message_id"].cast("string"), F.lit("\n"), x["block"])), "\n\n")
    batch_id = F.concat("chat_id", F.lit("#"), F.col("batch_no").cast("string")).alias("batch_id")
    return listed.select(batch_id, F.concat(F.lit(instructions + "\n\n"), text).alias("prompt"), F.transform("l", lambda x: x["message_id"]).alias("expected_ids"))
