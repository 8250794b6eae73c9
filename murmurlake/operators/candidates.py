"""Candidate extraction: rules, addresses, merges, removal of replies."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from murmurlake.functions.stored import numbered
from murmurlake.functions.text import urls_in
from murmurlake.functions.urls import PLATFORM_CONFIDENCE, PLATFORM_OF_KIND, lookup, url_kind
from murmurlake.operators import patterns as P
from murmurlake.operators.context import context_bounds, neighbours


def pattern_matches(messages: DataFrame, min_confidence: float = 0.5, custom: Sequence[str] = (), more_exclusions: Sequence[str] = ()) -> DataFrame:
    found = messages.filter(~P.excluded(F.col("content"), more_exclusions))
    # A generator, not a column: it is evaluated once and what it yields is what matched.
    hit = F.explode(F.array_compact(F.array(P.first_pattern(F.col("content"), min_confidence, custom)))).alias("_m")
    return found.select("chat_id", "id", "content", "sender", "timestamp", hit).select(
        "chat_id", F.col("id").alias("message_id"), "content", "sender", "timestamp",
        F.lit("regex").alias("source_type"), F.col("_m.pattern").alias("source_name"), F.col("_m.confidence").alias("confidence"), F.col("_m.kind").alias("candidate_type"),
    )


def url_matches(messages: DataFrame, min_confidence: float = 0.5) -> DataFrame:
    """Exclusions don't apply here; the first address decides on inclusion, the best on confidence."""
    some = messages.filter(F.size("urls") > 0).filter(P.includes_url(F.get("urls", F.lit(0)), F.col("content"))).withColumn("_u", P.best_url(F.col("urls")))
    scored = some.withColumn("_c", P.url_boosted(F.col("_u.confidence"), F.col("content"))).filter(F.col("_c") >= min_confidence)
    return scored.select(
        "chat_id", F.col("id").alias("message_id"), "content", "sender", "timestamp",
        F.lit("url").alias("source_type"), F.col("_u.kind").alias("source_name"), F.col("_c").alias("confidence"), F.lit("suggestion").alias("candidate_type"),
    )


def merge_best(parts: Sequence[DataFrame], key: Sequence[str] = ("chat_id", "message_id")) -> DataFrame:
    """Union with one row a key: greatest confidence, the earlier part on ties."""
    made = None
    for i, part in enumerate(parts):
        one = part.withColumn("_part", F.lit(i))
        made = one if made is None else made.unionByName(one)
    best = Window.partitionBy(*key).orderBy(F.desc("confidence"), "_part")
    return made.withColumn("_n", F.row_number().over(best)).filter("_n = 1").drop("_n", "_part")


def merge_first(parts: Sequence[DataFrame], key: Sequence[str] = ("chat_id", "message_id")) -> DataFrame:
    """Union with one row a key, from the earliest part that has it."""
    made = None
    for i, part in enumerate(parts):
        one = part.withColumn("_part", F.lit(i))
        made = one if made is None else made.unionByName(one)
    first = Window.partitionBy(*key).orderBy("_part", F.desc("confidence"))
    return made.withColumn("_n", F.row_number().over(first)).filter("_n = 1").drop("_n", "_part")


def drop_agreements(candidates: DataFrame, bounds: DataFrame) -> DataFrame:
    """Agreements within the window of a suggestion of their chat go, the suggestion's own message excepted.

    ``bounds``: chat_id, id, first_id, last_id.  Windows are dealt to blocks of ids, so the range join is an equality join on (chat, block).
    """
    block = 16
    windows = (
        candidates.filter("candidate_type = 'suggestion'")
        .join(bounds.select("chat_id", F.col("id").alias("message_id"), "first_id", "last_id"), ["chat_id", "message_id"])
        .select("chat_id", F.col("message_id").alias("target"), "first_id", "last_id")
        .withColumn("_block", F.explode(F.sequence(F.expr(f"first_id div {block}"), F.expr(f"last_id div {block}"))))
        .alias("w")
    )
    replies = candidates.filter("candidate_type = 'agreement'").withColumn("_block", F.expr(f"message_id div {block}"))
    within = (
        (F.col("r.chat_id") == F.col("w.chat_id"))
        & (F.col("r._block") == F.col("w._block"))
        & F.col("r.message_id").between(F.col("w.first_id"), F.col("w.last_id"))
        & (F.col("r.message_id") != F.col("w.target"))
    )
    kept = replies.alias("r").join(windows, within, "left_anti").drop("_block")
    return candidates.filter("candidate_type <> 'agreement'").unionByName(kept)


def extract_candidates(messages: DataFrame, min_confidence: float = 0.5, custom: Sequence[str] = ()) -> DataFrame:
    """The heuristic extraction: rules and addresses, the better of both for a message, replies to suggestions removed."""
    merged = merge_best([pattern_matches(messages, min_confidence, custom), url_matches(messages, min_confidence)])
    return drop_agreements(merged, context_bounds(messages.select("chat_id", "id", "content")))


def activity_links(messages: DataFrame, min_confidence: float = 0.3) -> DataFrame:
    """One row an eligible address, with intent, type and confidence."""
    near = neighbours(messages).filter(F.size("urls") > 0)
    rows = near.select("*", F.posexplode("urls").alias("url_no", "url")).withColumn("kind", url_kind(F.col("url"))).filter("kind <> 'website'")
    text = F.concat_ws(" ", F.array_join("before", " "), "content", F.array_join("after", " "))
    rows = rows.withColumn("platform", lookup(F.col("kind"), PLATFORM_OF_KIND, "other")).withColumn("_text", text)
    rows = rows.withColumns({"keywords": P.phrase_hits(F.col("_text")), "emojis": P.emoji_hits(F.col("_text"))})
    rows = rows.withColumn("intent", P.intent_score(F.col("keywords"), F.col("emojis")))
    rows = rows.withColumn("inferred_type", P.inferred_type(F.col("platform"), F.col("_text"), F.col("intent")))
    confidence = F.least(
        F.lit(1.0), lookup(F.col("platform"), PLATFORM_CONFIDENCE, 0.3) + F.col("intent") * 0.3 + F.when(F.col("inferred_type") != "unknown", 0.1).otherwise(0.0)
    )
    return rows.withColumn("confidence", confidence).filter(F.col("confidence") >= min_confidence).select(
        "chat_id", F.col("id").alias("message_id"), "url_no", "url", "platform", "intent", "inferred_type", "confidence", "keywords", "emojis"
    )


def quick_scan(messages: DataFrame, min_confidence: float = 0.5, max_messages: int | None = None) -> tuple[DataFrame, DataFrame]:
    """Candidates, and counts by chat over all messages; ``max_messages`` limits what is searched, by id."""
    searched = messages if max_messages is None else messages.filter(F.col("id") < max_messages)
    found = extract_candidates(searched, min_confidence)
    counts = found.groupBy("chat_id").agg(F.count_if(F.col("source_type") == "regex").alias("regex_matches"), F.count_if(F.col("source_type") == "url").alias("url_matches"))
    return found, counts


def distinct_addresses(rows: DataFrame) -> DataFrame:
    """place (0, 1, ...), url: the different addresses of candidates and the messages around them, by where they stand first.

    ``rows``: chat_id, message_id, content, context_before, context_after.  An address is combined in the map tasks, so a common one is one row each.
    """
    around = [F.coalesce(F.transform(c, lambda m: m["content"]), F.array().cast("array<string>")) for c in ("context_before", "context_after")]
    texts = F.concat(around[0], F.array("content"), around[1])
    told = rows.select("chat_id", "message_id", F.posexplode(F.flatten(F.transform(F.array_compact(texts), urls_in))).alias("pos", "url"))
    first = told.groupBy("url").agg(F.min(F.struct("chat_id", "message_id", "pos")).alias("at"))
    return numbered(first, [F.col("at.chat_id"), F.col("at.message_id"), F.col("at.pos")], "place", start=0).select("place", "url")
