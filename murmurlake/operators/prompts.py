"""Prompts by kind: suggestions with the messages around them, agreements with those before them.

What a prompt asks for is the caller's text; here it gets its context of use, its candidates and its place in the order of requests.
"""

from __future__ import annotations

from collections.abc import Mapping

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from murmurlake.functions.stored import numbered

KINDS = ("suggestion", "agreement")
# How times, candidates and the user's context are written.
CONTEXT_TIME, CANDIDATE_TIME = "yyyy-MM-dd'T'HH:mm", "MMM d, yyyy, h:mm a"
AGREE = " [AGREE]"


def context_lines(messages: Column) -> Column:
    """``[2024-10-11T13:34] John: Hello`` for each message of a context; none for a null one."""
    told = F.transform(messages, lambda m: F.concat(F.lit("["), F.date_format(m["timestamp"], CONTEXT_TIME), F.lit("] "), m["sender"], F.lit(": "), m["content"]))
    return F.coalesce(told, F.array().cast("array<string>"))


def candidate_text(kind: Column, message_id: Column, timestamp: Column, sender: Column, content: Column, before: Column, after: Column) -> Column:
    """A candidate between rules: its id and time, context before, itself behind ``>>>``, and after it what followed, unless it agrees."""
    agrees = F.coalesce(kind == "agreement", F.lit(False))
    head = F.concat(F.lit("ID: "), message_id.cast("string"), F.when(agrees, AGREE).otherwise(""), F.lit(" | "), F.date_format(timestamp, CANDIDATE_TIME))
    own = F.concat(F.lit(">>> "), sender, F.lit(": "), content)
    later = F.when(agrees, F.array().cast("array<string>")).otherwise(context_lines(after))
    return F.array_join(F.concat(F.array(F.lit("\n---"), head), context_lines(before), F.array(own), later, F.array(F.lit("---"))), "\n")


def user_context(home_country: str, timezone: str | None = None) -> str:
    """What a model is told of the user; a country is needed, as places are told apart by it."""
    if not home_country:
        raise ValueError("the home country is needed")
    return f"USER CONTEXT:\nHome country: {home_country}" + (f"\nTimezone: {timezone}" if timezone else "")


def by_kind(candidates: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Suggestions and agreements; a candidate of any other kind is a suggestion."""
    agrees = F.coalesce(F.col("candidate_type") == "agreement", F.lit(False))
    return candidates.filter(~agrees), candidates.filter(agrees)


def prompts_by_kind(candidates: DataFrame, instructions: Mapping[str, str], home_country: str, timezone: str | None = None, size: int = 30) -> DataFrame:
    """request_no, kind, prompt, expected_ids: batches of at most ``size`` candidates of one chat and kind, suggestions before agreements.

    ``candidates``: chat_id, message_id, candidate_type, timestamp, sender, content, context_before, context_after.  ``instructions`` has a text for each of
    ``KINDS``.  A chat's candidates are numbered by ranges, so a batch is the only thing that is ever put together.
    """
    lead = {k: f"{instructions[k]}\n\n{user_context(home_country, timezone)}\n\nMESSAGES:\n" for k in KINDS}
    agrees = F.coalesce(F.col("candidate_type") == "agreement", F.lit(False))
    told = candidates.withColumn("kind", F.when(agrees, KINDS[1]).otherwise(KINDS[0]))
    parts = [F.col(c) for c in ("kind", "message_id", "timestamp", "sender", "content", "context_before", "context_after")]
    rows = told.select("chat_id", agrees.cast("int").alias("last"), "kind", "message_id", candidate_text(*parts).alias("block"))
    placed = numbered(rows, [F.col("message_id")], "place", start=0, by=("last", "chat_id"))
    batches = placed.groupBy("last", "kind", "chat_id", F.floor(F.col("place") / size).alias("batch")).agg(F.array_sort(F.collect_list(F.struct("message_id", "block"))).alias("l"))
    head = F.when(F.col("last") == 1, lead[KINDS[1]]).otherwise(lead[KINDS[0]])
    text = F.concat(head, F.array_join(F.transform("l", lambda x: x["block"]), "\n"), F.lit("\n"))
    made = batches.select("last", "chat_id", "batch", "kind", text.alias("prompt"), F.transform("l", lambda x: x["message_id"]).alias("expected_ids"))
    ordered = numbered(made, [F.col("last"), F.col("chat_id"), F.col("batch")], "request_no", start=0)
    return ordered.select("request_no", "chat_id", "kind", "prompt", "expected_ids")
