"""Semantic extraction: messages near a query's vector become candidates."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from murmurlake.operators.candidates import drop_agreements, extract_candidates, merge_best
from murmurlake.operators.context import context_bounds
from murmurlake.operators.stats import SHORT_MESSAGE
from murmurlake.operators.vector import best_query

TOP_K = 500


def queries_of(suggestions: DataFrame, agreements: DataFrame, activity_types: DataFrame) -> DataFrame:
    """One table of queries (query, embedding, query_type); only those of ``agreements`` are agreements, a text in several counts once."""
    parts = [suggestions, agreements, activity_types]
    made = None
    for place, part in enumerate(parts):
        one = part.select("query", "embedding", F.lit(place).alias("_place"))
        made = one if made is None else made.unionByName(one)
    told = made.groupBy("query").agg(F.min_by("embedding", "_place").alias("embedding"), F.max(F.col("_place") == 1).alias("_agrees"))
    return told.select("query", "embedding", F.when(F.col("_agrees"), "agreement").otherwise("suggestion").alias("query_type"))


def semantic_candidates(messages: DataFrame, vectors: DataFrame, queries: DataFrame, least: float, k: int = TOP_K) -> DataFrame:
    """One row a message that is among a query's ``k`` best of its chat at ``least`` or above; its best query decides the type.

    ``vectors``: chat_id, message_id, embedding.  ``queries``: q_idx, query, query_type, embedding.  Messages of up to ten characters aren't
    searched; vectors without a message are dropped.
    """
    searched = messages.filter(F.length("content") > SHORT_MESSAGE)
    known = vectors.join(searched.select("chat_id", F.col("id").alias("message_id")), ["chat_id", "message_id"], "left_semi")
    hits = best_query(known.withColumnRenamed("message_id", "id"), queries.select("q_idx", "embedding"), k, least, within=("chat_id",))
    told = hits.join(queries.select("q_idx", "query", "query_type"), "q_idx")
    return told.join(searched.select("chat_id", "id", "content", "sender", "timestamp"), ["chat_id", "id"]).select(
        "chat_id", F.col("id").alias("message_id"), "content", "sender", "timestamp",
        F.lit("semantic").alias("source_type"), F.col("query").alias("source_name"), F.col("similarity").alias("confidence"), F.col("query_type").alias("candidate_type"),
    )


def all_candidates(messages: DataFrame, semantic: DataFrame, min_confidence: float = 0.5) -> DataFrame:
    """Heuristic and semantic candidates, one row a message: the greater confidence, the heuristic one on ties; then replies to suggestions go."""
    heuristic = extract_candidates(messages, min_confidence)
    merged = merge_best([heuristic, semantic.select(*heuristic.columns)])
    return drop_agreements(merged, context_bounds(messages.select("chat_id", "id", "content")))
