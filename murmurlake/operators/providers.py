"""Requests answered by one of several providers, and the names that models go by."""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from murmurlake.functions.stored import stored

# Short names of models with provider and the provider's own name, the setting that holds a provider's key, the default.
MODELS = {
    "gemini-3-flash": ("google", "gemini-3-flash-preview"),
    "gemini-3-flash-or": ("openrouter", "google/gemini-3-flash-preview"),
    "haiku-4.5": ("anthropic", "claude-haiku-4-5"),
    "haiku-4.5-or": ("openrouter", "anthropic/claude-3-5-haiku-latest"),
    "gpt-5-mini": ("openai", "gpt-5-mini"),
}
KEY_NAMES = {"google": "GOOGLE_AI_API_KEY", "openrouter": "OPENROUTER_API_KEY", "anthropic": "ANTHROPIC_API_KEY", "openai": "OPENAI_API_KEY"}
DEFAULT_MODEL = "gemini-3-flash"

#: The one error that sends a request on to the next provider.
RETRIED = "rate_limit"
_ANSWER = ("text", "error_type", "message", "input_tokens", "output_tokens")


def _of(key: Column, table: dict[str, str]) -> Column:
    return F.try_element_at(F.create_map(*[F.lit(x) for pair in table.items() for x in pair]), key)


def resolved_model(name: Column) -> Column:
    """struct(provider, model, key_name) of a short name; null for an unknown one."""
    provider = _of(name, {k: p for k, (p, _) in MODELS.items()})
    told = F.struct(provider.alias("provider"), _of(name, {k: m for k, (_, m) in MODELS.items()}).alias("model"), _of(provider, KEY_NAMES).alias("key_name"))
    return F.when(provider.isNotNull(), told)


def status_error_type(status: Column) -> Column:
    """The kind of error that a response's status means; null for success."""
    return (
        F.when(status.between(200, 299), None)
        .when(status == 429, "rate_limit")
        .when(status.isin(401, 403), "auth")
        .when(status.isNull(), "network")
        .otherwise("network")
    )


def answered(requests: DataFrame, answers: DataFrame, providers: Sequence[str], cached: DataFrame | None = None) -> DataFrame:
    """One row for each request (request_id): provider, text, error_type, message, input_tokens, output_tokens, tried.

    ``answers`` holds what each provider said (provider, request_id, text, error_type, message, input_tokens, output_tokens).  A round takes the
    requests that are still open to the next provider; only a rate limit leaves a request open, any other error and any text end it.
    Requests whom every provider limited keep that error, from the last one asked, and say that all did.  A request without an answer row counts
    as a network error.  Of several answers one with a text counts, then the least.  ``cached`` (request_id, text) answers before
    any provider, at no tokens.
    """
    rows = requests.select("request_id").distinct()
    done = []
    if cached is not None:
        known = cached.filter("text IS NOT NULL").groupBy("request_id").agg(F.min("text").alias("text"))
        free = F.lit(0).cast("long")
        hits = rows.join(known, "request_id").select(
            "request_id", F.lit("cache").alias("provider"), "text", *[F.lit(None).cast("string").alias(c) for c in ("error_type", "message")],
            free.alias("input_tokens"), free.alias("output_tokens"), F.lit(0).alias("tried"),
        )
        done.append(hits)
        rows = rows.join(known.select("request_id"), "request_id", "left_anti")
    for tried, provider in enumerate(providers, 1):
        rank = F.struct(F.col("text").isNull().alias("none"), *_ANSWER)
        own = answers.filter(F.col("provider") == provider).groupBy("request_id").agg(F.min(rank).alias("a"))
        said = rows.join(own, "request_id", "left")
        failed = F.when(F.col("a.text").isNotNull(), None).otherwise(F.coalesce("a.error_type", F.lit("network")))
        told = said.select(
            "request_id", F.lit(provider).alias("provider"), "a.text", failed.alias("error_type"), F.when(failed.isNotNull(), F.coalesce("a.message", F.lit("no answer"))).alias("message"),
            *[F.coalesce(f"a.{c}", F.lit(0)).cast("long").alias(c) for c in ("input_tokens", "output_tokens")], F.lit(tried).alias("tried"),
        )
        told = stored(told, "answered")
        limited = F.coalesce(F.col("error_type") == RETRIED, F.lit(False))
        if tried == len(providers):
            if tried > 1:
                told = told.withColumn("message", F.when(limited, "All providers rate limited (primary and fallbacks)").otherwise(F.col("message")))
            done.append(told)
        else:
            done.append(told.filter(~limited))
            rows = told.filter(limited).select("request_id")
    return reduce(DataFrame.unionByName, done)
