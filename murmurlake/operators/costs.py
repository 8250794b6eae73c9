"""Usage and cost; money in millionths of a dollar."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

# Prices of a request, and the estimator's assumptions.
REQUEST_MICROS = {"places": 17_000, "geocoding": 5_000, "places_photo": 7_000, "pixabay": 0, "pexels": 0}
TOKENS_PER_MESSAGE, MESSAGES_PER_ACTIVITY, TOKENS_PER_ACTIVITY = 80, 150, 150
GEOCODABLE, LOW, HIGH = 0.7, 0.6, 1.8
# Dollars a million tokens (in, out) of language models, (in) of embedding models, and the models taken by default.
MODEL_PRICES = {
    "gemini-3-flash-preview": ("google", 0.5, 3.0),
    "gemini-3-pro": ("google", 2.0, 12.0),
    "claude-haiku-4-5": ("anthropic", 1.0, 5.0),
    "claude-sonnet-4-5": ("anthropic", 3.0, 15.0),
    "claude-opus-4-1": ("anthropic", 15.0, 75.0),
    "gpt-5-mini": ("openai", 0.25, 2.0),
    "gpt-5": ("openai", 1.25, 10.0),
}
EMBEDDING_PRICES = {"text-embedding-3-small": 0.02, "text-embedding-3-large": 0.13, "text-embedding-ada-002": 0.1}
DEFAULT_MODELS = {"google": "gemini-3-flash-preview", "anthropic": "claude-haiku-4-5", "openai": "gpt-5-mini", "openrouter": "google/gemini-3-flash-preview"}
DEFAULT_EMBEDDING_MODELS = {"openai": "text-embedding-3-large", "google": "text-embedding-004"}


def micros_to_cents(micros: Column) -> Column:
    return F.ceil(micros / 10_000).cast("long")


def cents_to_micros(cents: Column) -> Column:
    return cents * 10_000


def _price(model: Column, prices: dict[str, float]) -> Column:
    known = F.try_element_at(F.create_map(*[F.lit(x) for kv in prices.items() for x in kv]), model)
    return F.coalesce(known, F.raise_error(F.concat(F.lit("unknown model: "), model)).cast("double"))


def embedding_cost(model: Column, tokens: Column) -> Column:
    """Millionths of a dollar; an unknown model raises an error."""
    return _price(model, EMBEDDING_PRICES) * tokens


def completion_cost(model: Column, input_tokens: Column, output_tokens: Column) -> Column:
    """Millionths of a dollar; an unknown model raises an error."""
    read, written = ({m: p[i] for m, p in MODEL_PRICES.items()} for i in (1, 2))
    return _price(model, read) * input_tokens + _price(model, written) * output_tokens


def price_table(spark: SparkSession) -> DataFrame:
    """The language models as ``model_usage`` reads them."""
    return spark.createDataFrame([(m, *p) for m, p in MODEL_PRICES.items()], "model string, provider string, input_token_price double, output_token_price double")


def format_micros(micros: Column) -> Column:
    dollars = micros / 1_000_000.0
    return F.when(F.abs(dollars) < 0.01, F.format_string("$%.4f", dollars)).otherwise(F.format_string("$%.2f", dollars))


def model_usage(calls: DataFrame, pricing: DataFrame) -> DataFrame:
    """Up to two usage rows a call (model, input_tokens, output_tokens); an unknown model raises an error."""
    priced = calls.join(pricing, "model", "left")  # Spark broadcasts it if it is small
    known = F.when(F.col("provider").isNull(), F.raise_error(F.concat(F.lit("unknown model: "), "model"))).otherwise(F.col("provider"))

    def part(resource: str, tokens: str, price: str) -> Column:
        quantity = F.col(tokens).cast("double")
        return F.struct(F.lit(resource).alias("resource"), quantity.alias("quantity"), (quantity * F.col(price)).alias("cost_micros"))

    both = F.array(part("ai_input_tokens", "input_tokens", "input_token_price"), part("ai_output_tokens", "output_tokens", "output_token_price"))
    return priced.select("model", known.alias("provider"), F.explode(F.filter(both, lambda x: x["quantity"] > 0)).alias("u")).select("model", "provider", "u.*")


def request_usage(calls: DataFrame) -> DataFrame:
    """Usage rows of counted requests (resource, provider, requests)."""
    table = F.create_map(*[F.lit(x) for kv in REQUEST_MICROS.items() for x in kv])
    quantity = F.col("requests").cast("double")
    return calls.filter("requests > 0").select("resource", "provider", quantity.alias("quantity"), (quantity * F.element_at(table, F.col("resource"))).alias("cost_micros"))


def summary(usage: DataFrame) -> DataFrame:
    """resource, provider, quantity, cost_micros, cents: by resource, by provider and in all, in one pass."""
    sets = usage.groupingSets([["resource"], ["provider"], []], "resource", "provider")
    made = sets.agg(F.sum("quantity").alias("quantity"), F.sum("cost_micros").alias("cost_micros"))
    return made.withColumn("cents", micros_to_cents(F.col("cost_micros")))


def estimate(chats: DataFrame, input_price: float, output_price: float, embedding_price: float) -> DataFrame:
    """Adds the estimated numbers and costs for ``message_count`` messages; prices in dollars a million tokens.

    The total is rounded up to cents; the range follows from those cents.
    """
    n = F.col("message_count")
    activities = F.ceil(n / MESSAGES_PER_ACTIVITY)
    geocodable = F.ceil(activities * GEOCODABLE)
    tokens = n * TOKENS_PER_MESSAGE
    classified = tokens * input_price + activities * TOKENS_PER_ACTIVITY * output_price
    micros = tokens * embedding_price + classified + geocodable * REQUEST_MICROS["places"]
    cents = micros_to_cents(micros)
    low, high = F.floor(cents * LOW).cast("long"), F.ceil(cents * HIGH).cast("long")
    return chats.withColumns(
        {
            "tokens": tokens.cast("long"),
            "activities": activities.cast("long"),
            "geocodable": geocodable.cast("long"),
            "cost_micros": micros.cast("double"),
            "cents": cents,
            "low_cents": low,
            "high_cents": high,
            "range": F.format_string("$%.2f - $%.2f", low / 100.0, high / 100.0),
        }
    )
