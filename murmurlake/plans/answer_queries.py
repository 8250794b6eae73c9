"""Registered queries of provider fallback, model names and entity resolution, each with the SQL that says the same."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from murmurlake.operators import prompts, providers, resolve
from murmurlake.plans.lookup_queries import ENTRIES, oracle_sql, queries
from murmurlake.plans.queries import _query, _read

__all__ = ["ENTRIES", "oracle_sql", "queries"]


@_query("""
WITH g AS (
  SELECT o_orderkey AS request_id, o_custkey AS c, o_orderstatus AS s, o_orderpriority AS p, floor(o_totalprice)::BIGINT AS price,
    o_orderpriority = '1-URGENT' AS first_limited, o_orderstatus = 'O' AS second_limited, o_custkey % 3 = 0 AS third_limited, o_custkey % 10 = 7 AS cached
  FROM orders)
SELECT request_id,
  CASE WHEN cached THEN 'cache' WHEN NOT first_limited THEN 'google' WHEN NOT second_limited THEN 'anthropic' ELSE 'openai' END AS provider,
  CASE WHEN cached THEN 'kept ' || c WHEN NOT first_limited THEN CASE WHEN p <> '2-HIGH' THEN 'g ' || p END
    WHEN NOT second_limited THEN CASE WHEN s = 'F' THEN 'a ' || price END WHEN NOT third_limited THEN 'o ' || c END AS text,
  CASE WHEN cached THEN NULL WHEN NOT first_limited THEN CASE WHEN p = '2-HIGH' THEN 'auth' END
    WHEN NOT second_limited THEN CASE WHEN s <> 'F' THEN 'network' END WHEN third_limited THEN 'rate_limit' END AS error_type,
  CASE WHEN cached THEN NULL WHEN NOT first_limited THEN CASE WHEN p = '2-HIGH' THEN 'key of ' || s END
    WHEN NOT second_limited THEN CASE WHEN s <> 'F' THEN 'no answer' END
    WHEN third_limited THEN 'All providers rate limited (primary and fallbacks)' END AS message,
  CASE WHEN cached THEN 0 WHEN NOT first_limited THEN 1 WHEN NOT second_limited THEN 2 ELSE 3 END AS tried,
  (CASE WHEN cached OR (first_limited AND second_limited) OR (first_limited AND s <> 'F') OR (NOT first_limited AND p = '2-HIGH') THEN 0 ELSE c END)::BIGINT AS input_tokens
FROM g""")
def provider_fallback(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every order asks three providers: urgent ones are limited by the first, open ones by the second, a third of the customers by the last."""
    o = _read(spark, sf_dir, "orders")
    key, customer, status, priority = (F.col(c) for c in ("o_orderkey", "o_custkey", "o_orderstatus", "o_orderpriority"))

    def said(provider: str, error, message, text, tokens) -> DataFrame:
        return o.select(
            F.lit(provider).alias("provider"), key.alias("request_id"), F.when(error.isNull(), text).alias("text"), error.alias("error_type"), message.alias("message"),
            F.when(error.isNull(), tokens).alias("input_tokens"), F.lit(None).cast("long").alias("output_tokens"), "o_orderstatus",
        )

    limited = F.lit(providers.RETRIED)
    first = said("google", F.when(priority == "1-URGENT", limited).when(priority == "2-HIGH", "auth"), F.concat(F.lit("key of "), status), F.concat(F.lit("g "), priority), customer)
    second = said("anthropic", F.when(status == "O", limited), F.lit("slow down"), F.concat(F.lit("a "), F.floor("o_totalprice").cast("long").cast("string")), customer)
    third = said("openai", F.when(customer % 3 == 0, limited), F.lit("slow down"), F.concat(F.lit("o "), customer.cast("string")), F.lit(0).cast("long"))
    # The second provider never heard of pending orders.
    answers = first.unionByName(second.filter(status.isin("O", "F"))).unionByName(third).drop("o_orderstatus")
    cached = o.filter(customer % 10 == 7).select(key.alias("request_id"), F.concat(F.lit("kept "), customer.cast("string")).alias("text"))
    made = providers.answered(o.select(key.alias("request_id")), answers, ("google", "anthropic", "openai"), cached)
    return made.select("request_id", "provider", "text", "error_type", "message", "tried", "input_tokens")


@_query("""
WITH t AS (
  SELECT event_id, event_type AS name, CASE event_type WHEN 'view' THEN 'gemini-3-flash' WHEN 'click' THEN 'gemini-3-flash-or' WHEN 'purchase' THEN 'haiku-4.5'
    WHEN 'signup' THEN 'haiku-4.5-or' ELSE 'gpt-5-mini' END || CASE WHEN event_id % 9 = 0 THEN '?' ELSE '' END AS alias FROM events)
SELECT event_id,
  CASE alias WHEN 'gemini-3-flash' THEN 'google' WHEN 'gemini-3-flash-or' THEN 'openrouter' WHEN 'haiku-4.5' THEN 'anthropic'
    WHEN 'haiku-4.5-or' THEN 'openrouter' WHEN 'gpt-5-mini' THEN 'openai' END AS provider,
  CASE alias WHEN 'gemini-3-flash' THEN 'gemini-3-flash-preview' WHEN 'gemini-3-flash-or' THEN 'google/gemini-3-flash-preview' WHEN 'haiku-4.5' THEN 'claude-haiku-4-5'
    WHEN 'haiku-4.5-or' THEN 'anthropic/claude-3-5-haiku-latest' WHEN 'gpt-5-mini' THEN 'gpt-5-mini' END AS model,
  CASE alias WHEN 'gemini-3-flash' THEN 'GOOGLE_AI_API_KEY' WHEN 'gemini-3-flash-or' THEN 'OPENROUTER_API_KEY' WHEN 'haiku-4.5' THEN 'ANTHROPIC_API_KEY'
    WHEN 'haiku-4.5-or' THEN 'OPENROUTER_API_KEY' WHEN 'gpt-5-mini' THEN 'OPENAI_API_KEY' END AS key_name
FROM t""")
def model_aliases(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each event names a model by its type; every ninth name is unknown."""
    kind = F.col("event_type")
    alias = F.when(kind == "view", "gemini-3-flash").when(kind == "click", "gemini-3-flash-or").when(kind == "purchase", "haiku-4.5").when(kind == "signup", "haiku-4.5-or").otherwise("gpt-5-mini")
    told = providers.resolved_model(F.concat(alias, F.when(F.col("event_id") % 9 == 0, "?").otherwise("")))
    return _read(spark, sf_dir, "events").select("event_id", *[told[c].alias(c) for c in ("provider", "model", "key_name")])


@_query("""
WITH p AS (
  SELECT p_partkey AS item_id, p_name || ' ' || p_partkey AS query, p_size AS size, p_brand AS brand,
    CASE WHEN p_size % 3 = 0 THEN 'book' WHEN p_size % 3 = 1 THEN 'movie' ELSE 'video_game' END AS type FROM part),
s AS (
  SELECT *, CASE WHEN size > 30 AND size % 4 > 0 THEN 'items' WHEN type = 'book' AND size % 2 = 0 AND brand < 'Brand#4' THEN 'books'
    WHEN size % 5 = 0 THEN 'search' WHEN size % 5 < 3 THEN 'heuristic' WHEN size % 7 > 0 THEN 'ranking' ELSE 'deferred' END AS stage FROM p)
SELECT item_id, CASE WHEN stage IN ('search', 'deferred') THEN 'failed' ELSE 'found' END AS outcome, stage,
  CASE stage WHEN 'items' THEN 'wikidata' WHEN 'books' THEN 'openlibrary' WHEN 'heuristic' THEN 'heuristic' WHEN 'ranking' THEN CASE WHEN size % 2 = 0 THEN 'heuristic' ELSE 'ai' END END AS source,
  CASE stage WHEN 'books' THEN query || ': a tale' WHEN 'search' THEN NULL WHEN 'deferred' THEN NULL ELSE query END AS title,
  CASE stage WHEN 'items' THEN CASE WHEN size % 4 = 1 AND type = 'movie' THEN 'https://www.imdb.com/title/tt' || item_id || '/'
      WHEN size % 4 = 3 THEN 'https://en.wikipedia.org/wiki/P' || item_id ELSE 'https://www.wikidata.org/wiki/Q' || item_id END
    WHEN 'books' THEN 'https://openlibrary.org/works/OL' || item_id
    WHEN 'heuristic' THEN CASE type WHEN 'book' THEN 'https://www.goodreads.com/book/show/' || item_id WHEN 'movie' THEN 'https://www.imdb.com/title/tt' || item_id
      ELSE 'https://store.steampowered.com/app/' || item_id END
    WHEN 'ranking' THEN CASE WHEN size % 2 = 0 THEN 'https://en.wikipedia.org/wiki/B' ELSE 'https://example.org/b' END || item_id END AS url
FROM s""")
def entity_cascade(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Parts as things to resolve; what their size and brand say decides which stage knows them."""
    size, key = F.col("p_size"), F.col("p_partkey").cast("string")
    kind = F.when(size % 3 == 0, "book").when(size % 3 == 1, "movie").otherwise("video_game")
    p = _read(spark, sf_dir, "part").select(F.col("p_partkey").alias("item_id"), F.concat("p_name", F.lit(" "), key).alias("query"), kind.alias("type"), F.col("p_brand").alias("author"), "p_size", "p_brand", "p_partkey")

    def made(*parts: str | Column) -> Column:
        return F.concat(*[F.lit(x) if isinstance(x, str) else x for x in parts])

    # A lesser candidate stands beside each; of every fourth the best one has nothing to show.
    ids = F.when(size % 4 == 1, F.create_map(F.lit("imdb"), made("tt", key)))
    image, article = F.when(size % 4 == 2, made("i", key, ".jpg")), F.when(size % 4 == 3, made("https://en.wikipedia.org/wiki/P", key))
    known = p.filter("p_size > 30")
    best = known.select("query", "type", made("Q", key).alias("qid"), F.col("query").alias("label"), size.alias("sitelinks"), ids.alias("ids"), image.alias("image_url"), article.alias("wikipedia_url"))
    lesser = known.select("query", "type", made("Z", key).alias("qid"), F.lit("other").alias("label"), F.lit(90).alias("sitelinks"), F.lit(None).cast("map<string,string>").alias("ids"), F.lit("x").alias("image_url"), F.lit("y").alias("wikipedia_url"))
    wrong = F.when(F.col("p_brand") < "Brand#4", F.col("author")).otherwise("nobody")
    books = p.filter("p_size % 2 = 0").select(made(F.col("query"), ": a tale").alias("title"), wrong.alias("author"), made("OL", key).alias("work_id"), F.lit(1).alias("rank"), F.lit("c").alias("cover_url"))
    own = F.when(kind == "book", made("https://www.goodreads.com/book/show/", key)).when(kind == "movie", made("https://www.imdb.com/title/tt", key)).otherwise(made("https://store.steampowered.com/app/", key))
    told = F.when(size % 2 == 0, made("https://en.wikipedia.org/wiki/B", key)).otherwise(made("https://example.org/b", key))
    title = F.when(size % 5 < 3, made(F.col("query"), " - a page")).otherwise("something else")
    hits = p.filter("p_size % 5 > 0").select("item_id", F.explode(F.array(F.struct(F.lit(1).alias("rank"), title.alias("title"), own.alias("url")), F.struct(F.lit(2).alias("rank"), F.lit("b").alias("title"), told.alias("url")))).alias("h")).select("item_id", "h.*")
    rankings = p.filter("p_size % 7 > 0").select("item_id", F.array(F.lit(9), F.lit(0), F.lit(2), F.lit(1)).alias("indexes"))
    return resolve.resolve(p, best.unionByName(lesser), books, hits, rankings).select("item_id", "outcome", "stage", "source", "title", "url")


@_query(r"""
WITH m AS (
  SELECT conv_id AS chat_id, row_number() OVER (PARTITION BY conv_id ORDER BY turn) - 1 AS id, role, coalesce(text, '') AS text,
    make_timestamp((1704067200 + conv_id * 86400 + turn * 4000) * 1000000) AS ts FROM conversations),
l AS (SELECT *, '[' || strftime(ts, '%Y-%m-%dT%H:%M') || '] ' || role || ': ' || text AS line FROM m),
c AS (
  SELECT *, CASE WHEN role = 'assistant' THEN 'agreement' ELSE 'suggestion' END AS kind,
    list(line) OVER (PARTITION BY chat_id ORDER BY id ROWS BETWEEN 2 PRECEDING AND 1 PRECEDING) AS before,
    list(line) OVER (PARTITION BY chat_id ORDER BY id ROWS BETWEEN 1 FOLLOWING AND 2 FOLLOWING) AS after FROM l),
t AS (
  SELECT *, chr(10) || '---' || chr(10) || 'ID: ' || id || CASE WHEN kind = 'agreement' THEN ' [AGREE]' ELSE '' END || ' | ' || strftime(ts, '%b %-d, %Y, %-I:%M %p')
    || chr(10) || coalesce(array_to_string(before, chr(10)) || chr(10), '') || '>>> ' || role || ': ' || text
    || CASE WHEN kind = 'suggestion' THEN coalesce(chr(10) || array_to_string(after, chr(10)), '') ELSE '' END || chr(10) || '---' AS block,
    (row_number() OVER (PARTITION BY kind, chat_id ORDER BY id) - 1) // 3 AS batch FROM c),
b AS (SELECT kind, chat_id, batch, string_agg(block, chr(10) ORDER BY id) AS blocks, list(id ORDER BY id) AS ids FROM t GROUP BY ALL)
SELECT row_number() OVER (ORDER BY kind DESC, chat_id, batch) - 1 AS request_no, chat_id, kind, len(ids) AS n,
  sha256(CASE kind WHEN 'agreement' THEN 'What is agreed to?' ELSE 'What is suggested?' END || chr(10) || chr(10) || 'USER CONTEXT:' || chr(10) || 'Home country: New Zealand' || chr(10)
    || 'Timezone: UTC' || chr(10) || chr(10) || 'MESSAGES:' || chr(10) || blocks || chr(10)) AS prompt
FROM b""")
def prompt_batches(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every turn is a candidate: what assistants say agrees, the rest suggests."""
    turns = _read(spark, sf_dir, "conversations")
    order = Window.partitionBy("conv_id").orderBy("turn")
    at = F.timestamp_seconds(F.lit(1_704_067_200) + F.col("conv_id") * 86_400 + F.col("turn") * 4_000)
    rows = turns.select(F.col("conv_id").alias("chat_id"), (F.row_number().over(order) - 1).cast("long").alias("message_id"), at.alias("timestamp"), F.col("role").alias("sender"), F.coalesce("text", F.lit("")).alias("content"))
    near = Window.partitionBy("chat_id").orderBy("message_id")
    entry = F.struct("timestamp", "sender", "content")
    told = rows.withColumns(
        {
            "candidate_type": F.when(F.col("sender") == "assistant", "agreement").otherwise("suggestion"),
            "context_before": F.collect_list(entry).over(near.rowsBetween(-2, -1)),
            "context_after": F.collect_list(entry).over(near.rowsBetween(1, 2)),
        }
    )
    made = prompts.prompts_by_kind(told, {"suggestion": "What is suggested?", "agreement": "What is agreed to?"}, "New Zealand", "UTC", size=3)
    return made.select("request_no", "chat_id", "kind", F.size("expected_ids").cast("long").alias("n"), F.sha2("prompt", 256).alias("prompt"))
