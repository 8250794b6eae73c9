"""Registered queries over the driver's tables, each with the SQL that says the same.

The tables hold no chats about plans, so ``messages`` derives some from ``conversations``: a phrase of a fixed list, then the turn's text.
"""

from __future__ import annotations

import datetime
from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from murmurlake.functions import text as T
from murmurlake.functions import urls as U
from murmurlake.operators import candidates, classify, clustering, context, costs, enrich, filters, fingerprint, media, pages, platforms, vector
from murmurlake.operators import patterns as P
from murmurlake.sources import chat, sinks
from murmurlake.streaming import chat_stream

PHRASES = (
    "we should try the new cafe",
    "let's go to the beach",
    "sounds fun, i'm keen",
    "see https://maps.google.com/?q=-36.85,174.76 looks good",
    "i want to see that exhibition",
    "can we go hiking",
    "check this out https://www.instagram.com/p/abc123/",
    "we need to talk about it",
    "dentist appointment, we should go",
    "bucket list: https://www.youtube.com/watch?v=dQw4w9WgXcQ.",
    "",
    "that would be fun to do",
    "https://www.eventbrite.com/e/some-show-123456789012 this place",
    "next time we visit the museum",
    "hello",
    "we should not worry",
)
SITES = (
    "https://www.youtube.com/watch?v=dQw4w9WgXcQ",
    "https://youtu.be/abcdefghijk",
    "https://www.tiktok.com/@a/video/7012345678901234567",
    "https://www.reddit.com/r/x/comments/1abcd2/title/",
    "https://www.google.com/maps/@-41.28,174.77,15z",
    "https://www.airbnb.com/rooms/12345?x=1",
    "https://www.facebook.com/events/99",
    "https://www.facebook.com/groups/walks",
    "https://www.netflix.com/title/1",
    "https://example.org/page#top",
)


def _read(spark: SparkSession, sf_dir: str, table: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{table}.parquet")


def _pick(values: tuple[str, ...], index: Column) -> Column:
    return F.element_at(F.array(*[F.lit(v) for v in values]), (index % len(values) + 1).cast("int"))


def _sql_list(values: tuple[str, ...]) -> str:
    return "[" + ", ".join("'" + v.replace("'", "''") + "'" for v in values) + "]"


def messages(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = _read(spark, sf_dir, "conversations")
    place = F.col("conv_id") * 7 + F.col("turn")
    content = F.concat(_pick(PHRASES, place), F.lit(" "), F.coalesce("text", F.lit("")))
    order = Window.partitionBy("conv_id").orderBy("turn")
    return rows.select(
        F.col("conv_id").alias("chat_id"),
        (F.row_number().over(order) - 1).cast("long").alias("id"),
        F.timestamp_seconds(F.lit(1_704_067_200) + F.col("conv_id") * 86_400 + F.col("turn") * 3_600).alias("timestamp"),
        F.col("role").alias("sender"),
        content.alias("content"),
        T.urls_in(content).alias("urls"),
    )


MESSAGES = f"""
messages AS (
  SELECT conv_id AS chat_id, row_number() OVER (PARTITION BY conv_id ORDER BY turn) - 1 AS id,
    make_timestamp((1704067200 + conv_id * 86400 + turn * 3600) * 1000000) AS ts, role AS sender,
    {_sql_list(PHRASES)}[(conv_id * 7 + turn) % {len(PHRASES)} + 1] || ' ' || coalesce(text, '') AS content
  FROM conversations),
linked AS (
  SELECT *, list_transform(regexp_extract_all(content, 'https?://[^\\s<>"'')\\]]+'), lambda u: regexp_replace(u, '[.,;:!?]+$', '')) AS urls
  FROM messages)"""

ENTRIES: dict[str, tuple[Callable[[SparkSession, str], DataFrame], str | None]] = {}


def _query(sql: str | None = None) -> Callable:
    def add(f: Callable[[SparkSession, str], DataFrame]) -> Callable:
        ENTRIES[f.__name__] = (f, sql)
        return f

    return add


def _re(p: str) -> str:
    return p.replace("'", "''")


def _kind_sql(url: str) -> str:
    whens = " ".join(
        f"WHEN {' OR '.join(f'contains(lower({url}), {chr(39)}{p}{chr(39)})' for p in parts)} THEN '{kind}'" for kind, parts in U.URL_KINDS
    )
    return f"CASE {whens} ELSE 'website' END"


def _map_sql(column: str, table: dict, default: str) -> str:
    return f"CASE {column} " + " ".join(f"WHEN '{k}' THEN {v if not isinstance(v, str) else repr(v)}" for k, v in table.items()) + f" ELSE {default} END"


def _rule_sql() -> str:
    """The rules for an engine without look-ahead: what must not follow is taken out before the search."""
    whens = []
    for name, regex, confidence, kind in P.PATTERNS:
        head, _, tail = regex.partition("(?!")
        if tail:
            gone = f"regexp_replace(content, '{_re(head)}{_re(tail.rsplit(')', 1)[0])}', '', 'gi')"
            test = f"regexp_matches({gone}, '{_re(head)}', 'i')"
        else:
            test = f"regexp_matches(content, '{_re(regex)}', 'i')"
        whens.append(f"WHEN {test} THEN {{'pattern': '{name}', 'confidence': {confidence}::DOUBLE, 'kind': '{kind}'}}")
    return "CASE " + " ".join(whens) + " END"


_EXCLUDED = f"regexp_matches(content, '{_re('|'.join(P.EXCLUSIONS))}', 'i')"
_KEYWORD = f"regexp_matches(content, '{_re('|'.join(P.KEYWORDS))}', 'i')"
_PHRASE = "(" + " OR ".join(f"contains(lower(content), '{_re(p)}')" for p in P.PHRASES) + ")"
RULED = f"""
ruled AS (
  SELECT chat_id, id AS message_id, r.pattern AS source_name, least(1.0::DOUBLE, r.confidence + CASE WHEN {_KEYWORD} THEN 0.15 ELSE 0 END::DOUBLE) AS confidence,
    r.kind AS candidate_type, 'regex' AS source_type
  FROM (SELECT *, {_rule_sql()} AS r FROM linked WHERE NOT {_EXCLUDED}) WHERE r IS NOT NULL)"""
ADDRESSED = f"""
kinds AS (
  SELECT *, {_kind_sql('urls[1]')} AS k1, list_transform(urls, lambda u: {_kind_sql('u')}) AS ks FROM linked WHERE len(urls) > 0),
scored AS (
  SELECT *, list_transform(ks, lambda k: {_map_sql('k', U.URL_CONFIDENCE, '0.3')}::DOUBLE) AS cs FROM kinds
  WHERE k1 NOT IN {U.SOCIAL_URLS} AND (k1 IN {U.ACTIVITY_URLS} OR {_PHRASE})),
addressed AS (
  SELECT chat_id, id AS message_id, ks[list_position(cs, list_max(cs))] AS source_name,
    CASE WHEN {_KEYWORD} THEN least(1.0::DOUBLE, c + 0.1::DOUBLE) ELSE c END AS confidence, 'suggestion' AS candidate_type, 'url' AS source_type
  FROM (SELECT *, CASE WHEN {_PHRASE} THEN least(1.0::DOUBLE, list_max(cs) + 0.25::DOUBLE) ELSE list_max(cs) END AS c FROM scored)
  WHERE CASE WHEN {_KEYWORD} THEN least(1.0::DOUBLE, c + 0.1::DOUBLE) ELSE c END >= 0.5)"""
BOUNDS = """
sums AS (
  SELECT *, sum(length(content)) OVER (PARTITION BY chat_id ORDER BY id) AS upto FROM messages),
sized AS (SELECT *, upto - length(content) AS before FROM sums),
bounds AS (
  SELECT chat_id, id, greatest(0, least(id - 2, coalesce(max(id) OVER (PARTITION BY chat_id ORDER BY before RANGE BETWEEN UNBOUNDED PRECEDING AND 280 PRECEDING), 0))) AS first_id,
    least(max(id) OVER (PARTITION BY chat_id), greatest(id + 2, coalesce(min(id) OVER (PARTITION BY chat_id ORDER BY upto RANGE BETWEEN 280 FOLLOWING AND UNBOUNDED FOLLOWING),
      max(id) OVER (PARTITION BY chat_id)))) AS last_id
  FROM sized)"""
MERGED = """
best AS (
  SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY chat_id, message_id ORDER BY confidence DESC, source_type) AS n
  FROM (SELECT * FROM ruled UNION ALL BY NAME SELECT * FROM addressed)) WHERE n = 1),
kept AS (
  SELECT c.* FROM best c WHERE candidate_type <> 'agreement' OR NOT EXISTS (
    SELECT 1 FROM best s JOIN bounds b ON s.chat_id = b.chat_id AND s.message_id = b.id
    WHERE s.candidate_type = 'suggestion' AND s.chat_id = c.chat_id AND c.message_id BETWEEN b.first_id AND b.last_id AND c.message_id <> s.message_id))"""
_OUT = ("chat_id", "message_id", "source_type", "source_name", "round(confidence, 6) AS confidence", "candidate_type")
_OUT_SQL = "SELECT chat_id, message_id, source_type, source_name, round(confidence, 6) AS confidence, candidate_type FROM"


@_query(f"WITH {MESSAGES}, {RULED}, {ADDRESSED}, {BOUNDS}, {MERGED} {_OUT_SQL} kept")
def quick_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return candidates.quick_scan(messages(spark, sf_dir))[0].selectExpr(*_OUT)


@_query(f"WITH {MESSAGES}, {RULED} {_OUT_SQL} ruled WHERE confidence >= 0.5")
def pattern_case(spark: SparkSession, sf_dir: str) -> DataFrame:
    return candidates.pattern_matches(messages(spark, sf_dir)).selectExpr(*_OUT)


@_query(f"WITH {MESSAGES}, {ADDRESSED} {_OUT_SQL} addressed")
def url_candidates(spark: SparkSession, sf_dir: str) -> DataFrame:
    return candidates.url_matches(messages(spark, sf_dir)).selectExpr(*_OUT)


@_query(f"WITH {MESSAGES}, {RULED}, {ADDRESSED} SELECT chat_id, message_id, source_type, source_name FROM (SELECT *, row_number() OVER (PARTITION BY chat_id, message_id ORDER BY source_type DESC) AS n FROM (SELECT * FROM ruled UNION ALL BY NAME SELECT * FROM addressed)) WHERE n = 1")
def merge_first_wins(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = messages(spark, sf_dir)
    return candidates.merge_first([candidates.url_matches(rows), candidates.pattern_matches(rows)]).select("chat_id", "message_id", "source_type", "source_name")


@_query(f"WITH {MESSAGES}, {BOUNDS} SELECT * FROM bounds")
def context_window(spark: SparkSession, sf_dir: str) -> DataFrame:
    return context.context_bounds(messages(spark, sf_dir)).select("chat_id", "id", "first_id", "last_id")


@_query(f"WITH {MESSAGES}, {RULED}, {BOUNDS} SELECT r.chat_id, r.message_id, count(m.id) FILTER (m.id < r.message_id) AS n_before, count(m.id) FILTER (m.id > r.message_id) AS n_after FROM ruled r JOIN bounds b ON r.chat_id = b.chat_id AND r.message_id = b.id LEFT JOIN messages m ON m.chat_id = b.chat_id AND m.id BETWEEN b.first_id AND b.last_id AND m.id <> r.message_id GROUP BY ALL")
def context_messages(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = messages(spark, sf_dir)
    bounds = context.context_bounds(rows).select("chat_id", F.col("id").alias("message_id"), "first_id", "last_id")
    found = context.with_context(candidates.pattern_matches(rows).join(bounds, ["chat_id", "message_id"]), rows)
    return found.select("chat_id", "message_id", *[F.coalesce(F.size(f"context_{s}"), F.lit(0)).cast("long").alias(f"n_{s}") for s in ("before", "after")])


_EVENTS = "SELECT user_id AS chat_id, epoch_ms(ts) // 3600000 AS message_id, event_id FROM events"


def _event_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _read(spark, sf_dir, "events").select(F.col("user_id").alias("chat_id"), F.expr("unix_timestamp(ts) div 3600").alias("message_id"), "event_id")


@_query(f"WITH e AS ({_EVENTS}), d AS (SELECT DISTINCT chat_id, message_id FROM e), l AS (SELECT *, CASE WHEN message_id - lag(message_id) OVER (PARTITION BY chat_id ORDER BY message_id) <= 5 THEN 0 ELSE 1 END AS f FROM d) SELECT chat_id, message_id, sum(f) OVER (PARTITION BY chat_id ORDER BY message_id)::BIGINT AS group_no FROM l")
def gap_groups(spark: SparkSession, sf_dir: str) -> DataFrame:
    return context.proximity_groups(_event_rows(spark, sf_dir).select("chat_id", "message_id").distinct())


@_query(f"WITH e AS ({_EVENTS}) SELECT chat_id, event_id, (row_number() OVER (PARTITION BY chat_id ORDER BY event_id) - 1) // 10 AS batch_no FROM e")
def fixed_batches(spark: SparkSession, sf_dir: str) -> DataFrame:
    return context.fixed_batches(_event_rows(spark, sf_dir), 10, F.col("event_id")).select("chat_id", "event_id", "batch_no")


_BATCHES = """
n AS (SELECT *, row_number() OVER (PARTITION BY chat_id ORDER BY group_no) AS k, sum(held) OVER (PARTITION BY chat_id ORDER BY group_no) AS upto FROM h),
b AS (
  SELECT chat_id, 1::BIGINT AS k, 0::BIGINT AS batch_no FROM n WHERE k = 1
  UNION ALL
  SELECT b.chat_id, min(j.k), b.batch_no + greatest(1, ceil(i.held / 10.0))::BIGINT
  FROM b JOIN n i USING (chat_id, k) JOIN n j ON j.chat_id = b.chat_id AND j.k > b.k AND j.upto > i.upto - i.held + 10
  GROUP BY b.chat_id, b.k, b.batch_no, i.held)"""


@_query(f"WITH RECURSIVE e AS ({_EVENTS}), d AS (SELECT DISTINCT chat_id, message_id FROM e), l AS (SELECT *, CASE WHEN message_id - lag(message_id) OVER (PARTITION BY chat_id ORDER BY message_id) <= 5 THEN 0 ELSE 1 END AS f FROM d), g AS (SELECT chat_id, sum(f) OVER (PARTITION BY chat_id ORDER BY message_id)::BIGINT AS group_no FROM l), h AS (SELECT chat_id, group_no, count(*) AS held FROM g GROUP BY ALL), {_BATCHES.strip()} SELECT n.chat_id, n.group_no, max(b.batch_no) AS batch_no FROM n JOIN b ON n.chat_id = b.chat_id AND b.k <= n.k GROUP BY n.chat_id, n.group_no")
def smart_batches(spark: SparkSession, sf_dir: str) -> DataFrame:
    return context.smart_batches(gap_groups(spark, sf_dir), 10)


def _order_messages(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _read(spark, sf_dir, "orders").select(
        F.lit("orders").alias("chat_id"), F.col("o_orderkey").alias("id"), F.col("o_orderdate").cast("timestamp").alias("timestamp"),
        F.col("o_custkey").cast("string").alias("sender"), F.col("o_orderpriority").alias("content"),
    )


_MONTHS = """
m AS (SELECT strftime(o_orderdate, '%Y-%m') AS month_key, o_custkey::VARCHAR || chr(10) || o_orderpriority AS t,
  row_number() OVER (PARTITION BY strftime(o_orderdate, '%Y-%m') ORDER BY o_orderdate, o_orderkey) AS n FROM orders),
f AS (SELECT month_key, count(*) AS message_count,
  sha256(month_key || chr(10) || count(*)::VARCHAR || chr(10) || string_agg(t, chr(10) || '---' || chr(10) ORDER BY n) FILTER (n <= 10)) AS fingerprint
  FROM m GROUP BY month_key)"""


@_query(f"WITH {_MONTHS} SELECT * FROM f")
def month_fingerprint(spark: SparkSession, sf_dir: str) -> DataFrame:
    return fingerprint.month_chunks(_order_messages(spark, sf_dir)).select("month_key", "message_count", "fingerprint")


@_query(f"WITH {_MONTHS} SELECT CASE WHEN month_key < '1998' THEN 'known' ELSE 'new' END AS state, count(*) AS chunks, sum(message_count)::BIGINT AS messages FROM f GROUP BY 1")
def dedup_plan(spark: SparkSession, sf_dir: str) -> DataFrame:
    chunks = fingerprint.month_chunks(_order_messages(spark, sf_dir))
    new, known = fingerprint.dedup_plan(chunks, chunks.filter("month_key < '1998'"))
    both = new.withColumn("state", F.lit("new")).unionByName(known.withColumn("state", F.lit("known")))
    return both.groupBy("state").agg(F.count("*").alias("chunks"), F.sum("message_count").alias("messages"))


@_query("SELECT a.vec_id AS id, round(list_cosine_similarity(a.embedding::DOUBLE[], b.embedding::DOUBLE[]), 6) AS similarity FROM embeddings a, embeddings b WHERE b.vec_id = 0 ORDER BY 2 DESC, 1 LIMIT 20")
def cosine_topk(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = _read(spark, sf_dir, "embeddings").select(F.col("vec_id").alias("id"), "embedding")
    query = [float(x) for x in rows.filter("id = 0").first()["embedding"]]
    return vector.top_k(rows, query, 20, -1.0).select("id", F.round("similarity", 6).alias("similarity"))


@_query("WITH q AS (SELECT vec_id AS q_idx, embedding::DOUBLE[] AS e FROM embeddings WHERE vec_id % 50 = 0), s AS (SELECT v.vec_id AS id, q_idx, list_cosine_similarity(v.embedding::DOUBLE[], e) AS similarity FROM embeddings v, q), k AS (SELECT *, row_number() OVER (PARTITION BY q_idx ORDER BY similarity DESC, id) AS n FROM s WHERE similarity >= 0.2) SELECT id, q_idx, round(similarity, 6) AS similarity FROM (SELECT *, row_number() OVER (PARTITION BY id ORDER BY similarity DESC, q_idx) AS m FROM k WHERE n <= 25) WHERE m = 1")
def semantic_best_query(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = _read(spark, sf_dir, "embeddings").select(F.col("vec_id").alias("id"), "embedding")
    queries = rows.filter("id % 50 = 0").select(F.col("id").alias("q_idx"), "embedding")
    return vector.best_query(rows, queries, 25, 0.2).select("id", "q_idx", F.round("similarity", 6).alias("similarity"))


def activities(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Activities made of orders: a category, scores, a place and one or two messages."""
    orders = _read(spark, sf_dir, "orders")
    at = F.col("o_orderdate").cast("timestamp")
    key = F.col("o_orderkey")
    message = F.struct(key.alias("id"), at.alias("timestamp"), F.concat(F.lit("user"), (F.col("o_custkey") % 9).cast("string")).alias("sender"), F.lit("see https://maps.google.com/?q=1.5,2.5").alias("message"))
    second = F.struct((key + 1).alias("id"), (at + F.expr("INTERVAL 1 DAY")).alias("timestamp"), F.lit("user9").alias("sender"), F.lit("yes").alias("message"))
    fun, interesting = (key % 51) / 10, (F.col("o_custkey") % 51) / 10
    return orders.select(
        key.alias("ord"),
        key.cast("string").alias("activity_id"),
        F.concat(F.lit("Plan "), (key % 400).cast("string")).alias("activity"),
        fun.alias("fun_score"),
        interesting.alias("interesting_score"),
        filters.combined_score(fun, interesting).alias("score"),
        F.element_at(F.array(*[F.lit(c) for c in classify.CATEGORIES]), (key % 23 + 1).cast("int")).alias("category"),
        F.when(key % 3 == 0, F.array(message, second)).otherwise(F.array(message)).alias("messages"),
        F.when(key % 5 > 0, F.concat(F.lit("Place "), (key % 40).cast("string"))).alias("place_name"),
        F.lit(None).cast("string").alias("place_query"),
        F.when(key % 4 > 0, F.concat(F.lit("City "), (key % 12).cast("string"))).alias("city"),
        F.lit(None).cast("string").alias("region"),
        F.when(key % 7 > 0, F.element_at(F.array(F.lit("NZ"), F.lit("Australia"), F.lit("us")), (key % 3 + 1).cast("int"))).alias("country"),
        F.lit(None).cast("string").alias("media_key"),
        F.lit(None).cast("string").alias("wiki_name"),
        F.when(key % 11 == 0, F.struct(F.lit("web").alias("type"), F.lit("q").alias("query"))).alias("link"),
    )


ACTIVITIES = f"""
activities AS (
  SELECT o_orderkey AS ord, o_orderkey::VARCHAR AS activity_id, 'Plan ' || (o_orderkey % 400)::VARCHAR AS activity,
    floor((2 * ((o_custkey % 51)::DOUBLE / 10) + (o_orderkey % 51)::DOUBLE / 10) / 3 * 10 + 0.5) / 10 AS score,
    {_sql_list(tuple(classify.CATEGORIES))}[(o_orderkey % 23)::INT + 1] AS category, o_orderdate::TIMESTAMP AS told,
    'user' || (o_custkey % 9)::VARCHAR AS sender, CASE WHEN o_orderkey % 3 = 0 THEN 2 ELSE 1 END AS mentions,
    CASE WHEN o_orderkey % 5 > 0 THEN 'Place ' || (o_orderkey % 40)::VARCHAR END AS place_name,
    CASE WHEN o_orderkey % 4 > 0 THEN 'City ' || (o_orderkey % 12)::VARCHAR END AS city,
    CASE WHEN o_orderkey % 7 > 0 THEN ['NZ', 'Australia', 'us'][(o_orderkey % 3)::INT + 1] END AS country
  FROM orders)"""
COUNTRIES = {"NZ": "New Zealand", "NZL": "New Zealand", "AU": "Australia", "US": "United States of America", "USA": "United States of America"}


@_query(f"WITH {ACTIVITIES} SELECT lower(coalesce(place_name, '')) AS place, lower(coalesce(city, '')) AS town, lower(coalesce(country, '')) AS land, arg_max(activity_id, score * 10000000000 - ord) AS representative, count(*) AS instance_count, min(told) AS first_mentioned, max(told + CASE WHEN mentions = 2 THEN INTERVAL 1 DAY ELSE INTERVAL 0 DAY END) AS last_mentioned, (count(DISTINCT sender) + max(CASE WHEN mentions = 2 THEN 1 ELSE 0 END))::INT AS n_senders FROM activities GROUP BY ALL")
def cluster_exact(spark: SparkSession, sf_dir: str) -> DataFrame:
    made = clustering.exact_clusters(activities(spark, sf_dir))
    parts = F.split("cluster_key", r"\|")
    return made.select(
        parts[1].alias("place"), parts[2].alias("town"), parts[3].alias("land"), "representative", "instance_count",
        F.col("first_mentioned").cast("timestamp_ntz").alias("first_mentioned"), F.col("last_mentioned").cast("timestamp_ntz").alias("last_mentioned"), F.size("all_senders").alias("n_senders"),
    )


#: Titles and places of the table are shorter than 20 characters, so only equal ones are alike; the fold keeps the leaders in order.
_LEADERS = """
p AS (
  SELECT lower(activity) AS title, coalesce(lower(place_name), '') AS place, coalesce(lower(city), '') AS city, coalesce(lower(country), '') AS land,
    ord % 11 = 0 AS linked, min(ord) AS ord FROM activities GROUP BY 1, 2, 3, 4, 5),
f AS (
  SELECT linked, list_reduce(list({'title': title, 'place': place, 'city': city, 'land': land, 'ord': ord} ORDER BY ord),
    lambda s, x: CASE WHEN len(list_filter(s, lambda y: (y.city = x.city OR y.city = '' OR x.city = '') AND (y.land = x.land OR y.land = '' OR x.land = '')
      AND (y.title = x.title OR y.place = x.place OR y.place = '' OR x.place = ''))) > 0 THEN s ELSE list_append(s, x) END,
    CAST([] AS STRUCT(title VARCHAR, place VARCHAR, city VARCHAR, land VARCHAR, ord BIGINT)[])) AS leaders
  FROM p GROUP BY linked),
l AS (SELECT linked, unnest(leaders) AS y FROM f),
m AS (
  SELECT p.*, min(y.ord) AS leader_ord FROM p JOIN l ON l.linked = p.linked AND y.ord <= p.ord
    AND (y.city = p.city OR y.city = '' OR p.city = '') AND (y.land = p.land OR y.land = '' OR p.land = '')
    AND (y.title = p.title OR y.place = p.place OR y.place = '' OR p.place = '')
  GROUP BY ALL)"""


@_query(f"WITH {ACTIVITIES}, {_LEADERS.strip()} SELECT a.ord, m.leader_ord FROM activities a JOIN m ON lower(a.activity) = m.title AND coalesce(lower(a.place_name), '') = m.place AND coalesce(lower(a.city), '') = m.city AND coalesce(lower(a.country), '') = m.land AND (a.ord % 11 = 0) = m.linked")
def leader_groups(spark: SparkSession, sf_dir: str) -> DataFrame:
    return clustering.leader_groups(activities(spark, sf_dir))


@_query(f"WITH {ACTIVITIES} SELECT coalesce(country, 'General') AS country, category, count(*) AS n FROM activities GROUP BY GROUPING SETS ((1, 2), (1), ())".replace("GROUPING SETS ((1, 2), (1), ())", "ROLLUP (coalesce(country, 'General'), category)"))
def category_rollup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return filters.category_rollup(activities(spark, sf_dir))


@_query(f"WITH {ACTIVITIES} SELECT ord, category, score, mentions FROM activities WHERE category IN ('food', 'music', 'travel') AND coalesce({_map_sql('upper(country)', COUNTRIES, 'country')}, '') = 'New Zealand' AND told >= TIMESTAMP '1996-01-01' AND told < TIMESTAMP '2000-01-01' AND score >= 2 ORDER BY score DESC, ord LIMIT 200")
def export_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    f = filters.ExportFilter(categories=("Food", "music", "travel"), countries=("nz",), start=datetime.date(1996, 1, 1), end=datetime.date(1999, 12, 31), min_score=2, only_locations=True, limit=200)
    return filters.select_activities(activities(spark, sf_dir), f, COUNTRIES).select("ord", "category", "score", F.size("messages").alias("mentions"))


@_query(f"WITH {ACTIVITIES} SELECT activity_id, mentions, told AS first_at, told + CASE WHEN mentions = 2 THEN INTERVAL 1 DAY ELSE INTERVAL 0 DAY END AS last_at FROM activities")
def mention_stats(spark: SparkSession, sf_dir: str) -> DataFrame:
    made = clustering.mention_stats(activities(spark, sf_dir))
    return made.withColumns({c: F.col(c).cast("timestamp_ntz") for c in ("first_at", "last_at")})


@_query(f"WITH {ACTIVITIES} SELECT ord FROM activities WHERE mentions > 1 ORDER BY ord LIMIT 10")
def most_wanted(spark: SparkSession, sf_dir: str) -> DataFrame:
    return clustering.most_wanted(activities(spark, sf_dir)).select("ord")


@_query(f"WITH {ACTIVITIES} SELECT ord, nullif(concat_ws(', ', place_name, city, country), '') AS location FROM activities")
def location_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    return activities(spark, sf_dir).select("ord", filters.location_text().alias("location"))


@_query("WITH u AS (SELECT l_returnflag AS resource, l_linestatus AS provider, l_quantity::DOUBLE AS q, floor(l_extendedprice::DOUBLE) AS c FROM lineitem) SELECT resource, provider, sum(q) AS quantity, sum(c) AS cost_micros, ceil(sum(c) / 10000)::BIGINT AS cents FROM u GROUP BY GROUPING SETS ((resource), (provider), ())")
def cost_summary(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = _read(spark, sf_dir, "lineitem").select(
        F.col("l_returnflag").alias("resource"), F.col("l_linestatus").alias("provider"), F.col("l_quantity").cast("double").alias("quantity"),
        F.floor(F.col("l_extendedprice").cast("double")).cast("double").alias("cost_micros"),
    )
    return costs.summary(rows)


@_query("WITH n AS (SELECT c_custkey, c_custkey * 80 AS tokens, ceil(c_custkey / 150.0)::BIGINT AS activities, ceil(ceil(c_custkey / 150.0)::DOUBLE * 0.7::DOUBLE)::BIGINT AS geocodable FROM customer), m AS (SELECT *, tokens * 0.02::DOUBLE + (tokens * 0.5::DOUBLE + activities * 150 * 3.0::DOUBLE) + geocodable * 17000 AS cost_micros FROM n), c AS (SELECT *, ceil(cost_micros / 10000::DOUBLE)::BIGINT AS cents FROM m) SELECT *, floor(cents * 0.6::DOUBLE)::BIGINT AS low_cents, ceil(cents * 1.8::DOUBLE)::BIGINT AS high_cents FROM c")
def cost_estimate(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = _read(spark, sf_dir, "customer").select("c_custkey", F.col("c_custkey").alias("message_count"))
    return costs.estimate(rows, 0.5, 3.0, 0.02).select("c_custkey", "tokens", "activities", "geocodable", "cost_micros", "cents", "low_cents", "high_cents")


@_query("SELECT model, provider, resource, sum(quantity) AS quantity, sum(quantity * price) AS cost_micros FROM (SELECT CASE WHEN p_partkey % 3 = 0 THEN 'gpt-5' ELSE 'gemini-3-pro' END AS model, CASE WHEN p_partkey % 3 = 0 THEN 'openai' ELSE 'google' END AS provider, 'ai_input_tokens' AS resource, (p_partkey % 4)::DOUBLE AS quantity, CASE WHEN p_partkey % 3 = 0 THEN 1.25::DOUBLE ELSE 2.0::DOUBLE END AS price FROM part UNION ALL SELECT CASE WHEN p_partkey % 3 = 0 THEN 'gpt-5' ELSE 'gemini-3-pro' END, CASE WHEN p_partkey % 3 = 0 THEN 'openai' ELSE 'google' END, 'ai_output_tokens', (p_partkey % 7)::DOUBLE, CASE WHEN p_partkey % 3 = 0 THEN 10.0::DOUBLE ELSE 12.0::DOUBLE END FROM part) WHERE quantity > 0 GROUP BY ALL")
def cost_usage(spark: SparkSession, sf_dir: str) -> DataFrame:
    key = F.col("p_partkey")
    calls = _read(spark, sf_dir, "part").select(F.when(key % 3 == 0, "gpt-5").otherwise("gemini-3-pro").alias("model"), (key % 4).alias("input_tokens"), (key % 7).alias("output_tokens"))
    usage = costs.model_usage(calls, costs.price_table(spark))
    return usage.groupBy("model", "provider", "resource").agg(F.sum("quantity").alias("quantity"), F.sum("cost_micros").alias("cost_micros"))


@_query("SELECT count(*) AS located, round(avg(c_acctbal::DOUBLE), 4) AS lat, round(avg(c_nationkey::DOUBLE), 4) AS lng FROM customer WHERE c_custkey % 3 > 0")
def geo_center(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = _read(spark, sf_dir, "customer").select(F.when(F.col("c_custkey") % 3 > 0, F.col("c_acctbal").cast("double")).alias("latitude"), F.col("c_nationkey").cast("double").alias("longitude"))
    return filters.geo_center(rows).select("located", F.round("lat", 4).alias("lat"), F.round("lng", 4).alias("lng"))


@_query("SELECT a.n_name AS a, b.n_name AS b, round(1.0::DOUBLE - levenshtein(lower(a.n_name), lower(b.n_name))::DOUBLE / greatest(length(a.n_name), length(b.n_name)), 6) AS similarity FROM nation a JOIN nation b ON a.n_regionkey = b.n_regionkey")
def levenshtein_similarity(spark: SparkSession, sf_dir: str) -> DataFrame:
    n = _read(spark, sf_dir, "nation")
    both = n.select("n_regionkey", F.col("n_name").alias("a")).join(n.select("n_regionkey", F.col("n_name").alias("b")), "n_regionkey")
    return both.select("a", "b", F.round(T.similarity(F.col("a"), F.col("b")), 6).alias("similarity"))


@_query("SELECT page_id, trim(regexp_replace(regexp_replace(html, '<[^>]*>', '', 'g'), '[ \\t\\n\\f\\r\\v]+', ' ', 'g')) AS text FROM pages")
def html_strip(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _read(spark, sf_dir, "pages").select("page_id", T.clean_html(F.col("html")).alias("text"))


@_query("SELECT page_id, regexp_replace(regexp_extract(url, '^https?://([^/?#:]+)', 1), '^www\\.', '') AS domain FROM pages")
def url_host(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _read(spark, sf_dir, "pages").select("page_id", U.domain(F.col("url")).alias("domain"))


@_query("WITH w AS (SELECT page_id, url, '<meta property=\"og:title\" content=\"T' || page_id || ' &amp;amp; co\"><meta content=\"about #Tag' || (page_id % 7) || '\" property=\"og:description\">' AS head FROM pages) SELECT page_id, 'T' || page_id || ' & co' AS title, 'about #Tag' || (page_id % 7) AS description, 'tag' || (page_id % 7) AS tag FROM w")
def page_metadata(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = _read(spark, sf_dir, "pages")
    key = F.col("page_id").cast("string")
    head = F.concat(F.lit('<meta property="og:title" content="T'), key, F.lit(' &amp;amp; co"><meta content="about #Tag'), (F.col("page_id") % 7).cast("string"), F.lit('" property="og:description">'))
    made = pages.page_metadata(rows.select(key.alias("url"), F.concat(head, F.col("html")).alias("html")))
    return made.select(F.col("url").cast("long").alias("page_id"), "title", "description", F.col("hashtags")[0].alias("tag"))


_SITED = f"SELECT event_id, {_sql_list(SITES)}[event_id % {len(SITES)} + 1] AS url FROM events"


@_query(f"WITH s AS ({_SITED}) SELECT event_id, {_kind_sql('url')} AS kind FROM s")
def url_classify(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _read(spark, sf_dir, "events").select("event_id", U.url_kind(_pick(SITES, F.col("event_id"))).alias("kind"))


@_query(f"WITH s AS ({_SITED}) SELECT event_id, coalesce(nullif(regexp_extract(url, '[?&]v=([A-Za-z0-9_-]{{11}})', 1), ''), nullif(regexp_extract(url, 'youtu\\.be/([A-Za-z0-9_-]{{11}})', 1), '')) AS youtube, nullif(regexp_extract(url, '/video/([0-9]+)', 1), '') AS tiktok, nullif(regexp_extract(url, '/comments/([a-z0-9]+)', 1), '') AS reddit, nullif(regexp_extract(url, '/rooms/([0-9]+)', 1), '') AS airbnb, nullif(regexp_extract(url, '@(-?[0-9.]+),', 1), '')::DOUBLE AS lat FROM s")
def platform_ids(spark: SparkSession, sf_dir: str) -> DataFrame:
    url = _pick(SITES, F.col("event_id"))
    return _read(spark, sf_dir, "events").select("event_id", U.youtube_id(url).alias("youtube"), U.tiktok_id(url).alias("tiktok"), U.reddit_id(url).alias("reddit"), U.airbnb_id(url).alias("airbnb"), U.maps_coordinates(url)["lat"].alias("lat"))


LICENSES = ("CC BY-SA 4.0", "cc-by-nc 2.0", "CC0", "Public domain", "fair use", "PD", "custom", "cc by 3.0", "GFDL", "unknown")


@_query(f"SELECT p_partkey, {_sql_list(LICENSES)}[p_partkey % 10 + 1] IN ('CC BY-SA 4.0', 'CC0', 'Public domain', 'PD', 'cc by 3.0', 'GFDL') AS allowed, CASE WHEN {_sql_list(LICENSES)}[p_partkey % 10 + 1] IN ('cc-by-nc 2.0', 'fair use', 'unknown') THEN 'blocked' WHEN {_sql_list(LICENSES)}[p_partkey % 10 + 1] = 'custom' THEN 'unrecognized' END AS reason FROM part")
def license_check(spark: SparkSession, sf_dir: str) -> DataFrame:
    told = enrich.license_check(_pick(LICENSES, F.col("p_partkey")))
    return _read(spark, sf_dir, "part").select("p_partkey", told["allowed"].alias("allowed"), told["reason"].alias("reason"))


@_query("SELECT s_suppkey AS batch_id, s_suppkey AS message_id, 'Visit ' || s_suppkey AS activity, least(5.0::DOUBLE, (s_suppkey % 8)::DOUBLE) AS fun_score, 2.5::DOUBLE AS interesting_score, floor((5.0::DOUBLE + least(5.0::DOUBLE, (s_suppkey % 8)::DOUBLE)) / 3 * 10 + 0.5) / 10 AS score, CASE WHEN s_suppkey % 2 = 0 THEN 'food' ELSE 'other' END AS category, s_suppkey % 3 - 1 AS \"offset\" FROM supplier")
def response_parse(spark: SparkSession, sf_dir: str) -> DataFrame:
    key = F.col("s_suppkey").cast("string")
    item = F.concat(
        F.lit('Sure:\n```json\n[{"msg": "'), key, F.lit('", "title": "visit '), key, F.lit('", "fun": "'), (F.col("s_suppkey") % 8).cast("string"), F.lit('", "cat": "'),
        F.when(F.col("s_suppkey") % 2 == 0, "Food").otherwise("cars"), F.lit('", "off": '), (F.col("s_suppkey") % 3 - 1).cast("string"), F.lit('}, {"msg": -5, "title": "no"}]\n```'),
    )
    responses = _read(spark, sf_dir, "supplier").select(F.col("s_suppkey").alias("batch_id"), F.array(F.col("s_suppkey").cast("long")).alias("expected_ids"), item.alias("response"))
    made = classify.to_activities(classify.parse_responses(responses))
    return made.select("batch_id", "message_id", "activity", "fun_score", "interesting_score", "score", "category", F.col("offset").cast("long").alias("offset"))


@_query(f"WITH {ACTIVITIES} SELECT ord, 1.5::DOUBLE AS latitude, 2.5::DOUBLE AS longitude, 'url' AS place_lookup_source FROM activities WHERE ord % 2 = 0 UNION ALL SELECT a.ord, CASE WHEN p.n_nationkey IS NOT NULL THEN p.n_nationkey::DOUBLE END, CASE WHEN p.n_nationkey IS NOT NULL THEN -p.n_nationkey::DOUBLE END, CASE WHEN p.n_nationkey IS NOT NULL THEN 'places' END FROM activities a LEFT JOIN nation p ON a.place_name = 'Place ' || p.n_nationkey WHERE a.ord % 2 = 1")
def place_cascade(spark: SparkSession, sf_dir: str) -> DataFrame:
    quiet = F.transform("messages", lambda m: m.withField("message", F.when(F.col("ord") % 2 == 0, m["message"]).otherwise("no address")))
    rows = activities(spark, sf_dir).withColumn("messages", quiet).drop("place_id")
    key = F.col("n_nationkey")
    responses = _read(spark, sf_dir, "nation").select(F.lit("places").alias("kind"), F.concat(F.lit("Place "), key.cast("string")).alias("query"), F.lit("OK").alias("status"), key.cast("double").alias("latitude"), (-key).cast("double").alias("longitude"), key.cast("string").alias("place_id"))
    return enrich.place_cascade(rows, responses).select("ord", "latitude", "longitude", "place_lookup_source")


@_query("SELECT c_custkey, coalesce(CASE WHEN c_custkey % 2 = 0 THEN 'a' || c_custkey END, CASE WHEN c_custkey % 3 = 0 THEN 'b' || c_custkey END) AS image_url, CASE WHEN c_custkey % 2 = 0 THEN 'photo' WHEN c_custkey % 3 = 0 THEN 'stock' END AS image_url_source FROM customer")
def image_cascade(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = _read(spark, sf_dir, "customer").select("c_custkey")
    key = F.col("c_custkey")
    tables = [(s, rows.filter(key % m == 0).select(key.alias("key"), F.concat(F.lit(t), key.cast("string")).alias("image_url")), "c_custkey") for s, m, t in (("photo", 2, "a"), ("stock", 3, "b"))]
    return enrich.first_of(rows, tables, "image_url")


@_query("SELECT p_partkey AS item, 'imdb' AS site, 'https://www.imdb.com/title/tt' || p_partkey AS url FROM part WHERE p_partkey % 3 > 0")
def entity_match(spark: SparkSession, sf_dir: str) -> DataFrame:
    key = F.col("p_partkey")
    rows = _read(spark, sf_dir, "part").select("p_partkey", F.concat(F.lit("The Great Film "), key.cast("string")).alias("item_title"), F.lit("movie").alias("category"))
    title = F.concat(F.col("item_title"), F.lit(" - review"))
    hits = rows.select("*", F.explode(F.filter(F.array(
        F.struct(F.lit(1).alias("rank"), title.alias("title"), F.concat(F.lit("https://en.wikipedia.org/wiki/F"), key.cast("string")).alias("url")),
        F.struct(F.lit(2).alias("rank"), title.alias("title"), F.concat(F.lit("https://www.imdb.com/title/tt"), key.cast("string")).alias("url")),
        F.when(key % 3 == 0, F.struct(F.lit(3).alias("rank"), title.alias("title"), F.concat(F.lit("https://www.imdb.com/title/xx"), key.cast("string")).alias("url"))),
    ), lambda x: x.isNotNull())).alias("h")).select("item_title", "category", "h.*")
    made = enrich.entity_matches(hits)
    return made.select(F.regexp_extract("item_title", r"(\d+)$", 1).cast("long").alias("item"), "site", "url")


@_query("WITH s AS (SELECT lower(left(r_name, 2)) AS wanted, n_name AS label, CASE WHEN lower(n_name) = lower(left(r_name, 2)) THEN 100 WHEN starts_with(lower(n_name), lower(left(r_name, 2))) THEN 80 WHEN contains(lower(n_name), lower(left(r_name, 2))) THEN 60 WHEN contains(lower(left(r_name, 2)), lower(n_name)) THEN 40 ELSE 0 END * 10 + least(n_nationkey * 9, 100) - CASE WHEN n_nationkey % 2 = 0 THEN 0 ELSE 500 END AS match_score FROM nation, region) SELECT wanted, label, match_score::BIGINT AS match_score FROM (SELECT *, row_number() OVER (PARTITION BY wanted ORDER BY match_score DESC, label) AS k FROM s) WHERE k = 1")
def entity_rank(spark: SparkSession, sf_dir: str) -> DataFrame:
    wanted = _read(spark, sf_dir, "region").select(F.lower(F.substring("r_name", 1, 2)).alias("wanted"))
    found = _read(spark, sf_dir, "nation").select(F.col("n_name").alias("label"), (F.col("n_nationkey") * 9).alias("sitelinks"), (F.col("n_nationkey") % 2 == 0).alias("has_id"))
    made = enrich.rank_entities(found.join(wanted, F.lit(True)))  # five titles
    return made.select("wanted", "label", F.col("match_score").cast("long").alias("match_score"))


@_query("SELECT page_id, CASE WHEN page_id % 3 = 0 THEN 'miss' WHEN page_id % 3 = 1 THEN 'hit' ELSE 'known_failure' END AS state FROM pages")
def cache_split(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = _read(spark, sf_dir, "pages").select("page_id", F.col("page_id").cast("string").alias("url"))
    cache = rows.filter("page_id % 3 > 0").select("url", F.when(F.col("page_id") % 3 == 1, "x").alias("data"))
    return enrich.split_cached(rows, cache).select("page_id", "state")


@_query()
def chunk_message(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = _read(spark, sf_dir, "conversations").select("conv_id", "turn", F.posexplode(chat.chunked(F.col("text"))).alias("chunk", "piece"))
    return rows.select("conv_id", "turn", "chunk", "piece")


@_query("SELECT conv_id::VARCHAR AS chat_id, row_number() OVER (PARTITION BY conv_id ORDER BY turn) - 1 AS id, role AS sender, 'say ' || turn || chr(10) || 'more' AS content FROM conversations")
def parse_whatsapp(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = _read(spark, sf_dir, "conversations")
    line = F.concat(F.lit("1/2/24, 10:"), F.lpad(F.col("turn").cast("string"), 2, "0"), F.lit(" - "), "role", F.lit(": say "), F.col("turn").cast("string"), F.lit("\nmore"))
    text = rows.groupBy("conv_id").agg(F.array_sort(F.collect_list(F.struct("turn", line.alias("l")))).alias("ls"))
    system = "before all\n1/2/24, 09:00 - Ann: This message was deleted\n"
    chats = text.select(F.col("conv_id").cast("string").alias("chat_id"), F.concat(F.lit(system), F.array_join(F.transform("ls", lambda x: x["l"]), "\n")).alias("content"))
    return chat.parse_chats(chats).select("chat_id", "id", "sender", "content")


@_query(f"WITH {MESSAGES} SELECT chat_id, count(*) AS message_count, sum(len(urls))::BIGINT AS url_count, min(ts) AS start_time, max(ts) AS end_time, count(DISTINCT sender)::INT AS n_senders FROM linked GROUP BY chat_id")
def parse_stats(spark: SparkSession, sf_dir: str) -> DataFrame:
    made = chat.parse_stats(messages(spark, sf_dir))
    return made.select("chat_id", "message_count", "url_count", *[F.col(c).cast("timestamp_ntz").alias(c) for c in ("start_time", "end_time")], F.size("senders").alias("n_senders"))


@_query()
def activity_links(spark: SparkSession, sf_dir: str) -> DataFrame:
    return candidates.activity_links(messages(spark, sf_dir)).select("chat_id", "message_id", "url_no", "platform", "inferred_type", F.round("confidence", 6).alias("confidence"))


@_query(f"""
WITH {ACTIVITIES}
SELECT row_number() OVER (ORDER BY ord) AS id, activity, category, printf('%.2f', score) AS confidence, strftime(told, '%Y-%m-%d') AS date, '00:00:00' AS time,
  sender, 'see https://maps.google.com/?q=1.5,2.5' AS message, mentions, concat_ws(', ', place_name, city, country) AS location, (ord % 90)::DOUBLE AS latitude,
  2.5::DOUBLE AS longitude, 'https://www.google.com/maps?q=' || (ord % 90) || '.0,2.5' AS maps_link, 'p' || ord AS place_id, 'url' AS place_lookup_source
FROM activities WHERE score >= 4""")
def csv_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    key = F.col("ord")
    placed = {"latitude": (key % 90).cast("double"), "longitude": F.lit(2.5), "place_id": F.concat(F.lit("p"), key.cast("string")), "place_lookup_source": F.lit("url")}
    return sinks.csv_rows(activities(spark, sf_dir).filter("score >= 4").withColumns(placed))


MEDIA_NAMES = ("Kayak", "boat", "paddling", "nothing", "hike_trail")


@_query("SELECT p_partkey AS ord, CASE p_partkey % 5 WHEN 0 THEN 'exact' WHEN 1 THEN 'synonym' WHEN 2 THEN 'action' WHEN 4 THEN 'exact' ELSE CASE WHEN p_partkey % 2 = 0 THEN 'country' ELSE 'category' END END AS match, CASE p_partkey % 5 WHEN 4 THEN 'hike trail' WHEN 3 THEN CASE WHEN p_partkey % 2 = 0 THEN 'México' ELSE 'food' END ELSE 'kayak' END AS folder_item FROM part")
def media_library(spark: SparkSession, sf_dir: str) -> DataFrame:
    key = F.col("p_partkey")
    wanted = _read(spark, sf_dir, "part").select(
        key.alias("ord"), _pick(MEDIA_NAMES, key).alias("object"), F.lit("food").alias("category"),
        F.when(key % 2 == 0, "Mexico").alias("country"), F.lit("MX").alias("country_code"),
    )
    index = spark.createDataFrame(
        [("objects", "kayak", ["k1", "k2"]), ("objects", "hike trail", ["h1"]), ("countries", "México", ["m1"]), ("categories", "food", ["f1"])],
        "entity_type string, item string, entries array<string>",
    )
    synonyms = spark.createDataFrame([("object", "kayak", "boat", None), ("action", "kayak", "paddling", None)], "kind string, folder string, synonym string, country_code string")
    return media.library_images(wanted, index, synonyms).select("ord", "match", "folder_item")


@_query("SELECT page_id, CASE page_id % 4 WHEN 0 THEN 'youtube' WHEN 1 THEN 'reddit' WHEN 2 THEN 'eventbrite' ELSE 'other' END AS platform, CASE page_id % 4 WHEN 0 THEN 'dQw4w9WgXcQ' WHEN 1 THEN '1abcd2' WHEN 2 THEN '123456789012' END AS content_id, 'T & ' || page_id AS title, CASE WHEN page_id % 5 = 0 THEN 'not_found' END AS error FROM pages")
def scrape_platforms(spark: SparkSession, sf_dir: str) -> DataFrame:
    key = F.col("page_id")
    kind, text = key % 4, key.cast("string")
    url = F.element_at(F.array(*[F.lit(u) for u in ("https://www.youtube.com/watch?v=dQw4w9WgXcQ", "https://www.reddit.com/r/x/comments/1abcd2/t/", "https://www.eventbrite.com/e/a-123456789012", "https://example.org/")]), (kind + 1).cast("int"))
    html = (
        F.when(kind == 0, F.concat(F.lit('<script>var ytInitialPlayerResponse = {"videoDetails": {"title": "T &amp; '), text, F.lit('", "author": "a"}};</script>')))
        .when(kind == 1, F.concat(F.lit('[{"data": {"children": [{"data": {"title": "T &amp; '), text, F.lit('", "author": "u"}}]}}]')))
        .when(kind == 2, F.concat(F.lit('<script type="application/ld+json">{"name": "T &amp; '), text, F.lit('", "location": {"name": "Hall"}}</script>')))
        .otherwise(F.concat(F.lit('<meta property="og:title" content="T &amp; '), text, F.lit('">')))
    )
    rows = _read(spark, sf_dir, "pages").select("page_id", url.alias("address"), html.alias("html"), F.when(key % 5 == 0, 404).otherwise(200).alias("status"))
    made = platforms.scrape(rows.select(F.concat("address", F.lit("#"), text).alias("url"), "status", "html"))
    return made.select(F.regexp_extract("url", r"#(\d+)$", 1).cast("long").alias("page_id"), "platform", "content_id", "title", "error")


@_query("SELECT n_nationkey AS k, 'go ' || CASE WHEN n_nationkey % 2 = 0 THEN 'u' || n_nationkey || ' [about ' || n_name || ']' ELSE 'u' || n_nationkey END || ' now' AS told FROM nation")
def url_metadata_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    key = F.col("n_nationkey")
    n = _read(spark, sf_dir, "nation").withColumn("url", F.concat(F.lit("u"), key.cast("string")))
    rows = n.select(key.alias("row_id"), F.concat(F.lit("go "), "url", F.lit(" now")).alias("content"), F.array("url").alias("urls"))
    known = n.filter(key % 2 == 0).select("url", F.concat(F.lit("about "), "n_name").alias("title"))
    return platforms.with_url_metadata(rows, known).select(F.col("row_id").alias("k"), "told")


@_query("SELECT n_nationkey AS k, least(n_nationkey + 3, 24) AS final FROM nation")
def redirects(spark: SparkSession, sf_dir: str) -> DataFrame:
    key = F.col("n_nationkey")
    n = _read(spark, sf_dir, "nation").select(key.cast("string").alias("url"), (key + 1).cast("string").alias("target"))
    made = platforms.follow_redirects(n.select("url"), n.filter("url < '24' OR length(url) = 1").filter("cast(url as int) < 24"), 3)
    return made.select(F.col("url").cast("long").alias("k"), F.col("final_url").cast("long").alias("final"))


@_query("SELECT u_id AS user_id, start_at, n FROM (SELECT user_id AS u_id, min(ts) AS start_at, count(*) AS n FROM (SELECT *, sum(f) OVER (PARTITION BY user_id ORDER BY ts, event_id) AS s FROM (SELECT *, CASE WHEN ts - lag(ts) OVER (PARTITION BY user_id ORDER BY ts, event_id) < INTERVAL 30 MINUTE THEN 0 ELSE 1 END AS f FROM events)) GROUP BY user_id, s)")
def event_sessions(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = _read(spark, sf_dir, "events").withColumn("ts", F.col("ts").cast("timestamp"))
    made = chat_stream.sessions(rows)
    return made.select("user_id", F.col("s.start").cast("timestamp_ntz").alias("start_at"), "n")


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {name: f for name, (f, _) in ENTRIES.items()}


def oracle_sql() -> dict[str, str]:
    return {name: sql for name, (_, sql) in ENTRIES.items() if sql}
