"""Registered queries of keys, named things, statistics, prices and semantic extraction, each with the SQL that says the same."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from murmurlake.functions import keys
from murmurlake.functions import text as T
from murmurlake.functions import urls as U
from murmurlake.operators import costs, entities, media, pages, previews, semantic, stats
from murmurlake.plans.queries import ENTRIES, MESSAGES, _pick, _query, _read, messages, oracle_sql, queries

__all__ = ["ENTRIES", "oracle_sql", "queries"]


@_query(r"""
SELECT k, 'places/places/' || sha256('google:places:{"query":"caf\\e \"' || k || '\""' || CASE WHEN k % 2 = 0 THEN ',"regionBias":"nz"' ELSE '' END || '}') AS place,
  'geo/google/' || sha256('google:geocoding:{"location":"caf\\e \"' || k || '\""}') AS geocode,
  'ai/openai/small/' || sha256('openai:small:{"inputs":["Zed","a b\n","n' || k || '"]}') AS embedding,
  'ai/google/flash/0a1b2c3d/' || sha256('google:flash:{"messages":[{"content":"go","id":' || k || '},{"content":"caf\\e \"' || k || '\"","id":7}]}') AS classifier
FROM (SELECT c_custkey AS k FROM customer)""")
def cache_keys(spark: SparkSession, sf_dir: str) -> DataFrame:
    k = F.col("k")
    rows = _read(spark, sf_dir, "customer").select(F.col("c_custkey").alias("k"))
    told = F.concat(F.lit('caf\\e "'), k.cast("string"), F.lit('"'))
    region = F.when(k % 2 == 0, "nz")
    asked = F.array(F.struct(k.alias("message_id"), F.lit("go").alias("content")), F.struct(F.lit(7).cast(rows.schema["k"].dataType).alias("message_id"), told.alias("content")))
    return rows.select(
        "k",
        keys.place_key(F.lit("places"), told, region).alias("place"),
        keys.geocode_key(told, F.lit(None).cast("string")).alias("geocode"),
        keys.embedding_key(F.lit("small"), F.array(F.concat(F.lit("n"), k.cast("string")), F.lit("a b\n"), F.lit("Zed"))).alias("embedding"),
        keys.classifier_key(F.lit("google"), F.lit("flash"), F.lit("0a1b2c3d"), asked).alias("classifier"),
    )


@_query("""
SELECT page_id, 'web/' || left(regexp_replace(regexp_replace(regexp_replace(url, '[^a-zA-Z0-9_-]', '_', 'g'), '_+', '_', 'g'), '^_|_$', '', 'g'), 80) || '_' || left(sha256(url), 8) AS web,
  left(regexp_replace(regexp_replace(regexp_replace(regexp_replace(url, '^https?://', ''), '[^a-zA-Z0-9_-]', '_', 'g'), '_+', '_', 'g'), '^_|_$', '', 'g'), 36) || '-' || left(sha256(url), 8) || '.jpg' AS file,
  'images/pixabay/' || left('hiking_mountains_' || page_id, 24) || '-' || left(sha256('hiking  mountains ' || page_id), 8) AS image
FROM pages""")
def url_keys(spark: SparkSession, sf_dir: str) -> DataFrame:
    query = F.concat(F.lit("Hiking  Mountains "), F.col("page_id").cast("string"))
    return _read(spark, sf_dir, "pages").select(
        "page_id", keys.url_key(F.col("url")).alias("web"), keys.image_filename(F.col("url")).alias("file"), keys.image_key(F.lit("pixabay"), query).alias("image")
    )


ID_SITES = ("imdb", "goodreads", "bgg", "steam", "spotify", "other")
ID_URLS = (
    "https://www.imdb.com/title/tt{}/reviews?x=1",
    "https://www.goodreads.com/book/show/{}-a-title",
    "https://boardgamegeek.com/boardgame/{}/a-game",
    "https://store.steampowered.com/app/{}/a_game/",
    "https://open.spotify.com/album/{}?si=2",
    "https://example.org/{}",
)


@_query("""
SELECT p_partkey AS k,
  CASE p_partkey % 6 WHEN 0 THEN 'tt' || p_partkey WHEN 5 THEN NULL ELSE p_partkey::VARCHAR END AS site_id,
  CASE p_partkey % 6 WHEN 0 THEN 'https://www.imdb.com/title/tt' || p_partkey || '/' WHEN 1 THEN 'https://www.goodreads.com/book/show/' || p_partkey
    WHEN 2 THEN 'https://boardgamegeek.com/boardgame/' || p_partkey WHEN 3 THEN 'https://store.steampowered.com/app/' || p_partkey
    WHEN 4 THEN 'https://open.spotify.com/album/' || p_partkey || '?si=2' ELSE 'https://example.org/' || p_partkey END AS root_url,
  CASE p_partkey % 6 WHEN 0 THEN 'imdb' WHEN 1 THEN 'goodreads' WHEN 2 THEN 'bgg' WHEN 3 THEN 'steam' WHEN 4 THEN 'spotify' ELSE 'ai' END AS resolved,
  CASE p_partkey % 6 WHEN 0 THEN 'imdb=tt' || p_partkey WHEN 1 THEN 'goodreads=' || p_partkey WHEN 2 THEN 'bgg=' || p_partkey WHEN 3 THEN 'steam=' || p_partkey ELSE '' END AS ids
FROM part""")
def entity_ids(spark: SparkSession, sf_dir: str) -> DataFrame:
    key = F.col("p_partkey")
    url = F.replace(_pick(ID_URLS, key), F.lit("{}"), key.cast("string"))
    rows = _read(spark, sf_dir, "part").select(key.alias("k"), url.alias("url"), _pick(ID_SITES, key).alias("site"))
    url, site = F.col("url"), F.col("site")
    ids = F.transform(F.map_entries(entities.ids_in_url(url, site)), lambda e: F.concat(e["key"], F.lit("="), e["value"]))
    return rows.select(
        "k", entities.site_id(url, site).alias("site_id"), entities.root_url(url, site).alias("root_url"),
        entities.resolved_site(url).alias("resolved"), F.array_join(ids, ",").alias("ids"),
    )


KINDS = ("movie", "album", "video_game", "book", "podcast", "comic")


@_query("""
SELECT k, CASE WHEN k % 7 = 0 THEN CASE WHEN k % 2 = 0 THEN 'https://en.wikipedia.org/wiki/T' || k ELSE 'https://www.wikidata.org/wiki/Q' || k END
    ELSE CASE k % 6 WHEN 0 THEN 'https://letterboxd.com/film/l' || k || '/' WHEN 1 THEN 'https://open.spotify.com/album/a' || k
      WHEN 2 THEN 'https://www.gog.com/game/g' || k WHEN 3 THEN 'https://openlibrary.org/works/o' || k WHEN 4 THEN 'https://podcasts.apple.com/podcast/idp' || k
      ELSE CASE WHEN k % 2 = 0 THEN 'https://en.wikipedia.org/wiki/T' || k ELSE 'https://www.wikidata.org/wiki/Q' || k END END END AS url,
  CASE WHEN k % 7 > 0 THEN 5 END AS shown
FROM (SELECT s_suppkey AS k FROM supplier)""")
def entity_urls(spark: SparkSession, sf_dir: str) -> DataFrame:
    k = F.col("k")
    rows = _read(spark, sf_dir, "supplier").select(F.col("s_suppkey").alias("k"))
    parts = (("imdb", None), ("letterboxd", "l"), ("spotify_album", "a"), ("gog", "g"), ("openlibrary", "o"), ("apple_podcasts", "p"), ("goodreads", None), ("official_website", "w"), ("tmdb_tv", "t"))
    told = F.create_map(*[c for name, mark in parts for c in (F.lit(name), F.lit("") if mark is None else F.concat(F.lit(mark), k.cast("string")))])
    ids = F.when(k % 7 > 0, told)
    wiki = F.when(k % 2 == 0, F.concat(F.lit("https://en.wikipedia.org/wiki/T"), k.cast("string")))
    qid = F.concat(F.lit("Q"), k.cast("string"))
    return rows.select("k", entities.preferred_url(_pick(KINDS, k), ids, wiki, qid).alias("url"), F.size(entities.preview_ids(ids)).alias("n")).select("k", "url", F.when(F.col("n") > 0, F.col("n")).alias("shown"))


@_query("""
SELECT n_nationkey AS k, lower(n_name) || ' a b' AS plain, n_nationkey % 3 < 2 AS matches, n_name AS author,
  n_name || CASE WHEN n_nationkey % 2 = 0 THEN ' tv series' ELSE '' END AS search,
  CASE WHEN n_nationkey % 3 = 0 THEN n_name WHEN n_nationkey % 3 = 1 THEN 'Baldur''s Gate ' || n_nationkey ELSE '' END AS label
FROM nation""")
def entity_titles(spark: SparkSession, sf_dir: str) -> DataFrame:
    key, name = F.col("n_nationkey"), F.col("n_name")
    text = key.cast("string")
    found = F.when(key % 3 == 0, F.concat(name, F.lit(": the sequel"))).when(key % 3 == 1, F.concat(F.lit(" "), F.lower(name), F.lit("!"))).otherwise(F.concat(name, F.lit(" II")))
    number = F.concat(F.lit("Q"), text)
    article = F.when(key % 3 == 1, F.concat(F.lit("https://en.wikipedia.org/wiki/Baldur%27s_Gate_"), text))
    return _read(spark, sf_dir, "nation").select(
        key.alias("k"),
        entities.plain_title(F.concat(name, F.lit(" - (a)—b."))).alias("plain"),
        entities.titles_match(name, found).alias("matches"),
        entities.first_author(F.concat(name, F.lit(" and B & C, D"))).alias("author"),
        entities.search_text(name, F.when(key % 2 == 0, "tv_show").otherwise("place")).alias("search"),
        entities.item_label(F.when(key % 3 == 0, name).otherwise(number), article).alias("label"),
    )


@_query("""
SELECT k, k * 0.13::DOUBLE AS embedding, k * 0.5::DOUBLE + k * 3.0::DOUBLE AS completion, k * 10000 AS micros
FROM (SELECT c_custkey AS k FROM customer)""")
def model_prices(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = _read(spark, sf_dir, "customer").select(F.col("c_custkey").alias("k"))
    k = F.col("k")
    model = F.lit(costs.DEFAULT_MODELS["google"])
    return rows.select(
        "k",
        costs.embedding_cost(F.lit(costs.DEFAULT_EMBEDDING_MODELS["openai"]), k).alias("embedding"),
        costs.completion_cost(model, k, k).alias("completion"),
        costs.cents_to_micros(k).alias("micros"),
    )


@_query(f"WITH {MESSAGES} SELECT chat_id, count(*) AS message_count, count(DISTINCT sender) AS sender_count, count(*) FILTER (WHERE len(urls) > 0) AS url_count, arg_min(ts, id) AS start_at, arg_max(ts, id) AS end_at FROM linked GROUP BY chat_id")
def parse_step_stats(spark: SparkSession, sf_dir: str) -> DataFrame:
    made = stats.parsed(messages(spark, sf_dir))
    return made.withColumns({c: F.col(c).cast("timestamp_ntz") for c in ("start_at", "end_at")})


@_query(f"WITH {MESSAGES}, n AS (SELECT count(*) FILTER (WHERE length(content) > 10) AS to_embed, count(*) FILTER (WHERE length(content) <= 10) AS skipped, (sum(ceil(length(content) / 4.0)) FILTER (WHERE length(content) > 10))::BIGINT AS total_tokens FROM messages) SELECT *, ceil(to_embed / 100.0)::BIGINT AS batches FROM n")
def embed_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return stats.to_embed(messages(spark, sf_dir))


@_query("SELECT count(*) AS processed, count(*) FILTER (WHERE o_orderkey % 5 > 0) AS geocoded, count(*) FILTER (WHERE o_orderkey % 5 = 1) AS from_maps_url, count(*) FILTER (WHERE o_orderkey % 5 = 2) AS from_geocoding, count(*) FILTER (WHERE o_orderkey % 5 > 2) AS from_place_search, count(*) FILTER (WHERE o_orderkey % 5 = 0) AS failed FROM orders")
def place_stats(spark: SparkSession, sf_dir: str) -> DataFrame:
    kind = F.col("o_orderkey") % 5
    source = _pick(("url", "url", "geocode", "places", "title"), F.col("o_orderkey"))
    rows = _read(spark, sf_dir, "orders").select(F.lit(1.5).alias("longitude"), F.when(kind > 0, 1.5).alias("latitude"), source.alias("place_lookup_source"))
    return stats.places(rows)


@_query("SELECT count(*) AS processed, count(*) FILTER (WHERE k < 7) AS found, count(*) FILTER (WHERE k = 0) AS from_media_library, count(*) FILTER (WHERE k = 1) AS from_cdn, count(*) FILTER (WHERE k = 2) AS from_google_places, count(*) FILTER (WHERE k = 3) AS from_wikipedia, count(*) FILTER (WHERE k = 4) AS from_pexels, count(*) FILTER (WHERE k = 5) AS from_pixabay, count(*) FILTER (WHERE k = 6) AS from_user_upload, count(*) FILTER (WHERE k = 7) AS failed FROM (SELECT o_orderkey % 8 AS k FROM orders)")
def image_stats(spark: SparkSession, sf_dir: str) -> DataFrame:
    key = F.col("o_orderkey")
    source = F.when(key % 8 < 7, _pick((*stats.IMAGE_SOURCES, ""), key))
    return stats.images(_read(spark, sf_dir, "orders").select(source.alias("source")))


@_query("SELECT count(*) AS processed, count(*) FILTER (WHERE k > 0) AS with_hints, count(*) FILTER (WHERE k > 0 AND k % 2 = 0 AND k % 3 = 0) AS resolved, count(*) FILTER (WHERE k > 0 AND k % 2 = 0 AND k % 3 > 0) AS failed, count(*) FILTER (WHERE k % 2 = 1) AS skipped FROM (SELECT o_orderkey % 10 AS k FROM orders)")
def link_stats(spark: SparkSession, sf_dir: str) -> DataFrame:
    k = F.col("o_orderkey") % 10
    kind = F.when((k > 0) & (k % 2 == 0), "movie").when(k > 0, "website")
    resolved = F.when((k > 0) & (k % 2 == 0) & (k % 3 == 0), "https://example.org")
    rows = _read(spark, sf_dir, "orders").select((k > 0).alias("has_link"), kind.alias("link_type"), resolved.alias("resolved_url"))
    return stats.links(rows, ("movie", "book"))


@_query("SELECT count(*) AS total, count(*) FILTER (WHERE o_orderkey % 3 = 0) AS geocoded, count(DISTINCT CASE WHEN o_orderkey % 4 > 0 THEN o_custkey % 9 END) AS senders FROM orders")
def report_header(spark: SparkSession, sf_dir: str) -> DataFrame:
    key = F.col("o_orderkey")
    sender = F.concat(F.lit("user"), (F.col("o_custkey") % 9).cast("string"))
    told = F.when(key % 4 > 0, F.array(F.struct(sender.alias("sender")), F.struct(sender.alias("sender")))).otherwise(F.array().cast("array<struct<sender:string>>"))
    rows = _read(spark, sf_dir, "orders").select(told.alias("messages"), F.when(key % 3 == 0, 1.5).alias("latitude"), F.lit(2.5).alias("longitude"))
    return stats.report_header(rows)


@_query(f"""WITH {MESSAGES}, v AS (SELECT vec_id // 4 AS chat_id, vec_id % 4 AS id, embedding::DOUBLE[] AS e FROM embeddings),
q AS (SELECT vec_id AS q_idx, embedding::DOUBLE[] AS e FROM embeddings WHERE vec_id % 50 = 0),
s AS (SELECT m.chat_id, m.id, q_idx, list_cosine_similarity(v.e, q.e) AS similarity FROM v JOIN messages m ON m.chat_id = v.chat_id AND m.id = v.id AND length(m.content) > 10, q),
k AS (SELECT *, row_number() OVER (PARTITION BY chat_id, q_idx ORDER BY similarity DESC, id) AS n FROM s WHERE similarity >= 0.1)
SELECT chat_id, id AS message_id, 'query ' || q_idx AS source_name, round(similarity, 6) AS confidence, CASE WHEN q_idx % 100 = 0 THEN 'agreement' ELSE 'suggestion' END AS candidate_type
FROM (SELECT *, row_number() OVER (PARTITION BY chat_id, id ORDER BY similarity DESC, q_idx) AS o FROM k WHERE n <= 2) WHERE o = 1""")
def semantic_candidates(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = _read(spark, sf_dir, "embeddings")
    key = F.col("vec_id")
    vectors = rows.select(F.expr("vec_id div 4").alias("chat_id"), (key % 4).cast("long").alias("message_id"), "embedding")
    asked = rows.filter(key % 50 == 0).select(key.alias("q_idx"), F.concat(F.lit("query "), key.cast("string")).alias("query"), "embedding")
    told = semantic.queries_of(asked.filter("q_idx % 100 = 50"), asked.filter("q_idx % 100 = 0"), asked)
    told = told.withColumn("q_idx", F.substring_index("query", " ", -1).cast("long"))
    made = semantic.semantic_candidates(messages(spark, sf_dir), vectors, told, 0.1, 2)
    return made.select("chat_id", "message_id", "source_name", F.round("confidence", 6).alias("confidence"), "candidate_type")


@_query("""
SELECT page_id, CASE WHEN page_id % 2 = 0 AND page_id % 3 = 0 THEN 'https://example.org/c' || page_id ELSE url END AS url,
  CASE WHEN page_id % 2 = 0 THEN 'scraped ' || page_id WHEN page_id % 5 = 0 THEN 'entity ' || page_id END AS title,
  CASE WHEN page_id % 5 = 0 THEN 'about' END AS description,
  regexp_replace(regexp_extract(url, '^https?://([^/?#:]+)', 1), '^www\\.', '') AS domain,
  CASE WHEN page_id % 5 = 0 THEN 'book' END AS entity_type
FROM pages""")
def link_previews(spark: SparkSession, sf_dir: str) -> DataFrame:
    key = F.col("page_id")
    text = key.cast("string")
    pages = _read(spark, sf_dir, "pages").select("page_id", F.concat("url", F.lit("&k="), text).alias("at"), "url")
    nothing = F.lit(None).cast("string")
    metadata = pages.filter(key % 2 == 0).select(
        F.col("at").alias("url"), F.when(key % 3 == 0, F.concat(F.lit("https://example.org/c"), text)).alias("canonical_url"),
        F.concat(F.lit("scraped "), text).alias("title"), nothing.alias("description"), nothing.alias("image_url"),
    )
    known = pages.filter(key % 5 == 0).select(
        key.alias("activity_id"), F.concat(F.lit("entity "), text).alias("title"), F.lit("about").alias("description"), nothing.alias("image_url"),
        F.lit("book").alias("kind"), F.create_map(F.lit("goodreads"), text).alias("ids"),
    )
    made = previews.link_previews(pages.select(key.alias("activity_id"), F.col("at").alias("link")), metadata, known)
    return made.select(F.col("activity_id").alias("page_id"), F.regexp_replace("url", "&k=[0-9]+$", "").alias("url"), "title", "description", "domain", "entity_type")


@_query("""
SELECT k, 'https://www.youtube.com/watch?v=abcdefghijk' AS video, CASE WHEN k % 2 = 0 THEN 'http://a.org/x?' || k || ',' END AS first,
  CASE WHEN k % 2 = 0 THEN 2 ELSE 0 END AS n, CASE k % 3 WHEN 0 THEN true WHEN 1 THEN false END AS yes, 'cc-by-' || k AS license,
  k % 4 = 0 AS reddit, CASE k % 4 WHEN 1 THEN 'blocked domain' WHEN 2 THEN 'suspicious path' WHEN 3 THEN 'invalid protocol' END AS problem
FROM (SELECT n_nationkey AS k FROM nation)""")
def link_scalars(spark: SparkSession, sf_dir: str) -> DataFrame:
    k = F.col("n_nationkey")
    text = k.cast("string")
    said = F.when(k % 2 == 0, F.concat(F.lit("see http://a.org/x?"), text, F.lit(", or https://b.org and https://b.org"))).otherwise("nothing")
    url = F.when(k % 4 == 0, "https://www.reddit.com/r/a/comments/1x/").when(k % 4 == 1, "https://img.own.example/a").when(k % 4 == 2, "https://b.org/a/../c").otherwise("ftp://b.org/")
    return _read(spark, sf_dir, "nation").select(
        k.alias("k"),
        U.youtube_url(F.lit("abcdefghijk")).alias("video"),
        T.first_url(said).alias("first"),
        F.size(T.distinct_urls(said)).alias("n"),
        T.parse_boolean(_pick(("TRUE", "false", "maybe"), k)).alias("yes"),
        T.plain_license(F.concat(F.lit(" CC_BY version "), text)).alias("license"),
        U.is_reddit(url).alias("reddit"),
        U.url_problem(url, ("own.example",)).alias("problem"),
    )


@_query("""
WITH r AS (SELECT c_custkey AS k FROM customer), s AS (SELECT k, CASE WHEN k % 20 = 0 THEN 'google_places' WHEN k % 3 = 0 AND k % 2 = 1 THEN 'media_library'
  WHEN k % 7 = 0 THEN 'pexels' WHEN k % 11 = 0 THEN 'pixabay' WHEN k % 3 = 0 THEN 'media_library' WHEN k % 4 <> 0 THEN 'media_library_category' END AS source FROM r)
SELECT k, source, CASE source WHEN 'google_places' THEN 'photo' || k WHEN 'media_library' THEN 'https://img.example/objects/kayak/k1-700.jpg'
  WHEN 'pexels' THEN 'a' || k WHEN 'pixabay' THEN 'b' || k WHEN 'media_library_category' THEN 'https://img.example/categories/food/f1-700.jpg' END AS url FROM s""")
def image_sources(spark: SparkSession, sf_dir: str) -> DataFrame:
    k = F.col("ord")
    text = k.cast("string")
    rows = _read(spark, sf_dir, "customer").select(F.col("c_custkey").alias("ord")).select(
        "ord", F.concat(F.lit("p"), text).alias("place_id"), (k % 10 == 0).alias("is_venue"), F.when(k % 3 == 0, "Boat").otherwise("zzz").alias("object"),
        (k % 2 == 0).alias("prefer_stock"), F.concat(F.lit("s"), text).alias("stock"), F.when(k % 4 == 0, "other").otherwise("food").alias("category"),
        F.lit("NZ").alias("country_code"),
    )
    index = spark.createDataFrame([("objects", "kayak", ["k1"]), ("categories", "food", ["f1"]), ("categories", "other", ["o1"])], "entity_type string, item string, entries array<string>")
    synonyms = spark.createDataFrame([("object", "kayak", "boat", None)], "kind string, folder string, synonym string, country_code string")

    def table(name: str, every: int, key: str, lead: str) -> DataFrame:
        return rows.filter(k % every == 0).select(F.col(key).alias(name), F.concat(F.lit(lead), text).alias("image_url"))

    photos, stocks = table("place_id", 4, "place_id", "photo"), [("pexels", table("query", 7, "stock", "a")), ("pixabay", table("query", 11, "stock", "b"))]
    made = media.image_chain(rows, photos, index, synonyms, stocks, "https://img.example")
    return made.select(k.alias("k"), F.col("image_url_source").alias("source"), F.col("image_url").alias("url"))


@_query("""
SELECT s_suppkey AS k, CASE s_suppkey % 4 WHEN 0 THEN 'wiki_name' WHEN 1 THEN 'city' WHEN 2 THEN 'country' END AS source,
  CASE s_suppkey % 4 WHEN 0 THEN 'w' || s_suppkey WHEN 1 THEN 'town' WHEN 2 THEN 'land' END AS url FROM supplier""")
def article_pictures(spark: SparkSession, sf_dir: str) -> DataFrame:
    k = F.col("s_suppkey")
    text = k.cast("string")
    rows = _read(spark, sf_dir, "supplier").select(
        k.alias("k"), F.when(k % 4 == 0, F.concat(F.lit("old house "), text)).alias("wiki_name"), F.when(k % 4 < 3, F.concat(F.lit("hall "), text)).alias("place_name"),
        F.when(k % 4 == 1, "some town").alias("city"), F.when(k % 4 < 3, "Land").otherwise("").alias("country"),
    )
    key = F.col("k").cast("string")
    kinds = "article string, rank int, name string, width int, license string, image_url string"
    fixed = spark.createDataFrame([("Some_Town", 1, "Town logo.png", 900, "CC BY 4.0", "logo"), ("Some_Town", 2, "Town.jpg", 399, "CC BY 4.0", "small"), ("Some_Town", 3, "Town.jpg", 400, "CC BY 4.0", "town"), ("Land", 1, "Land.jpg", 800, "CC0", "land")], kinds)
    own = [F.lit(1).alias("rank"), F.lit("a.jpg").alias("name"), F.lit(800).alias("width")]
    houses = rows.select(F.concat(F.lit("Old_House_"), key).alias("article"), *own, F.lit("CC BY-SA 3.0").alias("license"), F.concat(F.lit("w"), key).alias("image_url"))
    halls = rows.select(F.concat(F.lit("Hall_"), key).alias("article"), *own, F.lit("fair use").alias("license"), F.lit("hall").alias("image_url"))
    made = media.article_images(rows, fixed.unionByName(houses).unionByName(halls))
    return made.select("k", F.col("image_url_source").alias("source"), F.col("image_url").alias("url"))


@_query("""
SELECT page_id, CASE page_id % 3 WHEN 0 THEN 'Name ' || page_id WHEN 1 THEN 'Head } ' || page_id ELSE 'Og & ' || page_id END AS title,
  CASE page_id % 3 WHEN 0 THEN 'own.jpg' WHEN 1 THEN 'first.jpg' ELSE 'og.jpg' END AS image,
  CASE page_id % 3 WHEN 0 THEN 'example.org,article' WHEN 1 THEN 'example.org,event' ELSE 'example.org' END AS categories FROM pages""")
def typed_pages(spark: SparkSession, sf_dir: str) -> DataFrame:
    key = F.col("page_id")
    text, block, end = key.cast("string"), '<script type="application/ld+json">', "</script>"
    skipped = f'{block}{{"@type": "BreadcrumbList", "name": "no"}}{end}{block}broken{end}'
    html = (
        F.when(key % 3 == 0, F.concat(F.lit(skipped + block + '{"@type": "Article", "image": {"url": "own.jpg"}, "name": "Name '), text, F.lit('"}' + end)))
        .when(key % 3 == 1, F.concat(F.lit(block + '{"@type": "Event", "image": ["first.jpg", "b"], "headline": "Head } '), text, F.lit('"}' + end)))
        .otherwise(F.concat(F.lit(skipped + '<meta property="og:image" content="og.jpg"><meta property="og:title" content="Og &amp; '), text, F.lit('">')))
    )
    rows = _read(spark, sf_dir, "pages").select(F.concat(F.lit("https://www.example.org/"), text).alias("url"), html.alias("html"))
    made = pages.generic_metadata(rows)
    return made.select(F.regexp_extract("url", r"(\d+)$", 1).cast("long").alias("page_id"), "title", F.col("image_url").alias("image"), F.array_join("categories", ",").alias("categories"))
