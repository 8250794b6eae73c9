"""Metadata of pages by the platform they come from; errors are data."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from murmurlake.functions import urls as U
from murmurlake.functions.stored import stored
from murmurlake.functions.text import contains_any, decode_entities, hashtags
from murmurlake.operators.pages import assigned_json, json_ld, open_graph

# Domains by platform, hosts that aren't fetched.
DOMAINS = (
    ("tiktok", ("tiktok.com",)),
    ("youtube", ("youtube.com", "youtu.be")),
    ("instagram", ("instagram.com", "instagr.am")),
    ("reddit", ("reddit.com", "redd.it")),
    ("spotify", ("spotify.com",)),
    ("eventbrite", ("eventbrite.",)),
    ("airbnb", ("airbnb.",)),
    ("x", ("twitter.com", "x.com")),
    ("facebook", ("facebook.com", "fb.com", "fb.watch")),
    ("google_maps", ("maps.google.", "google.com/maps", "goo.gl/maps")),
)
BLOCKED_HOSTS = ("booking.com", "tripadvisor.com", "tripadvisor.co.", "tripadvisor.ca")
_TIKTOK = (r'(?s)<script[^>]*id="__UNIVERSAL_DATA_FOR_REHYDRATION__"[^>]*>(.*?)</script>', r'(?s)<script[^>]*id="SIGI_STATE"[^>]*>(.*?)</script>')


def platform_of(url: Column) -> Column:
    """By domain: after the scheme, a dot or a slash; 'other' for the rest."""
    low, made = F.lower(url), None
    for name, domains in DOMAINS:
        test = contains_any(low, [lead + d for d in domains for lead in ("://", ".", "/")])
        made = F.when(test, name) if made is None else made.when(test, name)
    return made.otherwise("other")


def is_blocked(url: Column) -> Column:
    return contains_any(F.lower(url), BLOCKED_HOSTS)


def status_error(status: Column) -> Column:
    """Kind of failure of a response status; null if there is none."""
    return F.when(status.isin(404, 410), "not_found").when(status.isin(401, 403, 429), "blocked").when(~status.between(200, 299), "network")


def _json(document: Column, *paths: str) -> Column:
    return F.coalesce(*[F.get_json_object(document, p) for p in paths])


def _found(html: Column, regex: str) -> Column:
    return F.nullif(F.regexp_extract(html, regex, 1), F.lit(""))


def scrape(pages: DataFrame) -> DataFrame:
    """url, platform, content_id, title, description, creator, image_url, hashtags, categories, error from url, status, html."""
    kinds = pages.withColumn("platform", platform_of(F.col("url")))
    html, url = F.col("html"), F.col("url")
    read = kinds.withColumns(
        {
            "_og": open_graph(html),
            "_ld": F.try_element_at(json_ld(html), F.lit(1)),
            "_player": assigned_json(html, "ytInitialPlayerResponse"),
            "_tok": F.coalesce(*[_found(html, r) for r in _TIKTOK]),
        }
    )
    item = "$.__DEFAULT_SCOPE__.webapp.video-detail.itemInfo.itemStruct"
    og = lambda name: F.try_element_at("_og", F.lit(name))
    content_id = F.coalesce(
        *[F.when(F.col("platform") == p, f(url)) for p, f in (
            ("youtube", U.youtube_id), ("tiktok", U.tiktok_id), ("reddit", U.reddit_id), ("spotify", U.spotify_id), ("eventbrite", U.eventbrite_id), ("airbnb", U.airbnb_id),
        )]
    )
    reddit = lambda name: F.when(F.col("platform") == "reddit", F.get_json_object(html, f"$[0].data.children[0].data.{name}"))
    title = F.coalesce(reddit("title"), _json(F.col("_player"), "$.videoDetails.title"), _json(F.col("_ld"), "$.name"), og("title"), F.when(F.col("platform") == "spotify", F.get_json_object(html, "$.title")))
    description = F.coalesce(reddit("selftext"), _json(F.col("_tok"), item + ".desc"), _json(F.col("_player"), "$.videoDetails.shortDescription"), _json(F.col("_ld"), "$.description"), og("description"))
    creator = F.coalesce(reddit("author"), _json(F.col("_tok"), item + ".author.uniqueId"), _json(F.col("_player"), "$.videoDetails.author"), _json(F.col("_ld"), "$.organizer.name", "$.author.name"))
    image = F.coalesce(_json(F.col("_player"), "$.videoDetails.thumbnail.thumbnails[0].url"), _json(F.col("_ld"), "$.image.url", "$.image[0]", "$.image"), og("image"))
    place = _json(F.col("_ld"), "$.location.address.addressLocality", "$.location.name")
    failed = F.coalesce(F.when(is_blocked(url), "blocked"), status_error(F.col("status")), F.when(F.coalesce(title, description).isNull(), "parse"))
    return read.select(
        "url",
        "platform",
        content_id.alias("content_id"),
        decode_entities(title).alias("title"),
        decode_entities(description).alias("description"),
        creator.alias("creator"),
        image.alias("image_url"),
        F.coalesce(hashtags(description), F.array().cast("array<string>")).alias("hashtags"),
        F.array_compact(F.array(place, reddit("subreddit"))).alias("categories"),
        failed.alias("error"),
    )


def follow_redirects(urls: DataFrame, redirects: DataFrame, most: int = 10) -> DataFrame:
    """url, final_url (after at most ``most`` steps of a (url, target) table), hops (of the whole chain; null for a cycle), outcome.

    ``outcome`` is 'final' where the chain ends within ``most`` steps, 'too_many' where it ends later, 'cycle' where it never does.  Pointers are
    doubled: a round joins the unfinished ones with themselves, so a chain of n steps takes log2(n) rounds, and what is unfinished after
    as many steps as there are redirects is a cycle.  Of several targets of an address the least counts.
    """
    pointers = redirects.groupBy(F.col("url").alias("at")).agg(F.min("target").alias("to"))
    sources = pointers.select(F.col("at").alias("to"))
    known = pointers.join(sources.withColumn("open", F.lit(True)), "to", "left")
    jumps = stored(known.select("at", "to", F.lit(1).cast("long").alias("hops"), F.coalesce("open", F.lit(False)).alias("open")), "redirects")
    rounds, n = [jumps], jumps.count()
    steps, ended = 1, [jumps.filter("NOT open")]
    while steps <= max(n, most) and not (jumps := rounds[-1]).filter("open").isEmpty():
        # An unfinished pointer stands ``steps`` steps on, where there is another of as many steps, or one that ended before.
        further = reduce(DataFrame.unionByName, [jumps.filter("open"), *ended])
        further = further.select(F.col("at").alias("to"), F.col("to").alias("end"), F.col("hops").alias("more"), F.col("open").alias("goes_on"))
        joined = jumps.filter("open").join(further, "to")
        rounds.append(stored(joined.select("at", F.col("end").alias("to"), (F.col("hops") + F.col("more")).alias("hops"), F.col("goes_on").alias("open")), "redirects"))
        ended.append(rounds[-1].filter("NOT open"))
        steps *= 2
    ends = reduce(DataFrame.unionByName, ended).select(F.col("at").alias("url"), F.col("to").alias("end"), "hops")
    cycles = rounds[-1].filter("open").select(F.col("at").alias("url"), F.lit(True).alias("cycle"))
    told = urls.select("url").distinct().join(ends, "url", "left").join(cycles, "url", "left")
    told = told.withColumns({"hops": F.when(F.col("cycle"), None).otherwise(F.coalesce("hops", F.lit(0))), "place": F.col("url")})
    long = told.filter(F.col("hops").isNull() | (F.col("hops") > most))
    for bit, jumps in enumerate(rounds):  # where the first ``most`` steps lead
        if most >> bit & 1:
            long = long.join(jumps.select(F.col("at").alias("place"), "to"), "place").withColumn("place", F.col("to")).drop("to")
    short = told.filter(F.col("hops") <= most).withColumn("place", F.coalesce("end", "url"))
    outcome = F.when(F.col("hops").isNull(), "cycle").when(F.col("hops") > most, "too_many").otherwise("final")
    found = short.unionByName(long).select("url", F.col("place").alias("final_url"), "hops", outcome.alias("outcome"))
    return urls.select("url").join(found, "url")


def with_url_metadata(rows: DataFrame, metadata: DataFrame) -> DataFrame:
    """Adds told: content with what is known of each address after it (rows: row_id, content, urls), at places where the address isn't the
    start of a longer one; of several titles for an address the least counts."""
    titles = metadata.groupBy("url").agg(F.min("title").alias("t"))
    listed = rows.select("row_id", F.explode(F.array_distinct("urls")).alias("url")).join(titles, "url")
    known = listed.groupBy("row_id").agg(F.array_sort(F.collect_list(F.struct("url", "t"))).alias("_k"))
    told = F.aggregate(
        F.coalesce("_k", F.array().cast("array<struct<url:string,t:string>>")),
        F.col("content"),
        lambda text, k: F.regexp_replace(
            text,
            F.concat(F.lit("\\Q"), k["url"], F.lit(r"\E(?![\w/?=&%#~+-]|[.,;:!@][\w/])")),
            F.concat(F.lit("$0 ["), F.regexp_replace(k["t"], r"([\\$])", r"\\$1"), F.lit("]")),
        ),
    )
    return rows.join(known, "row_id", "left").withColumn("told", told).drop("_k")
