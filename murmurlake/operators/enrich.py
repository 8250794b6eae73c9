"""Enrichment from response tables; whatever would be a call is a join."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from murmurlake.functions.text import content_words, matches
from murmurlake.functions.urls import maps_coordinates

# Licences, result sites and the order in which kinds of things prefer them.
BLOCKED = (r"^unknown$", r"fair[- ]?use", r"non[- ]?commercial", r"\bnc\b", r"no[- ]?deriv", r"\bnd\b")
ALLOWED = (r"^cc[- ]?by[- ]?sa", r"^cc[- ]?by(?![- ]?n)", r"^cc[- ]?0", r"^public[- ]?domain", r"^pd[- ]", r"^pd$", r"^gfdl", r"^attribution$")
SITES = (
    ("imdb", ("imdb.com",)),
    ("goodreads", ("goodreads.com",)),
    ("amazon", ("amazon.com", "amazon.co.")),
    ("wikipedia", ("wikipedia.org",)),
    ("rottentomatoes", ("rottentomatoes.com",)),
    ("penguin", ("penguin.",)),
    ("steam", ("store.steampowered.com",)),
    ("bgg", ("boardgamegeek.com",)),
    ("spotify", ("open.spotify.com",)),
    ("musicbrainz", ("musicbrainz.org",)),
    ("igdb", ("igdb.com",)),
    ("letterboxd", ("letterboxd.com",)),
)
SITE_ORDER = {
    "movie": ("imdb", "wikipedia", "rottentomatoes", "letterboxd"),
    "tv_show": ("imdb", "wikipedia", "rottentomatoes", "letterboxd"),
    "book": ("goodreads", "amazon", "penguin"),
    "video_game": ("steam", "igdb", "wikipedia"),
    "physical_game": ("bgg", "wikipedia"),
    "album": ("spotify", "musicbrainz", "wikipedia"),
    "song": ("spotify", "musicbrainz", "wikipedia"),
}


def license_check(license_: Column) -> Column:
    """struct(allowed, reason): blocked ones first, then allowed ones; any other isn't recognised."""
    blocked, allowed = (matches(F.trim(license_), "|".join(f"(?:{p})" for p in ps)) for ps in (BLOCKED, ALLOWED))
    reason = F.when(license_.isNull() | blocked, "blocked").when(allowed, F.lit(None).cast("string")).otherwise("unrecognized")
    return F.struct(reason.isNull().alias("allowed"), reason.alias("reason"))


def any_license_allowed(licenses: Column) -> Column:
    """Whether one of an array of licences is allowed; false for none."""
    return F.coalesce(F.exists(licenses, lambda x: license_check(x)["allowed"]), F.lit(False))


def site_of(url: Column) -> Column:
    low, made = F.lower(url), None
    for site, parts in SITES:
        test = low.contains(parts[0])
        for p in parts[1:]:
            test = test | low.contains(p)
        made = F.when(test, site) if made is None else made.when(test, site)
    return made


def coordinates_from_messages(activities: DataFrame) -> DataFrame:
    """ord, latitude, longitude of the first maps address in an activity's messages."""
    rows = activities.select("ord", F.posexplode("messages").alias("n", "m"))
    found = rows.select("ord", "n", maps_coordinates(F.col("m.message")).alias("c")).filter("c IS NOT NULL")
    return found.groupBy("ord").agg(F.min_by("c", "n").alias("c")).select("ord", F.col("c.lat").alias("latitude"), F.col("c.lng").alias("longitude"))


def place_cascade(activities: DataFrame, responses: DataFrame) -> DataFrame:
    """Adds latitude, longitude, place_id and place_lookup_source: maps address, place search, geocoding, search by title."""
    ok = responses.filter("status = 'OK'")
    answer = F.struct("place_id", "latitude", "longitude")
    told = ok.groupBy("kind", "query").agg(F.min(answer).alias("a")).select("kind", "query", "a.*")  # of several answers always the same
    places, codes = told.filter("kind = 'places'"), told.filter("kind = 'geocode'")
    url = coordinates_from_messages(activities)
    place = F.coalesce(F.nullif("place_query", F.lit("")), F.nullif("place_name", F.lit("")))
    region = F.nullif(F.concat_ws(", ", *[F.nullif(c, F.lit("")) for c in ("city", "region", "country")]), F.lit(""))
    keyed = activities.withColumns({"_place": place, "_region": F.when(place.isNull(), region), "_title": F.when(place.isNull() & region.isNull(), F.col("activity"))})
    made = keyed.join(url.withColumnsRenamed({"latitude": "u_lat", "longitude": "u_lng"}), "ord", "left")
    for tag, table, key in (("p", places, "_place"), ("g", codes, "_region"), ("t", places, "_title")):
        right = table.select(F.col("query").alias(f"{tag}_q"), F.col("latitude").alias(f"{tag}_lat"), F.col("longitude").alias(f"{tag}_lng"), F.col("place_id").alias(f"{tag}_id"))
        made = made.join(right, F.col(key) == F.col(f"{tag}_q"), "left")
    source = F.when(F.col("u_lat").isNotNull(), "url").when(F.col("p_lat").isNotNull(), "places").when(F.col("g_lat").isNotNull(), "geocode").when(F.col("t_lat").isNotNull(), "title")
    return made.select(
        *activities.columns,
        F.coalesce("u_lat", "p_lat", "g_lat", "t_lat").alias("latitude"),
        F.coalesce("u_lng", "p_lng", "g_lng", "t_lng").alias("longitude"),
        F.when(F.col("u_lat").isNull(), F.coalesce("p_id", "g_id", "t_id")).alias("place_id"),
        source.alias("place_lookup_source"),
    )


def entity_matches(results: DataFrame) -> DataFrame:
    """item_title, category, site, url: the first preferred site with results; more than one result there defers the item (no row)."""
    query, title = content_words(F.col("item_title")), content_words(F.col("title"))
    fits = results.withColumn("site", site_of(F.col("url"))).filter((F.size(query) > 0) & (F.size(F.array_except(query, title)) == 0))
    order = None
    for category, sites in SITE_ORDER.items():
        place = F.array_position(F.array(*[F.lit(s) for s in sites]), F.col("site"))
        order = F.when(F.col("category") == category, place) if order is None else order.when(F.col("category") == category, place)
    ranked = fits.withColumn("place", order).filter("place > 0")
    sites = ranked.groupBy("item_title", "category", "place", "site").agg(F.count_distinct("url").alias("n"), F.min_by("url", "rank").alias("url"))
    best = sites.groupBy("item_title", "category").agg(F.min_by(F.struct("site", "url", "n"), "place").alias("b"))
    return best.filter("b.n = 1").select("item_title", "category", "b.site", "b.url")


def title_score(label: Column, wanted: Column) -> Column:
    a, b = F.lower(F.trim(label)), F.lower(F.trim(wanted))
    return F.when(a == b, 100).when(F.startswith(a, b), 80).when(a.contains(b), 60).when(b.contains(a), 40).otherwise(0)


def rank_entities(found: DataFrame) -> DataFrame:
    """The best row for each wanted title: title score x 10 + sitelinks up to 100, 500 less without an identifier."""
    score = title_score(F.col("label"), F.col("wanted")) * 10 + F.least(F.col("sitelinks"), F.lit(100)) - F.when(F.col("has_id"), 0).otherwise(500)
    order = Window.partitionBy("wanted").orderBy(F.desc("match_score"), "label")
    return found.withColumn("match_score", score).withColumn("_n", F.row_number().over(order)).filter("_n = 1").drop("_n")


def first_of(rows: DataFrame, lookups: Sequence[tuple[str, DataFrame, str]], value: str) -> DataFrame:
    """Adds value and value_source from the first lookup (source, table of key and value, key column) that knows the row."""
    made, parts = rows, []
    for i, (source, table, key) in enumerate(lookups):
        one = table.groupBy(F.col("key").alias(f"_k{i}")).agg(F.min(value).alias(f"_v{i}"))  # of several always the same
        made = made.join(one, F.col(key) == F.col(f"_k{i}"), "left")
        parts.append((source, F.col(f"_v{i}")))
    told = None
    for source, column in parts:
        told = F.when(column.isNotNull(), source) if told is None else told.when(column.isNotNull(), source)
    return made.select(*rows.columns, F.coalesce(*[c for _, c in parts]).alias(value), told.alias(f"{value}_source"))


def split_cached(urls: DataFrame, cache: DataFrame) -> DataFrame:
    """Adds state: 'hit', 'known_failure' (cached without data) or 'miss'."""
    known = cache.groupBy(F.col("url").alias("_u")).agg(F.max(F.col("data").isNotNull()).alias("_ok"))
    made = urls.join(known, F.col("url") == F.col("_u"), "left")
    return made.withColumn("state", F.when(F.col("_u").isNull(), "miss").when(F.col("_ok"), "hit").otherwise("known_failure")).drop("_u", "_ok")
