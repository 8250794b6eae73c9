"""Expressions over addresses."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from murmurlake.functions.text import contains_any

# Substrings of a lower-case address and the kind they stand for, in the order they are tried.
URL_KINDS = (
    ("google_maps", ("maps.google", "goo.gl/maps", "maps.app.goo.gl", "google.com/maps")),
    ("event", ("eventfinda", "ticketmaster", "eventbrite", "meetup.com", "facebook.com/events")),
    ("facebook_group", ("facebook.com/groups",)),
    ("tiktok", ("tiktok.com", "vt.tiktok", "vm.tiktok")),
    ("youtube", ("youtube.com", "youtu.be", "music.youtube")),
    ("instagram", ("instagram.com", "instagr.am")),
    ("x", ("twitter.com", "x.com", "t.co")),
    ("facebook", ("facebook.com", "fb.com", "fb.watch", "m.facebook.com")),
    ("airbnb", ("airbnb.com", "airbnb.co")),
    ("booking", ("booking.com",)),
    ("tripadvisor", ("tripadvisor.com", "tripadvisor.co")),
)
URL_CONFIDENCE = {
    "google_maps": 0.7,
    "airbnb": 0.8,
    "booking": 0.8,
    "tripadvisor": 0.75,
    "event": 0.85,
    "facebook_group": 0.75,
    "tiktok": 0.5,
    "youtube": 0.4,
    "instagram": 0.35,
    "x": 0.35,
    "facebook": 0.4,
    "website": 0.3,
}
ACTIVITY_URLS = ("google_maps", "airbnb", "booking", "tripadvisor", "event", "facebook_group")
SOCIAL_URLS = ("tiktok", "youtube", "instagram", "x", "facebook")
PLATFORM_OF_KIND = {"google_maps": "google_maps", "tiktok": "tiktok", "youtube": "youtube", "instagram": "instagram", "x": "x", "facebook": "facebook", "facebook_group": "facebook"}
PLATFORM_CONFIDENCE = {
    "google_maps": 0.9,
    "airbnb": 0.9,
    "booking": 0.9,
    "tripadvisor": 0.85,
    "eventbrite": 0.85,
    "reddit": 0.5,
    "instagram": 0.5,
    "tiktok": 0.5,
    "youtube": 0.4,
    "facebook": 0.45,
    "x": 0.4,
    "spotify": 0.7,
    "other": 0.3,
}


def lookup(column: Column, table: dict, default: object) -> Column:
    """CASE over a small fixed table."""
    made = None
    for k, v in table.items():
        made = F.when(column == k, F.lit(v)) if made is None else made.when(column == k, F.lit(v))
    return made.otherwise(F.lit(default))


def url_kind(url: Column) -> Column:
    low, made = F.lower(url), None
    for kind, parts in URL_KINDS:
        test = contains_any(low, parts)
        made = F.when(test, kind) if made is None else made.when(test, kind)
    return made.otherwise("website")


def url_confidence(url: Column) -> Column:
    return lookup(url_kind(url), URL_CONFIDENCE, 0.3)


def maps_coordinates(url: Column) -> Column:
    """struct(lat, lng) from ``@lat,lng``, else ``q=``, else ``ll=``; null if there is none."""
    made = []
    for lead in ("@", "[?&]q=", "[?&]ll="):
        regex = rf"{lead}(-?\d+\.?\d*),(-?\d+\.?\d*)"
        lat, lng = (F.regexp_extract(url, regex, i).try_cast("double") for i in (1, 2))
        made.append(F.when(lat.isNotNull() & lng.isNotNull(), F.struct(lat.alias("lat"), lng.alias("lng"))))
    return F.coalesce(*made)


def _first(url: Column, *regexes: str) -> Column:
    return F.coalesce(*[F.nullif(F.regexp_extract(url, r, 1), F.lit("")) for r in regexes])


def youtube_id(url: Column) -> Column:
    return _first(url, r"[?&]v=([\w-]{11})", r"youtu\.be/([\w-]{11})", r"/(?:embed|shorts)/([\w-]{11})")


def tiktok_id(url: Column) -> Column:
    return _first(url, r"/video/(\d+)", r"/v/(\d+)")


def reddit_id(url: Column) -> Column:
    return _first(url, r"/comments/([a-z0-9]+)")


def spotify_id(url: Column) -> Column:
    return _first(url, r"spotify\.com/(?:intl-\w+/)?(?:track|album|playlist|artist|episode|show)/([A-Za-z0-9]+)")


def eventbrite_id(url: Column) -> Column:
    return _first(url, r"-(\d{9,})(?:[?#/]|$)", r"/e/(\d{9,})")


def airbnb_id(url: Column) -> Column:
    return _first(url, r"/rooms/(?:plus/)?(\d+)", r"/h/([\w-]+)", r"/experiences/(\d+)")


def domain(url: Column) -> Column:
    """Host without a leading www; null if the address can't be read."""
    return F.regexp_replace(F.try_parse_url(url, F.lit("HOST")), r"^www\.", "")


def youtube_url(video: Column) -> Column:
    return F.concat(F.lit("https://www.youtube.com/watch?v="), video)


def is_reddit(url: Column) -> Column:
    return F.coalesce(F.lower(F.try_parse_url(url, F.lit("HOST"))).rlike(r"(?:^|\.)(?:reddit\.com|redd\.it)$"), F.lit(False))


def is_reddit_share(url: Column) -> Column:
    """Short addresses that have to be followed."""
    return url.rlike("/r/[^/]+/s/[a-zA-Z0-9]+")


def url_problem(url: Column, own: tuple[str, ...] = ()) -> Column:
    """Why an address isn't to be fetched, null if it may be; ``own``: domains that never are, with all below them."""
    part = {p: F.try_parse_url(url, F.lit(p)) for p in ("PROTOCOL", "HOST", "PATH")}
    host = F.lower(part["HOST"])
    blocked = F.lit(False)
    for name in own:
        blocked = blocked | (host == name) | host.endswith(f".{name}")
    suspicious = part["PATH"].contains("..") | part["PATH"].contains("//")
    return (
        F.when(part["PROTOCOL"].isNull(), "invalid address")
        .when(~F.lower(part["PROTOCOL"]).isin("http", "https"), "invalid protocol")
        .when(host.isNull(), "invalid address")
        .when(blocked, "blocked domain")
        .when(suspicious, "suspicious path")
    )


def maps_link(lat: Column, lng: Column) -> Column:
    return F.when(
        lat.isNotNull() & lng.isNotNull(), F.concat(F.lit("https://www.google.com/maps?q="), lat.cast("string"), F.lit(","), lng.cast("string"))
    ).otherwise("")
