"""Things that activities name: identifiers, addresses and titles of films, books, games and music."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from murmurlake.functions.text import S

# Identifiers and the addresses made of them, in the order previews prefer them; identifiers by kind of thing.
URL_TEMPLATES = {
    "imdb": "https://www.imdb.com/title/{id}/",
    "tmdb_movie": "https://www.themoviedb.org/movie/{id}",
    "tmdb_tv": "https://www.themoviedb.org/tv/{id}",
    "letterboxd": "https://letterboxd.com/film/{id}/",
    "bgg": "https://boardgamegeek.com/boardgame/{id}",
    "steam": "https://store.steampowered.com/app/{id}",
    "igdb": "https://www.igdb.com/games/{id}",
    "gog": "https://www.gog.com/game/{id}",
    "musicbrainz_artist": "https://musicbrainz.org/artist/{id}",
    "musicbrainz_release_group": "https://musicbrainz.org/release-group/{id}",
    "musicbrainz_release": "https://musicbrainz.org/release/{id}",
    "spotify_artist": "https://open.spotify.com/artist/{id}",
    "spotify_album": "https://open.spotify.com/album/{id}",
    "spotify_show": "https://open.spotify.com/show/{id}",
    "discogs_artist": "https://www.discogs.com/artist/{id}",
    "discogs_release": "https://www.discogs.com/release/{id}",
    "goodreads": "https://www.goodreads.com/book/show/{id}",
    "openlibrary": "https://openlibrary.org/works/{id}",
    "google_books": "https://books.google.com/books?id={id}",
    "apple_podcasts": "https://podcasts.apple.com/podcast/id{id}",
    "official_website": "{id}",
}
PREVIEW_IDS = (
    "imdb", "steam", "bgg", "spotify_album", "spotify_artist", "spotify_show", "tmdb_movie", "tmdb_tv", "letterboxd", "goodreads", "openlibrary",
    "apple_podcasts", "official_website",
)
PREFERRED_IDS = {
    "movie": ("imdb", "tmdb_movie", "letterboxd"),
    "tv_show": ("imdb", "tmdb_tv"),
    "media": ("imdb", "tmdb_movie", "tmdb_tv"),
    "video_game": ("steam", "igdb", "gog"),
    "physical_game": ("bgg",),
    "game": ("steam", "bgg", "igdb"),
    "album": ("spotify_album",),
    "song": ("spotify_album",),
    "podcast": ("spotify_show", "apple_podcasts"),
    "artist": ("spotify_artist",),
    "book": ("goodreads", "openlibrary", "google_books"),
}
ID_PATTERNS = {"imdb": r"/title/(tt[0-9]+)", "goodreads": r"/book/show/([0-9]+)", "bgg": r"/boardgame/([0-9]+)", "steam": r"/app/([0-9]+)"}
ROOT_PATTERNS = {
    "imdb": r"(https?://[^/]*imdb\.com/title/tt[0-9]+)",
    "goodreads": r"(https?://[^/]*goodreads\.com/book/show/[0-9]+)",
    "bgg": r"(https?://[^/]*boardgamegeek\.com/boardgame/[0-9]+)",
    "steam": r"(https?://store\.steampowered\.com/app/[0-9]+)",
}
RESOLVED_SITES = (
    ("imdb.com", "imdb"), ("goodreads.com", "goodreads"), ("wikipedia.org", "wikipedia"), ("spotify.com", "spotify"), ("boardgamegeek.com", "bgg"),
    ("steam", "steam"), ("amazon.com", "amazon"),
)
SEARCH_HINTS = {
    "movie": "film", "tv_show": "tv series", "book": "book", "video_game": "video game", "physical_game": "board game", "album": "album music",
    "song": "song music", "podcast": "podcast", "artist": "musician artist", "theatre": "play theatre", "comic": "comic", "web_series": "web series",
    "media": "movie tv show", "game": "video game board game",
}
TITLE_MARKS = ".:,;!?()[]{}\"'-—–"
NOT_PHOTOS = ("logo", "icon", "flag", "coat_of_arms")
MIN_IMAGE_WIDTH = 400


def _lookup(key: Column, table: dict[str, str]) -> Column:
    return F.try_element_at(F.create_map(*[F.lit(x) for kv in table.items() for x in kv]), key)


def _found(text: Column, regex: str, group: int = 1) -> Column:
    return F.nullif(F.regexp_extract(text, regex, group), F.lit(""))


def _by_site(site: Column, url: Column, patterns: dict[str, str]) -> Column:
    return F.coalesce(*[F.when(site == name, _found(url, regex)) for name, regex in patterns.items()])


def site_id(url: Column, site: Column) -> Column:
    """What tells two results of a site apart; null where the address holds none."""
    return F.coalesce(_by_site(site, url, ID_PATTERNS), F.when(site == "spotify", _found(url, "/(album|artist)/([a-zA-Z0-9]+)", 2)))


def root_url(url: Column, site: Column) -> Column:
    """The address up to its identifier, the address itself where the site has none."""
    root = _by_site(site, url, ROOT_PATTERNS)
    return F.coalesce(F.when(site == "imdb", F.concat(root, F.lit("/"))).otherwise(root), url)


def resolved_site(url: Column) -> Column:
    """Site of an address that a model chose, 'ai' for any other."""
    low, made = F.lower(url), F
    for part, site in RESOLVED_SITES:
        made = made.when(low.contains(part), site)
    return made.otherwise("ai")


def ids_in_url(url: Column, site: Column) -> Column:
    """Map with the identifier of an address, empty without one."""
    told = F.array(*[F.struct(F.lit(s).alias("k"), F.when(site == s, _found(url, r)).alias("v")) for s, r in ID_PATTERNS.items()])
    return F.map_from_entries(F.filter(told, lambda x: x["v"].isNotNull()))


def url_of_id(kind: Column, value: Column) -> Column:
    """Address made of an identifier; null for kinds without a template."""
    return F.replace(_lookup(kind, URL_TEMPLATES), F.lit("{id}"), value)


def preferred_url(kind: Column, ids: Column, wikipedia_url: Column, qid: Column) -> Column:
    """The address that a kind of thing prefers among its identifiers (a map), then its article, then its item."""
    chosen = []
    for name, wanted in PREFERRED_IDS.items():
        known = [url_of_id(F.lit(i), F.nullif(F.try_element_at(ids, F.lit(i)), F.lit(""))) for i in wanted]
        chosen.append(F.when(kind == name, F.coalesce(*known)))
    return F.coalesce(*chosen, wikipedia_url, F.concat(F.lit("https://www.wikidata.org/wiki/"), qid))


def preview_ids(ids: Column) -> Column:
    """The identifiers that previews show, without empty ones and the thing's own site; null if none is left."""
    shown = [i for i in PREVIEW_IDS if i != "official_website"]
    kept = F.map_filter(ids, lambda k, v: k.isin(*shown) & (F.coalesce(v, F.lit("")) != ""))
    return F.when(F.size(kept) > 0, kept)


def search_text(title: Column, category: Column) -> Column:
    return F.concat_ws(" ", title, _lookup(category, SEARCH_HINTS))


def item_label(label: Column, article: Column) -> Column:
    """The label; for one that is only an item's number the article's name, empty without an article."""
    name = F.translate(F.try_url_decode(F.replace(_found(article, "/wiki/([^/]+)$"), F.lit("+"), F.lit("%2B"))), "_", " ")
    label = F.coalesce(label, F.lit(""))
    return F.when(label.rlike("^Q[0-9]+$"), F.coalesce(name, F.lit(""))).otherwise(label)


def plain_title(title: Column) -> Column:
    """Lower case, marks as blanks, single blanks."""
    spaced = F.translate(F.lower(F.coalesce(title, F.lit(""))), TITLE_MARKS, " " * len(TITLE_MARKS))
    return F.trim(F.regexp_replace(spaced, S + "+", " "))


def titles_match(expected: Column, found: Column) -> Column:
    """Equal as plain titles, or equal to what stands before a colon."""
    wanted = plain_title(expected)
    main = F.substring_index(found, ":", 1)
    return (plain_title(found) == wanted) | (found.contains(":") & (main != "") & (plain_title(main) == wanted))


def first_author(author: Column) -> Column:
    return F.trim(F.substring_index(F.substring_index(F.substring_index(author, "&", 1), " and ", 1), ",", 1))


def is_printed(form: Column) -> Column:
    """False for recordings; true where no form is given."""
    return ~F.coalesce(F.lower(form).rlike("audio|cd|mp3"), F.lit(False))


def edition_with_cover(editions: Column) -> Column:
    """struct(edition_id, cover_id, format) of the first printed edition that has covers; editions: array of struct(key, covers, physical_format)."""
    fit = F.filter(editions, lambda e: (F.coalesce(F.size(e["covers"]), F.lit(0)) > 0) & is_printed(e["physical_format"]))
    first = F.try_element_at(fit, F.lit(1))
    told = F.struct(
        F.substring_index(F.coalesce(first["key"], F.lit("")), "/", -1).alias("edition_id"),
        F.try_element_at(first["covers"], F.lit(1)).alias("cover_id"),
        first["physical_format"].alias("format"),
    )
    return F.when(first.isNotNull(), told)


def is_photo_name(name: Column) -> Column:
    """False for drawings, moving images, logos, icons, flags and arms."""
    low = F.lower(name)
    made = ~low.endswith(".svg") & ~low.endswith(".gif")
    for part in NOT_PHOTOS:
        made = made & ~low.contains(part)
    return made


def is_acceptable(ids: Column, image_url: Column, wikipedia_url: Column) -> Column:
    """An item counts as found if it has an image, an article or an identifier."""
    return (F.coalesce(image_url, F.lit("")) != "") | (F.coalesce(wikipedia_url, F.lit("")) != "") | (F.coalesce(F.size(preview_ids(ids)), F.lit(0)) > 0)


def chosen_match(title: Column, ranked_urls: Column) -> Column:
    """struct(url, source, title) of a model's first address; null without one."""
    url = F.nullif(F.try_element_at(ranked_urls, F.lit(1)), F.lit(""))
    site = resolved_site(url)
    return F.when(url.isNotNull(), F.struct(url.alias("url"), F.when(site == "amazon", "ai").otherwise(site).alias("source"), title.alias("title")))
