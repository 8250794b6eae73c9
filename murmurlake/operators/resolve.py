"""Named things resolved to addresses, stage by stage; each stage takes what the one before left open.

Stages: the item base, books, the preferred site among search hits, a model's ranking of the hits.  Whatever would be a call is a table of
responses.  Every item gets one row: found by a stage, or failed after the last.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from murmurlake.functions.stored import stored
from murmurlake.operators.enrich import entity_matches, title_score
from murmurlake.operators.entities import chosen_match, first_author, is_acceptable, preferred_url, titles_match

COLUMNS = ["item_id", "outcome", "stage", "source", "title", "url"]


def _dealt(table: DataFrame) -> DataFrame:
    """The table, to be joined by shuffle: all of these grow with the items, so none goes whole through the driver to the tasks."""
    return table.hint("merge")


def _found(stage: str, source: Column, title: Column, url: Column) -> list[Column]:
    return ["item_id", F.lit("found").alias("outcome"), F.lit(stage).alias("stage"), source.alias("source"), title.alias("title"), url.alias("url")]


def from_items(items: DataFrame, base: DataFrame) -> DataFrame:
    """Items (item_id, query, type) that the item base knows.

    ``base``: query, type, qid, label, sitelinks, ids (map), image_url, wikipedia_url.  The best candidate is that of the best title (100, 80, 60,
    40 or 0, times 10) and sitelinks, up to 100, 500 less without an identifier; it counts only with an image, an article or an
    identifier, whatever the next one has."""
    has_id = F.coalesce(F.size("ids"), F.lit(0)) > 0
    score = title_score(F.col("label"), F.col("query")) * 10 + F.least(F.col("sitelinks"), F.lit(100)) - F.when(has_id, 0).otherwise(500)
    whole = F.struct("label", "ids", "image_url", "wikipedia_url", "qid")
    rank = F.struct((-score).alias("s"), "label", "qid")
    best = base.groupBy("query", "type").agg(F.min_by(whole, rank).alias("b"))
    made = items.join(_dealt(best), ["query", "type"]).filter(is_acceptable(F.col("b.ids"), F.col("b.image_url"), F.col("b.wikipedia_url")))
    url = preferred_url(F.col("type"), F.col("b.ids"), F.col("b.wikipedia_url"), F.col("b.qid"))
    return made.select(*_found("items", F.lit("wikidata"), F.coalesce(F.nullif("b.label", F.lit("")), F.col("query")), url))


def from_books(items: DataFrame, books: DataFrame) -> DataFrame:
    """Books (type 'book') that the library knows with a cover.

    ``books``: title, author, work_id, rank, cover_url.  Titles must match; an item's first author, if it has one, must be among the book's
    authors.  Items meet books by their title up to a colon, so no pairs of unlike titles are made."""
    key = F.lower(F.trim(F.regexp_replace(F.substring_index("title", ":", 1), r"[^\p{L}\p{N}]+", " ")))
    known = books.filter("coalesce(cover_url, '') <> ''").select(key.alias("_key"), F.col("title").alias("_title"), F.col("author").alias("_author"), "work_id", "rank")
    wanted = items.filter("type = 'book'").withColumn("_key", F.lower(F.trim(F.regexp_replace(F.substring_index("query", ":", 1), r"[^\p{L}\p{N}]+", " "))))
    author = F.lower(first_author(F.col("author")))
    fits = titles_match(F.col("query"), F.col("_title")) & (F.coalesce(author, F.lit("")).isin("") | F.coalesce(F.lower("_author").contains(author), F.lit(False)))
    best = wanted.join(_dealt(known), "_key").filter(fits).groupBy("item_id").agg(F.min(F.struct("rank", "work_id", "_title")).alias("b"))
    return best.select(*_found("books", F.lit("openlibrary"), F.col("b._title"), F.concat(F.lit("https://openlibrary.org/works/"), F.col("b.work_id"))))


def from_hits(items: DataFrame, hits: DataFrame) -> DataFrame:
    """Items of which one preferred site has exactly one hit.  ``hits``: item_id, rank (1, 2, ...), title, url."""
    told = items.join(_dealt(hits), "item_id").select(F.col("query").alias("item_title"), F.col("type").alias("category"), "rank", "title", "url")
    best = entity_matches(told.distinct()).withColumnsRenamed({"item_title": "query", "category": "type"})
    return items.join(_dealt(best), ["query", "type"]).select(*_found("heuristic", F.lit("heuristic"), F.col("query"), F.col("url")))


def from_rankings(items: DataFrame, hits: DataFrame, rankings: DataFrame) -> DataFrame:
    """Items of which a model ranked the hits.  ``rankings``: item_id, indexes (1-based places among the item's hits, best first); places that no
    hit has are passed over.  Hits are met by place, so an item's list is never put together."""
    first = rankings.groupBy("item_id").agg(F.min("indexes").alias("indexes"))
    places = items.join(_dealt(first), "item_id").select("item_id", "query", F.posexplode("indexes").alias("nth", "rank"))
    met = places.join(_dealt(hits.select("item_id", "rank", "url")), ["item_id", "rank"]).filter("coalesce(url, '') <> ''")
    best = met.groupBy("item_id", "query").agg(F.min(F.struct("nth", "url")).alias("b"))
    match = chosen_match(F.col("query"), F.array("b.url"))
    return best.select(*_found("ranking", F.when(match["source"] == "ai", "ai").otherwise("heuristic"), F.col("query"), match["url"]))


def resolve(items: DataFrame, base: DataFrame, books: DataFrame, hits: DataFrame, rankings: DataFrame) -> DataFrame:
    """item_id, outcome ('found', 'failed'), stage ('items', 'books', 'heuristic', 'ranking'; of failed ones 'search' without hits, else 'deferred'), source,
    title, url: one row for each item (item_id, query, type, author)."""
    rest, found = items.select("item_id", "query", "type", "author"), []
    for stage in (lambda r: from_items(r, base), lambda r: from_books(r, books), lambda r: from_hits(r, hits), lambda r: from_rankings(r, hits, rankings)):
        made = stored(stage(rest), "resolved")
        found.append(made)
        rest = rest.join(_dealt(made.select("item_id")), "item_id", "left_anti")
    searched = hits.select("item_id").distinct().withColumn("_hit", F.lit(True))
    nothing = [F.lit(None).cast("string").alias(c) for c in ("source", "title", "url")]
    failed = rest.join(_dealt(searched), "item_id", "left").select("item_id", F.lit("failed").alias("outcome"), F.when(F.col("_hit"), "deferred").otherwise("search").alias("stage"), *nothing)
    return reduce(DataFrame.unionByName, [*found, failed])


def deferred(items: DataFrame, hits: DataFrame) -> DataFrame:
    """The items that hits alone don't settle, with their hits in order: what a ranking is asked about.  Columns: item_id, query, type, rank, title, url."""
    open_items = items.join(_dealt(from_hits(items, hits).select("item_id")), "item_id", "left_anti")
    return open_items.select("item_id", "query", "type").join(_dealt(hits), "item_id")

