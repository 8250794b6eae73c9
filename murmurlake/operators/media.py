"""Pictures for activities from a library's index, as joins on small dimensions."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from murmurlake.functions.text import without_accents
from murmurlake.operators.enrich import first_of, license_check
from murmurlake.operators.entities import is_photo_name

# Names and the least width of pictures that are taken from an article.
LEAST_WIDTH = 400


def object_name(column: Column) -> Column:
    return F.translate(F.lower(F.trim(column)), "_", " ")


def matching_name(column: Column) -> Column:
    return F.lower(without_accents(F.trim(column)))


def index_rows(index: DataFrame) -> DataFrame:
    """entity_type, item, entry: one row a picture; ``$type/item/hash`` entries refer to another folder."""
    rows = index.select("entity_type", "item", F.explode("entries").alias("entry"))
    part = F.split(F.regexp_replace("entry", r"^\$", ""), "/")
    refers = F.startswith("entry", F.lit("$"))
    return rows.select(
        "entity_type",
        "item",
        F.when(refers, part[0]).otherwise(F.col("entity_type")).alias("folder_type"),
        F.when(refers, F.get(part, F.lit(1))).otherwise(F.col("item")).alias("folder_item"),
        F.when(refers, F.try_element_at(part, F.lit(-1))).otherwise(F.col("entry")).alias("image_hash"),
    )


def _pick(rows: DataFrame, key: list[str]) -> DataFrame:
    """One picture a key, by least hash of key and picture: the same on every run."""
    order = Window.partitionBy(*key).orderBy(F.xxhash64(*key, "image_hash"), "image_hash")
    return rows.withColumn("_n", F.row_number().over(order)).filter("_n = 1").drop("_n")


def library_images(wanted: DataFrame, index: DataFrame, synonyms: DataFrame) -> DataFrame:
    """Adds folder_type, folder_item, image_hash, match for rows with ord, object, category, country, country_code.

    In order: the object's folder for the country, its own name, a synonym (the first folder that lists it), a verb's folder, the country (accents
    aside), the category.  ``synonyms``: kind ('object', 'action' or 'regional'), folder, synonym, country_code.
    """
    pictures = _pick(index_rows(index), ["entity_type", "item"])
    objects = pictures.filter("entity_type = 'objects'").withColumn("k", object_name(F.col("item")))
    named = synonyms.select("kind", F.col("folder"), object_name(F.col("synonym")).alias("s"), "country_code")
    first = named.filter("kind <> 'regional'").groupBy("kind", "s").agg(F.min("folder").alias("folder"))
    keyed = wanted.select("ord", object_name(F.col("object")).alias("o"), matching_name(F.col("country")).alias("c"), F.lower("category").alias("g"), "country_code")
    regional = named.filter("kind = 'regional'").select(F.col("s").alias("o"), "country_code", object_name(F.col("folder")).alias("k"))
    parts = [
        (1, "regional", keyed.join(regional, ["o", "country_code"]).join(objects, "k")),
        (2, "exact", keyed.join(objects, F.col("o") == F.col("k"))),
        (3, "synonym", keyed.join(first.filter("kind = 'object'"), F.col("o") == F.col("s")).withColumn("k", object_name(F.col("folder"))).join(objects, "k")),
        (4, "action", keyed.join(first.filter("kind = 'action'"), F.col("o") == F.col("s")).withColumn("k", object_name(F.col("folder"))).join(objects, "k")),
        (5, "country", keyed.join(pictures.filter("entity_type = 'countries'").withColumn("k", matching_name(F.col("item"))), F.col("c") == F.col("k"))),
        (6, "category", keyed.join(pictures.filter("entity_type = 'categories'").withColumn("k", F.lower("item")), F.col("g") == F.col("k"))),
    ]
    made = None
    for place, name, part in parts:
        one = part.select("ord", F.lit(place).alias("_place"), F.lit(name).alias("match"), "folder_type", "folder_item", "image_hash")
        made = one if made is None else made.unionByName(one)
    best = made.groupBy("ord").agg(F.min_by(F.struct("match", "folder_type", "folder_item", "image_hash"), F.struct("_place", "image_hash")).alias("b"))
    return wanted.join(best.select("ord", "b.*"), "ord", "left")


def image_url(base: str, size: int = 700) -> Column:
    path = F.concat_ws("/", F.col("folder_type"), F.url_encode("folder_item"), F.col("image_hash"))
    return F.when(F.col("image_hash").isNotNull(), F.concat(F.lit(base.rstrip("/") + "/"), path, F.lit(f"-{size}.jpg")))


def stock_query(most: int = 100) -> Column:
    """Text to search pictures for: the hint, else the category unless it is 'other'."""
    category = F.when(F.col("category") != "other", F.col("category"))
    return F.substring(F.coalesce(F.nullif(F.trim("stock"), F.lit("")), category), 1, most)


def image_chain(activities: DataFrame, photos: DataFrame, index: DataFrame, synonyms: DataFrame, stocks: Sequence[tuple[str, DataFrame]], base: str) -> DataFrame:
    """Adds image_url and image_url_source: the first that is found of

    the venue's own photo (``photos``: place_id, image_url; only where place_id is a venue's), the library's picture of the object unless stock
    pictures are preferred, each stock table (source, table of query and image_url) in turn, the library's picture where they are, and the
    category's picture unless it is 'other'.  activities: ord, place_id, is_venue, object, prefer_stock, stock, category, country_code.
    """
    asked = activities.select(
        "ord", F.when(F.col("is_venue"), F.col("place_id")).alias("_venue"), stock_query().alias("_query"), "object", "category", "country_code",
        F.when(~F.coalesce("prefer_stock", F.lit(False)), F.col("ord")).alias("_early"),
        F.when(F.col("prefer_stock"), F.col("ord")).alias("_late"),
        F.when(F.col("category") != "other", F.col("ord")).alias("_category"),
    )
    none = F.lit(None).cast("string")

    def pictures(**without: Column) -> DataFrame:
        rows = asked.select("ord", "object", "category", "country_code").withColumns({"country": none, **without})
        found = library_images(rows, index, synonyms).filter(F.col("image_hash").isNotNull())
        return found.select(F.col("ord").alias("key"), image_url(base).alias("image_url"))

    objects, categories = pictures(category=none), pictures(object=none)
    chain = [("google_places", photos.select(F.col("place_id").alias("key"), "image_url"), "_venue"), ("media_library", objects, "_early")]
    chain += [(source, table.select(F.col("query").alias("key"), "image_url"), "_query") for source, table in stocks]
    chain += [("media_library", objects, "_late"), ("media_library_category", categories, "_category")]
    return activities.join(first_of(asked, chain, "image_url").select("ord", "image_url", "image_url_source"), "ord", "left")


def article_name(query: Column) -> Column:
    """Name of an article as addresses have it: words with a capital, joined by underscores."""
    return F.array_join(F.transform(F.split(query, " "), lambda w: F.concat(F.upper(F.substring(w, 1, 1)), w.substr(F.lit(2), F.length(w)))), "_")


def article_images(activities: DataFrame, pictures: DataFrame) -> DataFrame:
    """Adds image_url and image_url_source (wiki_name, place_name, city or country: whose article has the first usable picture).

    pictures: article, rank, name, width, license, image_url; usable are photos of at least 400 pixels under an allowed licence, by rank."""
    usable = pictures.filter(is_photo_name(F.col("name")) & (F.col("width") >= LEAST_WIDTH) & license_check(F.col("license"))["allowed"])
    best = usable.groupBy(F.col("article").alias("key")).agg(F.min_by("image_url", F.struct("rank", "image_url")).alias("image_url"))
    names = ("wiki_name", "place_name", "city", "country")
    asked = activities.withColumns({f"_{n}": article_name(F.nullif(F.col(n), F.lit(""))) for n in names})
    return first_of(asked, [(n, best, f"_{n}") for n in names], "image_url").drop(*[f"_{n}" for n in names])


def image_stats(rows: DataFrame) -> DataFrame:
    """source, n: how many rows have their picture from where; 'none' for those without."""
    return rows.groupBy(F.coalesce("image_url_source", F.lit("none")).alias("source")).agg(F.count("*").alias("n"))


def needs_attribution(source: Column, license_: Column) -> Column:
    free = F.lower(F.trim(license_)).rlike("^(?:cc0|cc[- ]0|public[- ]?domain|pd)")
    return F.when(source == "wikipedia", ~F.coalesce(free, F.lit(False))).otherwise(source.isin("google_places", "pexels", "unsplash"))


def rank_image_matches(rows: DataFrame) -> DataFrame:
    """Adds matches: what a filter answered (index, confidence as JSON in ``response``), clamped and most confident first."""
    text = F.coalesce(F.nullif(F.regexp_extract("response", r"(?s)(\[.*\])", 1), F.lit("")), F.lit("[]"))
    items = F.from_json(text, "array<struct<index:int,confidence:double>>")
    clamped = F.transform(items, lambda x: F.struct((-F.least(F.lit(100.0), F.greatest(F.lit(0.0), F.coalesce(x["confidence"], F.lit(0.0))))).alias("c"), x["index"].alias("index")))
    return rows.withColumn("matches", F.transform(F.array_sort(clamped), lambda x: F.struct(x["index"].alias("index"), (-x["c"]).alias("confidence"))))
