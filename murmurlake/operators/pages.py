"""Metadata of fetched pages."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from murmurlake.functions.text import decode_entities, hashtags
from murmurlake.functions.urls import domain

# Types of JSON-LD blocks that tell of a page.
PAGE_TYPES = ("Article", "NewsArticle", "BlogPosting", "WebPage", "Product", "Place", "LocalBusiness", "Restaurant", "Event", "Organization")


def open_graph(html: Column) -> Column:
    """map of og names to contents, attributes in either order; the later of equal names wins."""
    one = r"""(?i)<meta[^>]+property=["']og:([^"']+)["'][^>]+content=["']([^"']*)["']"""
    two = r"""(?i)<meta[^>]+content=["']([^"']*)["'][^>]+property=["']og:([^"']+)["']"""
    names = F.concat(F.regexp_extract_all(html, F.lit(one), F.lit(1)), F.regexp_extract_all(html, F.lit(two), F.lit(2)))
    values = F.concat(F.regexp_extract_all(html, F.lit(one), F.lit(2)), F.regexp_extract_all(html, F.lit(two), F.lit(1)))
    pairs = F.arrays_zip(names.alias("k"), values.alias("v"))
    last = F.filter(pairs, lambda p, i: ~F.exists(F.slice(names, i + 2, F.greatest(F.size(names), F.lit(1))), lambda later: later == p["k"]))
    return F.map_from_entries(last)


def json_ld(html: Column) -> Column:
    return F.regexp_extract_all(html, F.lit(r"""(?is)<script[^>]*type=["']application/ld\+json["'][^>]*>(.*?)</script>"""), F.lit(1))


def json_ld_of(html: Column, types: tuple[str, ...] = PAGE_TYPES) -> Column:
    """The first JSON-LD block whose type is one of ``types``; blocks of several types, lists and broken ones don't count."""
    return F.try_element_at(F.filter(json_ld(html), lambda block: F.get_json_object(block, "$['@type']").isin(*types)), F.lit(1))


def assigned_json(html: Column, name: str) -> Column:
    """The page from the object on that a script assigns to ``name``; get_json_object reads that object up to its own closing brace, whatever
    braces stand in its strings, and leaves the rest of the page alone."""
    return F.nullif(F.regexp_extract(html, rf"(?s)\b{name}\s*=\s*(\{{.*)", 1), F.lit(""))


def image_in(block: Column, path: str = "image") -> Column:
    """Address in an image that is told as a text, a list (the first counts) or an object."""
    return F.coalesce(*[F.get_json_object(block, f"$.{path}{end}") for end in (".url", "[0].url", "[0]", "")])


def generic_metadata(pages: DataFrame) -> DataFrame:
    """url, title, description, image_url, hashtags, categories of pages of no known platform: names of a typed block before Open Graph, its
    picture after it; the domain and the block's type are categories.  Pages that tell neither title nor description have no row."""
    read = pages.select("url", open_graph(F.col("html")).alias("_og"), json_ld_of(F.col("html")).alias("_ld"))

    def told(*names: str) -> Column:
        return F.coalesce(*[F.get_json_object("_ld", f"$.{n}") for n in names])

    def og(name: str) -> Column:
        return F.try_element_at(F.col("_og"), F.lit(name))

    raw = read.select(
        "url", told("name", "headline").alias("_t"), og("title").alias("_ot"), told("description").alias("_d"), og("description").alias("_od"),
        og("image").alias("_oi"), image_in(F.col("_ld")).alias("_i"), F.lower(F.get_json_object("_ld", "$['@type']")).alias("_type"),
    ).filter("coalesce(_t, _ot, _d, _od) IS NOT NULL")
    # Decoding keeps nulls, so rows are told by what isn't decoded yet.
    description = F.coalesce(F.col("_d"), decode_entities(F.col("_od")))
    made = raw.select(
        "url",
        F.coalesce(F.col("_t"), decode_entities(F.col("_ot"))).alias("title"),
        description.alias("description"),
        F.coalesce(decode_entities(F.col("_oi")), F.col("_i")).alias("image_url"),
        F.array_compact(F.array(domain(F.col("url")), F.col("_type"))).alias("categories"),
    )
    tags = F.coalesce(hashtags(F.col("description")), F.array().cast("array<string>"))
    return made.select("url", "title", "description", "image_url", tags.alias("hashtags"), "categories")


def page_metadata(pages: DataFrame) -> DataFrame:
    """url, domain, title, description, image_url, hashtags: JSON-LD first, then Open Graph, then the title element."""
    read = pages.withColumns({"_og": open_graph(F.col("html")), "_ld": F.try_element_at(json_ld(F.col("html")), F.lit(1))})

    def pick(ld: str, og: str) -> Column:
        return F.coalesce(F.get_json_object("_ld", f"$.{ld}"), F.try_element_at("_og", F.lit(og)))

    title = F.coalesce(pick("name", "title"), F.nullif(F.regexp_extract("html", r"(?is)<title[^>]*>(.*?)</title>", 1), F.lit("")))
    description = pick("description", "description")
    return read.select(
        "url",
        domain(F.col("url")).alias("domain"),
        decode_entities(title).alias("title"),
        decode_entities(description).alias("description"),
        pick("image", "image").alias("image_url"),
        F.coalesce(hashtags(description), F.array().cast("array<string>")).alias("hashtags"),
    )
