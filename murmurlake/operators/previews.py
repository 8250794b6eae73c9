"""Previews of the addresses that activities link to."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from murmurlake.functions.urls import domain

SHOWN = ("title", "description", "image_url")


def link_previews(activities: DataFrame, metadata: DataFrame, entities: DataFrame) -> DataFrame:
    """One row an activity with a link: what its page says, then what the thing it names says.

    ``activities``: activity_id, link.  ``metadata``: url, canonical_url, title, description, image_url.  ``entities``: activity_id, title,
    description, image_url, kind, ids.  Of several rows for a page or an activity always the same counts.  Activities with a null or empty
    link have no preview.
    """
    pages = metadata.groupBy(F.col("url").alias("link")).agg(F.min(F.struct("canonical_url", *SHOWN)).alias("m"))
    things = entities.groupBy("activity_id").agg(F.min_by(F.struct(*SHOWN, "kind", "ids"), F.struct(*SHOWN, "kind")).alias("e"))
    linked = activities.select("activity_id", "link").filter(F.col("link") != "")
    made = linked.join(pages, "link", "left").join(things, "activity_id", "left")
    return made.select(
        "activity_id",
        F.coalesce(F.nullif(F.col("m.canonical_url"), F.lit("")), "link").alias("url"),
        *[F.coalesce(f"m.{c}", f"e.{c}").alias(c) for c in SHOWN],
        domain(F.col("link")).alias("domain"),
        F.when(F.col("e").isNotNull(), "resolved").otherwise("scraped").alias("source"),
        F.col("e.kind").alias("entity_type"),
        F.col("e.ids").alias("external_ids"),
    )
