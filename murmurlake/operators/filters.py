"""Selection and order for exports."""

from __future__ import annotations

import datetime
import re
from collections.abc import Mapping, Sequence
from dataclasses import dataclass
from typing import Any

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from murmurlake.functions.text import matches


@dataclass(frozen=True)
class ExportFilter:
    categories: Sequence[str] = ()
    countries: Sequence[str] = ()
    senders: Sequence[str] = ()
    start: datetime.date | None = None
    end: datetime.date | None = None
    min_score: float = 0.0
    only_locations: bool = False
    only_generic: bool = False
    order: str = "score"
    limit: int | None = None


def option_date(text: str | None) -> datetime.date | None:
    """A day as YYYY-MM-DD; None where it isn't one."""
    try:
        return datetime.date.fromisoformat(text) if text else None
    except ValueError:
        return None


def filter_of(kind: str, args: Mapping[str, Any], config: Mapping[str, Any] | None = None) -> ExportFilter:
    """The filter of an export of one kind from options named export_*, and pdf_* before them for 'pdf'.

    An option of the command line goes before the same one of the settings, and those of pdf before the general ones.  Empty lists count as unset
    everywhere, no limit and the order by score only on the command line; flags hold if any place sets them.
    """
    layers = [(t, f"{lead}_", t is args) for lead in (("pdf", "export") if kind == "pdf" else ("export",)) for t in (args, config or {})]

    def first(name: str, default: Any = None) -> Any:
        for table, lead, typed in layers:
            value = table.get(lead + name)
            if value is None or value in ([], ()) or (typed and (name, value) in (("max_activities", 0), ("sort", "score"))):
                continue
            return value
        return default

    def flag(name: str) -> bool:
        return any(bool(table.get(lead + name)) for table, lead, _ in layers)

    return ExportFilter(
        categories=tuple(first("categories", ())),
        countries=tuple(first("countries", ())),
        senders=tuple(first("from", ())),
        start=option_date(first("start_date")),
        end=option_date(first("end_date")),
        min_score=float(first("min_score", 0)),
        only_locations=flag("only_locations"),
        only_generic=flag("only_generic"),
        order=first("sort", "score"),
        limit=max(0, first("max_activities", 0)) or None,
    )


def normal_country(column: Column, countries: dict[str, str]) -> Column:
    """Names for codes and aliases (keys in upper case); trimmed input otherwise, null for blanks."""
    trimmed = F.nullif(F.trim(column), F.lit(""))
    if not countries:
        return trimmed
    table = F.create_map(*[F.lit(x) for kv in countries.items() for x in kv])
    return F.coalesce(F.element_at(table, F.upper(trimmed)), trimmed)


def is_mappable() -> Column:
    return F.coalesce(*[F.nullif(c, F.lit("")) for c in ("place_name", "place_query", "city", "region", "country")]).isNotNull()


def location_text() -> Column:
    return F.nullif(F.concat_ws(", ", *[F.nullif(c, F.lit("")) for c in ("place_name", "city", "region", "country")]), F.lit(""))


def combined_score(fun: Column, interesting: Column) -> Column:
    return F.floor((interesting * 2 + fun) / 3 * 10 + 0.5).cast("double") / 10


def sender_matches(sender: Column, wanted: str) -> Column:
    return matches(sender, rf"\b{re.escape(wanted)}\b")


def select_activities(activities: DataFrame, f: ExportFilter, countries: dict[str, str] | None = None) -> DataFrame:
    if f.only_locations and f.only_generic:
        raise ValueError("only_locations and only_generic exclude each other")
    df, first = activities, F.try_element_at("messages", F.lit(1))["timestamp"]
    if f.categories:
        df = df.filter(F.lower("category").isin(*[c.lower() for c in f.categories]))
    if f.countries:
        table = {k.upper(): v for k, v in (countries or {}).items()}
        wanted = [table.get(c.strip().upper(), c.strip()) for c in f.countries]
        df = df.filter(normal_country(F.col("country"), table).isin(*wanted))
    if f.senders:
        df = df.filter(F.exists("messages", lambda m: _any(sender_matches(m["sender"], s) for s in f.senders)))
    if f.start:
        df = df.filter(first.isNull() | (first >= F.lit(f.start).cast("timestamp")))
    if f.end:
        df = df.filter(first.isNull() | (first < F.lit(f.end + datetime.timedelta(days=1)).cast("timestamp")))
    if f.min_score > 0:
        df = df.filter(F.col("score") >= f.min_score)
    if f.only_locations:
        df = df.filter(is_mappable())
    if f.only_generic:
        df = df.filter(~is_mappable())
    at = F.coalesce(first, F.timestamp_seconds(F.lit(0)))
    order = {"score": F.desc("score"), "oldest": at.asc(), "newest": at.desc()}[f.order]
    df = df.orderBy(order, "ord")
    return df.limit(f.limit) if f.limit else df


def _any(tests) -> Column:
    made = F.lit(False)
    for t in tests:
        made = made | t
    return made


def category_rollup(activities: DataFrame) -> DataFrame:
    """Counts by country and category, by country, and in all."""
    return activities.withColumn("country", F.coalesce("country", F.lit("General"))).rollup("country", "category").agg(F.count("*").alias("n"))


def geo_center(rows: DataFrame) -> DataFrame:
    located = rows.filter("latitude IS NOT NULL AND longitude IS NOT NULL")
    return located.agg(F.count("*").alias("located"), F.coalesce(F.avg("latitude"), F.lit(0.0)).alias("lat"), F.coalesce(F.avg("longitude"), F.lit(0.0)).alias("lng"))
