"""Tables between the steps of a query, and dense numbers that rest on them."""

from __future__ import annotations

import os
import re
import tempfile
import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F


def shared_folder(spark: SparkSession, name: str) -> str:
    """A new folder below ``spark.checkpoint.dir``; where that is unset, local mode alone has a folder of its own."""
    base = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getConf().get("spark.checkpoint.dir")
    if not base:
        if not re.fullmatch(r"local(\[.*\])?", spark.sparkContext.master):
            raise ValueError("spark.checkpoint.dir must name a folder that driver and executors share")
        base = os.path.join(tempfile.gettempdir(), "murmurlake-shared")
    return f"{base.rstrip('/')}/{name}-{uuid.uuid4().hex}"


def stored(df: DataFrame, name: str) -> DataFrame:
    """The table, written to the shared folder and read again: its rows can't change between two readers, and lost executors cost nothing."""
    path = shared_folder(df.sparkSession, name)
    df.write.mode("overwrite").parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def numbered(df: DataFrame, order: list[Column], number: str = "number", start: int = 1, by: tuple[str, ...] = (), ties: tuple[Column, ...] = (), drop: tuple[str, ...] = ()) -> DataFrame:
    """Adds ``number``: start, start + 1, ... in the order given, over the whole table or for each value of the columns ``by``, which come first
    in the order.

    Rows are dealt by ranges of the order and numbered where they lie; a second pass adds what stands before a range: a row for each range,
    and one for each value of ``by`` that goes on from an earlier range, so both tables that are sent to all tasks have at most as many rows
    as there are ranges.  No task holds the whole table, nor all rows of a value.  ``ties`` order rows within a range only; rows of equal
    order and ties are numbered in any order.  Columns ``drop`` go once the rows are in order.
    """
    place, part, first, before = (f"_{x}_{number}" for x in ("place", "part", "first", "before"))
    dealt = df.repartitionByRange(*[F.col(c) for c in by], *order).sortWithinPartitions(*[F.col(c) for c in by], *order, *ties)
    laid = stored(dealt.drop(*drop).withColumn(place, F.monotonically_increasing_id()), "numbered").withColumn(part, F.shiftright(place, 33))
    held = laid.groupBy(part, *by).agg(F.count("*").alias("_n"), F.min(place).alias(first))
    if not by:
        found, sums = 0, []
        for row in sorted(held.collect(), key=lambda r: r[part]):  # a row for each range
            sums.append((row[part], row[first], found))
            found += row["_n"]
        told = df.sparkSession.createDataFrame(sums, f"{part} long, {first} long, {before} long")
        return laid.join(F.broadcast(told), part).withColumn(number, F.col(place) - F.col(first) + F.col(before) + start).drop(place, part, first, before)
    # Values that start in an earlier range are the first of their range: at most one for each.
    least = held.groupBy(part).agg(F.min(first).alias("_least"))
    heads = held.join(F.broadcast(least), part).filter(F.col(first) == F.col("_least")).collect()
    ends = held.groupBy(part).agg(F.max(F.struct(F.col(first), F.col("_n"), *by)).alias("_end")).collect()
    last = {r[part]: r["_end"] for r in ends}
    carried, open_rows, sums = None, 0, []
    for row in sorted(heads, key=lambda r: r[part]):
        value = tuple(row[c] for c in by)
        if value == carried:
            sums.append((row[part], row[first], open_rows))
        end = last[row[part]]
        ended = tuple(end[c] for c in by)
        open_rows = end["_n"] + (open_rows if value == carried and ended == value else 0)
        carried = ended
    told = df.sparkSession.createDataFrame(sums, f"{part} long, {first} long, {before} long")
    starts = held.select(part, *by, first)
    starts = starts.join(F.broadcast(told), [part, first], "left").withColumn(before, F.coalesce(before, F.lit(0)))
    same = F.lit(True)
    names = {c: f"_{c}_{number}" for c in (part, *by)}
    for c, other in names.items():
        same = F.col(c).eqNullSafe(F.col(other)) & same
    starts = starts.select(first, before, *[F.col(c).alias(other) for c, other in names.items()])
    made = laid.join(starts, same).withColumn(number, F.col(place) - F.col(first) + F.col(before) + start)
    return made.drop(place, part, first, before, *names.values())
