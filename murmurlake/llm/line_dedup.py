"""Line dedup over overlapping windows of three consecutive lines.

Every window of ``width`` lines of a text is hashed to 128 bits; windows that occur more than once anywhere are found by
one aggregation (copies are combined before the shuffle, so a common window is one row a task), and the first occurrence,
by doc_id, hash of the text and line, stays.  All later occurrences mark the lines they cover; covered positions of a document are
merged and its other lines joined again.  Windows that hold nothing but white space don't count.

Edge cases: null texts stay null, texts with fewer than ``width`` lines are left alone; rows that share a doc_id (null too) but not their
text are documents of their own; rows equal in both are one document, whose windows are first occurrences or later ones together; an empty
table gives an empty result; columns of any name are kept, and one called like the added struct is an error unless ``into`` names another.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

WIDTH = 3


def _lines(text: Column) -> Column:
    return F.split(text, "\n", -1)


def windows(docs: DataFrame, width: int = WIDTH) -> DataFrame:
    """lid, tid (hash of the text), line, k1, k2: one row for each window."""
    lines = F.col("lls")
    last = F.size("lls") - width
    hashed = F.transform(
        F.sequence(F.lit(0), last),
        lambda i: F.struct(
            i.alias("line"),
            F.concat_ws("\n", F.slice(lines, i + 1, width)).alias("three"),
        ),
    )
    return (
        docs.select(F.col("doc_id").cast("long").alias("lid"), F.xxhash64("text").alias("tid"), _lines(F.col("text")).alias("lls"))
        .filter(last >= 0)
        .select("lid", "tid", F.explode(hashed).alias("w"))
        .filter(F.length(F.trim(F.regexp_replace("w.three", r"\s+", ""))) > 0)
        .select(
            "lid",
            "tid",
            F.col("w.line").alias("line"),
            F.xxhash64("w.three").alias("k1"),
            F.xxhash64(F.lit(7), "w.three").alias("k2"),
        )
    )


def covered_lines(docs: DataFrame, width: int = WIDTH) -> DataFrame:
    """lid, tid, gone (sorted array of the lines that later occurrences cover)."""
    rows = windows(docs, width)
    first = (
        rows.groupBy("k1", "k2")
        .agg(F.count("*").alias("n"), F.min(F.struct("lid", "tid", "line")).alias("first"))
        .filter("n > 1")
    )
    later = rows.join(first, ["k1", "k2"]).filter(
        ~(F.col("lid").eqNullSafe(F.col("first.lid")) & (F.col("tid") == F.col("first.tid")) & (F.col("line") == F.col("first.line")))
    )
    return later.groupBy("lid", "tid").agg(F.collect_set("line").alias("starts")).select(
        "lid",
        "tid",
        F.array_sort(F.array_distinct(F.flatten(F.transform("starts", lambda s: F.sequence(s, s + (width - 1)))))).alias("gone"),
    )


def remove_repeated_lines(docs: DataFrame, width: int = WIDTH, into: str = "line_dedup") -> DataFrame:
    """``docs`` with the columns n_lines, n_removed and kept_text added under ``into``, a struct of a name that is free."""
    if into.lower() in map(str.lower, docs.columns):
        raise ValueError(f"the documents have a column {into}")
    mark = "_".join(["gone", *docs.columns])  # no column has this name
    gone = covered_lines(docs, width).select(F.col("lid").alias(f"{mark}_id"), F.col("tid").alias(f"{mark}_text"), F.col("gone").alias(mark))
    lines = _lines(F.col("text"))
    here = F.col("doc_id").cast("long").eqNullSafe(F.col(f"{mark}_id")) & (F.xxhash64("text") == F.col(f"{mark}_text"))
    merged = docs.join(gone, here, "left")
    stay = F.array_except(F.sequence(F.lit(0), F.size(lines) - 1), F.col(mark))
    left = F.transform(stay, lambda i: F.get(lines, i))
    return merged.select(
        *[F.col(f"`{c}`") for c in docs.columns],
        F.struct(
            F.when(F.col("text").isNull(), 0).otherwise(F.size(lines)).cast("long").alias("n_lines"),
            F.when(F.col(mark).isNull(), 0).otherwise(F.size(mark)).cast("long").alias("n_removed"),
            F.when(F.col(mark).isNull(), F.col("text")).otherwise(F.array_join(left, "\n")).alias("kept_text"),
        ).alias(into),
    )
