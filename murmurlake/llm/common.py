"""Helpers shared by the corpus operators."""

from __future__ import annotations

import itertools
import os
import re
import tempfile
import uuid
from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: Rows that a Python worker turns into objects at once; long texts make small slices sensible.
SLICE_ROWS = 256


def ids_and_texts(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The id and the text alone, null texts as empty ones; other columns can't clash with ours."""
    return docs.select(
        F.col(id_col).cast("long").alias(id_col),
        F.coalesce(F.col(text_col).cast("string"), F.lit("")).alias(text_col),
    )


def map_rows(df: DataFrame, make: Callable[[], Callable[[list], list[tuple]]], schema: str) -> DataFrame:
    """Apply ``make()`` (run once a task) to slices of rows; it gets the columns as lists and returns the result's columns."""
    from pyspark.sql.types import StructType
    from pyspark.sql.pandas.types import to_arrow_schema

    kind = StructType.fromDDL(schema)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        out = to_arrow_schema(kind)
        work = make()
        for batch in batches:
            for start in range(0, batch.num_rows, SLICE_ROWS):
                part = batch.slice(start, SLICE_ROWS)
                columns = work([c.to_pylist() for c in part.columns])
                yield pa.RecordBatch.from_arrays(
                    [pa.array(c, type=f.type) for c, f in zip(columns, out, strict=True)], schema=out
                )

    return df.mapInArrow(run, schema)


def shared_folder(spark: SparkSession, name: str) -> str:
    """A new folder below spark.checkpoint.dir, which all executors share; where that is unset one of our own, in local mode only."""
    base = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getConf().get("spark.checkpoint.dir")
    if not base:
        if not re.fullmatch(r"local(\[.*\])?", spark.sparkContext.master):
            raise ValueError("spark.checkpoint.dir must name a folder that driver and executors share")
        base = os.path.join(tempfile.gettempdir(), "murmurlake-shared")
    return f"{base.rstrip('/')}/{name}-{uuid.uuid4().hex}"


#: Shuffle files go when the query that wrote them is over; Spark makes them anew if a later query should need them.
_CLEANUP = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"


def written(df: DataFrame, name: str, *by: str) -> DataFrame:
    """Write to the shared folder, in folders ``by`` columns, and read again: the lineage ends here and lost executors cost nothing."""
    spark = df.sparkSession
    path = shared_folder(spark, name)
    before = spark.conf.get(_CLEANUP, "false")
    spark.conf.set(_CLEANUP, "true")
    try:
        (df.write.partitionBy(*by) if by else df.write).mode("overwrite").parquet(path)
    finally:
        spark.conf.set(_CLEANUP, before)
    return spark.read.schema(df.schema).parquet(path)


def forget(*tables: DataFrame) -> None:
    """Delete the files of tables that ``written`` made and that no later step reads."""
    for df in tables:
        spark = df.sparkSession
        for file in df.inputFiles()[:1]:
            folder = spark._jvm.org.apache.hadoop.fs.Path(file).getParent()
            folder.getFileSystem(spark._jsc.hadoopConfiguration()).delete(folder, True)


def sha256_hex(column: Column) -> Column:
    return F.sha2(column.cast("binary"), 256)


def chunks(rows: list, n: int) -> Iterator[list]:
    it = iter(rows)
    while part := list(itertools.islice(it, n)):
        yield part
