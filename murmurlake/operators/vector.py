"""Similarity search over embeddings."""

from __future__ import annotations

from collections.abc import Iterator, Sequence

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_schema

#: Bytes of queries that are sent to all tasks at once, and rows that a task multiplies with them at once.
BLOCK_BYTES, ROWS_AT_ONCE = 8_000_000, 64
#: Vectors of a value of ``within`` that one task takes together; and similarities that it holds at once.
WHOLE, HELD = 4096, 1 << 20


def _dot(a: Column, b: Column) -> Column:
    return F.aggregate(F.zip_with(a, b, lambda x, y: x.cast("double") * y.cast("double")), F.lit(0.0), lambda s, x: s + x)


def cosine(a: Column, b: Column) -> Column:
    """Cosine similarity in double; 0 for a zero vector, null where the dimensions differ."""
    norm = F.sqrt(_dot(a, a)) * F.sqrt(_dot(b, b))
    return F.when(F.size(a) == F.size(b), F.when(norm == 0, 0.0).otherwise(_dot(a, b) / norm))


def top_k(vectors: DataFrame, query: list[float], k: int, least: float = 0.0) -> DataFrame:
    """id, similarity of the k most similar vectors, by similarity and then id."""
    scored = vectors.select("id", cosine(F.col("embedding"), F.lit(query).cast("array<double>")).alias("similarity"))
    return scored.filter(F.col("similarity") >= least).orderBy(F.desc("similarity"), "id").limit(k)


def _best_in_task(vectors: DataFrame, asked: list, queries: np.ndarray, k: int, least: float, within: Sequence[str]) -> DataFrame:
    """The best ``k`` rows of each query (and value of ``within``) among the rows of each task: within, id, q_idx, similarity.

    Products are summed dimension by dimension for a slice of rows against all queries, so sums don't depend on where a row stands.  What a
    task holds is bounded by its queries: candidates are cut to k once they are twice as many.
    """
    kind = vectors.select(*within, "id").schema.add("q_idx", "long").add("similarity", "double")
    lengths = np.sqrt(_products(queries, queries, paired=True))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: pd.DataFrame | None = None
        waiting: list[pd.DataFrame] = []
        size = 0

        def cut(parts: list[pd.DataFrame]) -> pd.DataFrame:
            rows = pd.concat(parts).sort_values(["similarity", "id"], ascending=[False, True], kind="stable")
            return rows.groupby([*within, "q_idx"], dropna=False, sort=False).head(k)

        for batch in batches:
            for start in range(0, batch.num_rows, ROWS_AT_ONCE):
                part = batch.slice(start, ROWS_AT_ONCE)
                lists = part.column("embedding")
                fits = pc.equal(pc.list_value_length(lists), queries.shape[1]).fill_null(False)
                part = part.filter(fits)
                if not part.num_rows:
                    continue
                rows = pc.list_flatten(part.column("embedding")).to_numpy(zero_copy_only=False).astype(np.float64).reshape(part.num_rows, -1)
                scale = np.sqrt(_products(rows, rows, paired=True))[:, None] * lengths[None, :]
                with np.errstate(invalid="ignore", divide="ignore"):
                    found = np.where(scale == 0, 0.0, _products(rows, queries) / scale)
                row, query = np.nonzero(found >= least)
                told = part.select([*within, "id"]).to_pandas().take(row).reset_index(drop=True)
                waiting.append(told.assign(q_idx=np.array(asked, dtype=np.int64)[query], similarity=found[row, query]))
                size += len(row)
            if size > max(100_000, 0 if held is None else 2 * len(held)):
                held, waiting, size = cut([*([] if held is None else [held]), *waiting]), [], 0
        if waiting or held is not None:
            yield pa.RecordBatch.from_pandas(cut([*([] if held is None else [held]), *waiting]), schema=to_arrow_schema(kind), preserve_index=False)

    return vectors.select(*within, "id", "embedding").mapInArrow(run, kind)


def _best_of_groups(vectors: DataFrame, asked: list, queries: np.ndarray, k: int, least: float, within: Sequence[str]) -> DataFrame:
    """For each vector the best of these queries that has it among its best ``k`` of the value of ``within``: within, id, q_idx, similarity.

    Values lie whole in a task, one after another, so what leaves it, and what it holds, is in proportion to its vectors and not to their pairs with
    queries.  ``asked`` is in order."""
    kind = vectors.select(*within, "id").schema.add("q_idx", "long").add("similarity", "double")
    lengths, names = np.sqrt(_products(queries, queries, paired=True)), np.array(asked, dtype=np.int64)

    def keys_of(part: pa.RecordBatch) -> list[tuple]:
        return list(zip(*(part.column(c).to_pylist() for c in within), strict=True))

    def best(rows: pa.Table) -> Iterator[pa.RecordBatch]:
        """Of whole values; rows of one are in the order of their ids."""
        keys = keys_of(rows)
        rows = rows.combine_chunks()
        edges = [0, *(i for i in range(1, len(keys)) if keys[i] != keys[i - 1]), len(keys)]
        crowds = [(a, b) for a, b in zip(edges, edges[1:], strict=False) if b - a > k]
        own = pc.list_flatten(rows.column("embedding")).to_numpy().astype(np.float64).reshape(rows.num_rows, -1)
        own_lengths = np.sqrt(_products(own, own, paired=True))
        top, which = np.full(len(own), -np.inf), np.zeros(len(own), dtype=np.int64)
        width = max(1, HELD // len(own))
        for start in range(0, len(queries), width):
            end = start + width
            scale = own_lengths[:, None] * lengths[None, start:end]
            with np.errstate(invalid="ignore", divide="ignore"):
                found = np.where(scale == 0, 0.0, _products(own, queries[start:end]) / scale)
            kept = found >= least
            for a, b in crowds:
                order = np.argsort(-found[a:b], axis=0, kind="stable")
                np.put_along_axis(kept[a:b], order[k:], False, axis=0)
            found[~kept] = -np.inf
            first = found.argmax(axis=1)  # of equal ones the least q_idx
            value = found[np.arange(len(own)), first]
            better = value > top
            top[better], which[better] = value[better], names[start:end][first[better]]
        hit = np.flatnonzero(top > -np.inf)
        told = rows.select([*within, "id"]).take(hit).append_column("q_idx", pa.array(which[hit])).append_column("similarity", pa.array(top[hit]))
        yield from told.cast(to_arrow_schema(kind)).to_batches()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        waiting: list[pa.RecordBatch] = []
        last: tuple | None = None
        for batch in batches:
            for start in range(0, batch.num_rows, ROWS_AT_ONCE):
                part = batch.slice(start, ROWS_AT_ONCE)
                part = part.filter(pc.equal(pc.list_value_length(part.column("embedding")), queries.shape[1]).fill_null(False))
                if not part.num_rows:
                    continue
                keys = keys_of(part)
                going = keys.index(keys[-1])  # from here on rows may belong with the next ones
                if going or (waiting and keys[0] != last):
                    yield from best(pa.Table.from_batches([*waiting, part.slice(0, going)]))
                    waiting = []
                waiting.append(part.slice(going))
                last = keys[-1]
        if waiting:
            yield from best(pa.Table.from_batches(waiting))

    dealt = vectors.select(*within, "id", "embedding").repartition(*within).sortWithinPartitions(*within, "id")
    return dealt.mapInArrow(run, kind)


def _by_size(vectors: DataFrame, within: Sequence[str]) -> tuple[DataFrame, DataFrame | None]:
    """The vectors of values of ``within`` that have at most ``WHOLE``, and those of larger ones, if there are any."""
    large = vectors.groupBy(*within).agg(F.count("*").alias("_n")).filter(F.col("_n") > WHOLE)
    if large.isEmpty():
        return vectors, None
    names = large.select(*[F.col(c).alias(f"_large_{c}") for c in within])
    same = F.lit(True)
    for c in within:
        same = F.col(c).eqNullSafe(F.col(f"_large_{c}")) & same
    return vectors.join(names, same, "left_anti"), vectors.join(names, same, "left_semi")


def _products(a: np.ndarray, b: np.ndarray, paired: bool = False) -> np.ndarray:
    """Dot products of all rows of a and b, or of each row of a with its own of b, summed in the order of the dimensions."""
    out = np.zeros(len(a) if paired else (len(a), len(b)))
    for d in range(a.shape[1]):
        out += a[:, d] * b[:, d] if paired else a[:, d, None] * b[None, :, d]
    return out


def best_query(vectors: DataFrame, queries: DataFrame, k: int, least: float, within: Sequence[str] = ()) -> DataFrame:
    """id, q_idx, similarity: each query's k best vectors at ``least`` or above, then the best query of each vector.

    ``queries`` (q_idx, embedding) go to the tasks in blocks of at most ``BLOCK_BYTES`` by hash of q_idx, so each query is whole in one block;
    a task gives at most k rows for a query, which are ranked together afterwards.  Vectors and queries of different dimensions don't meet.
    ``within`` names columns of the vectors whose values are searched apart; they are returned too.  Values of up to ``WHOLE`` vectors are searched
    by one task each, which gives at most one row for a vector and block; larger ones by many.
    """
    told = queries.select(F.col("q_idx").cast("long").alias("q_idx"), F.col("embedding").cast("array<double>").alias("embedding"))
    sizes = told.groupBy(F.size("embedding").alias("dims")).agg(F.count("*").alias("n")).filter("dims > 0").collect()  # as many as there are models
    by_query = Window.partitionBy(*within, "q_idx").orderBy(F.desc("similarity"), "id")
    kept, many = None, vectors
    if within:
        few, many = _by_size(vectors, within)
    for size in sizes:
        blocks = max(1, -(-size["n"] * size["dims"] * 8 // BLOCK_BYTES))
        for block in range(blocks):
            rows = told.filter((F.size("embedding") == size["dims"]) & (F.pmod(F.xxhash64("q_idx"), F.lit(blocks)) == block)).orderBy("q_idx").toArrow()
            if not rows.num_rows:
                continue
            matrix = pc.list_flatten(rows.column("embedding")).to_numpy().reshape(rows.num_rows, -1)
            asked, parts = rows.column("q_idx").to_pylist(), []
            if within:
                parts.append(_best_of_groups(few, asked, matrix, k, least, within))
            if many is not None:
                part = _best_in_task(many, asked, matrix, k, least, within)
                parts.append(part.withColumn("_n", F.row_number().over(by_query)).filter(F.col("_n") <= k).drop("_n"))
            for part in parts:
                kept = part if kept is None else kept.unionByName(part)
    if kept is None:
        return vectors.select(*within, "id", F.lit(None).cast("long").alias("q_idx"), F.lit(None).cast("double").alias("similarity")).limit(0)
    by_vector = Window.partitionBy(*within, "id").orderBy(F.desc("similarity"), "q_idx")
    return kept.withColumn("_n", F.row_number().over(by_vector)).filter("_n = 1").select(*within, "id", "q_idx", "similarity")
