"""Dense search by blocks: vectors are packed to matrices, and a pair of blocks is one matrix product in a task.

The stated query set is repeated for each of ``GROUPS`` groups of reference blocks and joined by the group, so a row of the
join is a pair of blocks, never a pair of vectors. What leaves a task is already reduced: the k best of a block a query, or
a number a query. Vectors must be of one length; a null vector, or one with a null or a value that isn't finite, is an error.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

ROWS = 1024
GROUPS = 32


def _ids(column: pa.Array) -> np.ndarray:
    return column.to_numpy(zero_copy_only=False)


def packed(rows: DataFrame, id_col: str, vector: str, limit: str | None = None, size: int = ROWS) -> DataFrame:
    """(ids, limits, matrix, block): rows of one partition in blocks of ``size``; ``matrix`` is its float64 rows as bytes."""
    ready = rows.select(F.col(id_col).cast("long").alias("id"), (F.col(limit) if limit else F.lit(None)).cast("double").alias("limit"), F.col(vector).cast("array<double>").alias("x"))

    def pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[pa.RecordBatch] = []
        for batch in batches:
            held.append(batch)
            while sum(b.num_rows for b in held) >= size:
                whole = pa.Table.from_batches(held).combine_chunks()
                yield _block(whole.slice(0, size))
                held = whole.slice(size).to_batches()
        if sum(b.num_rows for b in held):
            yield _block(pa.Table.from_batches(held))

    made = ready.mapInArrow(pack, "ids array<long>, limits array<double>, matrix binary")
    return made.withColumn("block", F.monotonically_increasing_id())


def _block(table: pa.Table) -> pa.RecordBatch:
    table = table.combine_chunks()
    column = table.column("x").combine_chunks() if table.num_rows else table.column("x")
    column = column.chunk(0) if isinstance(column, pa.ChunkedArray) else column
    flat = column.flatten().to_numpy(zero_copy_only=False)
    if column.null_count or len(flat) % table.num_rows or not np.isfinite(flat).all() or len(set(np.diff(column.offsets.to_numpy()))) > 1:
        raise ValueError("vectors must be of one length, without nulls and finite")
    return pa.RecordBatch.from_pydict({"ids": [table.column("id").to_pylist()], "limits": [table.column("limit").to_pylist()], "matrix": [flat.astype(np.float64).tobytes()]}, schema=pa.schema([("ids", pa.list_(pa.int64())), ("limits", pa.list_(pa.float64())), ("matrix", pa.binary())]))


Reduce = Callable[[np.ndarray, np.ndarray, np.ndarray, np.ndarray], dict[str, np.ndarray]]


def block_pairs(queries: DataFrame, references: DataFrame, reduce: Reduce, schema: str, groups: int = GROUPS) -> DataFrame:
    """Rows that ``reduce(products, query ids, reference ids, query limits)`` makes of each pair of packed blocks."""
    q = queries.select(F.col("ids").alias("q_ids"), F.col("limits").alias("q_limits"), F.col("matrix").alias("q_matrix"), F.explode(F.sequence(F.lit(0), F.lit(groups - 1))).alias("group"))
    r = references.select(F.col("ids").alias("r_ids"), F.col("matrix").alias("r_matrix"), F.pmod(F.xxhash64("block"), F.lit(groups)).cast("int").alias("group"))
    names = [x.split(" ")[0] for x in schema.split(", ")]

    def products(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i in range(batch.num_rows):
                q_ids, r_ids = (np.array(batch.column(c)[i].as_py(), np.int64) for c in ("q_ids", "r_ids"))
                q_matrix, r_matrix = (np.frombuffer(batch.column(c)[i].as_buffer(), np.float64) for c in ("q_matrix", "r_matrix"))
                limits = np.array([np.nan if x is None else x for x in batch.column("q_limits")[i].as_py()])
                out = reduce(q_matrix.reshape(len(q_ids), -1) @ r_matrix.reshape(len(r_ids), -1).T, q_ids, r_ids, limits)
                yield pa.RecordBatch.from_arrays([pa.array(out[n]) for n in names], names)

    return q.join(r, "group").select("q_ids", "q_limits", "q_matrix", "r_ids", "r_matrix").mapInArrow(products, schema)


def _each(products: np.ndarray, q_ids: np.ndarray, r_ids: np.ndarray, keep: np.ndarray) -> dict[str, np.ndarray]:
    a, b = np.nonzero(keep)
    return {"query": q_ids[a], "reference": r_ids[b], "score": products[a, b]}


def all_scores(queries: DataFrame, references: DataFrame, own: bool = False, places: int = 6) -> DataFrame:
    """(query, reference, score) of every pair of packed queries and references, where that is the result itself."""

    def reduce(products, q_ids, r_ids, limits):
        return _each(np.round(products, places), q_ids, r_ids, np.ones(products.shape, bool) if own else q_ids[:, None] != r_ids)

    return block_pairs(queries, references, reduce, "query long, reference long, score double")


def top_k(queries: DataFrame, references: DataFrame, k: int, own: bool = False, places: int = 6) -> DataFrame:
    """(query, reference, score, rank): k best, of equal scores the smaller reference; a block gives at most k rows a query."""

    def reduce(products, q_ids, r_ids, limits):
        scores = np.round(products, places)
        if not own:
            scores[q_ids[:, None] == r_ids] = -np.inf
        order = np.lexsort((np.broadcast_to(r_ids, scores.shape), -scores), axis=1)[:, :k]
        keep = np.zeros(scores.shape, bool)
        np.put_along_axis(keep, order, True, 1)
        return _each(scores, q_ids, r_ids, keep & (scores > -np.inf))

    best = Window.partitionBy("query").orderBy(F.desc("score"), "reference")
    return block_pairs(queries, references, reduce, "query long, reference long, score double").withColumn("rank", F.row_number().over(best)).where(F.col("rank") <= k)


def larger_counts(queries: DataFrame, references: DataFrame, own: bool = False, places: int = 6) -> DataFrame:
    """(query, larger): how many references score more than the query's limit; 0 for a null limit. A block gives a number a query."""

    def reduce(products, q_ids, r_ids, limits):
        more = np.round(products, places) > limits[:, None]
        if not own:
            more &= q_ids[:, None] != r_ids
        return {"query": q_ids, "larger": more.sum(1).astype(np.int64)}

    return block_pairs(queries, references, reduce, "query long, larger long").groupBy("query").agg(F.sum("larger").alias("larger"))
