"""Exact nearest vectors, in blocks: a stated set of queries against all rows."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

#: Numbers of the query vectors that a task holds at a time (8 MB); more are searched in several passes.
BLOCK = 1_000_000


def blocks(queries: DataFrame) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """(ids, vectors) of the stated queries, at most `BLOCK` numbers at a time."""
    ids, vectors, held = [], [], 0
    for r in queries.select("id", "embedding").toLocalIterator():
        ids.append(r[0])
        vectors.append(r[1])
        held += len(r[1])
        if held >= BLOCK:
            yield np.array(ids, np.int64), np.array(vectors, np.float64)
            ids, vectors, held = [], [], 0
    if ids:
        yield np.array(ids, np.int64), np.array(vectors, np.float64)


def best_of_groups(queries: DataFrame, rows: DataFrame, group: str) -> DataFrame:
    """(query_id, group, best): for each query and each group of rows the largest scalar product with a row of it.

    A partition keeps one number for each query and group that it has met, and hands them on when they become many.
    """

    def find(q_ids: np.ndarray, q: np.ndarray) -> DataFrame:
        def make(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            best: dict = {}

            def out() -> pa.RecordBatch:
                names = list(best)
                return pa.RecordBatch.from_arrays([pa.array(np.tile(q_ids, len(names))), pa.array(np.repeat(np.arange(len(names)), len(q_ids))), pa.array(np.concatenate([best[n] for n in names]))], names=["query_id", "g", "best"]).set_column(1, group, pa.array([n for n in names for _ in range(len(q_ids))], kind))

            kind = None
            for b in batches:
                kind = b.column(0).type
                x = np.array(b.column(1).to_pylist(), np.float64).reshape(b.num_rows, -1)
                groups = b.column(0).to_pylist()
                for at in range(0, len(groups), 256):
                    dots = q @ x[at : at + 256].T
                    for k, name in enumerate(groups[at : at + 256]):
                        best[name] = np.maximum(best[name], dots[:, k]) if name in best else dots[:, k].copy()
                if len(best) * len(q_ids) > 4 * BLOCK:
                    yield out()
                    best.clear()
            if best:
                yield out()

        return rows.select(group, "embedding").mapInArrow(make, f"query_id long, {group} {rows.schema[group].dataType.simpleString()}, best double")

    found = None
    for q_ids, q in blocks(queries):
        part = find(q_ids, q)
        found = part if found is None else found.unionByName(part)
    if found is None:
        return rows.select(F.col("id").alias("query_id"), group, F.lit(0.0).alias("best")).limit(0)
    return found.groupBy("query_id", group).agg(F.max("best").alias("best"))


def nearest(queries: DataFrame, rows: DataFrame, k: int, metric: str = "l2") -> DataFrame:
    """(query_id, place, id, distance): each query's k nearest other rows, by squared Euclidean distance or 1 - cosine.

    Each partition keeps k rows a query, so k x partitions rows a query are shuffled.
    """

    def find(q_ids: np.ndarray, q: np.ndarray) -> DataFrame:
        def make(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            best_d, best_i = np.empty((len(q), 0)), np.empty((len(q), 0), np.int64)
            for b in batches:
                ids = b.column(0).to_numpy(zero_copy_only=False)
                x = np.array(b.column(1).to_pylist(), np.float64).reshape(len(ids), -1)
                for at in range(0, len(ids), 1024):
                    part, own = x[at : at + 1024], ids[at : at + 1024]
                    if metric == "l2":
                        d = np.maximum((q**2).sum(1)[:, None] - 2 * q @ part.T + (part**2).sum(1), 0)
                    else:
                        d = 1 - q @ part.T / np.maximum(np.linalg.norm(q, axis=1)[:, None] * np.linalg.norm(part, axis=1), 1e-30)
                    d[q_ids[:, None] == own] = np.inf
                    best_d, best_i = np.hstack([best_d, d]), np.hstack([best_i, np.broadcast_to(own, d.shape)])
                    keep = np.lexsort((best_i, best_d), axis=1)[:, :k]
                    best_d, best_i = np.take_along_axis(best_d, keep, 1), np.take_along_axis(best_i, keep, 1)
            there = np.isfinite(best_d)
            yield pa.RecordBatch.from_arrays([pa.array(np.repeat(q_ids, there.sum(1))), pa.array(best_i[there]), pa.array(best_d[there])], names=["query_id", "id", "distance"])

        return rows.select("id", "embedding").mapInArrow(make, "query_id long, id long, distance double")

    found = None
    for q_ids, q in blocks(queries):
        part = find(q_ids, q)
        found = part if found is None else found.unionByName(part)
    if found is None:
        found = rows.sparkSession.createDataFrame([], "query_id long, id long, distance double")
    place = F.row_number().over(Window.partitionBy("query_id").orderBy("distance", "id"))
    return found.withColumn("place", place).filter(F.col("place") <= k)
