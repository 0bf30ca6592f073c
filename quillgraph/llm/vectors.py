"""Integer vectors out of float ones, and small partial results merged by treeAggregate.

A vector's components are scaled, floored and kept as little-endian bytes (`code`): 16-bit integers
where all of a vector's components fit, else 64-bit ones.  Equal vectors have equal bytes, so they
can be grouped and shuffled by them at a quarter of their size.
"""

from __future__ import annotations

import pickle
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

_LARGEST, _LEAST = 2.0**63, -(2.0**63)


def floored(values: np.ndarray, scale: float) -> np.ndarray:
    """floor(scale * value) as int64; what lies beyond a long becomes the nearest long."""
    x = np.floor(values * scale)
    out = np.clip(x, _LEAST, np.nextafter(_LARGEST, 0)).astype(np.int64)
    out[x >= _LARGEST] = np.iinfo(np.int64).max
    return out


def integer_vectors(column: pa.Array, scale: float, dims: int | None = None) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """(positions of rows, their integer vectors) for each length of the vectors of a column of lists.

    Rows whose list is null or empty, or holds a null, or an entry that is not finite once scaled, are left out;
    with `dims` also those of another length.
    """
    column = pa.concat_arrays(column.chunks) if isinstance(column, pa.ChunkedArray) else column
    size = pc.fill_null(pc.list_value_length(column), 0).to_numpy(zero_copy_only=False).astype(np.int64)
    flat = column.flatten().to_numpy(zero_copy_only=False).astype(np.float64)
    with np.errstate(over="ignore"):
        fine = np.isfinite(flat * scale)
    broken = np.zeros(len(size), bool)
    broken[np.repeat(np.arange(len(size)), size)[~fine]] = True
    start = np.cumsum(size) - size
    for d in [dims] if dims is not None else np.unique(size).tolist():
        rows = np.flatnonzero((size == d) & ~broken) if d else np.zeros(0, np.int64)
        if len(rows):
            yield rows, floored(flat[start[rows, None] + np.arange(d)], scale)


def encoded(x: np.ndarray) -> pa.Array:
    """The bytes of each vector."""
    small = (np.abs(x.astype(np.float64)) < 32768).all(axis=1)
    out = np.empty(len(x), object)
    for rows, kind in ((np.flatnonzero(small), "<i2"), (np.flatnonzero(~small), "<i8")):
        if len(rows):
            packed = np.ascontiguousarray(x[rows].astype(kind))
            out[rows] = [r.tobytes() for r in packed]
    return pa.array(out, pa.binary())


def decoded(codes: list[bytes], dims: int) -> np.ndarray:
    """The vectors of `dims` components of some codes, as int64."""
    out = np.empty((len(codes), dims), np.int64)
    short = np.array([len(c) == 2 * dims for c in codes], bool)
    for rows, kind in ((np.flatnonzero(short), "<i2"), (np.flatnonzero(~short), "<i8")):
        if len(rows):
            out[rows] = np.frombuffer(b"".join(codes[i] for i in rows), kind).reshape(-1, dims)
    return out


def source(table: DataFrame, id_col: str, vector_col: str) -> DataFrame:
    """(id, v): the id as a long and the vector as doubles, whatever else the table holds."""
    return table.select(F.col(id_col).cast("long").alias("id"), F.col(vector_col).cast("array<double>").alias("v"))


def text_id(key: Column) -> Column:
    """An id in decimal; a null one is the empty text."""
    return F.coalesce(key.cast("string"), F.lit(""))


def merged(parts: DataFrame, make: Callable[[Iterator[pa.RecordBatch]], object], zero: object, add: Callable[[object, object], object]) -> object:
    """What `make` makes of each partition, added up by `add` in a tree of tasks, so that the driver gets a few sums only.

    `make` returns None for a partition without anything to add.
    """

    def one(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        found = make(batches)
        if found is not None:
            yield pa.RecordBatch.from_arrays([pa.array([pickle.dumps(found)], pa.binary())], names=["part"])

    sums = parts.mapInArrow(one, "part binary")
    return sums.rdd.treeAggregate(zero, lambda so_far, row: add(so_far, pickle.loads(row["part"])), add)  # noqa: S301  written by `one`
