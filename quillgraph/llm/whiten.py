"""Whitening of embeddings by a two-pass covariance.

1. Each vector becomes integers, x = floor(scale * c).  The fit list holds each distinct x once: the rows are
   made distinct before they meet (map-side), so a vector of very many copies costs a row for each task.
2. The first pass adds up integers exactly, which gives the mean S / n without rounding.
3. The second pass subtracts the mean, block by block, and adds up the outer products of a block by one NumPy
   matrix product; partitions' sums are merged by treeAggregate.  What is multiplied is (x - m) - r / n with the integers m = floor(S / n) and
   r = S - n m: nothing is lost where values are large and close together.
4. LAPACK's symmetric eigenvalues of the covariance give the components; a component's largest entry is positive.
5. The projection, k vectors of the dimension, is broadcast; one pass over all rows projects them.
6. The covariance of the whitened fit list is measured by a pass of its own (`identity_error`).

A sum of squares beyond a long is taken with Python's integers; `deviation` is null where the result
is no long itself.

Defined results: a row whose vector is null or empty, or holds a null or an entry that is not finite, is left out;
if the vectors have several lengths, those of the most frequent length among distinct vectors (ties: the longest) are
whitened and the others left out; repeated rows return rows each; a null id stays null; a component without
variance (as all are where there is one distinct vector) has a null `whitened` and explains 0, and the identity is
measured on the others; there are no more components than dimensions; an empty table returns no rows; other columns are not read.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quillgraph.llm.common import pieces, written
from quillgraph.llm.vectors import decoded, encoded, integer_vectors, merged, source

SCALE = 256.0
#: Vectors of a matrix product.
BLOCK = 4096
#: Eigenvalues below this part of the largest one are rounding errors of zero.
RANK = 1e-12
_OUT = "id long, component int, n long, deviation long, whitened double, explained double, identity_error double"


@dataclass
class Whitening:
    """The fitted projection: `low` and `rest` are floor(S / n) and S - n floor(S / n) of each dimension."""

    n: int
    low: list[int]
    rest: list[int]
    values: np.ndarray = field(default_factory=lambda: np.zeros(0))
    vectors: np.ndarray = field(default_factory=lambda: np.zeros((0, 0)))
    trace: float = 0.0
    identity_error: float = 0.0

    @property
    def dims(self) -> int:
        return len(self.low)

    def shifted(self, x: np.ndarray) -> np.ndarray:
        """x - floor(S / n), exactly: int64, or Python's integers where a long may not hold it."""
        low = np.array(self.low, object)
        if np.abs(x.astype(np.float64)).max(initial=0.0) < 2.0**61 and all(abs(m) < 2**61 for m in self.low):
            return x - low.astype(np.int64)
        return x.astype(object) - low

    def centred(self, x: np.ndarray) -> np.ndarray:
        """x - S / n as doubles."""
        return self.shifted(x).astype(np.float64) - np.array([r / self.n for r in self.rest])

    def deviations(self, x: np.ndarray) -> list[int | None]:
        """The sum over dimensions of (n x - S)^2."""
        y, rest = self.shifted(x), np.array(self.rest, object)
        if self.dims * (self.n * (float(np.abs(y).max(initial=0)) + 1.0)) ** 2 < 2.0**62:
            return (((self.n * y - rest.astype(np.int64)) ** 2).sum(axis=1)).tolist()
        exact = ((self.n * y.astype(object) - rest) ** 2).sum(axis=1)
        return [v if v < 1 << 63 else None for v in exact]

    def project(self, x: np.ndarray) -> np.ndarray:
        """(rows, components); NaN for components without variance."""
        live = self.values > 0
        out = np.full((len(x), len(self.values)), np.nan)
        out[:, live] = self.centred(x) @ self.vectors[:, live] / np.sqrt(self.values[live])
        return out


def _plus(a, b):
    return b if a is None else a if b is None else tuple(x + y for x, y in zip(a, b, strict=True))


def _blocks(batches: Iterator[pa.RecordBatch], dims: int) -> Iterator[np.ndarray]:
    for rows in batches:
        codes = rows.column(0).to_pylist()
        for at in range(0, len(codes), BLOCK):
            yield decoded(codes[at : at + BLOCK], dims)


def distinct_vectors(table: DataFrame, vector_col: str = "embedding", scale: float = SCALE, id_col: str = "vec_id") -> DataFrame:
    """(dims, code): each distinct integer vector once, as a written table."""

    def make(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in pieces(batches):
            for _, x in integer_vectors(whole.column(0), scale):
                codes = encoded(x)
                yield pa.RecordBatch.from_arrays([pa.array(np.full(len(codes), x.shape[1], np.int32)), codes], names=["dims", "code"])

    return written(source(table, id_col, vector_col).select("v").mapInArrow(make, "dims int, code binary").distinct(), "fit")


def fit(table: DataFrame, k: int = 4, scale: float = SCALE, id_col: str = "vec_id", vector_col: str = "embedding") -> Whitening | None:
    """The first `k` components of the distinct integer vectors; None if there are none."""
    every = distinct_vectors(table, vector_col, scale, id_col)
    most = every.groupBy("dims").agg(F.count("*").alias("n")).orderBy(F.col("n").desc(), F.col("dims").desc()).first()
    if most is None:
        return None
    dims, n = most["dims"], most["n"]
    codes = every.filter(F.col("dims") == dims).select("code")

    def sums(batches: Iterator[pa.RecordBatch]):
        total = None
        for x in _blocks(batches, dims):
            small = np.abs(x.astype(np.float64)).max() < 2.0**40  # a block's sums fit a long
            total = _plus(total, tuple(int(v) for v in (x if small else x.astype(object)).sum(axis=0)))
        return total

    total = merged(codes, sums, None, _plus)
    model = Whitening(n, [s // n for s in total], [s % n for s in total])

    def products(batches: Iterator[pa.RecordBatch]):
        out = None
        for x in _blocks(batches, dims):
            y = model.centred(x)
            out = _plus(out, (y.T @ y,))
        return out

    covariance = merged(codes, products, None, _plus)[0] / n
    values, vectors = np.linalg.eigh((covariance + covariance.T) / 2)
    first = np.argsort(-values, kind="stable")[: min(k, dims)]
    model.trace = float(np.trace(covariance))
    top = max(float(values.max(initial=0.0)), 0.0)
    model.values = np.where(values[first] > RANK * top, values[first], 0.0)
    model.vectors = vectors[:, first] * np.where(vectors[np.abs(vectors[:, first]).argmax(axis=0), first] < 0, -1.0, 1.0)
    live = np.flatnonzero(model.values > 0)
    if len(live):

        def whitened(batches: Iterator[pa.RecordBatch]):
            out = None
            for x in _blocks(batches, dims):
                w = model.project(x)[:, live]
                out = _plus(out, (w.T @ w, w.sum(axis=0)))
            return out

        squares, shift = merged(codes, whitened, None, _plus)
        mean = shift / n
        model.identity_error = float(np.abs(squares / n - np.outer(mean, mean) - np.eye(len(live))).max())
    return model


def whiten(table: DataFrame, model: Whitening | None, scale: float = SCALE, id_col: str = "vec_id", vector_col: str = "embedding") -> DataFrame:
    """(id, component, n, deviation, whitened, explained, identity_error) for each row and component."""
    spark = table.sparkSession
    if model is None:
        return spark.createDataFrame([], _OUT)
    held = spark.sparkContext.broadcast(model)

    def make(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model = held.value
        k = len(model.values)
        explained = model.values / model.trace if model.trace > 0 else np.zeros(k)
        for part in pieces(batches, 2_000_000):
            for rows, x in integer_vectors(part.column(1), scale, model.dims):
                value = model.project(x).ravel()
                arrays = [
                    part.column(0).take(pa.array(np.repeat(rows, k))),
                    pa.array(np.tile(np.arange(1, k + 1, dtype=np.int32), len(rows))),
                    pa.array(np.full(len(value), model.n, np.int64)),
                    pa.array(model.deviations(x), pa.int64()).take(pa.array(np.repeat(np.arange(len(rows)), k))),
                    pa.array(value, mask=np.isnan(value)),
                    pa.array(np.tile(explained, len(rows))),
                    pa.array(np.full(len(value), model.identity_error)),
                ]
                yield pa.RecordBatch.from_arrays(arrays, names=["id", "component", "n", "deviation", "whitened", "explained", "identity_error"])

    return source(table, id_col, vector_col).mapInArrow(make, _OUT)
