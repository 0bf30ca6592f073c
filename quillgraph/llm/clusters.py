"""Centroid clustering with Elkan's bounds and exact integer distances.

Vectors and centroids are integers, so squared distances are exact; only the bounds are doubles.  The state of a
vector is a row of a written table: its code, its centroid, an upper bound of its distance to that and a lower bound
to each of the k centroids.  A round is one pass over the state:

1. Bounds move with the centroids: the upper one by the move of the vector's own, each lower one by the move of its
   centroid, rounded outwards.
2. A vector whose upper bound is below half the distance of its centroid to the nearest other one stays; so does it
   towards each centroid whose lower bound, or half distance to its own, lies beyond the upper bound.
   Both comparisons are strict, and bounds are rounded so that they never claim too much: a centroid at an equal
   distance is always looked at, and the smaller number wins by exact integers.
3. What is left is measured exactly, which renews the bounds.
4. Sums and counts of the new clusters are taken from the written state and merged in a tree of tasks: k x dimensions
   numbers.  A new centroid is the exact floor of its mean.

Distances of vectors with very large components are taken with Python's integers; a distance that is no long is null.

Defined results: a row whose vector is null, has another number of components than `dims`, or holds a null or an entry that
is not finite, is left out; repeated rows are clustered each; equal hashes (of repeated ids) are ordered by the vectors' bytes; a null
id hashes as the empty text and stays null; with fewer vectors than k each is a centroid; an empty centroid stays where
it is; an empty table returns no rows; other columns are not read.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quillgraph.llm.common import delete, pieces, place_for, stored
from quillgraph.llm.vectors import decoded, encoded, integer_vectors, merged, source, text_id

SCALE, DIMS = 64.0, 64
_STATE = "id long, code binary, cluster int, distance decimal(38,0), upper double, lower array<double>"


def _down(x: np.ndarray) -> np.ndarray:
    """Two steps down: a root of a rounded integer is off by less."""
    return np.nextafter(np.nextafter(x, -np.inf), -np.inf)


def _up(x: np.ndarray) -> np.ndarray:
    return np.nextafter(np.nextafter(x, np.inf), np.inf)


def roomy(x: np.ndarray, centres: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Both as they are, or as Python's integers where a long may not hold a squared distance."""
    large = max(np.abs(x.astype(np.float64)).max(initial=0.0), np.abs(centres.astype(np.float64)).max(initial=0.0))
    if x.shape[-1] * (2 * large + 1) ** 2 >= 2.0**62:
        return x.astype(object), centres.astype(object)
    return x, centres


def squared(x: np.ndarray, centre: np.ndarray) -> np.ndarray:
    """Squared distances of integer vectors to one centre, or each to its own."""
    gap = x - centre
    return (gap * gap).sum(axis=-1)


def _root(d: np.ndarray) -> np.ndarray:
    return np.sqrt(d.astype(np.float64))


@dataclass
class Centroids:
    """The centres with what the rounds need of them: half distances between them, and how far they have moved."""

    centres: np.ndarray
    moves: np.ndarray

    def __post_init__(self) -> None:
        _, centres = roomy(self.centres, self.centres)
        between = np.stack([_root(squared(centres, c)) for c in centres])
        self.half = _down(_down(between) / 2)
        apart = self.half.copy()
        np.fill_diagonal(apart, np.inf)
        self.near = apart.min(axis=1)

    def assign(self, x: np.ndarray, home: np.ndarray | None, upper: np.ndarray | None, lower: np.ndarray | None) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray, np.ndarray, int]:
        """(cluster, distance or -1, whether it was measured, upper, lower, measured distances): the nearest centroid of each vector; ties go to the smaller number."""
        n, k = len(x), len(self.centres)
        x, centres = roomy(x, self.centres)
        if home is None:
            home, lower, upper = np.zeros(n, np.int64), np.zeros((n, k)), np.full(n, np.inf)
        else:
            home = home.copy()
            lower = np.maximum(_down(lower - _up(self.moves)), 0.0)
            upper = _up(upper + _up(self.moves)[home])
        distance, known, done = np.full(n, -1, x.dtype), np.zeros(n, bool), 0
        for c in range(k):
            due = np.flatnonzero((upper >= self.near[home]) & (home != c) & (lower[:, c] <= upper) & (self.half[home, c] <= upper))
            fresh = due[~known[due]]
            if len(fresh):  # the own distance first: it may settle the matter
                own = squared(x[fresh], centres[home[fresh]])
                done += len(fresh)
                distance[fresh], known[fresh] = own, True
                upper[fresh], lower[fresh, home[fresh]] = _up(_root(own)), _down(_root(own))
                due = due[(upper[due] >= self.near[home[due]]) & (lower[due, c] <= upper[due]) & (self.half[home[due], c] <= upper[due])]
            if not len(due):
                continue
            there = squared(x[due], centres[c])
            done += len(due)
            lower[due, c] = _down(_root(there))
            won = (there < distance[due]) | ((there == distance[due]) & (c < home[due]))
            moved = due[won]
            home[moved], distance[moved], upper[moved] = c, there[won], _up(_root(there[won]))
        return home, distance, known, upper, lower, done

    def distances(self, x: np.ndarray, home: np.ndarray, distance: np.ndarray, known: np.ndarray) -> np.ndarray:
        """The exact distances to the own centroids; those that no round needed are measured now."""
        rest = np.flatnonzero(~known)
        if len(rest):
            x, centres = roomy(x, self.centres)
            distance[rest] = squared(x[rest], centres[home[rest]])
        return distance

    def sha256(self) -> list[str]:
        return [hashlib.sha256(",".join(map(str, c.tolist())).encode()).hexdigest() for c in self.centres]


def _state(rows: pa.Array, code: pa.Array, found, last: np.ndarray | None) -> pa.RecordBatch:
    from decimal import Decimal

    home, _, _, upper, lower, _ = found
    exact = pa.nulls(len(home), pa.decimal128(38, 0)) if last is None else pa.array([Decimal(int(v)) if v < 10**38 else None for v in last], pa.decimal128(38, 0))
    bounds = pa.ListArray.from_arrays(pa.array(np.arange(len(home) + 1) * lower.shape[1], pa.int32()), pa.array(lower.ravel()))
    return pa.RecordBatch.from_arrays([rows, code, pa.array(home, pa.int32()), exact, pa.array(upper), bounds], names=["id", "code", "cluster", "distance", "upper", "lower"])


def _plus(a: dict, b: dict) -> dict:
    out = dict(a)
    for c, (count, sums) in b.items():
        out[c] = (out[c][0] + count, [x + y for x, y in zip(out[c][1], sums, strict=True)]) if c in out else (count, sums)
    return out


def _averaged(state: DataFrame, centres: np.ndarray, dims: int) -> np.ndarray:
    """The floor of each cluster's mean; empty clusters keep their centre."""

    def make(batches: Iterator[pa.RecordBatch]):
        out: dict = {}
        for rows in pieces(batches):
            x, home = decoded(rows.column(0).to_pylist(), dims), rows.column(1).to_numpy()
            x = x if np.abs(x.astype(np.float64)).max() < 2.0**40 else x.astype(object)
            out = _plus(out, {int(c): (int((home == c).sum()), [int(v) for v in x[home == c].sum(axis=0)]) for c in np.unique(home)})
        return out or None

    found = merged(state.select("code", "cluster"), make, {}, _plus)
    new = centres.copy()
    for c, (count, sums) in found.items():
        new[c] = [s // count for s in sums]
    return new


def cluster(table: DataFrame, k: int = 16, rounds: int = 3, scale: float = SCALE, dims: int = DIMS, id_col: str = "vec_id", vector_col: str = "embedding") -> DataFrame:
    """(id, cluster, distance, cluster_inertia, inertia, centroid_sha256) for each kept vector."""
    spark = table.sparkSession

    def keep(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in pieces(batches):
            for rows, x in integer_vectors(part.column(1), scale, dims):
                yield pa.RecordBatch.from_arrays([part.column(0).take(pa.array(rows)), encoded(x)], names=["id", "code"])

    vectors = source(table, id_col, vector_col).mapInArrow(keep, "id long, code binary")
    hashed = vectors.select("id", "code", F.sha2(F.concat(F.lit("1:"), text_id(F.col("id"))), 256).alias("h"))
    seeds = hashed.orderBy("h", "code").limit(k).collect()
    if not seeds:
        return spark.createDataFrame([], "id long, cluster int, distance long, cluster_inertia long, inertia long, centroid_sha256 string")
    now = Centroids(decoded([bytes(r["code"]) for r in seeds], dims), np.zeros(len(seeds)))
    state, before = vectors, None
    for turn in range(rounds + 1):
        held, last = spark.sparkContext.broadcast(now), turn == rounds

        def make(batches: Iterator[pa.RecordBatch], held=held, first=turn == 0, last=last) -> Iterator[pa.RecordBatch]:
            near = held.value
            for part in pieces(batches, 2_000_000):
                x = decoded(part.column(1).to_pylist(), dims)
                bounds = (None, None, None) if first else (part.column(2).to_numpy().astype(np.int64), part.column(3).to_numpy(), part.column(4).flatten().to_numpy().reshape(len(x), -1))
                found = near.assign(x, *bounds)
                yield _state(part.column(0), part.column(1), found, near.distances(x, *found[:3]) if last else None)

        given = state if turn == 0 else state.select("id", "code", "cluster", "upper", "lower")
        state = stored(given.mapInArrow(make, _STATE), path := place_for(spark, "state"))
        if before:
            delete(spark, before)
        before = path
        if not last:
            centres = _averaged(state, now.centres, dims)
            now = Centroids(centres, _up(_root(squared(*roomy(centres, now.centres)))))
    sums = {r["cluster"]: r["s"] for r in state.groupBy("cluster").agg(F.sum("distance").alias("s")).collect()}  # k rows
    told = [(c, sums[c], sum(v for v in sums.values() if v is not None), name) for c, name in enumerate(now.sha256()) if c in sums]
    side = spark.createDataFrame(told, "cluster int, cluster_inertia decimal(38,0), inertia decimal(38,0), centroid_sha256 string")
    as_long = lambda c: F.expr(f"try_cast({c} AS BIGINT)").alias(c)
    return state.select("id", "cluster", "distance").join(F.broadcast(side), "cluster").select("id", "cluster", as_long("distance"), as_long("cluster_inertia"), as_long("inertia"), "centroid_sha256")
