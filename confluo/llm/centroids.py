"""Centroid clustering of integer vectors, exact at every step.

Components are scaled and floored to integers. A squared distance is
|x|² - 2x·c + |c|². Tasks compute it for blocks of rows with one float64 matrix
product, and BLAS may add in any order: as long as ``dims * (max|x| + max|c|) ** 2`` stays
below 2^53, every partial sum is an integer that float64 holds exactly. Rows beyond
that bound take 64-bit integers, and rows beyond 2^63 Python's integers.
So assignments, ties and sums don't depend on partitioning, blocks or the order of
additions.

Each round scans a written table of the kept vectors, packed. A task reduces its blocks to one
row of ``k`` counts and integer sums, and ``treeAggregate`` combines those, so what reaches
the driver is ``k * dims`` numbers, whatever the size of the input. No row is shuffled, so
equal vectors, however many, cost nothing extra.

The first centroids are the kept vectors of the smallest SHA-256 of ``1:<id>``
(ties by the vector itself; null ids have no hash and come last). A centroid becomes the floor
of its vectors' mean, an empty one stays, and a tie of distances goes to the smaller number.

Defined cases: vectors that are null, of another length, or hold a null or non-finite
component are left out. With fewer than ``k`` kept vectors there are as many
centroids; with none the result is empty. Repeated rows count each; null ids are
kept; other columns are ignored. Distances and inertias beyond a long are null.
"""

from __future__ import annotations

import hashlib
import math
import pickle
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..plans.scratch import Scratch
from . import kernel as K

#: Below these bounds float64 and 64-bit integers are exact.
FLOAT_EXACT = 1 << 53
LONG_EXACT = 1 << 63
#: Rows of a block.
BLOCK = 4096


def _pack(dims: int):
    """The rows with a usable vector, as 64-bit floats in a row's bytes."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ids, column = batch.column(0), batch.column(1)
            offsets, flat = column.offsets.to_numpy(), column.values
            at = np.flatnonzero((np.diff(offsets) == dims) & column.is_valid().to_numpy(zero_copy_only=False))
            places = (offsets[at][:, None] + np.arange(dims)).ravel()
            known = flat.is_valid().to_numpy(zero_copy_only=False)[places].reshape(-1, dims).all(axis=1)
            x = flat.cast(pa.float64()).to_numpy(zero_copy_only=False)[places].reshape(-1, dims)
            use = known & np.isfinite(x).all(axis=1)
            packed = [r.tobytes() for r in x[use].astype("<f8")]
            yield pa.RecordBatch.from_arrays([ids.take(pa.array(at[use])), pa.array(packed, pa.binary())], names=["vec_id", "v"])

    return K.lean(run)


def integers(x: np.ndarray, scale: int) -> list[int]:
    """``floor(scale * x)`` of a vector, also where the product is beyond float64."""
    with np.errstate(over="ignore"):
        scaled = np.floor(x * scale)
    return [int(f) if math.isfinite(f) else int(c) * scale for f, c in zip(scaled.tolist(), x.tolist(), strict=True)]


def _reach(exact: int, dims: int, top: int) -> int:
    """The largest component for which all sums stay below ``exact``, with centroids up to ``top``; negative if there is none."""
    return max(-1, math.isqrt((exact - 1) // dims) - top)


def nearest(x: np.ndarray, centroids: list[list[int]], scale: int) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]]:
    """For parts of a block of raw vectors: which rows, their integers, the nearest centroid and the squared distance, each exact."""
    dims, top = x.shape[1], max(abs(c) for row in centroids for c in row)
    with np.errstate(over="ignore"):
        v = np.floor(x * scale)
    peak = np.abs(v).max(axis=1)
    in_floats = peak <= _reach(FLOAT_EXACT, dims, top)
    in_longs = ~in_floats & (peak <= _reach(LONG_EXACT, dims, top))
    for rows, kind in ((in_floats, np.float64), (in_longs, np.int64)):
        at = np.flatnonzero(rows)
        if len(at):
            own, c = v[at].astype(kind), np.array(centroids, kind)
            distance = (own * own).sum(axis=1)[:, None] - 2 * (own @ c.T) + (c * c).sum(axis=1)
            to = distance.argmin(axis=1)
            yield at, own, to, distance[np.arange(len(at)), to].astype(np.int64)
    at = np.flatnonzero(~in_floats & ~in_longs)
    if len(at):
        own = np.array([integers(r, scale) for r in x[at]], object)
        distance = np.stack([((own - np.array(c, object)) ** 2).sum(axis=1) for c in centroids], axis=1)
        to = np.array([min(range(len(centroids)), key=row.__getitem__) for row in distance.tolist()])
        yield at, own, to, distance[np.arange(len(at)), to]


def _blocks(batch: pa.RecordBatch, dims: int) -> Iterator[tuple[pa.RecordBatch, np.ndarray]]:
    for lo in range(0, batch.num_rows, BLOCK):
        part = batch.slice(lo, BLOCK)
        yield part, np.frombuffer(b"".join(part.column("v").to_pylist()), "<f8").reshape(-1, dims)


def _sums(centroids: list[list[int]], dims: int, scale: int):
    """One row per task: the number and the sum of the vectors of each centroid."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        k = len(centroids)
        counts, sums = np.zeros(k, object), np.zeros((k, dims), object)
        for batch in batches:
            for _, x in _blocks(batch, dims):
                for at, own, to, _ in nearest(x, centroids, scale):
                    counts += np.bincount(to, minlength=k)
                    if own.dtype == np.float64:
                        mine = np.zeros((k, len(at)))
                        mine[to, np.arange(len(at))] = 1
                        sums += (mine @ own).astype(np.int64)  # exact: a block's sums are below BLOCK * 2**27
                    else:
                        for row, j in zip(own.astype(object), to, strict=True):
                            sums[j] += row
        yield pa.RecordBatch.from_arrays([pa.array([pickle.dumps((counts, sums))], pa.binary())], names=["part"])

    return K.lean(run)


def _load(row) -> tuple[np.ndarray, np.ndarray]:
    return pickle.loads(row[0])


def _add(one: tuple[np.ndarray, np.ndarray], two: tuple[np.ndarray, np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
    return one[0] + two[0], one[1] + two[1]


def _assigned(centroids: list[list[int]], dims: int, scale: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part, x in _blocks(batch, dims):
                cluster, distance = np.zeros(len(x), np.int32), np.zeros(len(x), object)
                for at, _, to, far in nearest(x, centroids, scale):
                    cluster[at], distance[at] = to, far
                longs = pa.array([int(d) if d < LONG_EXACT else None for d in distance], pa.int64())
                yield pa.RecordBatch.from_arrays([part.column("vec_id"), pa.array(cluster), longs], names=["vec_id", "cluster", "distance"])

    return K.lean(run)


def start(vectors: DataFrame, k: int, scale: int) -> list[list[int]]:
    """The first centroids: at most ``k`` rows reach the driver."""
    hashed = F.sha2(F.concat(F.lit("1:"), F.col("vec_id").cast("string")), 256)
    rows = vectors.orderBy(hashed.asc_nulls_last(), "v").limit(k).collect()
    return [integers(np.frombuffer(r.v, "<f8"), scale) for r in rows]


def step(vectors: DataFrame, centroids: list[list[int]], dims: int, scale: int) -> list[list[int]]:
    """One round: the floor of each centroid's mean."""
    zero = (np.zeros(len(centroids), object), np.zeros((len(centroids), dims), object))
    counts, sums = vectors.select("v").mapInArrow(_sums(centroids, dims, scale), "part binary").rdd.map(_load).treeAggregate(zero, _add, _add)
    return [[int(s) // int(n) for s in row] if n else old for n, row, old in zip(counts, sums, centroids, strict=True)]


def cluster(df: DataFrame, *, k: int = 16, rounds: int = 3, dims: int = 64, scale: int = 64, id_col: str = "vec_id", vector_col: str = "embedding") -> DataFrame:
    """One row per kept vector: ``vec_id, cluster, distance, cluster_inertia, inertia, centroid_sha256``."""
    scratch = Scratch(df.sparkSession)
    rows = df.select(F.col(f"`{id_col}`").cast("long").alias("vec_id"), F.col(f"`{vector_col}`").cast("array<double>").alias("embedding"))
    vectors = scratch.table(rows.mapInArrow(_pack(dims), "vec_id long, v binary"))
    centroids = start(vectors, k, scale)
    schema = "vec_id long, cluster int, distance long, cluster_inertia long, inertia long, centroid_sha256 string"
    if not centroids:
        return df.sparkSession.createDataFrame([], schema)
    for _ in range(rounds):
        centroids = step(vectors, centroids, dims, scale)
    assigned = scratch.table(vectors.mapInArrow(_assigned(centroids, dims, scale), "vec_id long, cluster int, distance long"))
    # a sum is unknown if one of its distances is
    total = F.when(F.count("distance") == F.count("*"), F.sum(F.col("distance").cast("decimal(38,0)")))
    found = {r.cluster: r.s for r in assigned.groupBy("cluster").agg(total.alias("s")).collect()}
    long = lambda n: F.lit(n if n is not None and n < LONG_EXACT else None).cast("long")
    sums = {j: None if s is None else int(s) for j, s in found.items()}
    whole = None if None in sums.values() else sum(sums.values())
    digests = [hashlib.sha256(",".join(map(str, c)).encode()).hexdigest() for c in centroids]
    by_cluster = lambda values: F.element_at(F.array(*values), F.col("cluster") + 1)
    return scratch.finish(
        assigned.select(
            "vec_id",
            "cluster",
            "distance",
            by_cluster([long(sums.get(j, 0)) for j in range(len(centroids))]).alias("cluster_inertia"),
            long(whole).alias("inertia"),
            by_cluster([F.lit(d) for d in digests]).alias("centroid_sha256"),
        )
    )
