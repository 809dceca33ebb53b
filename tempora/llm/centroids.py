"""Clustering around integer centroids, exactly.

Nearest centroids are screened by a float32 matrix product. A product of vectors x and c is off by gamma * |x| * |c| at
the most, where gamma = n u / (1 - n u) for n roundings of u = 2^-24, in whatever order it is summed; so each
x.c, and with it each distance, lies in an interval. A centroid whose interval starts above the end of another's is out;
where more than one is left, their distances are computed in integers and ties go to the smallest number.

Components within BOUND are 64-bit integers. Vectors with larger ones are rare and go through Python's integers, by the
same rules. Tasks send sums of their vectors for each centroid, and the driver holds the centroids: both are as large as
`k` asks, whatever the table holds.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tempora.llm._common import in_arrow, saved, temporary

#: Scaled components up to this are exact in float32, and squared distances to centroids of up to 2^27 fit into 64 bits for 64 components.
BOUND = 1 << 22
_FAR = 1 << 27
#: Sums travel in parts of this many bits, so that no sum is too large.
_LIMB = 40
#: Distances of a block of vectors that are looked at together.
_BLOCK = 1 << 19


def scaled(x: float, scale: int) -> int:
    """floor(scale * x), of any finite number; scale is a power of two."""
    return math.floor(x * scale) if abs(x) < 2.0**52 else int(x) * scale


class Screen:
    """Finds the nearest of a list of integer centroids."""

    def __init__(self, centroids: list[list[int]]):
        self.exact = centroids
        top = [max(map(abs, c), default=0) for c in centroids]
        dim = len(centroids[0]) if centroids else 0
        # a centroid far outside is nearest to no vector within BOUND, if another one is near enough
        out = [t > _FAR and (t - BOUND) ** 2 > dim * (BOUND + min(top)) ** 2 for t in top]
        self.numbers = np.array([k for k, o in enumerate(out) if not o], np.int64)
        self.fits = all(top[k] <= _FAR for k in self.numbers)
        if self.fits:
            self.whole = np.array([centroids[k] for k in self.numbers], np.int64).reshape(len(self.numbers), dim)
            self.squares = (self.whole * self.whole).sum(axis=1)
            self.single, self.norms = self.whole.astype(np.float32).T.copy(), np.sqrt(self.squares.astype(np.float64))
            n = dim + 3
            self.gamma = 1.001 * n * 2.0**-24 / (1 - n * 2.0**-24)
            self.recomputed = 0  # intervals that overlapped

    def _block(self, x: np.ndarray) -> np.ndarray:
        product = (x.astype(np.float32) @ self.single).astype(np.float64)
        norms = np.sqrt((x.astype(np.float64) ** 2).sum(axis=1))[:, None] * self.norms
        squares = self.squares.astype(np.float64)
        middle = squares - 2 * product
        off = 2 * self.gamma * norms + (squares + 2 * np.abs(product) + 1) * 2.0**-46  # what the doubles here round is in the second term
        left = middle - off <= (middle + off).min(axis=1, keepdims=True)
        nearest = left.argmax(axis=1)
        open_rows = np.flatnonzero(left.sum(axis=1) > 1)
        row, col = np.nonzero(left[open_rows])
        if len(row):
            exact = np.full((len(open_rows), left.shape[1]), np.iinfo(np.int64).max)
            exact[row, col] = self.squares[col] - 2 * (x[open_rows][row] * self.whole[col]).sum(axis=1)
            nearest[open_rows] = exact.argmin(axis=1)
        self.recomputed += len(row)
        return nearest

    def nearest(self, x: np.ndarray) -> np.ndarray:
        """Numbers of the nearest centroids of vectors whose components are within BOUND."""
        if not self.fits:
            return np.array([self.nearest_of(v) for v in x.tolist()], np.int64)
        rows = max(1, _BLOCK // max(1, len(self.numbers)))
        return np.concatenate([self.numbers[:0], *[self.numbers[self._block(x[a : a + rows])] for a in range(0, len(x), rows)]])

    def nearest_of(self, v: list[int]) -> int:
        return min(range(len(self.exact)), key=lambda k: (self.distance(v, k), k))

    def distance(self, v: list[int], k: int) -> int:
        return sum((a - b) ** 2 for a, b in zip(v, self.exact[k], strict=True))

    def distances(self, x: np.ndarray, nearest: np.ndarray) -> list[int]:
        """Squared distances of vectors within BOUND."""
        if not self.fits:
            return [self.distance(v, k) for v, k in zip(x.tolist(), nearest.tolist(), strict=True)]
        place = np.zeros(len(self.exact), np.int64)
        place[self.numbers] = np.arange(len(self.numbers))
        off = x - self.whole[place[nearest]]
        return (off * off).sum(axis=1).tolist()


def _vectors(batch: pa.RecordBatch, dim: int) -> tuple[np.ndarray, np.ndarray]:
    """Which rows hold vectors within BOUND, and these."""
    narrow = batch.column("v")
    return np.flatnonzero(narrow.is_valid().to_numpy(zero_copy_only=False)), narrow.drop_null().flatten().to_numpy(zero_copy_only=False).reshape(-1, dim).astype(np.int64)


def _limbs(total: list[int]) -> Iterator[tuple[int, list[int]]]:
    """A list of integers as lists of signed parts, low ones first."""
    k = 0
    while any(total):
        part = [x & ((1 << _LIMB) - 1) for x in total] if any(abs(x) >> 62 for x in total) else total
        yield k, part
        total, k = [(x - p) >> _LIMB for x, p in zip(total, part, strict=True)], k + 1


def _sums(screen: Screen, dim: int, scale: int, batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The sum of the vectors of each centroid, and last how many they are."""
    totals = [[0] * (dim + 1) for _ in screen.exact]
    for batch in batches:
        _, x = _vectors(batch, dim)
        nearest = screen.nearest(x)
        for k in np.unique(nearest).tolist():
            own = x[nearest == k]
            totals[k] = [a + b for a, b in zip(totals[k], [*own.sum(axis=0).tolist(), len(own)], strict=True)]
        for wide in batch.column("wide").drop_null().to_pylist():
            v = [scaled(c, scale) for c in wide]
            k = screen.nearest_of(v)
            totals[k] = [a + b for a, b in zip(totals[k], [*v, 1], strict=True)]
    parts = [(k, limb, part) for k, total in enumerate(totals) for limb, part in _limbs(total)]
    if parts:
        yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*parts, strict=True), (pa.int32(), pa.int32(), pa.list_(pa.int64())), strict=True)], names=["cluster", "limb", "total"])


def _assigned(screen: Screen, dim: int, scale: int, batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        rows, x = _vectors(batch, dim)
        clusters, distances = np.zeros(batch.num_rows, np.int32), np.zeros(batch.num_rows, object)
        clusters[rows] = nearest = screen.nearest(x)
        distances[rows] = screen.distances(x, nearest)
        for row, wide in enumerate(batch.column("wide").to_pylist() if len(rows) < batch.num_rows else []):
            if wide is not None:
                v = [scaled(c, scale) for c in wide]
                clusters[row] = k = screen.nearest_of(v)
                distances[row] = screen.distance(v, k)
        fits = pa.array([d if d < 1 << 63 else None for d in distances.tolist()], pa.int64())
        yield pa.RecordBatch.from_arrays([batch.column("id"), pa.array(clusters), fits], names=["id", "cluster", "distance"])


def _moved(vectors: DataFrame, centroids: list[list[int]], dim: int, scale: int) -> list[list[int]]:
    """Each centroid's vectors' floored mean; where it has none, itself."""
    screen = Screen(centroids)
    parts = in_arrow(vectors, lambda batches: _sums(screen, dim, scale, batches), "cluster int, limb int, total array<long>")
    parts = parts.select("cluster", "limb", F.posexplode("total")).groupBy("cluster", "limb", "pos").agg(F.sum(F.col("col").cast("decimal(38,0)")).alias("total"))
    totals = [[0] * (dim + 1) for _ in centroids]
    for r in parts.collect():  # a row for each component of each centroid, by limbs
        totals[r.cluster][r.pos] += int(r.total) << (_LIMB * r.limb)
    return [[s // t[-1] for s in t[:-1]] if t[-1] else c for t, c in zip(totals, centroids, strict=True)]


def centroid_clusters(
    vectors: DataFrame, k: int = 8, rounds: int = 10, id_col: str = "vec_id", vector_col: str = "embedding", dim: int = 64, scale: int = 1024, seed: str = "3:",
) -> DataFrame:
    """(id, cluster, distance, cluster_inertia, inertia, centroid): the nearest of k centroids of each vector after some rounds.

    Vectors that are null, have not `dim` components, or hold a null or a number that isn't finite take no part. A component
    x counts as floor(scale * x). Centroids begin as the k vectors with the least sha256 of seed and id, in that order
    (equal ids: by vector; a null id is empty), all vectors if fewer; then each round assigns all vectors and replaces a
    centroid by the floored mean of its vectors, if it has any. `distance` is squared, `cluster_inertia` and `inertia` are
    its sums over the cluster and over all; one that doesn't fit into 64 bits is null, and so are sums that it is part of.
    `centroid` holds the final components as text, joined by commas. Repeated rows all count; no vectors give no rows.
    """
    x = F.col(vector_col).cast("array<double>")
    good = F.coalesce((F.size(x) == dim) & ~F.exists(x, lambda c: c.isNull() | F.isnan(c) | (F.abs(c) == float("inf"))), F.lit(False))
    narrow = ~F.exists(x, lambda c: F.abs(c) * scale >= BOUND)
    kept = vectors.where(good).select(
        F.col(id_col).cast("long").alias("id"), F.when(narrow, F.transform(x, lambda c: F.floor(c * scale).cast("int"))).alias("v"), F.when(~narrow, x).alias("wide"),
    )
    with temporary() as area:
        kept = saved(kept)
        name = F.sha2(F.concat(F.lit(seed), F.coalesce(F.col("id").cast("string"), F.lit(""))).cast("binary"), 256)
        first = kept.orderBy(name, "v", "wide").limit(k).collect()  # k rows
        centroids = [r.v if r.wide is None else [scaled(c, scale) for c in r.wide] for r in first]
        for _ in range(rounds):
            before, centroids = centroids, _moved(kept, centroids, dim, scale)
            if centroids == before:
                break
        screen = Screen(centroids)
        found = saved(in_arrow(kept, lambda batches: _assigned(screen, dim, scale, batches), "id long, cluster int, distance long"))
        sums = found.groupBy("cluster").agg(F.when(F.count("distance") == F.count("*"), F.sum(F.col("distance").cast("decimal(38,0)"))).alias("s")).collect()  # k rows
        fits = lambda s: int(s) if s is not None and s < 1 << 63 else None
        whole = None if any(r.s is None for r in sums) else sum(r.s for r in sums)
        clusters = [(r.cluster, fits(r.s), fits(whole), ",".join(map(str, centroids[r.cluster]))) for r in sums]
        clusters = kept.sparkSession.createDataFrame(clusters, "cluster int, cluster_inertia long, inertia long, centroid string")
        return area.keep(saved(found.join(F.broadcast(clusters), "cluster").select("id", "cluster", "distance", "cluster_inertia", "inertia", "centroid")))

