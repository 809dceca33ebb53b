"""Approximate nearest neighbours by collision-counting hashing.

Every vector is projected on `projections` random directions; a shard of the vectors keeps the projections on each
direction as one sorted array. The shards, each with its arrays and vectors, are the index: a written table, made once.
Queries are broadcast to it in blocks of bounded size. A query opens a window around its own projection in each array
and widens all windows step by step (virtual rehashing: a wider bucket of the same hash is a wider window). A vector
in as many windows as `threshold` asks is a candidate; candidates are verified with their exact cosine. Windows stop
widening when `verified` of the shard's vectors have been verified, or all have.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from functools import reduce

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tempora.llm._common import in_arrow, saved

#: Vectors of a shard, and bytes of queries that are broadcast at once.
SHARD, QUERY_BYTES = 8192, 32 << 20
#: Width at which windows open. Projections are of unit vectors on standard normal axes, so those of vectors with a cosine of 0.8 are 0.6 apart.
OPENING = 0.6
#: Vectors of a shard that are verified for each neighbour asked, at the least: among few vectors the nearest hardly stand out.
AT_LEAST = 120
_SEED = 7


def _usable(vector: Column) -> Column:
    """Neither null nor zero, and all components finite numbers."""
    bad = F.exists(vector, lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == float("inf")))
    return vector.isNotNull() & ~bad & F.exists(vector, lambda x: x != 0)


def cosine(rows: np.ndarray, query: np.ndarray) -> np.ndarray:
    """In double precision; equal rows get equal values wherever they stand."""
    norms = np.sqrt((rows * rows).sum(axis=1)) * math.sqrt(float((query * query).sum()))
    return (rows * query[None, :]).sum(axis=1) / norms


def _unit(vectors: np.ndarray) -> np.ndarray:
    return vectors / np.sqrt((vectors * vectors).sum(axis=1))[:, None]


def _axes(dim: int, projections: int) -> np.ndarray:
    return np.random.default_rng(_SEED).standard_normal((dim, projections))


_INDEX = "shard int, n int, ids binary, vectors binary, spots binary, owners binary, n_asked int, asked_ids binary, asked binary"


def _indexed(projections: int, rows: pd.DataFrame) -> pd.DataFrame:
    """A shard as one row: ids in ascending order, their vectors, for each direction the sorted projections and whose they are, and its queries."""
    rows = rows.sort_values("vec_id", kind="stable")
    ids, vectors, q = rows["vec_id"].to_numpy().astype(np.int64), np.stack(rows["v"].to_numpy()), rows["q"].to_numpy().astype(bool)
    spots = (_unit(vectors.astype(np.float64)) @ _axes(vectors.shape[1], projections)).astype(np.float32).T
    order = np.argsort(spots, axis=1, kind="stable").astype(np.uint16 if len(ids) <= 1 << 16 else np.int32)
    parts = ids, vectors, np.take_along_axis(spots, order.astype(np.int64), axis=1), order
    row = [rows["shard"].iat[0], len(ids), *(x.tobytes() for x in parts), int(q.sum()), ids[q].tobytes(), vectors[q].tobytes()]
    return pd.DataFrame([row], columns=[c.split()[0] for c in _INDEX.split(", ")])


class Shard:
    """A row of the index."""

    def __init__(self, row: dict[str, pa.Scalar], kind: type):
        array = lambda c, of: np.frombuffer(row[c].as_buffer(), of)
        n = row["n"].as_py()
        self.ids, self.vectors = array("ids", np.int64), array("vectors", kind).reshape(n, -1).astype(np.float64)
        self.spots, self.owners = array("spots", np.float32).reshape(-1, n), array("owners", np.uint16 if n <= 1 << 16 else np.int32).reshape(-1, n)

    def windows(self, at: np.ndarray, width: float) -> tuple[np.ndarray, np.ndarray]:
        """First and last + 1 place of each query's window in each array."""
        found = [(np.searchsorted(a, x - width, "left"), np.searchsorted(a, x + width, "right")) for a, x in zip(self.spots, at.T, strict=True)]
        return np.stack([f[0] for f in found], axis=1), np.stack([f[1] for f in found], axis=1)

    def candidates(self, at: np.ndarray, most: int, least: float, step: float) -> Iterator[tuple[int, np.ndarray]]:
        """(query, candidates) for the queries whose projections are the rows of `at`."""
        n, left, width = len(self.ids), np.arange(len(at)), OPENING
        counts, low, high = np.zeros((len(at), n), np.uint16), None, None
        while len(left):
            lo, hi = self.windows(at[left], width)
            before = (lo, lo) if low is None else (low, high)  # what the windows hold already
            on = []
            for k, q in enumerate(left.tolist()):
                rings = [o[a:b] for o, a, b in zip(self.owners, lo[k].tolist(), before[0][k].tolist(), strict=True)]
                rings += [o[a:b] for o, a, b in zip(self.owners, before[1][k].tolist(), hi[k].tolist(), strict=True)]
                counts[q] += np.bincount(np.concatenate(rings), minlength=n).astype(np.uint16)
                enough = np.flatnonzero(counts[q] >= least)
                on.append(not (len(enough) >= min(most, n) or (hi[k] - lo[k]).min() == n))
                if not on[-1]:
                    yield q, enough
            on = np.array(on, bool)
            left, low, high = left[on], lo[on], hi[on]
            width += step


def _nearest(shard: Shard, ids: np.ndarray, vectors: np.ndarray, axes: np.ndarray, k: int, threshold: float, verified: float, step: float) -> list[tuple]:
    """(query_ids, vec_ids, scores) of each query's k nearest in the shard, all that tie with the last of them by smaller id."""
    out, most = [], max(AT_LEAST * k, math.ceil(verified * len(shard.ids)))
    for a in range(0, len(ids), 256):
        at = (_unit(vectors[a : a + 256]) @ axes).astype(np.float32)
        for q, found in shard.candidates(at, most, threshold * axes.shape[1], step):
            query = ids[a + q]
            found = found[shard.ids[found] != query]
            score = cosine(shard.vectors[found], vectors[a + q])
            if len(found) > k:  # all that tie with the k-th stay in until ids decide
                least = np.partition(score, len(score) - k)[len(score) - k]
                found, score = found[score >= least], score[score >= least]
            best = np.lexsort((shard.ids[found], -score))[:k]
            out.append((np.full(len(best), query), shard.ids[found][best], score[best]))
    return out


def nearest_neighbours(
    vectors: DataFrame, query: Column, k: int = 5, id_col: str = "vec_id", vector_col: str = "embedding", projections: int = 96, threshold: float = 0.6, verified: float = 0.06, step: float = 0.1,
    shard: int = SHARD, query_bytes: int = QUERY_BYTES,
) -> DataFrame:
    """(query_id, rank, vec_id, score): for each row where `query` holds, its k nearest other rows by cosine, nearest first.

    Ties go to the smaller id. Vectors are dealt to shards of about `shard` by the hash of their ids; each block of
    queries, `query_bytes` at the most, reads every shard once, and a query's nearest in all shards are merged. So the
    work grows with queries times vectors, `verified` of which get an exact cosine. Vectors that are null, zero, or hold
    null or non-finite components take no part, nor do those without id. Of rows that repeat an id one counts, the one
    whose vector sorts first. Vectors of another length than the most frequent one's take no part. No rows give no rows.
    """
    spark = vectors.sparkSession
    single = vectors.schema[vector_col].dataType.elementType.typeName() == "float"
    kind = np.float32 if single else np.float64
    rows = vectors.where(F.col(id_col).isNotNull() & _usable(F.col(vector_col)))
    rows = rows.groupBy(F.col(id_col).cast("long").alias("vec_id")).agg(F.min(F.col(vector_col).cast("array<float>" if single else "array<double>")).alias("v"), F.bool_or(query).alias("q"))
    sizes = rows.groupBy(F.size("v").alias("d")).agg(F.count("*").alias("n")).orderBy(F.desc("n"), "d").first()
    dim, n = (sizes.d, sizes.n) if sizes else (1, 0)
    shards = max(1, math.ceil(n / shard))
    dealt = rows.where(F.size("v") == dim).select(F.pmod(F.xxhash64("vec_id"), F.lit(shards)).cast("int").alias("shard"), "*").repartition(shards, "shard")
    index = saved(dealt.groupBy("shard").applyInPandas(lambda x: _indexed(projections, x), _INDEX))
    blocks: list[list[int]] = [[]]
    held = 0
    for s, asked in sorted(index.where("n_asked > 0").select("shard", "n_asked").collect()):  # a row for each shard
        if held and (held + asked) * (dim + 1) * 8 > query_bytes:
            blocks, held = [*blocks, []], 0
        blocks[-1].append(s)
        held += asked
    axes, near = _axes(dim, projections), []
    for block in blocks:
        part = index.where(F.col("shard").isin(block)).select("asked_ids", "asked").collect()  # query_bytes at the most, or one shard's queries
        ids, asked = np.frombuffer(b"".join(r.asked_ids for r in part), np.int64), np.frombuffer(b"".join(r.asked for r in part), kind).reshape(-1, dim).astype(np.float64)
        shared = spark.sparkContext.broadcast((ids, asked))

        def search(batches: Iterator[pa.RecordBatch], shared=shared) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                for k_row in range(batch.num_rows):
                    row = {c: batch.column(c)[k_row] for c in batch.schema.names}
                    found = _nearest(Shard(row, kind), *shared.value, axes, k, threshold, verified, step)
                    if found:
                        yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(c)) for c in zip(*found, strict=True)], names=["query_id", "vec_id", "score"])

        near.append(in_arrow(index.select("n", "ids", "vectors", "spots", "owners"), search, "query_id long, vec_id long, score double"))
    nearest = Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id")
    return reduce(DataFrame.unionByName, near).withColumn("rank", F.row_number().over(nearest)).where(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")
