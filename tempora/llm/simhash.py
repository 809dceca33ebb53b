"""SimHash near-duplicates: fingerprints that meet in the middle of a Hamming ball.

Two fingerprints differ in `radius` bits or fewer just when some 64-bit value lies within radius / 2 bits of both.
So each fingerprint stands for all values within half the radius (its variants), and fingerprints that share a
variant are linked. Variants are dealt out by their first bits: a fingerprint goes to each bucket that one of its
variants begins with, and its variants there are written out and sorted inside the bucket, so what is moved are tens
of rows a fingerprint, not the thousands of its variants. All that share a variant are linked with each other; they
are joined to the least of them, and a bucket passes on a spanning forest, never all pairs.
"""

from __future__ import annotations

import functools
import itertools
import math
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tempora.llm._common import in_arrow, saved, skew_join, slices, temporary, text_bytes
from tempora.llm.components import components

SEED = 42
#: Variants that a bucket may write out for the fingerprints of its own prefix.
BUCKET_VARIANTS = 8_000_000
_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[0x41:0x5B] += 0x20


def _rehashed(hashes: np.ndarray, table: int) -> np.ndarray:
    """Other hashes of the same shingles for each table but the first."""
    if table:
        hashes = (hashes ^ (hashes >> np.uint64(29))) * np.uint64(0xBF58476D1CE4E5B9 + 2 * table)
        hashes = hashes ^ (hashes >> np.uint64(32))
    return hashes


def fingerprint(text: bytes, width: int, tables: int = 1) -> list[int]:
    """Fingerprints of lower-cased text as signed 64-bit numbers: a bit is set if over half of the shingles' hashes set it."""
    words = text.split()
    if not words:
        return [0] * tables
    line = b" ".join(words)
    if len(words) <= width:
        hashes = np.array([xxhash.xxh64_intdigest(line, SEED)], dtype="<u8")
    else:
        ends = np.cumsum(np.fromiter(map(len, words), np.int64, len(words)) + 1)
        starts = np.concatenate([[0], ends[:-1]])
        digest = xxhash.xxh64_intdigest
        hashes = np.array([digest(line[a:b], SEED) for a, b in zip(starts[: len(words) - width + 1].tolist(), (ends[width - 1 :] - 1).tolist(), strict=True)], dtype="<u8")
    found = []
    for table in range(tables):
        own, ones = _rehashed(hashes, table), np.zeros(64, np.int64)
        for k in range(0, len(own), 60_000):  # column sums of 0 and 1 fit 16 bits
            bits = np.unpackbits(own[k : k + 60_000].view(np.uint8).reshape(-1, 8), axis=1, bitorder="little")
            ones += bits.sum(axis=0, dtype=np.uint16)
        found.append(int(np.packbits(2 * ones > len(own), bitorder="little").view("<i8")[0]))
    return found


def _fingerprints(id_col: str, text_col: str, width: int, tables: int, batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in slices(batches, text_col):
        data, at = text_bytes(batch.column(text_col))
        data = _LOWER[data].tobytes()
        made = [fingerprint(data[a:b], width, tables) for a, b in itertools.pairwise(at.tolist())]
        columns = [pa.array([f[k] for f in made], pa.int64()) for k in range(tables)]
        yield pa.RecordBatch.from_arrays([batch.column(id_col).cast(pa.int64()), *columns], names=["doc", *_names(tables)])


def _names(tables: int) -> list[str]:
    return ["fp", *(f"fp_{k}" for k in range(1, tables))]


def fingerprints(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", width: int = 4, tables: int = 1) -> DataFrame:
    """(doc, fp, fp_1, ...) for each row: A-Z lower-cased, words between ASCII white space, shingles of `width` words,
    repeats included; fewer words are one shingle; no words, or null, fingerprint zero. fp is of XXH64 with seed 42,
    those of further tables are of other hashes."""
    rows = docs.select(F.col(id_col).cast("long").alias(id_col), text_col)
    kinds = ", ".join(f"{c} long" for c in ["doc", *_names(tables)])
    return in_arrow(rows, lambda batches: _fingerprints(id_col, text_col, width, tables, batches), kinds)


@functools.cache
def _flips(width: int, most: int) -> list[int]:
    """All masks of `width` bits with `most` ones or fewer."""
    return [sum(1 << b for b in bits) for n in range(most + 1) for bits in itertools.combinations(range(width), n)]


def _forest(a: np.ndarray, b: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """For links a-b: each node that isn't the least of its component, and that least one."""
    nodes, ends = np.unique(np.concatenate([a, b]), return_inverse=True)
    x, y = ends[: len(a)], ends[len(a) :]
    root = np.arange(len(nodes))
    while True:
        low = np.minimum(root[x], root[y])
        new = root.copy()
        np.minimum.at(new, root[x], low)
        np.minimum.at(new, root[y], low)
        new = new[new]
        if np.array_equal(new, root):
            break
        root = new
    keep = root != np.arange(len(nodes))
    return nodes[keep], nodes[root[keep]]


def _linked(prefix_bits: int, radius: int, rows: pd.DataFrame) -> pd.DataFrame:
    """The links inside one bucket."""
    low_bits, half = 64 - prefix_bits, radius // 2
    low = np.uint64((1 << low_bits) - 1)
    variants, owners = [], []
    for used, part in rows.groupby("used"):
        fps = part["fp"].to_numpy().view(np.uint64)
        masks = np.array(_flips(low_bits, half - int(used)), dtype=np.uint64)
        variants.append(((fps & low)[:, None] ^ masks[None, :]).ravel())
        owners.append(np.repeat(fps, len(masks)))
    variant, owner = np.concatenate(variants), np.concatenate(owners)
    order = np.argsort(variant, kind="stable")
    variant, owner = variant[order], owner[order]
    start = np.flatnonzero(np.concatenate([[True], variant[1:] != variant[:-1]]))
    least = np.repeat(np.minimum.reduceat(owner, start), np.diff(np.concatenate([start, [len(owner)]])))
    pairs = np.unique(np.stack([owner, least], axis=1)[owner != least], axis=0)
    pairs = pairs[np.bitwise_count(pairs[:, 0] ^ pairs[:, 1]) <= radius]
    a, b = _forest(pairs[:, 0], pairs[:, 1]) if len(pairs) else (pairs[:, 0], pairs[:, 1])
    return pd.DataFrame({"u": a.astype(np.uint64).view(np.int64), "v": b.astype(np.uint64).view(np.int64)})


def _prefix_bits(fps: DataFrame, radius: int) -> int:
    """A prefix under which no bucket's own fingerprints write out more than BUCKET_VARIANTS; that of 60 bits does for any table."""
    bits = 8
    while bits < 60:
        fullest = fps.groupBy(F.shiftrightunsigned("fp", 64 - bits).alias("p")).count().agg(F.max("count")).first()[0] or 0
        over = fullest * len(_flips(64 - bits, radius // 2)) / BUCKET_VARIANTS
        if over <= 1:
            break
        bits = min(60, bits + max(2, math.ceil(math.log2(over))))
    return bits


def fingerprint_links(fps: DataFrame, radius: int = 4) -> DataFrame:
    """Links (u, v) that join all fingerprints `fp` (each once) which differ in `radius` bits or fewer, directly or by steps.

    The radius is even: all that share a variant within half of it are then links. Others raise ValueError.
    """
    if radius < 0 or radius % 2:
        raise ValueError(f"a radius of {radius} has no half")
    bits = _prefix_bits(fps, radius)
    masks = _flips(bits, radius // 2)
    flips = F.array(*[F.struct(F.lit(m).cast("long").alias("m"), F.lit(m.bit_count()).alias("used")) for m in masks])
    dealt = fps.select("fp", F.explode(flips).alias("f")).select("fp", "f.used", F.shiftrightunsigned("fp", 64 - bits).bitwiseXOR(F.col("f.m")).alias("bucket"))
    return dealt.groupBy("bucket").applyInPandas(lambda rows: _linked(bits, radius, rows), "u long, v long").distinct()


def _all_links(prints: DataFrame, nodes: DataFrame, tables: int, radius: int) -> DataFrame:
    """Links (u, v) between values of fp: those of fp itself, and for each further table those of its fingerprints, each
    standing for the least fp that came with it."""
    links = fingerprint_links(nodes.select("fp"), radius)
    for other in _names(tables)[1:]:
        pairs = saved(prints.groupBy("fp", F.col(other).alias("g")).agg(F.count("*").alias("n")))
        stands = saved(pairs.groupBy("g").agg(F.min("fp").alias("rep"), F.count("*").alias("n")))
        own = skew_join(pairs.select("fp", "g"), stands, "g", "n").select(F.col("fp").alias("u"), F.col("rep").alias("v")).where("u <> v")
        near = fingerprint_links(stands.select(F.col("g").alias("fp")), radius)
        near = near.join(stands.select(F.col("g").alias("u"), F.col("rep").alias("a")), "u").join(stands.select(F.col("g").alias("v"), F.col("rep").alias("b")), "v")
        links = saved(links).unionByName(own).unionByName(near.select(F.col("a").alias("u"), F.col("b").alias("v")))
    return links


def near_duplicates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", width: int = 4, radius: int = 4, tables: int = 1) -> DataFrame:
    """(doc, fp, component) for each row: component is the smallest id reachable over links of `radius` bits or fewer.

    With more than one table, a link in any of them counts; so more of the pairs that are near the radius are found.
    Equal fingerprints are one node, whatever their number; rows that repeat an id each get a row. A null id gets a
    fingerprint and links like any other, but is never a component's name unless the component has no other id.
    Texts without words all have fingerprint zero and are linked like any other. An empty table gives no rows.
    """
    with temporary() as area:
        prints = saved(fingerprints(docs, id_col, text_col, width, tables))
        nodes = saved(prints.groupBy("fp").agg(F.min("doc").alias("first"), F.count("*").alias("n")))
        roots = saved(components(saved(_all_links(prints, nodes, tables, radius))))
        named = saved(nodes.join(roots.withColumnRenamed("node", "fp"), "fp", "left").withColumn("root", F.coalesce("root", "fp")))
        least = saved(named.groupBy("root").agg(F.min("first").alias("component"), F.count("*").alias("nodes")))
        table = saved(skew_join(named, least, "root", "nodes").select("fp", "n", "component"))
        found = saved(skew_join(prints.select("doc", "fp"), table, "fp", "n").select("doc", "fp", "component"))
        area.keep(found)
    return found


def without_near_duplicates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", width: int = 5, radius: int = 4, tables: int = 1) -> DataFrame:
    """docs with one document left of each component, that with the smallest id; rows that repeat an id are one document.

    Rows with a null id stay. A link of 4 bits in 64 stands for a cosine of shingle counts of about 0.98.
    """
    found = near_duplicates(docs.where(F.col(id_col).isNotNull()), id_col, text_col, width, radius, tables)
    keep = found.where(F.col("doc") == F.col("component")).select(F.col("doc").alias(id_col)).distinct()
    return docs.where(F.col(id_col).isNull()).unionByName(docs.join(keep, id_col, "left_semi").select(*docs.columns))
