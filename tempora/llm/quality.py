"""Quality by nearest-neighbour voting over latent-semantic vectors.

A text's terms are hashed words, pairs of neighbouring character classes, and marks of repetition and length. Their
weighted counts are projected on the leading singular directions of a bounded labelled sample. The sample's vectors
are broadcast; every document meets all of them in blocks of exact cosine products, and its nearest vote by similarity.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tempora.llm._common import in_arrow, slices, text_bytes, words_of

#: Labelled rows that vote, at the most; singular directions; neighbours asked.
VOTERS, RANK, NEIGHBOURS = 4000, 48, 25
_HASHED, _CLASSES, _BINS = 256, 16, 8
#: Bytes of text whose terms are counted at once: each byte takes some thirty bytes of working memory.
TEXT_BYTES = 1 << 20
TERMS = _HASHED + _CLASSES * _CLASSES + 4 * _BINS
#: The class of each byte: space, other white space, a-z, A-Z, digits, beyond ASCII, then kinds of punctuation, and the rest.
_KIND = np.full(256, 15, dtype=np.uint8)
_KIND[0x20] = 0
_KIND[0x09:0x0E] = 1
_KIND[0x61:0x7B] = 2
_KIND[0x41:0x5B] = 3
_KIND[0x30:0x3A] = 4
_KIND[0x80:] = 5
for _class, _chars in enumerate((b".,;:", b"!?", b"'\"`", b"-_", b"|", b"#*", b"$%", b"&@", b"()[]{}<>"), 6):
    _KIND[list(_chars)] = _class


def _binned(values: np.ndarray, top: float) -> np.ndarray:
    return np.clip((values * _BINS / top).astype(np.int64), 0, _BINS - 1)


def terms(texts: pa.Array) -> np.ndarray:
    """A row of term weights for each text: square roots of shares within each kind of term, so that length plays no part."""
    data, at = text_bytes(texts)
    flat, first = words_of(data, at)
    n = len(at) - 1
    out = np.zeros((n, TERMS), np.float32)
    n_words = np.diff(first)
    kind = _KIND[data].astype(np.int64)
    owner = np.repeat(np.arange(n), np.diff(at))
    if len(kind) > 1:
        same = owner[1:] == owner[:-1]
        pair = (owner[1:] * 256 + kind[:-1] * 16 + kind[1:])[same]
        out[:, _HASHED : _HASHED + 256] = np.bincount(pair, minlength=n * 256).reshape(n, 256)
    if len(flat):
        coded = flat.dictionary_encode()
        index = coded.indices.to_numpy(zero_copy_only=False).astype(np.int64)
        # a word's bucket from its bytes: any even spread will do
        letters, ends = text_bytes(coded.dictionary)
        powers = (letters.astype(np.uint64) + np.uint64(1)) * (np.uint64(0x9E3779B97F4A7C15) ** ((np.arange(len(letters)) - np.repeat(ends[:-1], np.diff(ends))).astype(np.uint64) + np.uint64(1)))
        bucket = (np.add.reduceat(powers, ends[:-1]) >> np.uint64(40)).astype(np.int64) % _HASHED
        whose = np.repeat(np.arange(n), n_words)
        out[:, :_HASHED] = np.bincount(whose * _HASHED + bucket[index], minlength=n * _HASHED).reshape(n, _HASHED)
        again = np.bincount(whose[1:][(index[1:] == index[:-1]) & (whose[1:] == whose[:-1])], minlength=n)
        distinct = np.bincount(np.unique(whose * np.int64(len(coded.dictionary)) + index) // len(coded.dictionary), minlength=n)
        base, rows, some = _HASHED + 256, np.arange(n), n_words > 0
        sizes = np.maximum(n_words, 1)
        for k, (value, top) in enumerate(((again / sizes, 0.5), (distinct / sizes, 1.0), (np.log2(sizes), 16.0), (np.diff(at) / sizes, 20.0))):
            out[rows[some], base + k * _BINS + _binned(value, top)[some]] = (2.0, 2.0, 0.25, 0.5)[k]
    for a, b, weight in ((0, _HASHED, 0.5), (_HASHED, _HASHED + 256, 4.0)):
        out[:, a:b] = weight * np.sqrt(out[:, a:b] / np.maximum(out[:, a:b].sum(axis=1, keepdims=True), 1))
    return out


@dataclass
class Voters:
    """Means and singular directions of the sample's terms, its unit vectors and labels."""

    mean: np.ndarray
    directions: np.ndarray
    vectors: np.ndarray
    labels: np.ndarray

    @classmethod
    def fit(cls, rows: np.ndarray, labels: np.ndarray, rank: int = RANK) -> Voters:
        if not len(rows):
            return cls(np.zeros(TERMS, np.float32), np.zeros((TERMS, 1), np.float32), np.zeros((0, 1), np.float32), np.zeros(0, np.float32))
        mean = rows.mean(axis=0)
        centred = (rows - mean).astype(np.float64)
        _, vectors = np.linalg.eigh(centred.T @ centred)
        directions = vectors[:, ::-1][:, :rank].astype(np.float32)
        return cls(mean, directions, _unit((rows - mean) @ directions), labels.astype(np.float32))

    def scores(self, rows: np.ndarray, neighbours: int = NEIGHBOURS, block: int = 512) -> np.ndarray:
        """Similarity-weighted shares of label 1 among the nearest; 0.5 without voters."""
        out = np.full(len(rows), 0.5)
        if not len(self.labels):
            return out
        unit = _unit((rows - self.mean) @ self.directions)
        k = min(neighbours, len(self.labels))
        for a in range(0, len(rows), block):
            near = unit[a : a + block] @ self.vectors.T
            top = np.argpartition(-near, k - 1, axis=1)[:, :k]
            weight = np.maximum(np.take_along_axis(near, top, axis=1), 1e-6).astype(np.float64) ** 2
            out[a : a + block] = (weight * self.labels[top]).sum(axis=1) / weight.sum(axis=1)
        return np.round(np.clip(out, 0.0, 1.0), 6)  # products in single precision differ beyond that by how rows are blocked


def _unit(rows: np.ndarray) -> np.ndarray:
    return rows / np.maximum(np.sqrt((rows * rows).sum(axis=1, keepdims=True)), 1e-12)


def _rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in slices(batches, "text", TEXT_BYTES):
        yield pa.RecordBatch.from_arrays([batch.column("doc_id"), batch.column("label"), pa.array([r.tobytes() for r in terms(batch.column("text"))], pa.binary())], names=["doc_id", "label", "terms"])


def fit_voters(docs: DataFrame, labels: DataFrame, learn: Column | None = None, label_col: str = "quality", voters: int = VOTERS) -> Voters:
    """From at most `voters` labelled rows where `learn` (a condition on doc_id) holds, drawn by the hash of their ids.

    Null labels and ids teach nothing; a row that is labelled twice counts by its larger label; of rows of docs that
    repeat an id, one is taken.
    """
    known = labels.where(F.col(label_col).isNotNull() & F.col("doc_id").isNotNull())
    known = (known.where(learn) if learn is not None else known).groupBy("doc_id").agg(F.max(label_col).cast("int").alias("label"))
    sample = known.orderBy(F.xxhash64("doc_id"), "doc_id").limit(voters)
    texts = docs.select("doc_id", "text").join(F.broadcast(sample), "doc_id").select("doc_id", "label", "text")
    kind = texts.schema["doc_id"].dataType.simpleString()
    rows = in_arrow(texts, _rows, f"doc_id {kind}, label int, terms binary").dropDuplicates(["doc_id"]).orderBy("doc_id").collect()
    return Voters.fit(np.frombuffer(b"".join(r.terms for r in rows), np.float32).reshape(-1, TERMS), np.array([r.label for r in rows]))


def quality_scores(docs: DataFrame, labels: DataFrame, learn: Column | None = None, label_col: str = "quality", voters: int = VOTERS, neighbours: int = NEIGHBOURS, column: str = "score") -> DataFrame:
    """docs with a column `column`: 0 to 1, higher if label 1 is likelier, from the whole text alone.

    Null and empty texts have the vector of no terms and are scored like any other; repeated rows score alike, to the
    last digit but one; without
    labelled rows all score 0.5; an empty table gives no rows; other columns pass unchanged, but for one named `column`, in any case of letters, which is replaced.
    """
    found = fit_voters(docs, labels, learn, label_col, voters)
    shared = docs.sparkSession.sparkContext.broadcast(found)
    from pyspark.sql import types as T
    from pyspark.sql.pandas.types import to_arrow_schema

    fields = T.StructType([f for f in docs.schema.fields if f.name.lower() != column.lower()] + [T.StructField(column, T.DoubleType())])
    schema = to_arrow_schema(fields)

    def score(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches, "text", TEXT_BYTES):
            made = shared.value.scores(terms(batch.column("text")), neighbours)
            yield pa.RecordBatch.from_arrays([*[batch.column(c) for c in batch.schema.names if c.lower() != column.lower()], pa.array(made, pa.float64())], schema=schema)

    return in_arrow(docs, score, fields)


def held_out(parts: int, part: int, id_col: str = "doc_id") -> Column:
    """Whether crc32 of the id as text leaves `part` when divided by `parts`. Null is held out."""
    return F.coalesce(F.crc32(F.col(id_col).cast("string")) % parts == part, F.lit(True))
