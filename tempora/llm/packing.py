"""Packing along a space-filling curve: neighbouring sequences hold documents alike.

A document's hashed vector counts its tokens by bucket of a hash, divided by their number. Random directions take it to a
point of few dimensions, whose cell has a place on the Hilbert curve. Documents are sorted by that place in ranges, one
task for each; along the curve they form one row of tokens, cut into sequences of equal length. What is left at its end
is cut into powers of two, which need no padding. So no token is padding, and a document is cut only where a sequence ends.

Equal texts have equal places; within a place documents are in order of id, and then of a checksum of their tokens, so
that ranges may split any number of copies.
"""

from __future__ import annotations

import functools
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tempora.llm._common import in_arrow, saved, slices, temporary
from tempora.llm.token_files import TEXT_BYTES, token_ids

#: Buckets of the hash (2^12), dimensions of the curve, bits of a cell's number in each, and the seed of the directions.
BUCKET_BITS, DIMENSIONS, BITS, _SEED = 12, 4, 15, 13
#: Components of directions are integers, this many to one; sums are exact, and so are places.
_UNIT = 1024
_PIECES = "doc_id long, start long, length long, ids binary, doc_tokens long, sequence_id long, offset long"


def hilbert_places(cells: np.ndarray, bits: int) -> np.ndarray:
    """The places of cells (rows of coordinates below 2^bits) on the Hilbert curve through all of them.

    From the highest bit down, each quadrant is turned so that the curve enters and leaves it at its corners: a set bit
    flips the lower bits of the first coordinate, a clear one exchanges them with its own. What remains is a Gray code.
    """
    axes = [c.astype(np.int64) for c in cells.T]
    for bit in range(bits - 1, 0, -1):
        low = (1 << bit) - 1
        for k, axis in enumerate(axes):
            up = (axis >> bit) & 1 == 1
            swap = np.where(up, 0, (axes[0] ^ axis) & low)
            axes[0] = np.where(up, axes[0] ^ low, axes[0] ^ swap)
            if k:
                axes[k] = axis ^ swap
    place, parity = np.zeros(len(cells), np.int64), np.zeros(len(cells), np.int64)
    for bit in range(bits - 1, -1, -1):
        for axis in axes:
            parity ^= (axis >> bit) & 1
            place = place << 1 | parity
    return place


@functools.cache
def _directions(size: int) -> np.ndarray:
    """Each component of the directions of all token ids' buckets."""
    rng = np.random.default_rng(_SEED)
    buckets = np.rint(rng.standard_normal((1 << BUCKET_BITS, DIMENSIONS)) * _UNIT).astype(np.int32)
    bucket = (np.arange(size, dtype=np.uint64) * np.uint64(0x9E3779B1) & np.uint64(0xFFFFFFFF)) >> np.uint64(32 - BUCKET_BITS)
    return buckets.T[:, bucket.astype(np.int64)].copy()


def curve_places(ids: np.ndarray, starts: np.ndarray) -> np.ndarray:
    """Places of documents whose tokens are ids, each from one of starts to the next; none is empty."""
    if len(starts) < 2:
        return np.zeros(0, np.int64)
    table = _directions(1 << max(16, int(ids.max(initial=0)).bit_length()))
    half = 1 << (BITS - 1)
    sums = np.stack([np.add.reduceat(table[k][ids], starts[:-1], dtype=np.int64) for k in range(DIMENSIONS)], axis=1)
    return hilbert_places(np.clip(sums * (half // 4) // (_UNIT * np.diff(starts))[:, None] + half, 0, 2 * half - 1), BITS)


def _tokens(id_col: str, text_col: str, path: str, end_id: int, batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """A row for each document: its place, its id, a checksum of its tokens, their number, and the tokens, in two bytes each if all of these fit."""
    for batch in slices(batches, text_col, TEXT_BYTES):
        ids, at = token_ids(batch.column(text_col), path, end_id)
        narrow = ids.astype("<u2") if int(ids.max(initial=0)) < 1 << 16 else ids.astype("<u4")
        data = memoryview(narrow).cast("B")
        edges = (at * narrow.itemsize).astype(np.int32)
        checks = [zlib.crc32(data[a:b]) for a, b in zip(edges[:-1].tolist(), edges[1:].tolist(), strict=True)]
        payload = pa.Array.from_buffers(pa.binary(), len(at) - 1, [None, pa.py_buffer(edges), pa.py_buffer(narrow)])
        columns = [pa.array(curve_places(ids, at)), batch.column(id_col), pa.array(checks, pa.int64()), pa.array(np.diff(at)), payload]
        yield pa.RecordBatch.from_arrays(columns, names=["place", "doc_id", "check", "n", "ids"])


def _placed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Adds to sorted documents the tokens before them in this range, and its number."""
    part, before = TaskContext.get().partitionId(), 0
    for batch in batches:
        n = batch.column("n").to_numpy()
        at = before + np.cumsum(n) - n
        before += int(n.sum())
        yield pa.RecordBatch.from_arrays([pa.array(np.full(len(n), part, np.int32)), pa.array(at), *(batch.column(c) for c in ("doc_id", "n", "ids"))], names=["part", "at", "doc_id", "n", "ids"])


class Cuts:
    """Where a row of `total` tokens is cut: at multiples of `length`, and the rest at falling powers of two."""

    def __init__(self, total: int, length: int):
        self.length, self.full = length, total // length
        rest = total % length
        sizes = [1 << bit for bit in range(rest.bit_length() - 1, -1, -1) if rest >> bit & 1]
        self.tail = self.full * length + np.cumsum([0, *sizes])

    def sequence(self, place: np.ndarray) -> np.ndarray:
        """The sequences that places of the row belong to."""
        return np.where(place < self.tail[0], place // self.length, self.full - 1 + np.searchsorted(self.tail, place, "right"))

    def start(self, sequence: np.ndarray) -> np.ndarray:
        return np.where(sequence < self.full, sequence * self.length, self.tail[np.clip(sequence - self.full, 0, len(self.tail) - 1)])


def _pieces(cuts: Cuts, batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in slices(batches, "ids", TEXT_BYTES):
        at, n = batch.column("at").to_numpy(), batch.column("n").to_numpy()
        first = cuts.sequence(at)
        many = cuts.sequence(at + n - 1) - first + 1
        doc = np.repeat(np.arange(len(n)), many)
        sequence = first[doc] + np.arange(len(doc)) - np.repeat(np.cumsum(many) - many, many)
        opens = cuts.start(sequence)
        begin, end = np.maximum(at[doc], opens), np.minimum((at + n)[doc], cuts.start(sequence + 1))
        wide = [np.frombuffer(b, "<u2" if len(b) == 2 * k else "<u4") for b, k in zip(batch.column("ids").to_pylist(), n.tolist(), strict=True)]
        tokens = np.concatenate(wide).astype("<u4")
        edges = np.append(0, np.cumsum(end - begin)).astype(np.int32) * 4  # pieces follow one another as their tokens do
        ids = pa.Array.from_buffers(pa.binary(), len(doc), [None, pa.py_buffer(edges), pa.py_buffer(tokens)])
        columns = [batch.column("doc_id").take(pa.array(doc)), pa.array(begin - at[doc]), pa.array(end - begin), ids, pa.array(n[doc]), pa.array(sequence), pa.array(begin - opens)]
        yield pa.RecordBatch.from_arrays(columns, names=["doc_id", "start", "length", "ids", "doc_tokens", "sequence_id", "offset"])


def packed_pieces(docs: DataFrame, tokenizer: str, length: int = 2048, end_id: int = 1, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """A row for each piece of a document in a sequence: doc_id, start (the document's tokens before it), length, ids (little-endian,
    four bytes each), doc_tokens, sequence_id, and offset (tokens before it in the sequence).

    A document's tokens are those of its text (null: empty), then end_id. All sequences hold `length` tokens, but for the
    last few, whose lengths are falling powers of two. Ids are cast to long; null ids and repeated rows are documents like
    any other. Other columns are ignored; an empty table gives no pieces.
    """
    spark, order = docs.sparkSession, ["place", "doc_id", "check", "row"]
    n = int(spark.conf.get("spark.sql.shuffle.partitions"))
    with temporary() as area:
        rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text"))
        tokens = in_arrow(rows, lambda batches: _tokens("doc_id", "text", tokenizer, end_id, batches), "place long, doc_id long, check long, n long, ids binary")
        tokens = saved(tokens.withColumn("row", F.monotonically_increasing_id()))
        sorted_rows = tokens.repartitionByRange(n, *order).sortWithinPartitions(*order).select("doc_id", "n", "ids")
        placed = area.keep(saved(in_arrow(sorted_rows, _placed, "part int, at long, doc_id long, n long, ids binary")))
    totals, before, offsets = sorted(placed.groupBy("part").agg(F.sum("n")).collect()), 0, []  # a row for each range
    for part, total in totals:
        offsets.append((part, before))
        before += total
    cuts = Cuts(before, length)
    offsets = F.broadcast(spark.createDataFrame(offsets, "part int, before long"))
    whole = placed.join(offsets, "part").select((F.col("at") + F.col("before")).alias("at"), "doc_id", "n", "ids")
    return in_arrow(whole, lambda batches: _pieces(cuts, batches), _PIECES)


def packed_sequences(pieces: DataFrame, length: int = 2048, pad_id: int = 0) -> DataFrame:
    """(sequence_id, ids, n_tokens, pieces): each sequence's tokens, padded to `length` unless they are a power of two, and
    what it is made of, in order: (offset, doc_id, start, length)."""
    made = pieces.groupBy("sequence_id").agg(F.array_sort(F.collect_list(F.struct("offset", "doc_id", "start", "length", "ids"))).alias("p"))  # `length` tokens at the most
    n = F.aggregate("p", F.lit(0).cast("long"), lambda s, p: s + p["length"])
    pad = F.when(n.bitwiseAND(n - 1) == 0, 0).otherwise(length - n)
    hexes = F.array_join(F.transform("p", lambda p: F.hex(p["ids"])), "")
    filled = F.concat(hexes, F.repeat(F.lit(pad_id.to_bytes(4, "little").hex().upper()), pad.cast("int")))
    return made.select("sequence_id", F.unhex(filled).alias("ids"), n.alias("n_tokens"), F.transform("p", lambda p: p.dropFields("ids")).alias("pieces"))
