"""Token ids in directly addressable codes: any token can be read without decoding what stands before it.

An id is split into chunks of fixed widths, low bits first. Level k holds the k-th chunk of all ids that have one,
bit-packed; a bitmap says which of them go on to level k + 1, and a rank directory counts its ones up to each block,
so that a token's place on the next level is one rank away. A segment holds whole documents, one after another.

A token file is a folder of Parquet rows, one for each segment: the range of documents it belongs to (`part`), its
number there (`seg`), `start` (tokens before it in the part), `n_tokens`, `doc_ids`, and the coded `payload`. So it
can be written to and read from any store that Spark knows, and a lost executor's segments are written again. Parquet
compresses nothing here, and its statistics find the one segment that `read_token` looks into.
"""

from __future__ import annotations

import functools
import json
import math
import struct
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tempora.llm._common import in_arrow, slices, text_bytes, words_of

WIDTHS = (10, 6)
SEGMENT_TOKENS = 1_000_000
TEXT_BYTES = 4 << 20
#: Words that each Python worker remembers the ids of.
REMEMBERED = 600_000
_RANK_BLOCK = 512
_MAGIC = b"DAC1"


# ---- the codes


def _group(width: int) -> int:
    """How many values of a width fill whole bytes; such a group is packed as one 64-bit word."""
    group = 8 // math.gcd(width, 8)
    if not 0 < group * width <= 64:
        raise ValueError(f"chunks of {width} bits aren't packed")
    return group


def _packed(values: np.ndarray, width: int) -> bytes:
    """The low `width` bits of each value, one after another, in whole groups."""
    group = _group(width)
    padded = np.zeros(-(-len(values) // group) * group, np.uint64)
    padded[: len(values)] = values & ((1 << width) - 1)
    word = np.zeros(len(padded) // group, np.uint64)
    for k, part in enumerate(padded.reshape(-1, group).T):
        word |= part << np.uint64(k * width)
    return word.astype("<u8").view(np.uint8).reshape(-1, 8)[:, : group * width // 8].tobytes()


def _unpacked(data: np.ndarray, width: int, first: int, count: int) -> np.ndarray:
    """Values first .. first + count of what _packed made."""
    group = _group(width)
    size, a, b = group * width // 8, first // group, -(-(first + count) // group)
    padded = np.zeros((b - a, 8), np.uint8)
    padded[:, :size] = data[a * size : b * size].reshape(-1, size)
    word, out = padded.view("<u8").ravel(), np.empty((b - a, group), np.uint32)
    for k in range(group):
        out[:, k] = (word >> np.uint64(k * width)) & np.uint64((1 << width) - 1)
    return out.ravel()[first - a * group : first - a * group + count]


def encode_segment(ids: np.ndarray, doc_starts: np.ndarray, widths: tuple[int, ...] = WIDTHS) -> bytes:
    """ids as levels of chunks. Where the widths don't hold the largest id, levels of 8 bits follow."""
    widths, top = list(widths), int(ids.max(initial=0))
    while top >> sum(widths):
        widths.append(8)
    out = [_MAGIC, struct.pack("<QII", len(ids), len(doc_starts), len(widths)), bytes(widths), doc_starts.astype("<u8").tobytes()]
    rest = ids.astype(np.uint32)
    for k, width in enumerate(widths):
        on = rest >> np.uint32(width) > 0
        chunk = _packed(rest, width)
        bitmap, directory = b"", b""
        if k + 1 < len(widths):
            bitmap = np.packbits(on, bitorder="little").tobytes()
            ones = np.add.reduceat(on, np.arange(0, len(on), _RANK_BLOCK), dtype=np.int64) if len(on) else np.zeros(0, np.int64)
            directory = np.concatenate([[0], np.cumsum(ones)]).astype("<u8").tobytes()
        out += [struct.pack("<QQQQ", len(rest), len(chunk), len(bitmap), len(directory)), chunk, bitmap, directory]
        rest = rest[on] >> np.uint32(width)
    return b"".join(out)


class Segment:
    """Reads a coded segment in place."""

    def __init__(self, payload: bytes | memoryview | pa.Buffer):
        payload = memoryview(payload)
        if bytes(payload[:4]) != _MAGIC:
            raise ValueError("no segment of directly addressable codes")
        self.n_tokens, self.n_docs, n_levels = struct.unpack_from("<QII", payload, 4)
        self.widths, at = tuple(bytes(payload[20 : 20 + n_levels])), 20 + n_levels
        self.doc_starts = np.append(np.frombuffer(payload, "<u8", self.n_docs, at).astype(np.int64), self.n_tokens)
        at += 8 * self.n_docs
        self.levels = []
        for _ in range(n_levels):
            count, chunk, bitmap, directory = struct.unpack_from("<QQQQ", payload, at)
            at += 32
            self.levels.append((count, np.frombuffer(payload, np.uint8, chunk, at), np.frombuffer(payload, np.uint8, bitmap, at + chunk), np.frombuffer(payload, "<u8", directory // 8, at + chunk + bitmap)))
            at += chunk + bitmap + directory

    def _rank(self, level: int, place: int) -> int:
        """Ones of the level's bitmap before place."""
        _, _, bitmap, directory = self.levels[level]
        block = place // _RANK_BLOCK
        first = block * _RANK_BLOCK // 8
        bits = np.unpackbits(bitmap[first : (place + 7) // 8], bitorder="little")[: place - block * _RANK_BLOCK]
        return int(directory[block]) + int(bits.sum())

    def ids(self, first: int, end: int) -> np.ndarray:
        """Tokens first .. end."""
        out, where, shift = np.zeros(end - first, np.uint32), np.arange(end - first), 0
        for k, width in enumerate(self.widths):
            if end == first:
                break
            out[where] |= _unpacked(self.levels[k][1], width, first, end - first) << np.uint32(shift)
            shift += width
            if k + 1 < len(self.widths):
                byte = first // 8
                on = np.unpackbits(self.levels[k][2][byte : (end + 7) // 8], bitorder="little")[first - 8 * byte : end - 8 * byte].astype(bool)
                first = self._rank(k, first)
                where, end = where[on], first + int(on.sum())
        return out

    def token(self, place: int) -> int:
        """One token, by a rank for each level it goes on to."""
        return int(self.ids(place, place + 1)[0])

    def document(self, k: int) -> np.ndarray:
        return self.ids(int(self.doc_starts[k]), int(self.doc_starts[k + 1]))


# ---- tokens


def _byte_letters() -> dict[int, str]:
    """The letter that byte-level vocabularies write each byte as: printable bytes as themselves, the others from 256 on."""
    own = [b for b in range(256) if 33 <= b < 127 or 161 <= b < 173 or 174 <= b]
    other = iter(range(256, 512))
    return {b: chr(b if b in own else next(other)) for b in range(256)}


_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[0x41:0x5B] += 0x20
#: Marks that are split from a letter before them in any text, other than the apostrophe and what special tokens are written with.
_MARKS = np.isin(np.arange(256), list(b".,;:!?$#%&*"))
_LETTERS = np.isin(np.arange(256), np.arange(0x61, 0x7B))


def split_marks(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The texts with A-Z lower-cased, as the vocabulary has them, and a space between a letter and the mark after it.

    Letters are a-z and those of Latin-1; either way the ids stay the same, and fewer different words are left.
    """
    data = _LOWER[data]
    if len(data) < 3:
        return data, offsets
    before, letter = data[1:-1], _LETTERS[data[1:-1]]
    letter |= (data[:-2] == 0xC3) & (before >= 0x80) & (before != 0x97) & (before != 0xB7)
    cut = np.flatnonzero(letter & _MARKS[data[2:]]) + 2
    return np.insert(data, cut, 0x20), offsets + np.searchsorted(cut, offsets, side="left")


#: The normalizer and the splitter with which no token crosses white space, and lower case and marks split as below.
_NORMALIZER = {"type": "Sequence", "normalizers": [{"type": "NFC"}, {"type": "Replace", "pattern": {"Regex": r"\s+"}, "content": " "}, {"type": "Lowercase"}]}
_SPLITTER = {"type": "Sequence", "pretokenizers": [
    {"type": "Split", "pattern": {"Regex": r"'s|'t|'re|'ve|'m|'ll|'d|[\p{L}]+|[\p{N}]|[^\s\p{L}\p{N}]+"}, "behavior": "Removed", "invert": True},
    {"type": "ByteLevel", "add_prefix_space": False, "trim_offsets": True, "use_regex": False},
]}


def by_words(path: str) -> bool:
    """Whether a tokenizer file splits texts as WordEncoder expects; texts of others go through the library whole."""
    with open(path, encoding="utf-8") as file:
        said = json.load(file)
    return said.get("normalizer") == _NORMALIZER and said.get("pre_tokenizer") == _SPLITTER and said.get("post_processor") is None


class WordEncoder:
    """Ids of what stands between ASCII white space. No token of the vocabulary and no rule of its splitter crosses that,
    so a text's ids are those of its words. Words of Latin letters alone go to the library's model, in the letters that
    it writes bytes as; whatever else goes through the whole library. Words met lately are remembered."""

    def __init__(self, path: str):
        from tokenizers import Tokenizer

        self.whole, self.by_words = Tokenizer.from_file(path), by_words(path)
        self.model = self.whole.model
        self.letters = _byte_letters()
        self.young: dict[str, bytes] = {}
        self.old: dict[str, bytes] = {}

    def _encoded(self, word: str) -> bytes:
        if word.isalpha() and (word.isascii() or max(word) < "Ā") and word == word.lower():
            mapped = word.encode().decode("latin-1").translate(self.letters)
            return np.array([t.id for t in self.model.tokenize(mapped)], "<u4").tobytes()
        return np.array(self.whole.encode(word, add_special_tokens=False).ids, "<u4").tobytes()

    def __call__(self, words: list[str]) -> list[bytes]:
        if len(self.young) > REMEMBERED // 2:
            self.young, self.old = {}, self.young
        young, old, out = self.young, self.old, []
        for word in words:
            got = young.get(word)
            if got is None:
                got = young[word] = old.get(word) or self._encoded(word)
            out.append(got)
        return out


@functools.cache
def _encoder(path: str) -> WordEncoder:
    return WordEncoder(path)


def token_ids(texts: pa.Array, path: str, end_id: int) -> tuple[np.ndarray, np.ndarray]:
    """The ids of all texts, end_id after each, and where each text's begin (and the end)."""
    if not _encoder(path).by_words:
        each = [[*_encoder(path).whole.encode(t or "", add_special_tokens=False).ids, end_id] for t in texts.to_pylist()]
        return np.array([i for ids in each for i in ids], np.uint32), np.concatenate([[0], np.cumsum([len(x) for x in each], dtype=np.int64)])
    flat, at = words_of(*split_marks(*text_bytes(texts)))
    coded = flat.dictionary_encode()
    parts = _encoder(path)(coded.dictionary.to_pylist())
    sizes = np.fromiter(map(len, parts), np.int64, len(parts)) // 4
    pool = np.frombuffer(b"".join(parts), "<u4")
    first = np.concatenate([[0], np.cumsum(sizes)[:-1]]) if len(sizes) else sizes
    word = coded.indices.to_numpy(zero_copy_only=False)
    n = sizes[word] if len(word) else np.zeros(0, np.int64)
    before = np.concatenate([[0], np.cumsum(n)])
    starts = before[at] + np.arange(len(at))
    out = np.full(int(starts[-1]), end_id, np.uint32)
    if len(word):
        take = np.repeat(first[word] - before[:-1], n)
        take += np.arange(len(take))
        put = np.ones(len(out), bool)
        put[starts[1:] - 1] = False
        out[put] = pool[take]
    return out, starts


# ---- files


_SEGMENTS = "part int, seg long, start long, n_tokens long, doc_ids array<long>, payload binary"


def _segments(id_col: str, text_col: str, path: str, end_id: int, widths: tuple[int, ...], most: int, batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    part, seg, start = TaskContext.get().partitionId(), 0, 0
    for batch in slices(batches, text_col, TEXT_BYTES):
        ids, at = token_ids(batch.column(text_col), path, end_id)
        docs = batch.column(id_col).cast(pa.int64()).to_pylist()
        a = 0
        while a < len(docs):
            b = max(a + 1, int(np.searchsorted(at, at[a] + most, side="right")) - 1)
            b = min(b, len(docs))
            payload = encode_segment(ids[at[a] : at[b]], at[a:b] - at[a], widths)
            n = int(at[b] - at[a])
            yield pa.RecordBatch.from_arrays(
                [pa.array([part], pa.int32()), pa.array([seg]), pa.array([start]), pa.array([n]), pa.array([docs[a:b]], pa.list_(pa.int64())), pa.array([payload], pa.binary())],
                names=["part", "seg", "start", "n_tokens", "doc_ids", "payload"],
            )
            seg, start, a = seg + 1, start + n, b


def write_token_file(docs: DataFrame, path: str, tokenizer: str, end_id: int = 2, id_col: str = "doc_id", text_col: str = "text", widths: tuple[int, ...] = WIDTHS, segment_tokens: int = SEGMENT_TOKENS) -> None:
    """Writes the ids of all texts in ascending order of id (null ids first, equal ids by text), end_id after each.

    Null and empty texts are an end id alone. Ranges of ids are dealt to as many tasks as a shuffle has; each task writes
    its segments, one after another. An empty table writes no segments.
    """
    n = int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    rows = docs.select(F.col(id_col), F.col(text_col)).repartitionByRange(n, id_col).sortWithinPartitions(id_col, text_col)
    in_arrow(rows, lambda batches: _segments(id_col, text_col, tokenizer, end_id, tuple(widths), segment_tokens, batches), _SEGMENTS).write.parquet(path, compression="uncompressed")


def _read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for row in batch.to_pylist():
            segment = Segment(row["payload"])
            starts, crcs = segment.doc_starts, []
            # a document is read by itself, from its own place
            for k in range(segment.n_docs):
                crcs.append(zlib.crc32(segment.document(k).astype("<u4").tobytes()))
            yield pa.RecordBatch.from_arrays(
                [pa.array([row["part"]] * segment.n_docs, pa.int32()), pa.array(row["doc_ids"], pa.int64()), pa.array(starts[:-1] + row["start"]), pa.array(np.diff(starts)), pa.array(crcs, pa.int64())],
                names=["part", "doc", "start", "n_tokens", "crc"],
            )


def read_token_index(spark: SparkSession, path: str) -> DataFrame:
    """(doc, start, n_tokens, crc) of each document, decoded from the file: start counts the tokens of all before it."""
    segments = spark.read.schema(_SEGMENTS).parquet(path)
    totals = sorted(segments.groupBy("part").agg(F.sum("n_tokens")).collect())  # a row for each range of ids
    before, rows = 0, []
    for part, n in totals:
        rows.append((part, before))
        before += n
    offsets = spark.createDataFrame(rows, "part int, before long")
    found = in_arrow(segments, _read, "part int, doc long, start long, n_tokens long, crc long")
    return found.join(F.broadcast(offsets), "part").select("doc", (F.col("start") + F.col("before")).alias("start"), "n_tokens", "crc")


def read_token(spark: SparkSession, path: str, place: int) -> int | None:
    """Token `place` of the file, counted from zero over all documents; None past its end.

    The counts of tokens name its segment; of that one row the token is read in place, with one rank for each level it
    goes on to, and nothing else of the file is decoded.
    """
    segments = spark.read.schema(_SEGMENTS).parquet(path)
    for part, n in sorted(segments.groupBy("part").agg(F.sum("n_tokens")).collect()):  # a row for each range of ids
        if place < n:
            break
        place -= n
    else:
        return None
    one = segments.where((F.col("part") == part) & (F.col("start") <= place) & (F.col("start") + F.col("n_tokens") > place)).select("start", "payload")

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ids = [Segment(p.as_buffer()).token(place - s.as_py()) for s, p in zip(batch.column("start"), batch.column("payload"), strict=True)]
            yield pa.RecordBatch.from_arrays([pa.array(ids, pa.int64())], names=["id"])

    return in_arrow(one, read, "id long").first().id
