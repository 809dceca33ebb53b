"""Benchmark decontamination with suffix arrays of the training documents.

A shard is what one task holds of the documents at a time. Its words, document after document, have a suffix array:
the places of all words, sorted by the words that follow, as deep as a window is long. Every test suffix is searched
in it by bisection. The places found for a window are all of its occurrences; occurrences that go on along a diagonal
of item and document are the longest verbatim matches, and where a test suffix has no window in the shard, its
neighbours in the array tell how many words it shares (`longest_matches`). No document leaves its task.
"""

from __future__ import annotations

import itertools
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import Broadcast
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.pandas.types import to_arrow_schema

from tempora.llm._common import free_name, in_arrow, slices, text_bytes, words_of

#: Python workers build the suffix array of this many bytes of text at once.
TEXT_BYTES = 4 << 20
#: Bytes of test text that are broadcast at once; a larger benchmark goes through in several passes.
BENCH_BYTES = 16 << 20
#: What is no word and no letter to lower-case, by byte: [^\x00-\x2F\x3A-\x60\x7B-\x7F]+ after A-Z became a-z.
_AS_WORDS = np.full(256, 0x20, dtype=np.uint8)
_AS_WORDS[0x30:0x3A] = np.arange(0x30, 0x3A)
_AS_WORDS[0x61:0x7B] = np.arange(0x61, 0x7B)
_AS_WORDS[0x41:0x5B] = np.arange(0x61, 0x7B)
_AS_WORDS[0x80:] = np.arange(0x80, 0x100)

_MATCH = T.StructType([T.StructField(c, T.LongType()) for c in ("item_id", "start", "item_start", "n_words")])
_FOUND = [
    T.StructField("n_words", T.LongType()), T.StructField("hit_spans", T.ArrayType(T.LongType())),
    T.StructField("item_ids", T.ArrayType(T.LongType())), T.StructField("matches", T.ArrayType(_MATCH)),
]


def _words(texts: pa.Array) -> tuple[pa.Array, np.ndarray]:
    data, offsets = text_bytes(texts)
    return words_of(_AS_WORDS[data], offsets)


class TestSet:
    """A bounded set of items as arrays: the numbers of their words with a zero after each item, and where windows begin.

    A window is `window` words of an item, or all words of a shorter one.
    """

    def __init__(self, ids: list[int], texts: list[str], window: int):
        flat, at = _words(pa.array(texts, pa.string()))
        sizes = np.diff(at)
        self.words, self.window = flat.unique(), window
        self.ids = np.array(ids, np.int64)
        self.item = np.repeat(np.arange(len(ids)), sizes + 1)
        self.first = at[:-1] + np.arange(len(ids))
        self.word = np.zeros(int(sizes.sum()) + len(ids), np.int32)
        self.word[np.arange(len(flat)) + np.repeat(np.arange(len(ids)), sizes)] = pc.index_in(flat, self.words).to_numpy(zero_copy_only=False) + 1 if len(flat) else 0
        #: words from each place to the end of its item, itself included
        self.left = (self.first + sizes)[self.item] - np.arange(len(self.word)) if len(ids) else np.zeros(0, np.int64)
        size = np.minimum(window, sizes)[self.item] if len(ids) else self.left
        self.start = np.flatnonzero((self.word > 0) & (self.left >= size))
        self.size = size[self.start]

    def in_shard(self, dictionary: pa.Array) -> np.ndarray:
        """The words as the shard numbers them, from one on; words that it lacks have a larger number than any."""
        number = pc.fill_null(pc.index_in(self.words, dictionary), len(dictionary)).to_numpy(zero_copy_only=False).astype(np.int64) + 1
        return np.where(self.word > 0, number[self.word - 1], 0) if len(number) else self.word.astype(np.int64)


class SuffixArray:
    """The places of a shard's words, sorted by `depth` words or more from there on. A zero stands after each document."""

    def __init__(self, words: np.ndarray, depth: int):
        bits = int(words.max(initial=1)).bit_length()
        self.depth = min(depth, 63 // bits)
        self.words = np.concatenate([words, np.zeros(max(depth, 63) * 2, np.int64)])
        rank = np.zeros(len(words), np.int64)
        for k in range(self.depth):
            rank = rank << bits | self.words[k : len(words) + k]
        while self.depth < depth:  # ranks of so many words, and those of as many words further on, rank twice as many
            known, rank = np.unique(rank, return_inverse=True)
            further = np.zeros(len(rank), np.int64)
            further[: max(0, len(rank) - self.depth)] = rank[self.depth :]
            rank = rank * (len(known) + 1) + further
            self.depth *= 2
        order = np.argsort(rank, kind="stable")
        self.place = order[words[order] > 0]

    def _compared(self, place: np.ndarray, test: np.ndarray, start: np.ndarray, size: np.ndarray) -> np.ndarray:
        """-1, 0 or 1: how the words at each place stand to the `size` words of the test suffix."""
        out, at = np.zeros(len(place), np.int64), np.arange(len(place))
        k = 0
        while len(at):
            out[at] = np.sign(self.words[place[at] + k] - test[start[at] + k])
            k += 1
            at = at[(out[at] == 0) & (k < size[at])]
        return out

    def bisected(self, test: np.ndarray, start: np.ndarray, size: np.ndarray, after: bool = False) -> np.ndarray:
        """How many places stand before those that begin with each test suffix, or up to the last of them. Sizes are `depth` at the most."""
        low, high = np.zeros(len(start), np.int64), np.full(len(start), len(self.place))
        at = np.flatnonzero(low < high)
        while len(at):
            middle = (low[at] + high[at]) // 2
            is_ = self._compared(self.place[middle], test, start[at], size[at])
            right = (is_ <= 0) if after else (is_ < 0)
            low[at[right]], high[at[~right]] = middle[right] + 1, middle[~right]
            at = at[low[at] < high[at]]
        return low

    def occurrences(self, test: np.ndarray, start: np.ndarray, size: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """All places where a test suffix occurs, each with the suffix's index."""
        low = self.bisected(test, start, size)
        there = low < len(self.place)
        there[there] = self._compared(self.place[low[there]], test, start[there], size[there]) == 0
        there = np.flatnonzero(there)
        low, n = low[there], self.bisected(test, start[there], size[there], after=True) - low[there]
        which = np.repeat(np.arange(len(there)), n)
        return self.place[low[which] + np.arange(len(which)) - np.repeat(np.cumsum(n) - n, n)], there[which]

    def shared(self, place: np.ndarray, test: np.ndarray, start: np.ndarray, left: np.ndarray) -> np.ndarray:
        """How many words from each place on are those of the test suffix."""
        n, at = np.zeros(len(place), np.int64), np.arange(len(place))
        while len(at := at[n[at] < left[at]]):
            at = at[self.words[place[at] + n[at]] == test[start[at] + n[at]]]
            n[at] += 1
        return n


class Shard:
    """The words of some texts: their numbers with a zero after each text, where each text's begin, and the words themselves."""

    def __init__(self, texts: pa.Array):
        flat, self.at = _words(texts)
        coded = flat.dictionary_encode()
        n = np.diff(self.at)
        self.dictionary, self.doc = coded.dictionary, np.repeat(np.arange(len(n)), n + 1)
        self.first = self.at[:-1] + np.arange(len(n))
        self.words = np.zeros(len(flat) + len(n), np.int64)
        self.words[np.arange(len(flat)) + np.repeat(np.arange(len(n)), n)] = coded.indices.to_numpy(zero_copy_only=False) + 1 if len(flat) else 0


def _diagonals(place: np.ndarray, start: np.ndarray, size: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """The matches that windows at `start`, found at `place`, make up: first place, first window's start, words."""
    order = np.lexsort((place, place - start))
    place, start, size = place[order], start[order], size[order]
    on = (np.diff(place) == 1) & (np.diff(start) == 1)
    head = np.flatnonzero(np.concatenate([[True], ~on]))
    last = np.concatenate([head[1:], [len(place)]]) - 1
    return place[head], start[head], place[last] - place[head] + size[head]


def _scan(tests: TestSet, text_col: str, column: str, schema: pa.Schema, batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in slices(batches, text_col, TEXT_BYTES):
        shard, n = Shard(batch.column(text_col)), batch.num_rows
        test = tests.in_shard(shard.dictionary)
        # a window with a word that the shard lacks is nowhere in it
        unknown = np.concatenate([[0], np.cumsum(test > len(shard.dictionary))])
        known = unknown[tests.start + tests.size] == unknown[tests.start]
        start, size = tests.start[known], tests.size[known]
        spans, items, matches = ([[] for _ in range(n)] for _ in range(3))
        if len(start):
            place, window = SuffixArray(shard.words, int(size.max())).occurrences(test, start, size)
        if len(start) and len(place):
            edge = np.bincount(place, minlength=len(shard.words) + 1) - np.bincount(place + size[window], minlength=len(shard.words) + 1)
            inside = np.concatenate([[0], np.cumsum(edge) > 0, [0]]).astype(np.int8)
            for a, b in itertools.batched(np.flatnonzero(np.diff(inside)).tolist(), 2):  # zeros part documents
                spans[shard.doc[a]] += [a - int(shard.first[shard.doc[a]]), b - int(shard.first[shard.doc[a]])]
            for p, s, words in zip(*(x.tolist() for x in _diagonals(place, start[window], size[window])), strict=True):
                d = int(shard.doc[p])
                matches[d].append({"item_id": int(tests.ids[tests.item[s]]), "start": p - int(shard.first[d]), "item_start": s - int(tests.first[tests.item[s]]), "n_words": words})
            items = [sorted({m["item_id"] for m in found}) for found in matches]
        if column in batch.schema.names:  # an earlier pass over another part of the items
            for d, old in enumerate(batch.column(column).to_pylist()):
                spans[d] = _united(old["hit_spans"] + spans[d])
                items[d] = sorted({*old["item_ids"], *items[d]})
                matches[d] += old["matches"]
        for found in matches:
            found.sort(key=lambda m: (m["start"], m["item_id"], m["item_start"], m["n_words"]))
        found = [{"n_words": w, "hit_spans": s, "item_ids": i, "matches": m} for w, s, i, m in zip(np.diff(shard.at).tolist(), spans, items, matches, strict=True)]
        kept = [batch.column(c) for c in batch.schema.names if c != column]
        yield pa.RecordBatch.from_arrays([*kept, pa.array(found, schema.field(column).type)], schema=schema)


def _united(bounds: list[int]) -> list[int]:
    out: list[int] = []
    for a, b in sorted(itertools.batched(bounds, 2)):
        if out and a <= out[-1]:
            out[-1] = max(out[-1], b)
        else:
            out += [a, b]
    return out


def _test_sets(benchmark: DataFrame, item_col: str, item_text_col: str, window: int, bench_bytes: int) -> Iterator[Broadcast[TestSet]]:
    """The benchmark in broadcasts of about `bench_bytes` of text, dealt by item. A set takes some ten times its text in memory."""
    bench = benchmark.where(F.col(item_col).isNotNull()).select(F.col(item_col).cast("long").alias("item"), F.col(item_text_col).alias("text")).distinct()
    size = bench.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    passes = -(-2 * size // bench_bytes) if size > bench_bytes else 1
    for k in range(passes):
        part = bench if passes == 1 else bench.where(F.pmod(F.xxhash64("item"), F.lit(passes)) == k)
        rows = part.collect()  # bench_bytes at the most, but for the spread of the hash
        yield bench.sparkSession.sparkContext.broadcast(TestSet([r.item for r in rows], [r.text or "" for r in rows], window))


def contamination(docs: DataFrame, benchmark: DataFrame, text_col: str = "text", item_col: str = "item_id", item_text_col: str = "text", window: int = 10, bench_bytes: int = BENCH_BYTES, column: str = "_found") -> DataFrame:
    """docs with a struct column `column`: n_words, hit_spans, item_ids, matches (item, start word in the document and in
    the item, words of each longest match that holds a window).

    A window is `window` consecutive words of an item, or a shorter item as a whole. hit_spans lists first and
    last + 1 word of each stretch of words inside occurrences. The test set is broadcast `bench_bytes` at a time; what
    is larger is dealt by item over several passes. Null or empty texts have no words and hit nothing; items without
    words or id never occur; items that repeat count once; an empty benchmark hits nothing; rows of docs that repeat
    are each searched; other columns pass unchanged, but for one named `column`, which is replaced.
    """
    out = docs.drop(*[c for c in docs.columns if c.lower() == column.lower()])
    plain = list(out.schema.fields)
    fields = T.StructType([*plain, T.StructField(column, T.StructType(_FOUND))])
    schema = to_arrow_schema(fields)
    for tests in _test_sets(benchmark, item_col, item_text_col, window, bench_bytes):
        out = in_arrow(out, lambda batches, tests=tests: _scan(tests.value, text_col, column, schema, batches), fields)
    return out


def _longest(tests: TestSet, id_col: str, text_col: str, depth: int, batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in slices(batches, text_col):
        shard = Shard(batch.column(text_col))
        test, start = tests.in_shard(shard.dictionary), np.flatnonzero(tests.word > 0)
        array = SuffixArray(shard.words, depth)
        if not len(start) or not len(array.place):
            continue
        left = tests.left[start]
        size = np.minimum(left, array.depth)
        place, which = array.occurrences(test, start, size)  # whoever shares all that is sorted, and the neighbours of all others
        low = array.bisected(test, start, size)
        for near in (low - 1, low):
            there = np.flatnonzero((near >= 0) & (near < len(array.place)))
            place, which = np.concatenate([place, array.place[near[there]]]), np.concatenate([which, there])
        n = array.shared(place, test, start[which], left[which])
        item, doc = tests.item[start[which]], shard.doc[place]
        ids = batch.column(id_col).cast(pa.int64()).to_numpy(zero_copy_only=False)
        begin, begins = place - shard.first[doc], start[which] - tests.first[item]
        order = np.lexsort((begins, begin, ids[doc], -n, item))
        best = order[np.concatenate([[True], np.diff(item[order]) > 0])]
        best = best[n[best] > 0]
        yield pa.RecordBatch.from_arrays([pa.array(x.astype(np.int64)) for x in (tests.ids[item[best]], n[best], ids[doc[best]], begin[best], begins[best])], names=["item_id", "n_words", "doc", "start", "item_start"])


def longest_matches(docs: DataFrame, benchmark: DataFrame, id_col: str = "doc_id", text_col: str = "text", item_col: str = "item_id", item_text_col: str = "text", depth: int = 10, bench_bytes: int = BENCH_BYTES) -> DataFrame:
    """(item_id, n_words, doc, start, item_start): the longest verbatim match of each item in all documents, and where.

    Ties go to the least document, then the first place in it, then in the item. Rows without id, items without id or words, and
    items that share no word with any document have no row.
    """
    rows = docs.where(F.col(id_col).isNotNull()).select(id_col, text_col)
    found = None
    for tests in _test_sets(benchmark, item_col, item_text_col, depth, bench_bytes):
        part = in_arrow(rows, lambda batches, tests=tests: _longest(tests.value, id_col, text_col, depth, batches), "item_id long, n_words long, doc long, start long, item_start long")
        found = part if found is None else found.unionByName(part)
    best = F.max_by(F.struct("n_words", "doc", "start", "item_start"), F.struct("n_words", -F.col("doc"), -F.col("start"), -F.col("item_start")))
    return found.groupBy("item_id").agg(best.alias("m")).select("item_id", "m.*")


def span_words(spans: str = "_found.hit_spans"):
    """Words inside the spans."""
    return F.aggregate(F.transform(F.col(spans), lambda x, i: F.when(i % 2 == 0, -x).otherwise(x)), F.lit(0).cast("long"), lambda a, x: a + x)


def item_digest(items: str = "_found.item_ids"):
    """SHA-256 of the ids, sorted as strings, comma-joined."""
    return F.sha2(F.concat_ws(",", F.array_sort(F.transform(F.col(items), lambda x: x.cast("string")))), 256)


def decontaminated(docs: DataFrame, benchmark: DataFrame, **options) -> DataFrame:
    """docs without those that hold a window of the benchmark; all columns pass unchanged."""
    column = free_name("_found", docs)
    found = contamination(docs, benchmark, column=column, **options)
    return found.where(F.size(f"{column}.item_ids") == 0).select(*docs.columns)
