"""Greedy word-piece counts by a longest-match automaton that reads each byte once and builds no pieces.

The trie of the vocabulary has a failure link at each node: where the match goes on once the longest pieces of what
has been read are taken off, and how many pieces that takes off. A word's count is the sum of those numbers.
"""

from __future__ import annotations

import functools
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tempora.llm._common import in_arrow, slices, text_bytes, words_of


#: So few words are read one after another.
FEW = 16


class PieceCounter:
    """For pieces that begin a word and pieces that go on with one. With `lone`, a piece without letters may begin a word.

    count() gives the greedy longest-match pieces of each word; a word that the pieces can't spell counts as one.
    """

    def __init__(self, first: list[bytes], further: list[bytes], lone: bool = False):
        child: dict[tuple[int, int], int] = {}
        parent, label, piece = [-1, -1], [0, 0], [False, False]  # node 0 begins words, node 1 goes on with them
        for root, pieces in ((0, first), (1, further)):
            for p in pieces:
                node = root
                for byte in p:
                    nxt = child.get((node, byte))
                    if nxt is None:
                        nxt = child[node, byte] = len(parent)
                        parent.append(node)
                        label.append(byte)
                        piece.append(False)
                    node = nxt
                if p:
                    piece[node] = True
        fail, popped = [-1] * len(parent), [0] * len(parent)
        if lone:
            fail[0], popped[0] = 1, 1
        depth = [0] * len(parent)
        for v in range(2, len(parent)):
            depth[v] = depth[parent[v]] + 1
        for v in sorted(range(2, len(parent)), key=depth.__getitem__):
            if piece[v]:
                fail[v], popped[v] = 1, 1
                continue
            z, n = fail[parent[v]], popped[parent[v]]
            while z >= 0 and (z, label[v]) not in child:
                n += popped[z]
                z = fail[z]
            if z >= 0:
                fail[v], popped[v] = child[z, label[v]], n
        self.child, self.fails, self.pops = child, fail, popped
        self.fail, self.popped = np.array(fail), np.array(popped)
        edges = sorted((node * 256 + byte, to) for (node, byte), to in child.items())
        self.keys, self.to = np.array([k for k, _ in edges], np.int64), np.array([t for _, t in edges], np.int64)

    def _step(self, node: np.ndarray, byte: np.ndarray) -> np.ndarray:
        if not len(self.keys):
            return np.full(len(node), -1)
        key = node * 256 + byte
        at = np.minimum(np.searchsorted(self.keys, key), len(self.keys) - 1)
        return np.where(self.keys[at] == key, self.to[at], -1)

    def count(self, data: np.ndarray, offsets: np.ndarray) -> np.ndarray:
        """The count for each word; all words move on by one byte at a time, and the last few, which are long, each by itself."""
        size = np.diff(offsets)
        node, total = np.zeros(len(size), np.int64), np.zeros(len(size), np.int64)
        bad = np.zeros(len(size), bool)
        order = np.argsort(-size, kind="stable")
        longer = len(size) - np.searchsorted(np.sort(size), np.arange(size.max(initial=0)), side="right")
        for k, n in enumerate(longer.tolist()):
            if n <= FEW:
                for w in order[:n].tolist():
                    if not bad[w]:
                        node[w], more, bad[w] = self._walked(int(node[w]), data[offsets[w] + k : offsets[w + 1]].tobytes())
                        total[w] += more
                break
            live = order[:n]
            live = live[~bad[live]]
            byte = data[offsets[live] + k].astype(np.int64)
            while len(live):
                to = self._step(node[live], byte)
                on = to >= 0
                node[live[on]] = to[on]
                live, byte = self._popped(live[~on], node, total, bad, byte[~on])
        live = np.flatnonzero(~bad & (size > 0))
        while len(live := live[node[live] != 1]):
            live, _ = self._popped(live, node, total, bad, live)
        return np.where(bad, 1, total)

    def _walked(self, node: int, rest: bytes) -> tuple[int, int, bool]:
        """The node after the bytes, the pieces taken off, and whether no piece went on."""
        child, fails, pops, total = self.child, self.fails, self.pops, 0
        for byte in rest:
            to = child.get((node, byte))
            while to is None:
                total += pops[node]
                node = fails[node]
                if node < 0:
                    return 0, 0, True
                to = child.get((node, byte))
            node = to
        return node, total, False

    def _popped(self, live, node, total, bad, byte):
        """Follows the failure links of those that have one."""
        to = self.fail[node[live]]
        bad[live[to < 0]] = True
        live, byte, to = live[to >= 0], byte[to >= 0], to[to >= 0]
        total[live] += self.popped[node[live]]
        node[live] = to
        return live, byte


@functools.cache
def vocabulary(path: str) -> PieceCounter:
    """From a file of base64 tokens and ranks, a line each. Tokens that begin with a space begin words; all others go on
    with one. Where a space is a token too, words that no other token begins start with it."""
    import base64

    with open(path, "rb") as lines:
        tokens = [base64.b64decode(line.split()[0]) for line in lines if line.strip()]
    return PieceCounter([t[1:] for t in tokens if t[:1] == b" " and len(t) > 1], [t for t in tokens if t[:1] != b" "], b" " in tokens)


def _counts(id_col: str, text_col: str, path: str, batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in slices(batches, text_col):
        flat, at = words_of(*text_bytes(batch.column(text_col)))
        coded = flat.dictionary_encode()
        each = vocabulary(path).count(*text_bytes(coded.dictionary)) if len(flat) else np.zeros(0, np.int64)
        total = np.concatenate([[0], np.cumsum(each[coded.indices.to_numpy(zero_copy_only=False)])])
        yield pa.RecordBatch.from_arrays([batch.column(id_col), pa.array(np.diff(at)), pa.array(total[at[1:]] - total[at[:-1]])], names=[id_col, "n_words", "n_tokens"])


def token_counts(docs: DataFrame, vocabulary_path: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, n_words, n_tokens) for each row: words between ASCII white space of the whole text, as they are written.

    A word is spelled by the longest piece that begins it, a space alone if there is no other, then the longest piece that
    goes on with it, and so on; one that can't be spelled counts as one token. Null and empty texts count zero; null ids and repeated rows keep their
    rows; an empty table gives none.
    """
    rows = docs.select(F.col(id_col), F.col(text_col))
    kind = rows.schema[id_col].dataType.simpleString()
    return in_arrow(rows, lambda batches: _counts(id_col, text_col, vocabulary_path, batches), f"`{id_col}` {kind}, n_words long, n_tokens long")
