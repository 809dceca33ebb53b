"""Toxicity by weak supervision.

Voters are words and word beginnings that speak for toxicity (a lexicon found in labelled rows), a few patterns of
writing, and each of these where it is dense or comes again. A generative model of a hidden label estimates from the
votes alone how often each voter fires for either label and how voters depend on each other; dependent voters share
their weight. The given labels choose the lexicon, the prior and the model's first guess of the rates, but cast no
vote: a wrong label is outvoted. A linear classifier is trained on the posterior labels that the model gives.
"""

from __future__ import annotations

import math
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tempora.llm._common import in_arrow, saved, slices, text_bytes, words_of

#: Labelled rows of each label that are learned from, and terms that are kept, at the most.
SAMPLE, TERMS = 6000, 300
_SHORTEST, _LONGEST = 3, 7
#: A lexicon entry has so many characters at the most; longer words vote by their beginnings.
LONGEST_TERM = 200
#: A term is dense if it makes up one word in so many, or more.
DENSE = 150
_EDGES = ".,;:!?\"'`()[]{}<>|#$%&*+-_=/\\~^@«»“”„…¡¿"


def word_terms(word: str) -> list[str]:
    """What a word can be looked up by: itself, and its beginnings, marked by a star."""
    word = word.strip(_EDGES).lower()
    if not word:
        return []
    return [word, *(word[:n] + "*" for n in range(_SHORTEST, min(_LONGEST, len(word)) + 1))]


#: Patterns of writing that vote too, by the characters of a word as it stands: shouting, runs of marks, masked letters.
def pattern_terms(word: str) -> list[str]:
    found = []
    if len(word) > 3 and word.isupper():
        found.append("<shouted>")
    if "!!" in word or "??" in word:
        found.append("<marks>")
    if "*" in word[1:-1] and word[0].isalpha():
        found.append("<masked>")
    return found


def _voters(said: dict, n_words: int) -> Iterator[tuple]:
    """Each term that is said, once for what it is, once more if it is dense, and again if it is dense and repeated."""
    for term, times in said.items():
        yield term, 0
        if times * DENSE >= n_words:
            yield term, 1
            if times > 1:
                yield term, 2


def _documents(texts: pa.Array, known: dict[str, list[int]] | None) -> Iterator[tuple[dict, int]]:
    """For each text how often it says each term, and its words. `known` has the terms that count; None counts all."""
    flat, at = words_of(*text_bytes(texts))
    coded = flat.dictionary_encode()
    words = coded.dictionary.to_pylist()
    index = coded.indices.to_numpy(zero_copy_only=False)
    every = [[t for t in (*word_terms(w), *pattern_terms(w)) if known is None or t in known] for w in words]
    telling = np.array([bool(x) for x in every], bool)
    hits = np.flatnonzero(telling[index]) if len(index) else np.zeros(0, np.int64)
    bounds, said = np.searchsorted(hits, at), index[hits]
    for k, (a, b) in enumerate(zip(bounds[:-1].tolist(), bounds[1:].tolist(), strict=True)):
        found: dict[str, int] = {}
        if b > a:
            for w, times in zip(*(x.tolist() for x in np.unique(said[a:b], return_counts=True)), strict=True):
                for t in every[w]:
                    found[t] = found.get(t, 0) + times
        yield found, int(at[k + 1] - at[k])


def _fired(texts: pa.Array, known: dict[str, list[int]]) -> Iterator[list[int]]:
    """The numbers of the voters that fire in each text; known has those of a term's three voters, -1 where there is none."""
    for found, n in _documents(texts, known):
        yield sorted(v for term, kind in _voters(found, n) if (v := known[term][kind]) >= 0)


@dataclass
class LabelModel:
    """Hidden labels y; voter j fires with rate fires[1][j] if y is 1 and fires[0][j] if it is 0; share[j] of its evidence counts.

    A voter that doesn't fire says nothing: there are lexicons for several languages. The last voter is silence, which
    fires where no other does. `bias` is such that as many rows are toxic as the prior has it.
    """

    fires: np.ndarray
    share: np.ndarray
    bias: float = 0.0

    def _evidence(self, votes: np.ndarray) -> np.ndarray:
        return _with_silence(votes) @ (self.share * np.log(self.fires[1] / self.fires[0]))

    def posterior(self, votes: np.ndarray) -> np.ndarray:
        return 1 / (1 + np.exp(-np.clip(self._evidence(votes) + self.bias, -40, 40)))

    def balanced(self, votes: np.ndarray, counts: np.ndarray, prior: float) -> LabelModel:
        """With the bias at which the mean posterior is the prior, by bisection."""
        evidence, low, high = self._evidence(votes), -60.0, 60.0
        for _ in range(60):
            middle = (low + high) / 2
            if (counts / (1 + np.exp(-np.clip(evidence + middle, -40, 40)))).sum() < prior * counts.sum():
                low = middle
            else:
                high = middle
        return LabelModel(self.fires, self.share, (low + high) / 2)

    @classmethod
    def of(cls, votes: np.ndarray, y: np.ndarray, counts: np.ndarray) -> LabelModel:
        """Rates and shares if y were the labels, soft or not. A row stands for counts[k] rows."""
        votes, clean, toxic = _with_silence(votes), counts * (1 - y), counts * y
        weight = np.array([clean.sum(), toxic.sum()])
        fires = np.clip((np.stack([clean @ votes, toxic @ votes]) + 0.05) / (weight[:, None] + 0.1 + 1e-9), 1e-4, 1 - 1e-4)
        # what voters have in common beyond the label: the correlation of what the rates leave unexplained, weak ones cubed away
        rest = votes - (np.outer(1 - y, fires[0]) + np.outer(y, fires[1]))
        covariance = rest.T @ (rest * counts[:, None]) / counts.sum()
        scale = np.sqrt(np.maximum(np.diag(covariance), 1e-12))
        correlation = np.abs(covariance / np.outer(scale, scale))
        share = 1 / (np.where(correlation > 0.1, correlation, 0) ** 3).sum(axis=1).clip(1)
        share[-1] = 1.0
        return cls(fires, share)

    @classmethod
    def fit(cls, votes: np.ndarray, guess: np.ndarray, counts: np.ndarray, rounds: int = 15) -> LabelModel:
        """Expectation and maximisation over the hidden labels. `guess`, a label for each row, sets the prior of toxicity and
        a prior of the rates, which weighs as much as the votes: else voters of few rows drift to other ways of parting them."""
        prior = float(np.clip((counts * guess).sum() / counts.sum(), 0.01, 0.99))
        first = cls.of(votes, guess.astype(np.float64), counts)
        model = first.balanced(votes, counts, prior)
        for _ in range(rounds):
            found = cls.of(votes, model.posterior(votes), counts)
            model = cls((found.fires + first.fires) / 2, found.share).balanced(votes, counts, prior)
        return model


def _with_silence(votes: np.ndarray) -> np.ndarray:
    return np.hstack([votes, ~votes.any(axis=1, keepdims=True)])


@dataclass
class Classifier:
    """A linear classifier of terms."""

    terms: dict[str, list[int]]
    weights: np.ndarray
    bias: float

    def score(self, fired: list[int]) -> float:
        return 1 / (1 + math.exp(-max(-40.0, min(40.0, self.bias + float(self.weights[fired].sum() if fired else 0.0)))))


def _logistic(votes: np.ndarray, y: np.ndarray, counts: np.ndarray, ridge: float = 1.0, rounds: int = 25) -> tuple[np.ndarray, float]:
    """Newton's method for soft labels. A row stands for counts[k] rows."""
    x = np.hstack([votes, np.ones((len(votes), 1))])
    w = np.zeros(x.shape[1])
    penalty = np.full(x.shape[1], ridge)
    penalty[-1] = 1e-3
    for _ in range(rounds):
        p = 1 / (1 + np.exp(-np.clip(x @ w, -40, 40)))
        step = np.linalg.solve((x * (counts * p * (1 - p))[:, None]).T @ x + np.diag(penalty), x.T @ (counts * (p - y)) + penalty * w)
        w -= step
        if np.abs(step).max() < 1e-6:
            break
    return w[:-1], float(w[-1])


def _counted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """How many documents of either label each voter fires in, as far as this task sees."""
    counts: tuple[Counter, Counter] = (Counter(), Counter())
    for batch in slices(batches, "text"):
        for label, (found, n) in zip(batch.column("label").to_pylist(), _documents(batch.column("text"), None), strict=True):
            counts[label].update(_voters(found, n))
    every = [t for t in counts[0].keys() | counts[1].keys() if len(t[0]) <= LONGEST_TERM]
    for k in range(0, len(every), 100_000):
        part = every[k : k + 100_000]
        yield pa.RecordBatch.from_arrays(
            [pa.array([t for t, _ in part]), pa.array([k for _, k in part], pa.int32()), pa.array([counts[0][t] for t in part], pa.int64()), pa.array([counts[1][t] for t in part], pa.int64())],
            names=["term", "kind", "clean", "toxic"],
        )


def _distinct(best: list, most: int) -> list:
    """Of voters that fire in as many documents and whose words begin alike, the first; `most` at the most."""
    kept, seen = [], {}
    for r in best:
        word, like = r.term.rstrip("*"), seen.setdefault((r.kind, r.clean, r.toxic), [])
        if not any(word.startswith(x) or x.startswith(word) for x in like):
            like.append(word)
            kept.append(r)
    return kept[:most]


def fit(docs: DataFrame, labels: DataFrame, learn: Column | None = None, label_col: str = "toxic", sample: int = SAMPLE, terms: int = TERMS) -> Classifier:
    """From at most `sample` labelled rows of either label where `learn` (a condition on doc_id) holds, drawn by the hash of their ids.

    Null labels and ids teach nothing; a row that is labelled twice counts by its larger label. Where a label is
    missing, the classifier is the prior alone. Drawn rows of a label stand for all of its rows, so that scores mean
    the same whether the sample holds either label whole or not.
    """
    spark = docs.sparkSession
    known = labels.where(F.col(label_col).isNotNull() & F.col("doc_id").isNotNull())
    known = (known.where(learn) if learn is not None else known).groupBy("doc_id").agg((F.max(label_col) > 0).cast("int").alias("label"))
    drawn = known.where("label = 1").orderBy(F.xxhash64("doc_id"), "doc_id").limit(sample).unionByName(known.where("label = 0").orderBy(F.xxhash64("doc_id"), "doc_id").limit(sample))
    total = dict(known.groupBy("label").count().collect())
    prior = total.get(1, 0) / sum(total.values()) if total else None
    n = dict(drawn.groupBy("label").count().collect())
    if len(n) < 2:
        prior = 0.5 if prior is None else min(0.99, max(0.01, prior))
        return Classifier({}, np.zeros(0), math.log(prior / (1 - prior)))
    texts = saved(docs.select("doc_id", "text").join(F.broadcast(drawn), "doc_id").select("label", "text"))
    counts = in_arrow(texts, _counted, "term string, kind int, clean long, toxic long").groupBy("term", "kind").agg(F.sum("clean").alias("clean"), F.sum("toxic").alias("toxic"))
    # terms that hold for toxic rows and seldom for others, the most telling first
    rate1, rate0 = (F.col("toxic") + 0.1) / (n[1] + 0.2), (F.col("clean") + 0.1) / (n[0] + 0.2)
    telling = F.col("toxic") * F.log(rate1 / rate0) - (F.col("toxic") + F.col("clean")) * 0.01
    best = counts.where((F.col("toxic") >= max(3, n[1] // 500)) & (rate1 > 8 * rate0)).orderBy(F.desc(telling), F.desc(F.length("term")), "term", "kind").limit(20 * terms).collect()
    if not best:
        return Classifier({}, np.zeros(0), math.log(prior / (1 - prior)))
    best = _distinct(best, terms)
    number: dict[str, list[int]] = {}
    for k, r in enumerate(best):
        number.setdefault(r.term, [-1, -1, -1])[r.kind] = k
    shared = spark.sparkContext.broadcast(number)

    def fired(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches, "text"):
            found = pa.array(list(_fired(batch.column("text"), shared.value)), pa.list_(pa.int32()))
            yield pa.RecordBatch.from_arrays([batch.column("label"), found], names=["label", "found"])

    rows = in_arrow(texts, fired, "label int, found array<int>").groupBy("label", "found").count().orderBy("label", "found").collect()
    votes, guess, count = np.zeros((len(rows), len(best))), np.array([r.label for r in rows]), np.array([r["count"] for r in rows], np.float64)
    for k, r in enumerate(rows):
        votes[k, r.found] = 1
    # one on average, so that smoothing and ridge weigh the same however large the table is
    stands = count * np.where(guess > 0, total[1] / n[1], total[0] / n[0]) * sum(n.values()) / sum(total.values())
    posterior = LabelModel.fit(votes, guess, stands).posterior(votes)
    return Classifier(number, *_logistic(votes, posterior, stands))


def toxicity_scores(docs: DataFrame, labels: DataFrame, learn: Column | None = None, label_col: str = "toxic", sample: int = SAMPLE, terms: int = TERMS, column: str = "score") -> DataFrame:
    """docs with a column `column`: 0 to 1, higher if label 1 is likelier, from the whole text alone.

    Null and empty texts have no terms and get the score of such; repeated rows score alike; an empty table gives no
    rows; other columns pass unchanged, but for one named `column`, in any case of letters, which is replaced.
    """
    from pyspark.sql.pandas.types import to_arrow_schema

    shared = docs.sparkSession.sparkContext.broadcast(fit(docs, labels, learn, label_col, sample, terms))
    fields = T.StructType([f for f in docs.schema.fields if f.name.lower() != column.lower()] + [T.StructField(column, T.DoubleType())])
    schema = to_arrow_schema(fields)

    def score(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        classifier = shared.value
        for batch in slices(batches, "text", 16 << 20):
            made = [classifier.score(fired) for fired in _fired(batch.column("text"), classifier.terms)]
            yield pa.RecordBatch.from_arrays([*[batch.column(c) for c in batch.schema.names if c.lower() != column.lower()], pa.array(made, pa.float64())], schema=schema)

    return in_arrow(docs, score, fields)
