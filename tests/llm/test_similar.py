"""Near-duplicates by Jaccard similarity: recall and precision against brute force."""

import itertools

import numpy as np
import pandas as pd
import plain
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from tempora.llm import similar
from tempora.llm.similar import recall, similar_documents, without_similar


def shingles(text, width=5):
    said = plain.words((text or "").translate(plain.UPPER))
    return {tuple(said[k : k + width]) for k in range(max(1, len(said) - width + 1))} if said else set()


def similarity(a, b):
    return len(a & b) / len(a | b) if a or b else 1.0


@pytest.fixture(scope="module")
def planted():
    """[(id, text)] of documents and edited copies, 2k and 2k + 1, with the similarity of each such pair."""
    rng = np.random.default_rng(7)
    rows, near = [], {}
    for k in range(1200):
        words = [f"w{x}" for x in rng.integers(0, 50_000, int(rng.integers(60, 400)))]
        copy = list(words)
        for at in rng.choice(len(words), max(1, int(len(words) * rng.uniform(0.004, 0.03))), replace=False):
            copy[at] = f"e{rng.integers(0, 50_000)}"
        rows += [(2 * k, " ".join(words)), (2 * k + 1, " ".join(copy))]
        near[k] = similarity(shingles(rows[-2][1]), shingles(rows[-1][1]))
    return rows, near


def test_recall(spark, planted):
    rows, near = planted
    got = {r.doc: r.component for r in similar_documents(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    linked = {k for k in near if got[2 * k + 1] == 2 * k}
    assert all(near[k] >= 0.8 for k in linked) and len(set(got.values())) == len(rows) - len(linked)
    for low, high, least in [(0.80, 0.85, 0.95), (0.85, 0.90, 0.98), (0.90, 0.95, 0.99), (0.95, 1.01, 1.0)]:
        of = [k for k in near if low <= near[k] < high]
        share = sum(k in linked for k in of) / len(of)
        print(f"J {low}-{high}: {share:.4f} of {len(of)} pairs")
        assert len(of) >= 60 and share >= least - 0.01
    assert 0.95 < recall(0.8) < recall(0.9)


def test_links_past_the_least(spark):
    """A chain whose ends are too far apart: each member is linked only with its neighbour, and all are one component."""
    rng = np.random.default_rng(3)
    words = [f"w{x}" for x in rng.integers(0, 50_000, 300)]
    rows = []
    for k in range(12):
        rows.append((k, " ".join(words)))
        words = words[12:] + [f"v{k}_{x}" for x in range(12)]
    sets = [shingles(t) for _, t in rows]
    links = [(i, j) for j in range(12) for i in range(j) if similarity(sets[i], sets[j]) >= 0.8]
    assert similarity(sets[0], sets[11]) < 0.5
    got = {r.doc: r.component for r in similar_documents(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert got == plain.components(range(12), links) == dict.fromkeys(range(12), 0)


def test_similar_odd(with_nulls, spark):
    rows = without_similar(with_nulls)
    assert rows.columns == with_nulls.columns and rows.where("doc_id IS NULL").count() == 2
    docs = {r.doc_id: shingles(r.text) for r in with_nulls.where("doc_id IS NOT NULL").collect()}
    links = [(i, j) for i in docs for j in docs if i < j and similarity(docs[i], docs[j]) >= 0.8]
    assert {r.doc_id for r in rows.collect() if r.doc_id is not None} == set(plain.components(docs, links).values())
    assert similar_documents(with_nulls.limit(0)).collect() == []


def near_copies(n, edits, seed=11, words=150):
    """Texts that are each some words away from one text; the numbers of words are drawn from `edits`."""
    rng = np.random.default_rng(seed)
    first, texts = [f"w{x}" for x in rng.integers(0, 50_000, words)], []
    for _ in range(n):
        copy = list(first)
        for at in rng.choice(words, int(rng.choice(edits)), replace=False):
            copy[at] = f"e{rng.integers(0, 50_000)}"
        texts.append(" ".join(copy))
    return texts


def dealt(texts, bits, kind):
    """The buckets of nodes that are each a component of their own."""
    sets = [similar.shingle_set(t.encode(), 5) for t in texts]
    signs = np.stack([similar.signature(s) for s in sets])
    columns = {"node": np.arange(len(texts)), "root": np.arange(len(texts)), **dict(zip(similar._SIGNATURE, np.ascontiguousarray(signs.T), strict=True))}
    batch = pa.RecordBatch.from_pydict({**{k: pa.array(v) for k, v in columns.items()}, "set": pa.array([s.astype("<u4").tobytes() for s in sets], pa.binary())})
    packs = pd.concat(b.to_pandas() for b in similar._dealt(bits, kind, iter([batch])))
    return [bucket for _, bucket in packs.groupby("bucket")], sets


def test_rows_of_a_group_in_proportion():
    """What the buckets pass on of a group of near copies follows its size, not its square."""
    starred, crossed = {}, {}
    for n in (200, 800):
        texts = near_copies(n, [2, 3])
        buckets, _ = dealt(texts, 3, similar._FIRST)
        starred[n] = pd.concat(similar._starred(3, b) for b in buckets).query("u != v").drop_duplicates()
        buckets, _ = dealt(texts, 2, similar._SECOND)
        crossed[n] = pd.concat(similar._crossed(2, b) for b in buckets).query("u != v")
        assert not crossed[n].duplicated().any()
    print({n: (len(starred[n]), len(crossed[n])) for n in starred})
    assert len(starred[800]) <= 16 * 800 and len(starred[800]) <= 6 * len(starred[200])
    assert len(crossed[800]) <= 20 * 800 and len(crossed[800]) <= 7 * len(crossed[200])


def test_crowds_lose_no_link():
    """Pairs that a bucket keeps to itself are those of crowds, and these meet again: all links that _meetings finds stay."""
    texts = near_copies(150, [1, 2, 2, 3])
    for bits in (2, 5):
        buckets, sets = dealt(texts, bits, similar._SECOND)
        met, passed, crowd = set(), set(), set()
        for b in buckets:
            rows = similar._unpacked(b, similar._SECOND)
            met |= {(int(rows["node"][u]), int(rows["node"][v])) for u, near in similar._meetings(bits, int(b["bucket"].iat[0]), rows, rows["root"]) for v in near}
            got = similar._crossed(bits, b)
            passed |= set(zip(got.u[got.u != got.v], got.v[got.u != got.v], strict=True))
            crowd |= set(got.u[got.u == got.v])
        assert passed < met and all(u in crowd and v in crowd for u, v in met - passed)
        members = sorted(crowd)
        again, of = dealt([texts[k] for k in members], bits, similar._THIRD)
        spanned = {(members[u], members[v]) for b in again for u, v in similar._spanned(bits, 0.8, b).itertuples(index=False)}
        good = {(u, v) for u, v in met if similar.jaccard(sets[u], sets[v]) >= 0.8}
        assert spanned and all(similar.jaccard(sets[u], sets[v]) >= 0.8 for u, v in spanned)
        assert plain.components(range(150), spanned | good & passed) == plain.components(range(150), good)
        assert len(spanned) < len(good - passed)


def test_group_near_the_threshold(spark):
    texts = near_copies(160, [1, 2, 2, 3, 5], seed=5) + near_copies(40, [1, 5], seed=6, words=60)
    sets = [shingles(t) for t in texts]
    links = [(i, j) for i, j in itertools.combinations(range(len(texts)), 2) if similarity(sets[i], sets[j]) >= 0.8]
    got = {r.doc: r.component for r in similar_documents(spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")).collect()}
    expected = plain.components(range(len(texts)), links)
    assert got == expected and len(set(expected.values())) > 3


def test_other_texts_stay(spark):
    """Of the texts that no pair needs one in sixty-four moves, on average; of those needed, all rows."""
    docs = spark.createDataFrame([(f"text {k // 2}",) for k in range(8000)], "text string").unionByName(spark.createDataFrame([(None,)], "text string"))
    docs = docs.select("text", F.xxhash64("text").alias("of_1"), F.xxhash64(F.reverse("text")).alias("of_2"))
    for wanted in (F.col("text").isin([f"text {k}" for k in range(100)]) | F.col("text").isNull(), F.lit(True), F.lit(False)):
        needed = docs.where(wanted).select("of_1", "of_2").distinct()
        texts = [r.text for r in similar._among(docs, needed).select("text").collect()]
        sought = [r.text for r in docs.where(wanted).collect()]
        others = len(texts) - len(sought)
        assert not pd.Series(sought, dtype=object).value_counts(dropna=False).sub(pd.Series(texts, dtype=object).value_counts(dropna=False), fill_value=0).gt(0).any()
        assert 0 <= others <= (8001 - len(sought)) / 32
