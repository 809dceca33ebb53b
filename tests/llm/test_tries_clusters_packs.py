"""The prefix trie, integer centroids and packing, held against plain versions and what must hold of any result."""

import zlib

import numpy as np
import plain
import pytest
from compare import DATA
from pyspark.sql import functions as F

from tempora.llm import queries as Q
from tempora.llm.centroids import BOUND, Screen, centroid_clusters
from tempora.llm.packing import BITS, Cuts, curve_places, hilbert_places, packed_pieces, packed_sequences
from tempora.llm.prefix_trie import prefix_trie

SF = f"{DATA}/sf0.001"


# ---- prefix trie


def nodes(df):
    return sorted((r.conv_id, r.depth, -1 if r.parent_conv_id is None else r.parent_conv_id, r.n_convs, r.n_children, r.n_leaves, r.saved_tokens, r.ends_sha256) for r in df.collect())


def test_prefix_trie_query(spark):
    rows = [tuple(r) for r in spark.read.parquet(f"{DATA}/sf0.01/conversations.parquet").select("conv_id", "turn", "role", "text").collect()]
    assert nodes(Q.op11_prefix_trie(spark, f"{DATA}/sf0.01")) == plain.prefix_trie(rows)


def odd_conversations():
    """Conversations long and short, negative ids, null ids, turns, roles and texts, equal turns, many copies, one that others begin."""
    rng = np.random.default_rng(4)
    rows = []
    for c in range(-20, 40):
        for k in range(int(rng.choice([0, 1, 2, 5, 9, 12, 30]))):
            pick = lambda *x: x[int(rng.integers(len(x)))]
            rows.append((c if rng.random() > 0.02 else None, pick(k, k, k, None, 3), pick("a", "b", None), pick("x", "é", "", None) if k > 3 else "x"))
    rows += [(100 + k, j, "a", "x") for k in range(6) for j in range(40)] + [(200 + k, j, "a", "x") for k in range(12) for j in range(k)]
    return rows + rows[:3]


@pytest.mark.parametrize("block", [2, 3, 1024])
def test_prefix_trie_odd(spark, block):
    rows = odd_conversations()
    df = spark.createDataFrame([(*r, 5, "mine") for r in rows], "conv_id long, turn long, role string, text string, depth int, digest string").repartition(5)
    assert nodes(prefix_trie(df, block=block)) == plain.prefix_trie(rows)


def test_prefix_trie_of_nothing(spark):
    df = spark.createDataFrame([(None, 1, "a", "x")], "conv_id long, turn long, role string, text string")
    assert prefix_trie(df).collect() == [] and prefix_trie(df.limit(0)).collect() == []


def test_one_conversation_many_tasks(spark):
    """A conversation with nearly all turns is numbered over many ranges."""
    rows = [(5, k, "a", f"t{k % 7}") for k in range(3000)] + [(6, k, "a", f"t{k % 7}") for k in range(2000)]
    df = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string").repartition(9)
    found = prefix_trie(df, block=64)
    assert found.agg(F.count("*"), F.max("depth")).first() == (3001, 3000)
    top = found.where("depth = 0").first()
    assert (top.n_convs, top.n_leaves, top.saved_tokens) == (2, 1, 4000)


# ---- centroids


def test_screen_is_exact():
    """Centroids that lie within float32's rounding of one another, and ties: the shortlist holds the nearest, integers decide."""
    rng = np.random.default_rng(2)
    base = rng.integers(-BOUND + 9, BOUND - 9, 64)
    centroids = [(base + rng.integers(-3, 4, 64)).tolist() for _ in range(30)]
    centroids += centroids[:5]
    screen = Screen(centroids)
    vectors = np.concatenate([base + rng.integers(-5, 6, (300, 64)), rng.integers(-BOUND, BOUND, (50, 64)), np.array(centroids)])
    assert screen.nearest(vectors).tolist() == [screen.nearest_of(v) for v in vectors.tolist()]
    assert screen.recomputed > 300
    apart = Screen(rng.integers(-BOUND, BOUND, (8, 64)).tolist())
    apart.nearest(rng.integers(-BOUND, BOUND, (1000, 64)))
    assert apart.recomputed < 50  # hardly any is left to integers


def test_centroids_query(spark):
    rows = [tuple(r) for r in spark.read.parquet(f"{SF}/embeddings.parquet").select("vec_id", "embedding").collect()]
    found = Q.op12_centroids(spark, SF).collect()
    assert sorted((r.vec_id, r.cluster, r.distance) for r in found) == plain.clusters(rows, 8, 10)[0]


@pytest.mark.parametrize(("k", "rounds", "wide"), [(3, 4, 1.0), (5, 2, 3e6), (2, 3, 1e300), (40, 1, 1e9), (1, 0, 1.0)])
def test_centroids_odd(spark, k, rounds, wide):
    rng = np.random.default_rng(k)
    rows = [(i, rng.normal(0, 2, 3).tolist()) for i in range(30)] + [(31, None), (32, [1.0, 2.0]), (33, [1.0, None, 2.0]), (34, [float("nan")] * 3), (35, [1.0, float("inf"), 0.0]), (36, [0.0] * 3), (None, [1.0] * 3), (3, [0.5] * 3), (3, [0.5] * 3)]
    rows += [(40 + i, [wide, -wide * (i + 1), 0.25]) for i in range(3)]
    df = spark.createDataFrame([(*r, 9) for r in rows], "vec_id long, embedding array<double>, cluster int").repartition(4)
    got, (want, centroids) = centroid_clusters(df, k=k, rounds=rounds, dim=3).collect(), plain.clusters(rows, k, rounds, dim=3)
    fits = lambda d: d if d < 1 << 63 else -1
    assert sorted((-1 if r.id is None else r.id, r.cluster, -1 if r.distance is None else r.distance) for r in got) == sorted((i, c, fits(d)) for i, c, d in want)
    assert all(r.centroid == ",".join(map(str, centroids[r.cluster])) for r in got)
    total = sum(d for _, _, d in want) if all(d < 1 << 63 for _, _, d in want) else 1 << 63
    assert {r.inertia for r in got} == {total if total < 1 << 63 else None}


def test_centroids_of_nothing(spark):
    df = spark.createDataFrame([(1, None), (2, [])], "vec_id long, embedding array<float>")
    assert centroid_clusters(df).collect() == [] and centroid_clusters(df.limit(0)).collect() == []


# ---- packing


@pytest.mark.parametrize(("bits", "dims"), [(1, 2), (4, 2), (3, 3), (2, 4), (5, 1)])
def test_hilbert_curve(bits, dims):
    """It visits all cells, and from each goes on to a neighbour."""
    cells = np.stack(np.meshgrid(*[np.arange(1 << bits)] * dims, indexing="ij"), -1).reshape(-1, dims)
    places = hilbert_places(cells, bits)
    assert sorted(places.tolist()) == list(range(len(cells)))
    assert set(np.abs(np.diff(cells[np.argsort(places)], axis=0)).sum(axis=1).tolist()) == {1}


def test_alike_documents_are_neighbours():
    """Documents of one vocabulary lie in fewer runs along the curve than chance has."""
    rng = np.random.default_rng(3)
    kinds = rng.integers(0, 4, 400)
    texts = [rng.integers(0, 50, 200) + 1000 * k for k in kinds]
    places = curve_places(np.concatenate(texts).astype(np.uint32), np.arange(401) * 200)
    assert places.min() >= 0 and places.max() < 1 << (4 * BITS)
    turns = lambda order: np.count_nonzero(np.diff(kinds[order]))
    assert turns(np.argsort(places)) < turns(np.arange(400)) / 4


@pytest.mark.parametrize("total", [0, 1, 2047, 2048, 2049, 4096, 9999])
def test_cuts(total):
    cuts = Cuts(total, 2048)
    at = np.arange(total)
    numbers = cuts.sequence(at)
    assert (np.diff(numbers) >= 0).all() and (at - cuts.start(numbers) >= 0).all()
    sizes = np.bincount(numbers) if total else np.zeros(0, int)
    assert all(n == 2048 or n & (n - 1) == 0 < n for n in sizes.tolist()) and sizes.sum() == total


def tokens(texts):
    from tokenizers import Tokenizer

    library = Tokenizer.from_file(Q.vocabulary_path(Q.TOKENIZER))
    return [np.array([*library.encode(t or "", add_special_tokens=False).ids, 1], "<u4") for t in texts]


def check_packed(rows, texts, length=2048):
    """rows: (key of the document, start, length, crc, doc_tokens, sequence, offset). Every token in one piece, gapless sequences, no padding."""
    ids = dict(zip(texts, tokens(texts.values()), strict=True))
    by_doc, by_sequence = {}, {}
    for key, start, n, crc, whole, sequence, offset in rows:
        assert n > 0 and whole == len(ids[key]) and crc == zlib.crc32(ids[key][start : start + n].tobytes())
        by_doc.setdefault(key, []).append((start, n))
        by_sequence.setdefault(sequence, []).append((offset, n))
    for parts, sizes in ((by_doc, {k: len(v) for k, v in ids.items()}), (by_sequence, None)):
        for key, pieces in parts.items():
            at = 0
            for start, n in sorted(pieces):
                assert start == at
                at += n
            assert at == sizes[key] if sizes else at <= length and (at == length or at & (at - 1) == 0)
    assert set(by_doc) == set(ids) and sorted(by_sequence) == list(range(len(by_sequence)))


COLUMNS = ("start", "length", "ids_crc32", "doc_tokens", "sequence_id", "offset")


def test_packing_query(spark):
    texts = {r.doc_id: r.text for r in spark.read.parquet(f"{SF}/documents.parquet").collect()}
    rows = [(r.doc_id, *(r[c] for c in COLUMNS)) for r in Q.op13_packing(spark, SF).collect()]
    check_packed(rows, texts)
    ids = dict(zip(texts, tokens(texts.values()), strict=True))
    place = {k: int(curve_places(v, np.array([0, len(v)]))[0]) for k, v in ids.items()}
    order = [r[0] for r in sorted(rows, key=lambda r: (r[5], r[6])) if r[1] == 0]
    assert order == sorted(texts, key=lambda k: (place[k], k))


def test_packing_odd(spark, odd):
    texts = {r.doc_id: r.text for r in odd.collect()}
    pieces = packed_pieces(odd.withColumn("sequence_id", F.lit(1)), Q.vocabulary_path(Q.TOKENIZER)).withColumn("ids_crc32", F.crc32("ids"))
    check_packed([(r.doc_id, *(r[c] for c in COLUMNS)) for r in pieces.collect()], texts)
    assert packed_pieces(odd.limit(0), Q.vocabulary_path(Q.TOKENIZER)).collect() == []


def test_packed_sequences(spark, with_nulls):
    """Null ids and repeated rows are documents too; sequences hold their pieces' tokens."""
    pieces = packed_pieces(with_nulls, Q.vocabulary_path(Q.TOKENIZER), length=100).withColumn("crc", F.crc32("ids")).collect()
    assert sum(r.length for r in pieces) == sum(len(x) for x in tokens([r.text for r in with_nulls.collect()]))
    assert len([r for r in pieces if r.doc_id is None and r.start == 0]) == 2 and len([r for r in pieces if r.doc_id == 5 and r.start == 0]) == 2
    made = packed_sequences(packed_pieces(with_nulls, Q.vocabulary_path(Q.TOKENIZER), length=100), length=100).collect()
    by = {}
    for r in sorted(pieces, key=lambda r: r.offset):
        by.setdefault(r.sequence_id, []).append(bytes(r.ids))
    assert {r.sequence_id: bytes(r.ids[: 4 * r.n_tokens]) for r in made} == {k: b"".join(v) for k, v in by.items()}
    assert all(len(r.ids) == 400 or r.n_tokens & (r.n_tokens - 1) == 0 and len(r.ids) == 4 * r.n_tokens for r in made)
