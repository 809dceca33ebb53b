"""Operators with one right answer, held against the plain versions."""

import numpy as np
import plain
import pyarrow as pa
import pytest
from compare import DATA, rows_of_duck, rows_of_spark


from tempora.llm import queries as Q
from tempora.llm.components import components
from tempora.llm.decontaminate import contamination, decontaminated, longest_matches
from tempora.llm.line_dedup import drop_shared_lines
from tempora.llm.mixing import mixed
from tempora.llm.neighbours import nearest_neighbours
from tempora.llm.quality import quality_scores
from tempora.llm.simhash import fingerprint_links, near_duplicates, without_near_duplicates
from tempora.llm.similar import without_similar
from tempora.llm.token_counts import PieceCounter, token_counts
from tempora.llm.toxicity import toxicity_scores
from tempora.llm.token_files import Segment, by_words, encode_segment, read_token, read_token_index, token_ids, write_token_file

SF = f"{DATA}/sf0.001"


def pairs(df, *columns):
    return [tuple(r[c] for c in columns) for r in df.collect()]


@pytest.fixture(scope="module")
def docs(spark):
    return spark.read.parquet(f"{SF}/documents.parquet")


@pytest.fixture(scope="module")
def texts(docs):
    return pairs(docs, "doc_id", "text")


# ---- line dedup


def test_line_dedup_query(spark, texts):
    got = {r.doc_id: (r.n_lines, r.n_dropped, r.kept_sha256) for r in Q.op2_line_dedup(spark, SF).collect()}
    assert got == plain.line_dedup(texts)


@pytest.mark.parametrize("name", sorted(Q.SQL))
def test_sql(spark, duck, name):
    assert rows_of_spark(Q.QUERIES[name](spark, SF)) == rows_of_duck(duck(SF), Q.SQL[name])


@pytest.mark.parametrize("batches", [1, 2, 5])
def test_line_dedup_odd(odd, batches):
    import hashlib

    found = drop_shared_lines(odd, min_docs=3, batches=batches)
    assert sorted(found.columns) == sorted(odd.columns)  # `lines` now is the operator's
    got = {r.doc_id: (r.lines.n_lines, r.lines.n_dropped, hashlib.sha256(r.lines.kept_text.encode()).hexdigest()) for r in found.collect()}
    assert got == plain.line_dedup(pairs(odd, "doc_id", "text"), min_docs=3)


def test_line_dedup_nulls_and_empty(with_nulls):
    rows = drop_shared_lines(with_nulls, min_docs=3).collect()
    assert len(rows) == with_nulls.count()
    assert [r.lines.n_lines for r in rows if r.doc_id is None] == [1, 1]
    assert len({r.lines.n_dropped for r in rows if r.doc_id == 5}) == 1
    assert drop_shared_lines(with_nulls.limit(0)).collect() == []


# ---- token counts


def test_token_counts(spark, odd):
    import base64

    with open(Q.vocabulary_path(Q.COUNT_VOCABULARY), "rb") as lines:
        tokens = [base64.b64decode(x.split()[0]) for x in lines if x.strip()]
    first, further = {t[1:] for t in tokens if t[:1] == b" " and len(t) > 1}, {t for t in tokens if t[:1] != b" "}
    each = lambda t: sum(plain.greedy_pieces(w.encode(), first, further, b" " in tokens) for w in plain.words(t))
    scripts = spark.createDataFrame([(1, "한국어 단어 中文文字 日本語のテキスト \U0001f469 ab\x01c " + "語" * 500)], "doc_id long, text string")
    for df in (spark.read.parquet(f"{SF}/documents.parquet"), odd, scripts):
        rows = pairs(df, "doc_id", "text")
        want = {i: (len(plain.words(t)), each(t)) for i, t in rows}
        assert {r.doc_id: (r.n_words, r.n_tokens) for r in token_counts(df, Q.vocabulary_path(Q.COUNT_VOCABULARY)).collect()} == want


def test_piece_counter_by_chance():
    rng = np.random.default_rng(3)
    word = lambda n: bytes(rng.integers(97, 100, n).astype(np.uint8))
    for _ in range(40):
        first, further = ({word(int(rng.integers(1, 5))) for _ in range(8)} for _ in range(2))
        said = [word(int(rng.integers(1, 14))) for _ in range(60)]
        at = np.concatenate([[0], np.cumsum([len(w) for w in said])])
        for lone in (False, True):
            got = PieceCounter(sorted(first), sorted(further), lone).count(np.frombuffer(b"".join(said), np.uint8), at)
            assert got.tolist() == [plain.greedy_pieces(w, first, further, lone) for w in said]


def test_token_counts_of_a_long_word(spark):
    """A word of a million letters is read byte by byte like any other."""
    df = spark.createDataFrame([(1, "ab" * 500_000)], "doc_id long, text string")
    row = token_counts(df, Q.vocabulary_path(Q.COUNT_VOCABULARY)).first()
    assert row.n_words == 1 and 100_000 < row.n_tokens <= 1_000_000


def test_token_counts_nulls_and_empty(with_nulls):
    path = Q.vocabulary_path(Q.COUNT_VOCABULARY)
    rows = token_counts(with_nulls, path).collect()
    assert sorted(r.n_words for r in rows if r.doc_id is None) == [0, 4] and sum(r.doc_id == 5 for r in rows) == 2
    assert token_counts(with_nulls.limit(0), path).collect() == []


# ---- near duplicates


def test_simhash_query(spark, texts):
    got = {r.doc_id: (r.fingerprint, r.component_id) for r in Q.op4_simhash(spark, SF).collect()}
    assert got == plain.near_duplicates(texts)


def test_simhash_odd(odd):
    got = {r.doc: (f"{r.fp & (1 << 64) - 1:016x}", r.component) for r in near_duplicates(odd, width=4, radius=4).collect()}
    assert got == plain.near_duplicates(pairs(odd, "doc_id", "text"))


@pytest.mark.parametrize("radius", [0, 2, 4])
def test_links_by_chance(spark, radius):
    rng = np.random.default_rng(11)
    seeds = rng.integers(0, 2**63, 60, dtype=np.uint64)
    found = set(seeds.tolist())
    for s in seeds.tolist():
        for _ in range(4):
            bits = rng.choice(64, int(rng.integers(1, 7)), replace=False)
            found.add(int(s) ^ sum(1 << int(b) for b in bits))
    values = sorted(x - (1 << 64) if x >> 63 else x for x in found)
    df = spark.createDataFrame([(v,) for v in values], "fp long")
    named = {r.node: r.root for r in components(fingerprint_links(df, radius)).collect()}
    near = [(a, b) for k, a in enumerate(values) for b in values[k + 1 :] if ((a ^ b) & (1 << 64) - 1).bit_count() <= radius]
    assert {v: named.get(v, v) for v in values} == plain.components(values, near)


def test_components_of_a_path(spark):
    rng = np.random.default_rng(5)
    order = rng.permutation(300).tolist()
    links = [(a, b) for a, b in zip(order[:200], order[1:200])] + [(order[250], order[251]), (7, 7), (None, 3)]
    got = {r.node: r.root for r in components(spark.createDataFrame(links, "u long, v long")).collect()}
    assert got == {i: r for i, r in plain.components(range(300), [x for x in links if None not in x]).items() if i in got}
    assert len(got) == 202


def test_without_near_duplicates(with_nulls):
    rows = without_near_duplicates(with_nulls, width=5)
    assert rows.columns == with_nulls.columns
    ids = sorted(r.doc_id for r in rows.collect() if r.doc_id is not None)
    named = plain.near_duplicates(pairs(with_nulls.where("doc_id IS NOT NULL").distinct(), "doc_id", "text"), width=5)
    assert sorted(set(ids)) == sorted({c for _, c in named.values()})
    assert rows.where("doc_id IS NULL").count() == 2
    assert near_duplicates(with_nulls.limit(0)).collect() == []


# ---- decontamination


def test_decontamination_query(spark, texts):
    items = pairs(spark.read.parquet(f"{SF}/benchmark.parquet"), "item_id", "text")
    rows = Q.op6_decontamination(spark, SF).collect()
    assert {r.doc_id: (r.n_words, r.n_hit, r.n_items, r.items_sha256) for r in rows} == plain.contamination(texts, items)
    assert all(r.contaminated == (r.n_hit > 0) for r in rows) and any(r.contaminated for r in rows)


@pytest.mark.parametrize("bench_bytes", [1 << 24, 40])
def test_decontamination_odd(spark, odd, bench_bytes):
    items = [(1, "Quick brown FOX jumps over the lazy dog and runs far away"), (2, "old mill"), (3, None), (4, "..."), (2, "old mill"), (5, "w5 w6 w7"), (6, "日本語 の"), (7, "old mill by the river")]
    bench = spark.createDataFrame([*items, (None, "one")], "item_id long, text string")
    rows = contamination(odd, bench, bench_bytes=bench_bytes).select("doc_id", "_found.n_words", Q.span_words().alias("n_hit"), Q.item_digest().alias("d"), "_found.item_ids", "_found.matches").collect()
    assert {r.doc_id: (r.n_words, r.n_hit, len(r.item_ids), r.d) for r in rows} == plain.contamination(pairs(odd, "doc_id", "text"), items)
    match = {m.item_id: (m.start, m.n_words) for r in rows if r.doc_id == 5 for m in r.matches}
    assert match[1] == (1, 12) and match[2] == (15, 2)


def test_decontamination_nulls_and_empty(spark, with_nulls):
    none = spark.createDataFrame([], "item_id long, text string")
    assert decontaminated(with_nulls, none).count() == with_nulls.count()
    bench = spark.createDataFrame([(1, "without id")], "item_id long, text string")
    assert decontaminated(with_nulls, bench).count() == with_nulls.count() - 1
    assert decontaminated(with_nulls, bench).columns == with_nulls.columns
    assert contamination(with_nulls.limit(0), bench).collect() == []


@pytest.mark.parametrize("bench_bytes", [1 << 24, 60])
def test_longest_matches(spark, bench_bytes):
    rng = np.random.default_rng(9)
    text = lambda n: " ".join(f"x{k}" for k in rng.integers(0, 6, n))
    docs = [(k, text(int(rng.integers(0, 60)))) for k in range(40)] + [(90, None), (91, "unknown words")]
    items = [(k, text(int(rng.integers(1, 30)))) for k in range(12)] + [(50, "nothing shared"), (51, None), (52, " ".join(docs[3][1].split()[:25]))]
    found = longest_matches(spark.createDataFrame([*docs, (None, "x1 x2")], "doc_id long, text string").repartition(5), spark.createDataFrame(items, "item_id long, text string"), depth=4, bench_bytes=bench_bytes)
    assert {r.item_id: (r.n_words, r.doc, r.start, r.item_start) for r in found.collect()} == plain.longest_matches(docs, items)


def test_windows_by_chance(spark):
    """Few different words, so that windows overlap and repeat, within items and across them."""
    rng = np.random.default_rng(4)
    text = lambda n: " ".join(f"x{k}" for k in rng.integers(0, 3, n))
    docs = [(k, text(int(rng.integers(0, 80)))) for k in range(60)]
    items = [(k, text(int(rng.integers(0, 12)))) for k in range(25)]
    rows = contamination(spark.createDataFrame(docs, "doc_id long, text string"), spark.createDataFrame(items, "item_id long, text string"), window=6)
    rows = rows.select("doc_id", "_found.n_words", Q.span_words().alias("n_hit"), Q.item_digest().alias("d"), "_found.item_ids").collect()
    assert {r.doc_id: (r.n_words, r.n_hit, len(r.item_ids), r.d) for r in rows} == plain.contamination(docs, items, window=6)


# ---- token files


def test_token_files_query(spark, texts):
    from tokenizers import Tokenizer

    rows = sorted((r.doc_id, r.start, r.n_tokens, r.ids_crc32) for r in Q.op8_token_files(spark, SF).collect())
    assert rows == plain.token_file(texts, Tokenizer.from_file(Q.vocabulary_path(Q.TOKENIZER)))


def test_token_files_odd(spark, odd, tmp_path):
    from tokenizers import Tokenizer

    path = Q.vocabulary_path(Q.TOKENIZER)
    tricky = ["don't stop!!! 3.14 it's 'll", "<|endoftext|> a", "ÉCOLE École x y", "àb ﬁ ™ 1½ 10²", "tab\tand\x1cfs \x85 nel", "emoji 👩‍👩‍👧 ok?!", "'s 's x's", "İstanbul ẞ ß ŉ"]
    more = spark.createDataFrame([(100 + k, t) for k, t in enumerate(tricky)], "doc_id long, text string")
    both = odd.select("doc_id", "text").unionByName(more)
    for tokens in (1_000_000, 50):
        write_token_file(both, f"file://{tmp_path}/{tokens}", path, segment_tokens=tokens)
        got = sorted((r.doc, r.start, r.n_tokens, r.crc) for r in read_token_index(spark, f"file://{tmp_path}/{tokens}").collect())
        assert got == plain.token_file(pairs(both, "doc_id", "text"), Tokenizer.from_file(path))


def test_token_files_nulls_and_empty(spark, with_nulls, tmp_path):
    path = Q.vocabulary_path(Q.TOKENIZER)
    write_token_file(with_nulls, f"file://{tmp_path}/a", path)
    rows = sorted(read_token_index(spark, f"file://{tmp_path}/a").collect(), key=lambda r: r.start)
    assert len(rows) == with_nulls.count() and [r.doc for r in rows[:2]] == [None, None] and rows[0].n_tokens == 1
    assert all(a.start + a.n_tokens == b.start for a, b in zip(rows, rows[1:]))
    write_token_file(with_nulls.limit(0), f"file://{tmp_path}/b", path)
    assert read_token_index(spark, f"file://{tmp_path}/b").collect() == []


def test_read_token(spark, texts, tmp_path):
    """Any token of a file, by its place."""
    path, file = Q.vocabulary_path(Q.TOKENIZER), f"file://{tmp_path}/t"
    docs = spark.createDataFrame(texts[:60], "doc_id long, text string")
    write_token_file(docs, file, path, segment_tokens=700)
    ids, _ = token_ids(pa.array([t for _, t in sorted(texts[:60])], pa.string()), path, 2)
    for place in (0, 1, 699, 700, 701, len(ids) // 2, len(ids) - 1):
        assert read_token(spark, file, place) == ids[place]
    assert read_token(spark, file, len(ids)) is None


def test_other_tokenizers_see_whole_texts(texts):
    from tokenizers import Tokenizer

    path = Q.vocabulary_path("byte_bpe_50k.json")
    assert by_words(Q.vocabulary_path(Q.TOKENIZER)) and not by_words(path)
    some = [t for _, t in texts[:20]]
    ids, at = token_ids(pa.array(some, pa.string()), path, 2)
    want = [[*Tokenizer.from_file(path).encode(t, add_special_tokens=False).ids, 2] for t in some]
    assert ids.tolist() == sum(want, []) and np.diff(at).tolist() == [len(x) for x in want]


@pytest.mark.parametrize("widths", [(10, 6), (8, 8), (4, 4, 8), (12,)])
def test_codes_round_trip(widths):
    rng = np.random.default_rng(1)
    for n in (0, 1, 511, 512, 513, 5000):
        ids = np.concatenate([rng.integers(0, 50000, n // 2), rng.integers(0, 300, n - n // 2)]).astype(np.uint32)
        if n > 1:
            ids[n // 2] = 2**32 - 1
        rng.shuffle(ids)
        starts = np.array([0, n // 3, n // 3], np.int64)
        segment = Segment(encode_segment(ids, starts, widths))
        assert np.array_equal(segment.ids(0, n), ids)
        assert [segment.token(k) for k in range(0, n, 97)] == ids[::97].tolist()
        assert np.array_equal(segment.document(2), ids[n // 3 :]) and len(segment.document(1)) == 0


# ---- neighbours


def test_neighbours_recall_and_scores(spark):
    df = spark.read.parquet(f"{SF}/embeddings.parquet")
    vectors = dict(pairs(df, "vec_id", "embedding"))
    want = plain.nearest(vectors, [i for i in vectors if i % 50 == 0])
    got = {}
    for r in sorted(Q.op9_neighbours(spark, SF).collect(), key=lambda r: (r.query_id, r.rank)):
        got.setdefault(r.query_id, []).append((r.vec_id, r.score))
    assert got.keys() == want.keys()
    assert sum(len({i for i, _ in got[q]} & {i for i, _ in want[q]}) for q in want) >= 0.9 * sum(map(len, want.values()))
    for q, near in got.items():
        assert len(near) == 5 and near == sorted(near, key=lambda x: (-x[1], x[0])) and q not in dict(near)
        for i, score in near:
            a, b = np.array(vectors[q], float), np.array(vectors[i], float)
            assert score == pytest.approx(float(a @ b / np.sqrt((a @ a) * (b @ b))), abs=1e-12)


def test_neighbours_odd(spark):
    rows = [(0, [1.0, 0.0]), (1, [2.0, 0.0]), (2, [3.0, 0.0]), (3, [0.0, 0.0]), (4, None), (5, [float("nan"), 1.0]), (6, [float("inf"), 1.0]), (7, [None, 1.0]), (8, [0.0, 1.0]), (None, [1.0, 0.0]), (50, [0.0, 2.0]), (100, [0.0, 0.0]), (9, [1.0]), (8, [0.0, 1.0])]
    df = spark.createDataFrame([(i, v, "x") for i, v in rows], "vec_id long, embedding array<float>, label string")
    got = sorted((r.query_id, r.rank, r.vec_id) for r in nearest_neighbours(df, df.vec_id % 50 == 0).collect())
    assert got == [(0, 1, 1), (0, 2, 2), (0, 3, 8), (0, 4, 50), (50, 1, 8), (50, 2, 0), (50, 3, 1), (50, 4, 2)]
    assert nearest_neighbours(df.limit(0), df.vec_id % 50 == 0).collect() == []


@pytest.mark.parametrize("query_bytes", [1 << 25, 20_000])
def test_neighbours_recall_at_size(spark, query_bytes):
    """2,000 vectors in two shards: a tenth of them verified for each query is enough."""
    df = spark.read.parquet(f"{DATA}/sf0.1/embeddings.parquet")
    vectors = dict(pairs(df, "vec_id", "embedding"))
    queries = [i for i in vectors if i % 50 == 0]
    ids, rows = np.array(list(vectors)), np.array([np.array(v, float) for v in vectors.values()])
    unit = rows / np.sqrt((rows * rows).sum(axis=1))[:, None]
    got = {}
    for r in nearest_neighbours(df, df.vec_id % 50 == 0, shard=1000, query_bytes=query_bytes).collect():
        got.setdefault(r.query_id, set()).add(r.vec_id)
    found = 0
    for q in queries:
        near = ids[np.argsort(-(unit @ unit[np.flatnonzero(ids == q)[0]]), kind="stable")]
        found += len(got[q] & set(near[near != q][:5].tolist()))
    assert set(got) == set(queries) and found >= 0.9 * 5 * len(queries)


# ---- names that clash with the operators' own


def test_clashing_columns(spark):
    own = ["_found", "_doc", "_of", "_places", "_keep", "_id", "_rate", "_copy", "_quality", "_goes"]
    line = "a line that several documents share, and long enough to be a key of its own"
    docs = spark.createDataFrame([(k, f"{line}\nmore {k}", *[c + str(k) for c in own]) for k in range(6)], f"doc_id long, text string, {', '.join(c + ' string' for c in own)}")
    bench = spark.createDataFrame([(1, "more 3")], "item_id long, text string")
    kept = decontaminated(docs, bench)
    assert kept.columns == docs.columns and {(r.doc_id, r._found) for r in kept.collect()} == {(k, f"_found{k}") for k in range(6) if k != 3}
    lines = drop_shared_lines(docs, min_docs=3).collect()
    assert {(r.doc_id, r._doc, r._places, r.lines.n_dropped) for r in lines} == {(k, f"_doc{k}", f"_places{k}", int(k < 5)) for k in range(6)}
    rates = spark.createDataFrame([(k, 1.0) for k in range(6)], "doc_id long, rate double")
    assert {(r.doc_id, r._rate, r._copy, r._id) for r in mixed(docs, rates).collect()} == {(k, f"_rate{k}", f"_copy{k}", f"_id{k}") for k in range(6)}
    for single in (without_near_duplicates(docs), without_similar(docs)):
        assert single.columns == docs.columns and all(r._keep == f"_keep{r.doc_id}" for r in single.collect())


def test_columns_that_clash_in_another_case(spark):
    docs = spark.createDataFrame([(k, f"text {k}", 1.0, "x", "y") for k in range(4)], "doc_id long, text string, Score double, LINES string, Note string")
    labels = spark.createDataFrame([(k, k % 2, k % 2) for k in range(4)], "doc_id long, quality int, toxic int")
    for scores in (toxicity_scores, quality_scores):
        assert sorted(scores(docs, labels).columns) == ["LINES", "Note", "doc_id", "score", "text"] and scores(docs, labels).select("score", "Note").count() == 4
    assert sorted(drop_shared_lines(docs).columns) == ["Note", "Score", "doc_id", "lines", "text"]


def test_lines_of_rows_that_share_an_id(spark):
    """Each row loses its own lines, wherever they stand in it."""
    line = "a line that several documents share, and long enough to be a key of its own"
    rows = [(1, f"x\n{line}\ny"), (1, f"{line}\nz\n{line}"), (2, line), (3, line), (None, line)]
    got = sorted((r.doc_id or 0, r.lines.kept_text, r.lines.n_dropped) for r in drop_shared_lines(spark.createDataFrame(rows, "doc_id long, text string"), min_docs=3).collect())
    assert got == [(0, line, 0), (1, "x\ny", 1), (1, "z", 2), (2, "", 1), (3, line, 0)]


def test_odd_radius(spark):
    with pytest.raises(ValueError):
        fingerprint_links(spark.createDataFrame([(0,), (7,)], "fp long"), 3)


def test_scratch_on_a_cluster():
    """Without a shared folder a cluster's executors would write where nobody else can read."""
    from types import SimpleNamespace

    from tempora.llm._common import scratch

    session = SimpleNamespace(conf=SimpleNamespace(get=lambda *_: None), sparkContext=SimpleNamespace(master="spark://host:7077"))
    with pytest.raises(ValueError):
        scratch(session)


def test_text_slices():
    from tempora.llm._common import slices

    batch = pa.RecordBatch.from_pydict({"text": ["a" * 10, None, "b" * 25, "", "c"]})
    assert [s.num_rows for s in slices(iter([batch]), "text", 12)] == [2, 1, 2]
