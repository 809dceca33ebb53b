"""Near-duplicates by the Jaccard similarity of shingle sets, found by SimHash tables and verified by the sets.

Each bit of a SimHash of sets with similarity J differs with a chance of acos(2J / (1 + J)) / pi. TABLES fingerprints
of 32 bits, met in the middle of Hamming balls of radius 2, so bring together 96 % of all pairs at J = 0.8, and more
above (`recall`). As in `simhash`, a fingerprint goes to each bucket that one of its variants begins with. Pairs that
share a variant are compared by 128 further bits in the bucket, then by all bits of all tables, then by the shingle
sets themselves; only what passes is a link.

In a bucket those that are alike the least of their variant hang together, over all variants, and each is paired with
the least of all that hang together, not with all. Of its pairs a document's nearest is verified first; the others
matter only where they still join different components. Where this could lose a link, since not all that share a variant
are alike or of one component then, a second round compares all bits of those in different components, and passes on each
pair that is near enough once. In a large group near the threshold such pairs are as many as the square of its members:
where both have more than CROWD of them in a bucket, they aren't passed on, but meet there once more with their shingle
sets, and the bucket passes on a spanning forest of the links.
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
from pyspark.sql import DataFrame, GroupedData
from pyspark.sql import functions as F

from tempora.llm._common import free_name, in_arrow, saved, skew_join, slices, temporary, text_bytes
from tempora.llm.components import components
from tempora.llm.simhash import _LOWER, SEED, _forest

#: Words of signature, of 64 bits; each holds the fingerprints of two tables. Bits of a fingerprint and its radius.
WORDS, BITS, RADIUS = 13, 32, 2
TABLES = 2 * WORDS
#: Of 128 further bits so many may differ. At J = 0.8 one pair in 150 differs in more, and meets in three tables on average.
FURTHER = 29
#: Of all bits of two signatures so many may differ. At J = 0.8 one pair in 300 differs in more; at J = 0.65 nineteen of twenty do.
CLOSE = 154
#: Variants that a bucket may write out, if fingerprints are even.
BUCKET_VARIANTS = 2_000_000
#: Bytes of shingle sets that a bucket may get, if fingerprints are even.
BUCKET_BYTES = 32 << 20
#: Pairs of a node in a bucket from which on it is compared there, with others that have as many.
CROWD = 4
#: Bits for each text that is looked for in the map that keeps other texts from moving, and those of one of Spark's bitmaps.
TEXT_BITS, BITMAP = 64, 32768
_SIGNATURE = [f"s{k}" for k in range(WORDS)]
#: Two hashes that tell texts apart.
_TEXT = ("of_1", "of_2")


def recall(j: float, tables: int = TABLES) -> float:
    """The share of pairs at similarity j that meet in a table."""
    p = math.acos(2 * j / (1 + j)) / math.pi
    one = sum(math.comb(BITS, k) * p**k * (1 - p) ** (BITS - k) for k in range(RADIUS + 1))
    return 1 - (1 - one) ** tables


def shingle_set(text: bytes, width: int) -> np.ndarray:
    """Sorted hashes of the different shingles of `width` words; fewer words are one shingle, no words none."""
    words = text.split()
    line, digest = b" ".join(words), xxhash.xxh64_intdigest
    if len(words) <= width:
        return np.array([digest(line, SEED)] if words else [], np.uint64)
    ends = np.cumsum(np.fromiter(map(len, words), np.int64, len(words)) + 1)
    starts = np.concatenate([[0], ends[:-1]])
    return np.unique(np.array([digest(line[a:b], SEED) for a, b in zip(starts[: len(words) - width + 1].tolist(), (ends[width - 1 :] - 1).tolist(), strict=True)], np.uint64))


def signature(hashes: np.ndarray) -> np.ndarray:
    """WORDS words: a bit is set if over half of the set's hashes, mixed anew for each word, set it."""
    ones = np.zeros(64 * WORDS, np.int64)
    for k in range(0, len(hashes), 255):  # column sums of 0 and 1 fit 8 bits
        h = hashes[k : k + 255, None] + np.arange(1, WORDS + 1, dtype=np.uint64) * np.uint64(0x9E3779B97F4A7C15)
        h = (h ^ (h >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
        h = (h ^ (h >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
        h ^= h >> np.uint64(31)
        ones += np.unpackbits(h.view(np.uint8), axis=1, bitorder="little").sum(axis=0, dtype=np.uint8)
    return np.packbits(2 * ones > len(hashes), bitorder="little").view("<i8")


def jaccard(a: np.ndarray, b: np.ndarray) -> float:
    both = len(np.intersect1d(a, b, assume_unique=True))
    return both / (len(a) + len(b) - both) if len(a) or len(b) else 1.0


def _texts(texts: pa.Array) -> list[bytes]:
    data, at = text_bytes(texts)
    data = _LOWER[data].tobytes()
    return [data[a:b] for a, b in itertools.pairwise(at.tolist())]


def _signed(width: int, batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in slices(batches, "text"):
        sets = [shingle_set(t, width) for t in _texts(batch.column("text"))]
        node = pa.array(np.array([xxhash.xxh64_intdigest(s.tobytes(), SEED) for s in sets], np.uint64).view(np.int64))
        signs = np.stack([signature(s) for s in sets])
        yield pa.RecordBatch.from_arrays([batch.column("doc"), *(batch.column(c) for c in _TEXT), node, *(pa.array(np.ascontiguousarray(c)) for c in signs.T)], names=["doc", *_TEXT, "node", *_SIGNATURE])


#: What a bucket gets of a node, packed: in the first round, in the second.
_TABLE = [("fp", "<u4"), ("node", "<i8")]
_FIRST, _SECOND = np.dtype([*_TABLE, ("further", "<u8", (2,))]), np.dtype([*_TABLE, ("root", "<i8"), ("signature", "<u8", (WORDS,))])
#: And of a node of a crowd; its shingle set, of `size` hashes, follows in a column of its own.
_THIRD = np.dtype([*_SECOND.descr, ("size", "<u4")])


def _dealt(prefix_bits: int, kind: np.dtype, batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(bucket, rows), with sets for _THIRD: each table's fingerprints go to every bucket that one of their variants begins with, packed by batch."""
    flips = np.array([0, *(1 << b for b in range(prefix_bits))], np.uint32)
    for batch in batches:
        words = np.stack([batch.column(c).to_numpy().view(np.uint64) for c in _SIGNATURE], axis=1)
        rows = np.empty(batch.num_rows, kind)
        rows["node"] = batch.column("node").to_numpy()
        if "root" in kind.names:
            rows["root"], rows["signature"] = batch.column("root").to_numpy(), words
        if "size" in kind.names:
            sets = batch.column("set").to_pylist()
            rows["size"] = [len(s) // 4 for s in sets]
        for table in range(TABLES):
            word = table // 2
            rows["fp"] = words[:, word] >> np.uint64(32 * (table % 2)) & np.uint64(0xFFFFFFFF)
            if "further" in kind.names:
                rows["further"] = words[:, [(word + 1) % WORDS, (word + 2) % WORDS]]
            prefix = ((rows["fp"] >> np.uint32(BITS - prefix_bits))[:, None] ^ flips).ravel()
            order = np.argsort(prefix, kind="stable")
            prefix, packed = prefix[order], rows[order // len(flips)]
            cuts = np.flatnonzero(np.diff(prefix)) + 1
            firsts = prefix[np.concatenate([[0], cuts])] if len(prefix) else prefix
            parts = [p.tobytes() for p in np.split(packed, cuts)] if len(prefix) else []
            buckets = (table << prefix_bits) + firsts.astype(np.int64)
            packs = {"bucket": pa.array(buckets), "rows": pa.array(parts, pa.binary())}
            if "size" in kind.names:
                packs["sets"] = pa.array([b"".join(sets[k] for k in p) for p in np.split(order // len(flips), cuts)] if len(prefix) else [], pa.binary())
            yield pa.RecordBatch.from_pydict(packs)


def _unpacked(bucket: pd.DataFrame, kind: np.dtype) -> np.ndarray:
    """The nodes of a bucket in ascending order."""
    rows = np.frombuffer(b"".join(bucket["rows"]), kind)
    return rows[np.argsort(rows["node"], kind="stable")]


def _runs(prefix_bits: int, bucket: int, rows: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """The places of rows by variant, the number of each one's run, and each run's variant. Rows alone in their run are left out."""
    fp, low_bits = rows["fp"].astype(np.int64), BITS - prefix_bits
    prefix = bucket & (1 << prefix_bits) - 1
    low = fp & (1 << low_bits) - 1
    home = np.flatnonzero(fp >> low_bits == prefix)
    masks = np.array([1 << b for b in range(low_bits)], np.int64)
    variant = np.concatenate([low, (low[home, None] ^ masks).ravel()])
    place = np.concatenate([np.arange(len(fp)), np.repeat(home, low_bits)])
    order = np.lexsort((place, variant))
    variant, place = variant[order], place[order]
    known, run, size = np.unique(variant, return_inverse=True, return_counts=True)
    keep = size[run] > 1
    return place[keep], run[keep], known | prefix << low_bits


def _starred(prefix_bits: int, bucket: pd.DataFrame) -> pd.DataFrame:
    """Pairs (u, v) of each node with the least of those that it hangs together with, which need not be alike itself: nodes
    hang together if alike by the further bits, one being the least of a variant. And (v, v) for the least of
    those that nodes hang together with whose runs were alike in part, so that links may be missed."""
    rows = _unpacked(bucket, _FIRST)
    node, further = rows["node"], rows["further"]
    place, run, _ = _runs(prefix_bits, int(bucket["bucket"].iat[0]), rows)
    all_place, all_run, some, torn, found = place, run, [], [], []
    while len(run):
        first = np.flatnonzero(np.concatenate([[True], run[1:] != run[:-1]]))
        size = np.diff(np.concatenate([first, [len(run)]]))
        lead = np.repeat(place[first], size)
        leads = np.zeros(len(run), bool)
        leads[first] = True
        like = ~leads & (np.bitwise_count(further[place] ^ further[lead]).sum(axis=1) <= FURTHER)
        found.append(np.stack([place[like], lead[like]], axis=1))
        rest = ~leads & ~like
        some.append(run[like])
        torn.append(run[rest])
        place, run = place[rest], run[rest]
    if not found:
        return pd.DataFrame({"u": np.zeros(0, np.int64), "v": np.zeros(0, np.int64)})
    pairs = np.stack(_forest(*np.concatenate(found).T), axis=1)
    least = np.arange(len(node))
    least[pairs[:, 0]] = pairs[:, 1]
    again = np.unique(least[all_place[np.isin(all_run, np.intersect1d(np.concatenate(some), np.concatenate(torn)))]])
    return pd.DataFrame({"u": np.concatenate([node[pairs[:, 0]], node[again]]), "v": np.concatenate([node[pairs[:, 1]], node[again]])})


def _first_meeting(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """The variant at which two fingerprints, 2 bits apart at the most, are held to meet, of all that they share."""
    apart = a ^ b
    bit = apart & -apart
    return np.where(np.bitwise_count(apart) == 2, np.minimum(a ^ bit, b ^ bit), np.minimum(a, b))


def _meetings(prefix_bits: int, number: int, rows: np.ndarray, root: np.ndarray) -> Iterator[tuple[int, np.ndarray]]:
    """(u, places): rows before u that share a variant, are close by all bits and have another root: each pair in the first
    table in which it meets, and there at one variant alone. root may change between the steps."""
    signature, fp = rows["signature"], rows["fp"].astype(np.int64)
    table = number >> prefix_bits
    place, run, variants = _runs(prefix_bits, number, rows)
    ends = np.flatnonzero(np.diff(run)) + 1
    for members, at in zip(np.split(place, ends), run[np.concatenate([[0], ends])] if len(run) else [], strict=True) if len(run) else []:
        if (root[members] == root[members[0]]).all():
            continue
        for k in range(1, len(members)):
            u, before = members[k], members[:k]
            before = before[(root[before] != root[u]) & (_first_meeting(fp[before], fp[u]) == variants[at])]
            bits = np.bitwise_count((signature[before] ^ signature[u]).view(np.uint32))  # a column for each table
            near = before[(bits.sum(axis=1, dtype=np.int64) <= CLOSE) & (bits[:, :table] > RADIUS).all(axis=1)]
            if len(near):
                yield u, near


def _crossed(prefix_bits: int, bucket: pd.DataFrame) -> pd.DataFrame:
    """The pairs (u, v), v < u, of _meetings, but for those both of whose nodes have more than CROWD of them here; for such nodes (u, u)."""
    rows = _unpacked(bucket, _SECOND)
    node, count = rows["node"], np.zeros(len(rows), np.int64)
    crowd, pairs, found = np.zeros(len(rows), bool), np.zeros((0, 2), np.int64), []

    def sifted() -> np.ndarray:
        """Counts only grow, so that what is crowded now stays so."""
        all_pairs = np.concatenate([pairs, *found])
        both = (count[all_pairs] > CROWD).all(axis=1)
        crowd[all_pairs[both]] = True
        return all_pairs[~both]

    held = 0
    for u, near in _meetings(prefix_bits, int(bucket["bucket"].iat[0]), rows, rows["root"]):
        found.append(np.stack([np.full(len(near), u), near], axis=1))
        count[u] += len(near)
        count[near] += 1
        held += len(near)
        if held > BUCKET_VARIANTS:
            pairs, found, held = sifted(), [], 0
    pairs = sifted()
    return pd.DataFrame({"u": np.concatenate([node[pairs[:, 0]], node[crowd]]), "v": np.concatenate([node[pairs[:, 1]], node[crowd]])})


def _similar(a: np.ndarray, b: np.ndarray, least: float) -> bool:
    return min(len(a), len(b)) >= least * max(len(a), len(b)) and jaccard(a, b) >= least


def _spanned(prefix_bits: int, least: float, bucket: pd.DataFrame) -> pd.DataFrame:
    """Of the pairs (u, v) of _meetings those whose sets have a similarity of `least` or more, as far as they join different components here."""
    rows, sets = np.frombuffer(b"".join(bucket["rows"]), _THIRD), np.frombuffer(b"".join(bucket["sets"]), "<u4")
    order = np.argsort(rows["node"], kind="stable")
    ends = np.cumsum(rows["size"], dtype=np.int64)[order]
    rows = rows[order]
    node, root, starts = rows["node"], rows["root"].copy(), ends - rows["size"]
    found = []
    for u, near in _meetings(prefix_bits, int(bucket["bucket"].iat[0]), rows, root):
        for v in near:
            if root[v] != root[u] and _similar(sets[starts[u] : ends[u]], sets[starts[v] : ends[v]], least):
                found.append((node[u], node[v]))
                root[root == root[v]] = root[u]
    return pd.DataFrame(found, columns=["u", "v"], dtype="int64")


def _with_ends(pairs: DataFrame, table: DataFrame) -> DataFrame:
    """pairs (u, v, ...), a saved table, with the other columns of table (node, ...) for both ends: those of u as they are, those of v with a mark."""
    for end, mark in (("v", "_v"), ("u", "")):
        named = table.select(F.col("node").alias(end), *[F.col(c).alias(c + mark) for c in table.columns if c != "node"])
        counts = pairs.groupBy(end).agg(F.count("*").alias("ends"))
        joined = skew_join(pairs, saved(counts.join(named, end)), end, "ends")
        pairs = saved(joined) if end == "v" else joined
    return pairs


def _close(pairs: DataFrame, nodes: DataFrame) -> DataFrame:
    """(u, v, d) of the pairs whose signatures differ in d bits, CLOSE at the most."""
    both = _with_ends(pairs.select("u", "v"), nodes.select("node", *_SIGNATURE))
    apart = sum((F.bit_count(F.col(c).bitwiseXOR(F.col(f"{c}_v"))) for c in _SIGNATURE), F.lit(0))
    return saved(both.select("u", "v", apart.alias("d")).where(F.col("d") <= CLOSE))


def _apart(pairs: DataFrame, roots: DataFrame) -> DataFrame:
    """The pairs (u, v) whose ends have different roots; nodes that roots (node, root) doesn't name are their own."""
    ends = pairs.select(F.col("u").alias("node")).unionByName(pairs.select(F.col("v").alias("node"))).distinct()
    named = saved(ends.join(roots, "node", "left").select("node", F.coalesce("root", "node").alias("root")))
    return saved(_with_ends(pairs.select("u", "v"), named).where(F.col("root") != F.col("root_v")).select("u", "v"))


def _marked(rows: DataFrame, key: str, needed: DataFrame, needed_key: str, shown: str) -> DataFrame:
    """rows with a column that is true where the hash `key` is in needed[needed_key], and for one in TEXT_BITS of the others:
    a map of TEXT_BITS bits for each row of needed goes to all tasks. Nulls are shown."""
    maps = max(1, math.ceil(needed.count() * TEXT_BITS / BITMAP))
    number = lambda c: F.pmod(F.shiftrightunsigned(c, 15), F.lit(maps))
    bit = lambda c: F.col(c).bitwiseAND(BITMAP - 1).cast("int")
    at, bits = free_name("_map", rows), free_name("_bits", rows)
    bitmaps = needed.groupBy(number(needed_key).alias(at)).agg(F.bitmap_construct_agg(bit(needed_key).cast("long")).alias(bits))
    byte = F.conv(F.hex(F.substring(bits, F.shiftright(bit(key), 3) + 1, F.lit(1))), 16, 10).cast("int")
    is_in = F.coalesce(F.getbit(byte, bit(key).bitwiseAND(7)) == 1, F.col(key).isNull())
    return rows.withColumn(at, number(key)).join(F.broadcast(bitmaps), at, "left").withColumn(shown, is_in).drop(at, bits)


def _among(docs: DataFrame, needed: DataFrame) -> DataFrame:
    """(text, of) of the rows of docs whose hashes are in needed, and of a few others, so that all other texts stay where they are."""
    return _marked(docs, _TEXT[0], needed, _TEXT[0], "shown").where("shown").select("text", F.struct(*_TEXT).alias("of"))


def _sets(ends: DataFrame, docs: DataFrame, nodes: DataFrame, width: int) -> DataFrame:
    """(node, set) for the nodes of ends: the sorted hashes of its shingles, 32 bits of each.

    One text of each node is read again, by its hash. Of two texts of two thousand words one pair in a thousand seems to
    share a shingle that it doesn't.
    """
    needed = saved(ends.distinct().join(nodes.select("node", *_TEXT, "n"), "node"))
    texts = skew_join(saved(_among(docs, needed)), needed.select("node", F.struct(*_TEXT).alias("of"), "n"), "of", "n")
    texts = texts.groupBy("node").agg(F.first("text").alias("text"))

    def gathered(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches, "text"):
            sets = [np.unique(shingle_set(t, width).astype(np.uint32)).tobytes() for t in _texts(batch.column("text"))]
            yield pa.RecordBatch.from_arrays([batch.column("node"), pa.array(sets, pa.binary())], names=["node", "set"])

    return saved(in_arrow(texts, gathered, "node long, set binary"))


def _verified(pairs: DataFrame, docs: DataFrame, nodes: DataFrame, width: int, least: float) -> DataFrame:
    """The pairs (u, v), a saved table, whose shingle sets have a similarity of `least` or more."""
    ends = pairs.select(F.col("u").alias("node")).unionByName(pairs.select(F.col("v").alias("node")))

    def compared(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches, "set"):
            both = zip(batch.column("set"), batch.column("set_v"), strict=True)
            good = [_similar(np.frombuffer(a.as_buffer(), np.uint32), np.frombuffer(b.as_buffer(), np.uint32), least) for a, b in both]
            yield batch.select(["u", "v"]).filter(pa.array(good, pa.bool_()))

    both = _with_ends(pairs.select("u", "v"), _sets(ends, docs, nodes, width))
    return saved(in_arrow(both, compared, "u long, v long"))


def _roots(docs: DataFrame, nodes: DataFrame, width: int, least: float) -> DataFrame:
    """(node, root) of the nodes that are linked to any other."""
    def dealt(of: DataFrame, least_bits: int, kind: np.dtype) -> tuple[int, GroupedData]:
        share = of.count() * (BITS + 1) / BUCKET_VARIANTS
        if "set" in of.columns:
            share = max(share, (of.agg(F.sum(F.octet_length("set"))).first()[0] or 0) / BUCKET_BYTES)
        bits = min(24, max(least_bits, math.ceil(math.log2(1 + share))))
        return bits, in_arrow(of, functools.partial(_dealt, bits, kind), "bucket long, rows binary" + ", sets binary" * ("set" in of.columns)).groupBy("bucket")

    bits, buckets = dealt(nodes.select("node", *_SIGNATURE), 3, _FIRST)
    starred = saved(buckets.applyInPandas(functools.partial(_starred, bits), "u long, v long").distinct())
    pairs = saved(starred.where("u <> v"))
    tried = _close(pairs, nodes)
    first = saved(tried.groupBy("u").agg(F.min_by("v", F.struct("d", "v")).alias("v")))
    links = _verified(first, docs, nodes, width, least)
    roots = saved(components(links))
    apart = _apart(pairs, roots)
    rest = saved(tried.join(apart, ["u", "v"], "left_semi").select("u", "v"))
    if not rest.isEmpty():
        links = saved(links.unionByName(_verified(rest, docs, nodes, width, least)))
        roots = saved(components(links))
        apart = _apart(apart, roots)
    # what hangs together in a bucket is settled if it is of one component; else any two of it may be a link, as in runs that hang together in part
    unsettled = saved(apart.select("v").unionByName(starred.where("u = v").select("v")).distinct())
    again = unsettled.select(F.col("v").alias("node")).unionByName(pairs.join(unsettled, "v", "left_semi").select(F.col("u").alias("node")))
    open_ = saved(nodes.join(again.distinct(), "node").join(roots, "node", "left").select("node", F.coalesce("root", "node").alias("root"), *_SIGNATURE))
    if not open_.isEmpty():
        bits, buckets = dealt(open_, 1, _SECOND)
        met = saved(buckets.applyInPandas(functools.partial(_crossed, bits), "u long, v long"))
        crossed = saved(met.where("u <> v").join(tried, ["u", "v"], "left_anti"))
        if not crossed.isEmpty():
            links = saved(links.unionByName(_verified(crossed, docs, nodes, width, least)))
        crowd = saved(open_.join(met.where("u = v").select(F.col("u").alias("node")).distinct(), "node"))
        if not crowd.isEmpty():
            bits, buckets = dealt(saved(crowd.join(_sets(crowd.select("node"), docs, nodes, width), "node")), 1, _THIRD)
            links = saved(links.unionByName(buckets.applyInPandas(functools.partial(_spanned, bits, least), "u long, v long")))
        roots = saved(components(links))
    return roots


def similar_documents(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", width: int = 5, least: float = 0.8) -> DataFrame:
    """(doc, component) for each row: component is the smallest id reachable over pairs of similarity `least` or more, as far as a table found them.

    A-Z is lower-cased, words stand between ASCII white space. Texts with equal sets are one node, whatever their
    number, and so are all texts without words, null among them. A null id is a component's name only where it has no other id.
    """
    rows = docs.select(F.col(id_col).cast("long").alias("doc"), F.col(text_col).alias("text"), F.xxhash64(text_col).alias(_TEXT[0]), F.xxhash64(F.reverse(text_col)).alias(_TEXT[1]))
    kinds = ", ".join(f"{c} long" for c in (*_TEXT, "node", *_SIGNATURE))
    with temporary() as area:
        prints = saved(in_arrow(rows, functools.partial(_signed, width), f"doc long, {kinds}"))
        nodes = saved(prints.groupBy("node").agg(F.min("doc").alias("first"), F.count("*").alias("n"), F.min(F.struct(*_TEXT)).alias("of"), *[F.min(c).alias(c) for c in _SIGNATURE]).select("*", "of.*").drop("of"))
        roots = _roots(rows, nodes, width, least)
        named = saved(nodes.select("node", "first", "n").join(roots, "node", "left").withColumn("root", F.coalesce("root", "node")))
        smallest = saved(named.groupBy("root").agg(F.min("first").alias("component"), F.count("*").alias("nodes")))
        table = saved(skew_join(named.select("node", "n", "root"), smallest, "root", "nodes").select("node", "n", "component"))
        found = saved(skew_join(prints.select("doc", "node"), table, "node", "n").select("doc", "component"))
        area.keep(found)
    return found


def without_similar(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", width: int = 5, least: float = 0.8) -> DataFrame:
    """docs with one document left of each component, that with the smallest id; rows that repeat an id are one document. Rows with a null id stay."""
    found = similar_documents(docs.where(F.col(id_col).isNotNull()), id_col, text_col, width, least)
    # few go; what a map of their ids doesn't show stays where it is
    gone = saved(found.groupBy("doc").agg(F.max(F.col("doc") == F.col("component")).alias("stays")).where("NOT stays").select("doc"))
    key, shown = free_name("_key", docs), free_name("_shown", docs)
    rows = _marked(docs.withColumn(key, F.xxhash64(F.col(id_col).cast("long"))), key, gone.select(F.xxhash64("doc").alias("key")), "key", shown)
    seen = rows.where(F.col(shown)).join(gone, rows[id_col].cast("long") == gone["doc"], "left_anti")
    return rows.where(~F.col(shown)).select(*docs.columns).unionByName(seen.select(*docs.columns))
