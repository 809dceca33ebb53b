"""The trie of all prefixes of conversations, from chained digests.

A turn's digest is the SHA-256 of its role and text; a prefix's digest chains those of its turns. So equal prefixes meet
in one group by (depth, digest), however long they are, and texts are never shuffled. Chains are cut into blocks of
turns, chained each by itself and then to one another, so that one endless conversation is work for many tasks.

Sums over subtrees explode nodes to their ancestors. Nodes of one member are left out (their subtree is a path, so they
are a leaf to the last node with more members), and nodes with the same members, one below the other, are exploded once.
A chain of such nodes ends where a member leaves it or ends, so all chains together have no more ancestors than the
conversations have turns.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tempora.llm._common import in_arrow, saved, temporary

#: Turns that are chained, or summed, in one go.
BLOCK = 1024
#: Ids from one multiple of this to the next are joined to one text before they are hashed.
_IDS = 12


def _sha(*parts: Column) -> Column:
    return F.unhex(F.sha2(F.concat(*parts), 256))


# ---- turns in order


def _positions(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Adds the number of rows of the same conversation that stand before each row in this partition, and the partition."""
    part, last, seen = TaskContext.get().partitionId(), None, 0
    for batch in batches:
        if not batch.num_rows:
            continue
        conv = batch.column("conv").to_numpy()
        starts = np.flatnonzero(np.concatenate([[True], conv[1:] != conv[:-1]]))
        sizes = np.diff(np.append(starts, len(conv)))
        at = np.arange(len(conv)) - np.repeat(starts, sizes)
        if conv[0] == last:
            at[: sizes[0]] += seen
        last, seen = conv[-1], int(at[-1]) + 1
        columns = [pa.array(np.full(len(conv), part, np.int32)), batch.column("conv"), pa.array(at), batch.column("t"), batch.column("n_bytes")]
        yield pa.RecordBatch.from_arrays(columns, names=["part", "conv", "at", "t", "n_bytes"])


def _numbered(turns: DataFrame) -> DataFrame:
    """(conv, k, t, n_bytes): turns with their number in the conversation, from 1. Ranges of the sorted turns are dealt to
    tasks, whatever conversation they belong to; what a range's first conversation has before it is added afterwards."""
    spark, order = turns.sparkSession, ["conv", "turn", "t", "row"]
    n = int(spark.conf.get("spark.sql.shuffle.partitions"))
    placed = saved(in_arrow(turns.repartitionByRange(n, *order).sortWithinPartitions(*order), _positions, "part int, conv long, at long, t binary, n_bytes long"))
    bounds = placed.groupBy("part").agg(F.min("conv").alias("first"), F.max(F.struct("conv", "at")).alias("last"))
    carried, open_conv, open_n = [], None, 0
    for r in sorted(bounds.collect(), key=lambda r: r.part):  # a row for each range
        before = open_n if r.first == open_conv else 0
        if before:
            carried.append((r.part, r.first, before))
        open_n = r.last.at + 1 + (before if r.last.conv == r.first else 0)
        open_conv = r.last.conv
    before = spark.createDataFrame(carried, "part int, conv long, before long")
    return placed.join(F.broadcast(before), ["part", "conv"], "left").select("conv", (F.col("at") + F.coalesce("before", F.lit(0)) + 1).alias("k"), "t", "n_bytes")


# ---- digests


def _chain(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Adds to each row the chained digest of its block up to it, and that up to the row before (empty for a block's first)."""
    open_key, state = None, b""
    for batch in batches:
        ups, digests = [], []
        for *key, t in zip(*(batch.column(c).to_pylist() for c in ("conv", "b", "t")), strict=True):
            if key != open_key:
                open_key, state = key, b""
            ups.append(state)
            state = hashlib.sha256(state + t).digest()
            digests.append(state)
        yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(ups, pa.binary()), pa.array(digests, pa.binary())], names=[*batch.schema.names, "up", "digest"])


def chained_digests(rows: DataFrame, block: int = BLOCK) -> DataFrame:
    """rows (conv, depth from 1, t, ...) with `digest` of all t of the conversation up to the row, and `up`, that of the row
    before (empty where there is none). Equal sequences of t, and no others, have equal digests."""
    dealt = rows.withColumn("b", F.floor((F.col("depth") - 1) / block)).repartition("conv", "b").sortWithinPartitions("conv", "b", "depth")
    digests = [T.StructField(c, T.BinaryType()) for c in ("up", "digest")]
    links = saved(in_arrow(dealt, _chain, T.StructType([*dealt.schema, *digests])))
    ends = links.where(F.col("depth") % block == 0)
    if ends.isEmpty():
        return links.drop("b")
    whole = chained_digests(ends.select("conv", (F.col("b") + 1).alias("depth"), F.col("digest").alias("t")), block)
    before = F.when(F.length("up") == 0, F.col("t")).otherwise(_sha(F.col("up"), F.col("t")))
    whole = whole.select("conv", F.col("depth").alias("b"), F.col("digest").alias("head"), before.alias("before"))
    head = F.col("head")
    digest = F.when(head.isNull(), F.col("digest")).otherwise(_sha(head, F.col("digest")))
    up = F.when(head.isNull(), F.col("up")).when(F.length("up") == 0, F.col("before")).otherwise(_sha(head, F.col("up")))
    return saved(links.join(whole, ["conv", "b"], "left").select(*rows.columns, up.alias("up"), digest.alias("digest")))


# ---- conversations, rebuilt


def _rebuilt(turns: DataFrame, group: int, heads: int) -> tuple[DataFrame, DataFrame]:
    """Turns (conv, depth, t, n_bytes, is_last) and conversations (conv, length) after the first h turns of each were taken
    from the first conversation of its group of ids."""
    h, base = F.crc32(F.col("conv").cast("string").cast("binary")) % heads, F.col("conv") - F.pmod("conv", F.lit(group))
    first = turns.where((F.pmod("conv", F.lit(group)) == 0) & (F.col("k") < heads))  # fewer than `heads` rows of a conversation
    first = first.groupBy(F.col("conv").alias("base")).agg(F.array_sort(F.collect_list(F.struct("k", "t", "n_bytes"))).alias("lent"))
    convs = turns.groupBy("conv").agg(F.max("k").alias("n")).withColumns({"h": h.cast("long"), "base": base})
    lent = F.coalesce(F.slice("lent", F.lit(1), F.col("h").cast("int")), F.array())
    convs = convs.join(first, "base", "left").select("conv", "n", "h", lent.alias("lent"), F.size(lent).cast("long").alias("n_lent"))
    convs = saved(convs.withColumn("length", F.col("n_lent") + F.greatest(F.col("n") - F.col("h"), F.lit(0))))
    borrowed = convs.select("conv", "length", F.explode("lent").alias("x")).select("conv", F.col("x.k").alias("depth"), "x.t", "x.n_bytes", "length")
    own = turns.join(convs.select("conv", "h", "n_lent", "length"), "conv").where("k > h").select("conv", (F.col("k") - F.col("h") + F.col("n_lent")).alias("depth"), "t", "n_bytes", "length")
    rows = borrowed.unionByName(own).select("conv", "depth", "t", "n_bytes", (F.col("depth") == F.col("length")).alias("is_last"))
    return rows, convs.select("conv", "length")


# ---- the trie


def _ids_hash(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The SHA-256 of the texts of each (depth, digest), in the order they come in, joined by commas. Holds one text at a time."""
    open_key, state = None, None
    for batch in batches:
        done = []
        for depth, digest, ids in zip(*(batch.column(c).to_pylist() for c in ("depth", "digest", "ids")), strict=True):
            if (depth, digest) == open_key:
                state.update(b"," + ids.encode())
            else:
                if open_key:
                    done.append((*open_key, state.hexdigest()))
                open_key, state = (depth, digest), hashlib.sha256(ids.encode())
        if done:
            yield _hashes(done)
    if open_key:
        yield _hashes([(*open_key, state.hexdigest())])


def _hashes(done: list[tuple]) -> pa.RecordBatch:
    depth, digest, sha = zip(*done, strict=True)
    return pa.RecordBatch.from_arrays([pa.array(depth, pa.int64()), pa.array(digest, pa.binary()), pa.array(sha)], names=["depth", "digest", "ends_sha256"])


def _from_below(shared: DataFrame, rows: DataFrame, block: int) -> DataFrame:
    """(depth, digest, leaves, saved): what the subtree of each node with several members holds."""
    chain = ["conv_id", "n_convs"]  # the members of two nodes on one path are the same if they are as many
    summed = [F.sum("leaves").alias("leaves"), F.sum("saved").alias("saved")]
    chains = shared.groupBy(*chain).agg(F.min("depth").alias("top"), *summed)
    # all ancestors above a chain's top stand on the path of its smallest member
    above = chains.where("top > 0").withColumn("depth", F.explode(F.sequence(F.lit(0).cast("long"), F.col("top") - 1))).groupBy("conv_id", "depth").agg(*summed)
    path = rows.select(F.col("conv").alias("conv_id"), "depth", "digest")
    above = above.join(path, ["conv_id", "depth"], "left").select("depth", F.coalesce("digest", F.lit(b"")).alias("digest"), "leaves", "saved")
    # within a chain, sums from its bottom up, by blocks
    cut = shared.withColumn("b", F.floor(F.col("depth") / block))
    later = Window.partitionBy(*chain).orderBy(F.desc("b")).rowsBetween(Window.unboundedPreceding, -1)
    blocks = cut.groupBy(*chain, "b").agg(*summed).select(*chain, "b", F.sum("leaves").over(later).alias("more_leaves"), F.sum("saved").over(later).alias("more_saved")).where("more_leaves is not null")
    down = Window.partitionBy(*chain, "b").orderBy(F.desc("depth")).rowsBetween(Window.unboundedPreceding, 0)
    within = cut.withColumns({c: F.sum(c).over(down) for c in ("leaves", "saved")}).join(blocks, [*chain, "b"], "left")
    within = within.select("depth", "digest", *[(F.col(c) + F.coalesce(f"more_{c}", F.lit(0))).alias(c) for c in ("leaves", "saved")])
    return within.unionByName(above).groupBy("depth", "digest").agg(*summed)


def prefix_trie(
    conversations: DataFrame, id_col: str = "conv_id", turn_col: str = "turn", role_col: str = "role", text_col: str = "text", group: int = 5, heads: int = 9, block: int = BLOCK,
) -> DataFrame:
    """One row for each distinct prefix of the rebuilt conversations, the empty one included.

    A conversation c takes its first h = crc32(c) % heads turns from conversation c - c mod group (fewer if that has fewer,
    none if there is none) and goes on with its own turns after its first h. conv_id is the smallest member, parent_conv_id
    that of the node above (null for the root), n_convs counts members, n_children nodes below, n_leaves nodes without
    children in the subtree; saved_tokens sums, over the subtree, the bytes of a node's last text for all members but one;
    ends_sha256 is the hash of the ids, joined by commas in ascending order, of members that end at the node.

    Null roles and texts are empty. Turns are in ascending order, null first; equal turns, repeated rows too, stay all, in
    order of the digest of role and text. The remainder of a negative id is not negative. Rows without id belong to no
    conversation; an empty table, or one of such rows, gives no rows. Other columns are ignored.
    """
    spark = conversations.sparkSession
    role, text = (F.coalesce(F.col(c).cast("string"), F.lit("")) for c in (role_col, text_col))
    turns = conversations.where(F.col(id_col).isNotNull()).select(
        F.col(id_col).cast("long").alias("conv"), F.col(turn_col).alias("turn"), _sha(F.octet_length(role).cast("string"), F.lit(":"), role, text).alias("t"),
        F.octet_length(text).cast("long").alias("n_bytes"), F.monotonically_increasing_id().alias("row"),
    )
    with temporary() as area:
        numbered = saved(_numbered(saved(turns)))
        made, convs = _rebuilt(numbered, group, heads)
        rows = chained_digests(made, block)
        nodes = rows.groupBy("depth", "digest").agg(F.min("conv").alias("conv_id"), F.count("*").alias("n_convs"), F.min("n_bytes").alias("n_bytes"), F.min("up").alias("up"))
        root = convs.agg(F.min("conv"), F.count("*")).first()
        top = [(0, b"", root[0], root[1], 0, None)] if root[1] else []
        nodes = saved(nodes.unionByName(spark.createDataFrame(top, "depth long, digest binary, conv_id long, n_convs long, n_bytes long, up binary")))
        below = nodes.where("depth > 0").groupBy((F.col("depth") - 1).alias("depth"), F.col("up").alias("digest")).agg(F.count("*").alias("n_children"), F.count_if(F.col("n_convs") == 1).alias("lone"))
        above = nodes.where("depth > 0").select((F.col("depth") + 1).alias("depth"), F.col("digest").alias("up"), F.col("conv_id").alias("parent"))
        parent = F.when(F.col("depth") == 1, F.lit(root[0])).otherwise(F.col("parent"))
        tree = nodes.join(below, ["depth", "digest"], "left").join(above, ["depth", "up"], "left").select(
            "depth", "digest", "conv_id", parent.alias("parent_conv_id"), "n_convs", F.coalesce("n_children", F.lit(0)).alias("n_children"),
            F.when(F.col("n_children").isNull(), 1).otherwise(F.col("lone")).cast("long").alias("leaves"), ((F.col("n_convs") - 1) * F.col("n_bytes")).alias("saved"),
        )
        tree = saved(tree)
        sums = _from_below(tree.where("n_convs > 1"), rows, block)
        ends = rows.where("is_last").select("depth", "digest", "conv").unionByName(convs.where("length = 0").select(F.lit(0).cast("long").alias("depth"), F.lit(b"").alias("digest"), "conv"))
        ids = ends.groupBy("depth", "digest", F.shiftright("conv", _IDS).alias("b")).agg(F.array_join(F.transform(F.array_sort(F.collect_list("conv")), lambda c: c.cast("string")), ",").alias("ids"))
        ids = in_arrow(ids.repartition("depth", "digest").sortWithinPartitions("depth", "digest", "b"), _ids_hash, "depth long, digest binary, ends_sha256 string")
        found = tree.drop("leaves", "saved").join(sums, ["depth", "digest"], "left").join(ids, ["depth", "digest"], "left").select(
            "conv_id", "depth", "parent_conv_id", "n_convs", "n_children", F.coalesce("leaves", F.lit(1)).cast("long").alias("n_leaves"),
            F.coalesce("saved", F.lit(0)).cast("long").alias("saved_tokens"), F.coalesce("ends_sha256", F.lit(hashlib.sha256().hexdigest())).alias("ends_sha256"),
        )
        return area.keep(saved(found))
