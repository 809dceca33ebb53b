"""Connected components of an edge table, by alternating large-star and small-star rounds."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tempora.llm._common import saved, temporary


def _state(edges: DataFrame) -> tuple:
    return tuple(edges.agg(F.count("*"), F.sum(F.xxhash64("u", "v").cast("decimal(20,0)"))).first())


def _least(arcs: DataFrame) -> DataFrame:
    """(u, m): the least of u and of all that u is linked to. A table of its own, so that the stage that joins it holds no
    aggregate: adaptive execution then splits a hub's arcs over several tasks."""
    return saved(arcs.groupBy("u").agg(F.least(F.col("u"), F.min("v")).alias("m")))


def _shortened(edges: DataFrame) -> DataFrame:
    """The edges after one large-star and one small-star step."""
    arcs = edges.select("u", "v").unionByName(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
    large = saved(arcs.join(_least(arcs), "u").where("v > u").select(F.col("v").alias("u"), F.col("m").alias("v")).where("u <> v").distinct())
    small = large.join(_least(large), "u")
    pairs = small.select(F.col("v").alias("u"), F.col("m").alias("v")).unionByName(small.select("u", F.col("m").alias("v")))
    return saved(pairs.where("u <> v").distinct())


def components(edges: DataFrame) -> DataFrame:
    """(node, root) for every node of edges (u, v): root is the least node that can be reached.

    Large-star hangs the larger neighbours of each node below its least neighbour, small-star the smaller ones; the
    rounds, in number about the logarithm of the longest path, end when the edges stay the same. Each round is a
    written table. Repeats and either direction are allowed; links of a node to itself or to null say nothing; no edges, no rows.
    """
    ends = edges.where(F.col("u").isNotNull() & F.col("v").isNotNull() & (F.col("u") != F.col("v")))
    edges = saved(ends.select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")).distinct())
    before = None
    while (now := _state(edges)) != before and now[0]:
        before, last = now, edges
        with temporary() as area:
            edges = area.keep(_shortened(last))
            area.append(last)
    roots = edges.select(F.col("v").alias("node"), F.col("v").alias("root")).distinct()
    return edges.select(F.col("u").alias("node"), F.col("v").alias("root")).unionByName(roots)
