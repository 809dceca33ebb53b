"""Sequential algorithms that windows can't express: peak merging, overlap removal, ordered matching, sampling.

Each works on one key's short list, the cycles and segments of one recording, as an ordered array: peaks and overlaps
are folded by expressions; the matchers get a batch of keys' arrays at a time. A key's list is as long as one
recording, not as the table.
"""

from __future__ import annotations

import functools
from collections.abc import Callable, Iterator, Sequence

import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tempora.functions.scalars import overlap_ratio


def _schema(df: DataFrame, more: str = "") -> str:
    return ", ".join([*(f"`{f.name}` {f.dataType.simpleString()}" for f in df.schema.fields), *([more] if more else [])])


def _lists(rows: DataFrame, keys: Sequence[str], order: Sequence[str], name: str = "_list") -> DataFrame:
    """(keys, name): the rows of each key as an array of structs, sorted by the columns of `order`, then by all others."""
    rest = [c for c in rows.columns if c not in keys and c not in order]
    return rows.groupBy(*keys).agg(F.array_sort(F.collect_list(F.struct(*order, *rest))).alias(name))


def _unlisted(lists: DataFrame, keys: Sequence[str], columns: Sequence[str], kept: Column, number: str | None = None) -> DataFrame:
    """The structs of an array as rows again; `number` counts them from one."""
    out = lists.select(*keys, F.posexplode(kept).alias("_n", "_row"))
    picks = [F.col(c) if c in keys else F.col(f"_row.{c}").alias(c) for c in columns]
    return out.select(*picks, *([(F.col("_n") + 1).cast("long").alias(number)] if number else []))


def merged(peaks: Column, time: str, strength: str, gap: float, inclusive: bool = False) -> Column:
    """Of an array of structs in order of time: one within `gap` of the last kept one (or just at it, if inclusive) replaces
    it if stronger, else goes. Each step copies what is kept, so the work grows with the square of one recording's peaks."""

    def take(kept: Column, peak: Column) -> Column:
        last, before = F.get(kept, F.size(kept) - 1), F.slice(kept, 1, F.greatest(F.lit(0), F.size(kept) - 1))
        away = F.round(peak[time] - last[time], 9)
        near = F.when(peak[strength] > last[strength], F.concat(before, F.array(peak))).otherwise(kept)
        return F.when(F.size(kept) == 0, F.array(peak)).when(away <= gap if inclusive else away < gap, near).otherwise(F.concat(kept, F.array(peak)))

    return F.aggregate(peaks, F.filter(peaks, lambda _: F.lit(False)), take)


def merge_peaks(peaks: DataFrame, keys: Sequence[str], time: str, strength: str, gap: float, inclusive: bool = False) -> DataFrame:
    """Peaks in time order; one within `gap` of the last kept one replaces it if stronger, else goes."""
    lists = _lists(peaks, keys, [time, strength])
    return _unlisted(lists, keys, peaks.columns, merged(F.col("_list"), time, strength, gap, inclusive))


def drop_overlaps(cycles: DataFrame, keys: Sequence[str], strength: str, most: float) -> DataFrame:
    """Of cycles that share `most` or more of the shorter one, the stronger stays; numbered anew in time order.

    In time order, each cycle meets the first kept one that it overlaps so, and takes its place if it is stronger.
    """
    lists = _lists(cycles, keys, ["start", "end"])

    def take(kept: Column, cycle: Column) -> Column:
        shared = lambda old: overlap_ratio(old["start"], old["end"], cycle["start"], cycle["end"], of_shorter=True) >= most
        met = F.array_position(F.transform(kept, shared), F.lit(True))
        placed = F.transform(kept, lambda old, k: F.when((k + 1 == met) & (cycle[strength] > old[strength]), cycle).otherwise(old))
        return F.when(met == 0, F.concat(kept, F.array(cycle))).otherwise(placed)

    empty = F.filter("_list", lambda _: F.lit(False))
    return _unlisted(lists, keys, cycles.columns, F.array_sort(F.aggregate("_list", empty, take)), "number")


def _distance(segment: dict, anchor: float) -> float:
    """From the segment's middle to the anchor, and three times what the anchor lies outside."""
    outside = max(0.0, segment["start"] - anchor, anchor - segment["end"])
    return abs(anchor - (segment["start"] + segment["end"]) / 2) + 3 * outside


def _share(segment: dict, cycle: dict) -> float:
    """How much of the cycle lies in the segment."""
    return max(0.0, min(segment["end"], cycle["end"]) - max(segment["start"], cycle["start"])) / max(0.01, cycle["end"] - cycle["start"])


def assignment_cost(segment: dict, cycle: dict) -> float:
    """What a segment pays for a cycle: the anchor's distance, and its own length for as much of the cycle as it misses."""
    return _distance(segment, cycle["anchor"]) + (1 - _share(segment, cycle)) * max(0.01, segment["end"] - segment["start"])


def ordered_pairs(segments: list[dict], cycles: list[dict]) -> list[tuple[int, int]]:
    """Places of the pairs that keep both orders: as many as can be, then least cost in all. Where that ties, a pair is
    made rather than put off, and a segment is passed over rather than a cycle."""
    n, m = len(segments), len(cycles)
    # matches and cost of the best that segments from i and cycles from j on can do
    best = [[(0, 0.0)] * (m + 1) for _ in range(n + 1)]
    how = [[""] * m for _ in range(n)]
    for i in range(n - 1, -1, -1):
        for j in range(m - 1, -1, -1):
            matches, cost = best[i + 1][j + 1]
            options = [("pair", (matches + 1, cost + assignment_cost(segments[i], cycles[j]))), ("segment", best[i + 1][j]), ("cycle", best[i][j + 1])]
            how[i][j], best[i][j] = min(options, key=lambda o: (-o[1][0], o[1][1]))
    i = j = 0
    pairs = []
    while i < n and j < m:
        if how[i][j] == "pair":
            pairs.append((i, j))
        i, j = i + (how[i][j] != "cycle"), j + (how[i][j] != "segment")
    return pairs


def sequential_pairs(segments: list[dict], cycles: list[dict], share: float = 0.55, tolerance: float = 0.4) -> list[tuple[int, int]]:
    """Places of pairs: each segment takes the first cycle after the last taken one of which it holds `share` or whose anchor
    is within `tolerance` of it, else of all those after the one whose anchor is nearest."""
    pairs, cursor = [], 0
    for i, s in enumerate(segments):
        fits = (j for j in range(cursor, len(cycles)) if _share(s, cycles[j]) >= share or s["start"] - tolerance <= cycles[j]["anchor"] <= s["end"] + tolerance)
        j = next(fits, None)
        if j is None:
            j = min(range(cursor, len(cycles)), key=lambda j: _distance(s, cycles[j]["anchor"]), default=None)
        if j is not None:
            pairs.append((i, j))
            cursor = j + 1
    return pairs


def _matched(segments: DataFrame, cycles: DataFrame, keys: Sequence[str], match: Callable[[list[dict], list[dict]], list[tuple[int, int]]]) -> DataFrame:
    anchored = cycles.select(*keys, "id", "start", "end", F.coalesce("anchor", (F.col("start") + F.col("end")) / 2).alias("anchor")).where("anchor IS NOT NULL")
    left = _lists(segments.select(*keys, "id", "start", "end"), keys, ["start", "end", "id"], "_segments")
    both = left.join(_lists(anchored, keys, ["anchor", "id"], "_cycles"), list(keys))
    pairs_kind = pa.list_(pa.struct([("segment_id", pa.int64()), ("cycle_id", pa.int64()), ("cost", pa.float64())]))

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            made = []
            for s, c in zip(batch.column("_segments").to_pylist(), batch.column("_cycles").to_pylist(), strict=True):
                made.append([{"segment_id": s[i]["id"], "cycle_id": c[j]["id"], "cost": assignment_cost(s[i], c[j])} for i, j in match(s, c)])
            yield pa.RecordBatch.from_arrays([*(batch.column(k) for k in keys), pa.array(made, pairs_kind)], names=[*keys, "_pairs"])

    kinds = ", ".join(f"`{k}` {segments.schema[k].dataType.simpleString()}" for k in keys)
    found = both.mapInArrow(work, f"{kinds}, _pairs array<struct<segment_id:bigint,cycle_id:bigint,cost:double>>")
    return found.select(*keys, F.explode("_pairs").alias("_")).select(*keys, "_.*")


def match_in_order(segments: DataFrame, cycles: DataFrame, keys: Sequence[str]) -> DataFrame:
    """(keys, segment_id, cycle_id, cost): one-to-one pairs of segments (id, start, end) and cycles (id, start, end,
    anchor) that keep both orders, as many as can be, then at the least cost in all.

    Cycles are ordered by their anchor, their middle where that is null; those with neither take no part.
    """
    return _matched(segments, cycles, keys, ordered_pairs)


def match_greedily(segments: DataFrame, cycles: DataFrame, keys: Sequence[str], share: float = 0.55, tolerance: float = 0.4) -> DataFrame:
    """(keys, segment_id, cycle_id, cost): each segment in turn takes a cycle after those taken before; tables as in match_in_order()."""
    return _matched(segments, cycles, keys, functools.partial(sequential_pairs, share=share, tolerance=tolerance))


def balanced_picks(rows: list[dict], size: int) -> list[dict]:
    """Up to `size` of the rows (score, source, tie), one after another: of a score not picked yet, of a source not picked yet,
    of the source picked least, of the score picked least, of the first tie."""
    left, picked, scores, sources = list(rows), [], {}, {}
    while left and len(picked) < size:
        of = lambda r: (scores.get(r["score"], 0), sources.get(r["source"], 0))
        best = min(left, key=lambda r: (of(r)[0] > 0, of(r)[1] > 0, of(r)[1], of(r)[0], r["tie"]))
        left.remove(best)
        picked.append(best)
        scores[best["score"]], sources[best["source"]] = scores.get(best["score"], 0) + 1, sources.get(best["source"], 0) + 1
    return picked


def balanced_sample(rows: DataFrame, stratum: str, score: str, source: str, key: str, size: int, seed: object) -> DataFrame:
    """(stratum, key, score, source, pick): `size` rows of each stratum, picked one by one so that scores and sources are balanced.

    Ties go by a hash of seed, stratum and key; rows without a score are a score of their own. What can be picked is
    bounded before it is gathered, exactly: of a score and source the first `size` rows, of a score the first `size`
    sources. A stratum with fewer rows gives all it has.
    """
    tie = F.sha2(F.concat_ws(":", F.lit(str(seed)), F.col(stratum).cast("string"), F.col(key).cast("string")), 256)
    named = rows.select(F.col(stratum), F.col(key), F.coalesce(F.col(score).cast("string"), F.lit("unlabeled")).alias("score"), F.col(source).cast("string").alias("source"), tie.alias("tie"))
    cell = Window.partitionBy(stratum, "score", "source").orderBy("tie", key)
    some = named.withColumn("_n", F.row_number().over(cell)).where(F.col("_n") <= size).withColumn("_first", F.min("tie").over(Window.partitionBy(stratum, "score", "source")))
    some = some.withColumn("_s", F.dense_rank().over(Window.partitionBy(stratum, "score").orderBy("_first", "source"))).where(F.col("_s") <= size).drop("_n", "_s", "_first")
    kinds = f"{_schema(some.drop('tie'))}, pick int"

    def pick(part: pd.DataFrame) -> pd.DataFrame:
        picked = balanced_picks(part.sort_values("tie").to_dict("records"), size)
        return pd.DataFrame([{**r, "pick": n} for n, r in enumerate(picked, 1)], columns=[*part.columns, "pick"]).drop(columns="tie")

    return some.groupBy(stratum).applyInPandas(pick, kinds)
