"""Cycles brought to the number of segments that a recording has: halves paired, whole ones chosen, short ones merged, weak ones left out."""

from __future__ import annotations

from collections.abc import Iterator, Sequence
from dataclasses import dataclass

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

_FIELDS = (("start", pa.float64()), ("end", pa.float64()), ("anchor", pa.float64()), ("strength", pa.float64()), ("visibility", pa.float64()), ("side", pa.string()))


@dataclass(frozen=True)
class Limits:
    """Seconds: what a whole repetition lasts at the least, what is shorter than any, what the way back takes, and how near halves are."""

    whole: float = 3.0
    noise: float = 1.6
    recovery: float = 1.2
    near: float = 2.5


def _length(cycle: dict) -> float:
    return max(0.0, cycle["end"] - cycle["start"])


def _power(cycle: dict) -> float:
    return (cycle["strength"] or 0.0) + 0.05 * (cycle["visibility"] or 0.0)


def _joined(parts: list[dict]) -> dict:
    """One cycle from the first start to the last end; all else is the strongest one's, the first of those that tie."""
    seen = [p["visibility"] for p in parts if p["visibility"]]
    return max(parts, key=_power) | {"start": min(p["start"] for p in parts), "end": max(p["end"] for p in parts), "visibility": sum(seen) / len(seen) if seen else None}


def _through_return(cycles: list[dict], limits: Limits) -> list[dict]:
    """Each cycle up to the next one's start if that is near, else a little longer, but not into the next."""
    out = []
    for cycle, following in zip(cycles, [*cycles[1:], None]):
        end = cycle["end"] + limits.recovery
        if following:
            gap = following["start"] - cycle["end"]
            end = following["start"] if 0 <= gap <= limits.near else min(end, following["start"])
        out.append(cycle | {"end": round(max(cycle["end"], end), 2)})
    return out


def _halves(cycles: list[dict], expected: int, limits: Limits) -> bool:
    """Whether cycles 1 and 2, 3 and 4, ... are the two ways of one side's repetition, for all that are expected."""
    fits = lambda a, b: a["side"] and a["side"] == b["side"] and 0 <= b["start"] - a["end"] <= limits.near
    return len(cycles) == 2 * expected and all(fits(a, b) for a, b in zip(cycles[::2], cycles[1::2]))


def to_count(cycles: list[dict], expected: int, limits: Limits = Limits()) -> list[dict]:
    """At most `expected` cycles (all of them where nothing is expected), in order of their anchors.

    Noise goes if enough is left. Halves are paired; else, if all are whole repetitions, the earliest are taken. Otherwise,
    while there are too many, the shortest one that isn't whole joins its shorter neighbour, and then the weakest go.
    """
    cycles = sorted(cycles, key=lambda c: (c["anchor"] if c["anchor"] is not None else c["start"], c["start"]))
    if not expected:
        return cycles
    loud = [c for c in cycles if _length(c) >= limits.noise]
    loud = loud if len(loud) >= expected else cycles
    if _halves(loud, expected, limits):
        return _through_return([_joined([a, b]) for a, b in zip(loud[::2], loud[1::2])], limits)
    if len(loud) >= expected and all(_length(c) >= limits.whole for c in loud):
        return _through_return(loud, limits)[:expected]
    groups = [[c] for c in cycles]
    while len(groups) > expected:
        lengths = [_length(_joined(g)) for g in groups]
        short = min(range(len(groups)), key=lambda k: (lengths[k], k))
        if lengths[short] >= limits.whole:
            break
        before, after = lengths[short - 1] if short else None, lengths[short + 1] if short + 1 < len(groups) else None
        at = short - 1 if after is None or before is not None and before <= after else short
        groups[at : at + 2] = [groups[at] + groups[at + 1]]
    made = [_joined(g) for g in groups]
    while len(made) > expected:
        made.pop(min(range(len(made)), key=lambda k: (_power(made[k]), k)))
    return made


def cycles_to_count(cycles: DataFrame, expected: DataFrame, keys: Sequence[str], count: str = "expected", limits: Limits = Limits()) -> DataFrame:
    """(keys, start, end, anchor, strength, visibility, side, number): to_count() for the cycles of each key; those without an expected count keep all."""
    row = F.struct(*[F.col(name).cast("string" if kind == pa.string() else "double").alias(name) for name, kind in _FIELDS])
    lists = cycles.groupBy(*keys).agg(F.collect_list(row).alias("_cycles")).join(expected.select(*keys, F.col(count).cast("int").alias("_expected")), list(keys), "left")
    kind = pa.list_(pa.struct(list(_FIELDS)))

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            made = [to_count(c, n or 0, limits) for c, n in zip(batch.column("_cycles").to_pylist(), batch.column("_expected").to_pylist(), strict=True)]
            yield pa.RecordBatch.from_arrays([*(batch.column(k) for k in keys), pa.array(made, kind)], names=[*keys, "_made"])

    kinds = ", ".join(f"`{k}` {cycles.schema[k].dataType.simpleString()}" for k in keys)
    struct = ",".join(f"{name}:{'string' if of == pa.string() else 'double'}" for name, of in _FIELDS)
    found = lists.mapInArrow(work, f"{kinds}, _made array<struct<{struct}>>")
    return found.select(*keys, F.posexplode("_made").alias("_n", "_c")).select(*keys, "_c.*", (F.col("_n") + 1).alias("number"))
