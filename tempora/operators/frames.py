"""Sampled frames with several subjects of named points each: unnesting, choice of the subject, and signals of a frame."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tempora.functions.scalars import finite, overlap

#: Schema of a document of frames; what else a document holds is ignored by the reader.
POINT = "struct<name:string,x:double,y:double,z:double,visibility:double>"
DOCUMENT = f"id string, frames array<struct<number:bigint,second:double,subjects:array<struct<position:int,points:array<{POINT}>>>>>"


def frame_rows(documents: DataFrame, *keys: str) -> DataFrame:
    """(keys, number, second, subjects) for each frame; frames without a finite time go."""
    rows = documents.select(*keys, F.explode("frames").alias("_")).select(*keys, "_.number", "_.second", "_.subjects")
    return rows.where(finite(F.col("second")).isNotNull())


def subject_rows(frames: DataFrame, *keys: str) -> DataFrame:
    """(keys, number, second, position, points) for each subject of each frame."""
    return frames.select(*keys, "number", "second", F.explode("subjects").alias("_")).select(*keys, "number", "second", "_.position", "_.points")


def usable(points: Column, least: float) -> Column:
    """The points with finite x and y whose visibility is unknown or `least` or more."""
    seen = lambda p: finite(p["x"]).isNotNull() & finite(p["y"]).isNotNull() & (p["visibility"].isNull() | (p["visibility"] >= least))
    return F.filter(points, seen)


def point(points: Column, name: str) -> Column:
    """The first point of a name, null if there is none."""
    return F.get(F.filter(points, lambda p: p["name"] == name), F.lit(0))


def mean_of(points: Column, names: Sequence[str], axis: str) -> Column:
    """Mean coordinate of those of the named points that are there."""
    values = F.filter(F.transform(points, lambda p: F.when(p["name"].isin(list(names)), p[axis])), lambda v: v.isNotNull())
    return F.when(F.size(values) > 0, F.aggregate(values, F.lit(0.0), lambda a, v: a + v) / F.size(values))


def depth_ratio(top: Column, middle: Column, bottom: Column, least: float = 0.05) -> Column:
    """How far the middle has sunk from top to bottom; null where those are less than `least` apart."""
    return F.when(bottom - top >= least, (middle - top) / (bottom - top))


def reach_ratio(distance: Column, length: Column, fallback: Column) -> Column:
    """A distance in body lengths, of 0.01 at least; null for no distance."""
    return F.when(distance > 0, distance / F.greatest(F.lit(0.01), F.coalesce(length, fallback)))


def overlay(points: Column, least: float = 0.2) -> Column:
    """Points by name as per cent of the picture, without those that are hardly seen."""
    kept = F.filter(usable(points, least), lambda p: p["name"].isNotNull())
    return F.map_from_entries(F.transform(kept, lambda p: F.struct(p["name"], F.struct((p["x"] * 100).alias("x"), (p["y"] * 100).alias("y")))))


def remapped(points: Column, x1: Column, y1: Column, x2: Column, y2: Column) -> Column:
    """Points of a cut-out in coordinates of the whole picture; depth goes with the width."""
    moved = lambda p: p.withField("x", x1 + p["x"] * (x2 - x1)).withField("y", y1 + p["y"] * (y2 - y1)).withField("z", p["z"] * (x2 - x1))
    return F.transform(points, moved)


def subject_score(strategy: str, x1: Column, y1: Column, x2: Column, y2: Column, visibility: Column, position: Column, region: tuple[float, float, float, float] | None = None) -> Column:
    """What a subject's box is worth: how far left, right or central it is, how large, or how much of it lies in a region.

    Size and visibility add a little. Any other strategy takes the first subject. A subject without box is worth nothing (null).
    """
    centre, area, seen = (x1 + x2) / 2, F.greatest(F.lit(0.0), x2 - x1) * F.greatest(F.lit(0.0), y2 - y1), visibility * 0.05
    if strategy == "largest":
        return area + seen
    if strategy == "region" and region:
        shared = overlap(x1, x2, F.lit(region[0]), F.lit(region[2])) * overlap(y1, y2, F.lit(region[1]), F.lit(region[3]))
        return shared + F.coalesce(F.try_divide(shared, F.nullif(area, F.lit(0.0))), F.lit(0.0)) * 0.5 + area * 0.25 + seen
    by = {"left": 1 - centre, "right": centre, "center": 1 - F.abs(centre - 0.5) * 2}.get(strategy)
    return (position == 0).cast("double") if by is None else by + area * 0.25 + seen


def primary_subject(subjects: DataFrame, keys: Sequence[str], score: Column, position: str = "position") -> DataFrame:
    """The subject of the highest score for each key, the first of those that tie; subjects without score come last."""
    row = F.struct(*[F.col(c) for c in subjects.columns if c not in keys])
    best = F.max_by(row, F.struct(F.coalesce(score, F.lit(float("-inf"))), -F.col(position)))
    return subjects.groupBy(*keys).agg(best.alias("_")).select(*keys, "_.*")
