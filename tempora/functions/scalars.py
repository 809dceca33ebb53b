"""Column expressions with fixed rules for rounding, ranges, missing values and hashes."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def rate(part: Column, whole: Column, digits: int = 4) -> Column:
    """part / whole, null where whole is zero."""
    return F.round(F.try_divide(part.cast("double"), whole.cast("double")), digits)


def half_up(x: Column) -> Column:
    """The nearest whole number; halves go up, for negative numbers too."""
    return F.floor(x + 0.5)


def clamp(x: Column, low: float, high: float) -> Column:
    """x, held between low and high; null stays null, which least() and greatest() would pass over."""
    return F.when(x.isNotNull(), F.greatest(F.lit(low), F.least(F.lit(high), x)))


def finite(x: Column) -> Column:
    """x, or null where it isn't a finite number."""
    return F.when(~F.isnan(x) & (F.abs(x) != float("inf")), x)


def rating(x: Column, good: float, fair: float, rising: bool = True) -> Column:
    """good / watch / limited by two thresholds; `rising` if more is better. Null isn't rated."""
    better = (lambda t: x >= t) if rising else (lambda t: x <= t)
    return F.when(x.isNull(), "not_applicable").when(better(good), "good").when(better(fair), "watch").otherwise("limited")


def rating_score(label: Column) -> Column:
    """3 for good and what isn't rated, 2 for watch, 1 for limited."""
    return F.when(label == "limited", 1).when(label == "watch", 2).otherwise(3)


def length(dx: Column, dy: Column) -> Column:
    """Of a vector of coordinates. hypot() guards against overflow, which these can't reach, at many times the cost."""
    return F.sqrt(dx * dx + dy * dy)


def joint_angle(ax: Column, ay: Column, bx: Column, by: Column, cx: Column, cy: Column) -> Column:
    """Degrees at b between a and c; null if either leg has no length."""
    dot = (ax - bx) * (cx - bx) + (ay - by) * (cy - by)
    legs = length(ax - bx, ay - by) * length(cx - bx, cy - by)
    return F.degrees(F.acos(clamp(F.try_divide(dot, F.nullif(legs, F.lit(0.0))), -1.0, 1.0)))


def lean_angle(dx: Column, dy: Column) -> Column:
    """Degrees off the vertical."""
    return F.degrees(F.abs(F.atan2(dx, dy)))


def axial_difference(a: Column, b: Column) -> Column:
    """Degrees between two undirected lines, at most 90."""
    d = F.pmod(F.abs(a - b), F.lit(180.0))
    return F.least(d, F.lit(180.0) - d)


def line_distance(px: Column, py: Column, ax: Column, ay: Column, bx: Column, by: Column) -> Column:
    """Distance of a point from the line through a and b."""
    area = F.abs((bx - ax) * (ay - py) - (ax - px) * (by - ay))
    return F.try_divide(area, F.nullif(length(bx - ax, by - ay), F.lit(0.0)))


def overlap(a_start: Column, a_end: Column, b_start: Column, b_end: Column) -> Column:
    """Length that two intervals share."""
    return F.greatest(F.lit(0.0), F.least(a_end, b_end) - F.greatest(a_start, b_start))


def overlap_ratio(a_start: Column, a_end: Column, b_start: Column, b_end: Column, of_shorter: bool = False) -> Column:
    """The shared length as a part of b's, or of the shorter one's; lengths count as 0.01 at least."""
    whole = F.least(a_end - a_start, b_end - b_start) if of_shorter else b_end - b_start
    return overlap(a_start, a_end, b_start, b_end) / F.greatest(F.lit(0.01), whole)


def fnv1a(text: Column) -> Column:
    """32-bit FNV-1a of a string's characters' codes."""
    codes = F.transform(F.filter(F.split(text, ""), lambda c: c != ""), F.ascii)
    return F.aggregate(codes, F.lit(2166136261).cast("long"), lambda h, c: (h.bitwiseXOR(c.cast("long")) * F.lit(16777619)).bitwiseAND(F.lit(4294967295)))


def csv_value(x: Column) -> Column:
    """Null is empty; quotes double; what holds a quote, comma or line break is quoted."""
    text = F.coalesce(x.cast("string"), F.lit(""))
    return F.when(text.rlike('[",\n\r]'), F.concat(F.lit('"'), F.replace(text, F.lit('"'), F.lit('""')), F.lit('"'))).otherwise(text)


def frame_rate(text: Column) -> Column:
    """'30000/1001' as a number; null if it is none, or its divisor is zero."""
    parts = F.split(text, "/")
    over = F.when(F.size(parts) > 1, parts[1]).otherwise("1").try_cast("double")
    return F.try_divide(parts[0].try_cast("double"), F.nullif(over, F.lit(0.0)))


def iso_seconds(text: Column) -> Column:
    """An ISO-8601 duration of hours, minutes and seconds, in seconds; null if it is none."""
    part = lambda unit: F.coalesce(F.regexp_extract(text, rf"(\d+(?:\.\d+)?){unit}", 1).try_cast("double"), F.lit(0.0))
    return F.when(text.rlike(r"^PT(?=\d)(\d+(\.\d+)?H)?(\d+(\.\d+)?M)?(\d+(\.\d+)?S)?$"), part("H") * 3600 + part("M") * 60 + part("S"))


def list_of(*reasons: tuple[Column, str]) -> Column:
    """The names of the conditions that hold, each once, sorted."""
    return F.array_sort(F.array_distinct(F.array_compact(F.array(*[F.when(condition, F.lit(name)) for condition, name in reasons]))))
