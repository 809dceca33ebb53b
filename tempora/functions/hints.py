"""What titles and notes say: folded text, actions, counts in digits or Chinese numerals, and camera views."""

from __future__ import annotations

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql.types import StringType

#: Phrases that stand for others, in this order, after letters are folded.
_SAME = ((r"&amp;", "and"), (r"\bfunction(?:al)? movement screen\b", "fms"), (r"\bassessment\b", "test"), (r"\bpush-up\b", "push up"))
_DIGITS = {"零": 0, "一": 1, "二": 2, "两": 2, "三": 3, "四": 4, "五": 5, "六": 6, "七": 7, "八": 8, "九": 9}
_NUMERAL = r"[一二三四五六七八九十两\d]+"


@F.pandas_udf(StringType())
def _decomposed(texts: pd.Series) -> pd.Series:
    """Compatibility forms taken apart: accents by themselves, ligatures, full-width and other forms of letters as letters."""
    return texts.str.normalize("NFKD")


def folded(text: Column) -> Column:
    """A title for comparison: accents off, lower case, phrases that mean the same made one, all else than a-z and 0-9 one space.
    Only texts beyond ASCII are taken apart, in batches; all others pass as nulls there."""
    plain = F.octet_length(text) == F.char_length(text)
    out = F.coalesce(F.when(plain, text).otherwise(_decomposed(F.when(~plain, text))), F.lit(""))
    out = F.lower(F.regexp_replace(out, "[\u0300-\u036f]", ""))
    for phrase, other in _SAME:
        out = F.regexp_replace(out, phrase, other)
    return F.trim(F.regexp_replace(out, "[^a-z0-9]+", " "))


def numeral(token: Column) -> Column:
    """A number in digits or in Chinese numerals up to 99; null if it is neither."""
    digits = F.create_map(*[F.lit(x) for pair in _DIGITS.items() for x in pair])
    digit = lambda c: F.try_element_at(digits, c)
    left, right = F.substring_index(token, "十", 1), F.substring_index(token, "十", -1)
    tens = F.when(left == "", 1).otherwise(digit(left)) * 10 + F.when(right == "", 0).otherwise(digit(right))
    return F.when(token.rlike(r"^\d+$"), token.try_cast("int")).when(F.contains(token, F.lit("十")), tens).otherwise(digit(token))


def _count(text: Column, pattern: str) -> Column:
    found = F.regexp_extract(text, pattern, 1)
    return F.when(found != "", numeral(found))


def repetitions(notes: Column, file_name: Column) -> Column:
    """How many repetitions the notes, or else the file's name, speak of; null if neither does."""
    said = F.lower(F.coalesce(notes, F.lit("")))
    tests = [rf"(?:共|总共|一共|共计)?({_NUMERAL})\s*(?:个)?(?:动作|片段|次|下)", r"(?:only|total)\s+(\d+)\s*(?:reps?|segments?|times?)", rf"做了({_NUMERAL})次"]
    named = _count(F.lower(F.coalesce(file_name, F.lit(""))), r"(?:^|[^a-z0-9])([1-9]\d?)\s*[-_ ]?\s*reps?(?:[^a-z0-9]|$)")
    return F.coalesce(*[_count(said, t) for t in tests], named)


def estimated_repetitions(seconds: Column, notes: Column, file_name: Column, expected: Column, cycle: float = 3.8, most: int = 20) -> Column:
    """1 to `most`: what is expected, else what is said, else what fits the duration at `cycle` seconds each."""
    said = F.coalesce(F.when(expected > 0, expected), repetitions(notes, file_name))
    fits = F.greatest(F.lit(1), F.floor(seconds / cycle).cast("int"))
    return F.least(F.lit(most), F.greatest(F.lit(1), F.coalesce(said, fits)))


def camera_view(notes: Column, file_name: Column) -> Column:
    """front or side, if notes or else the file's name say just one of them; null otherwise."""
    said, named = F.lower(F.coalesce(notes, F.lit(""))), F.lower(F.coalesce(file_name, F.lit("")))
    has = lambda text, *words: F.greatest(*[F.contains(text, F.lit(w)) for w in words])
    both = has(said, "正面", "front") & has(said, "侧面", "side")
    return (
        F.when(both, None)
        .when(has(said, "都是正面", "全是正面", "all front"), "front")
        .when(has(said, "都是侧面", "全是侧面", "all side"), "side")
        .when(has(named, "front", "正面"), "front")
        .when(has(named, "side", "侧面"), "side")
    )
