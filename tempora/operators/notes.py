"""What notes say of single repetitions: rules for one, for a range, for the first or last ones, resolved for each repetition.

A rule is an interval of repetitions with what it says of them; notes give an array of rules, first the ones that go
before others. Repetitions are exploded and look for the first rule that holds them, so nothing is joined or shuffled.
"""

from __future__ import annotations

from collections.abc import Callable, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tempora.functions.hints import numeral

_N = "([一二三四五六七八九十两\\d]+)"
#: How notes name one repetition, a range, and the first or last ones with their view.
_ONE = (rf"第{_N}个[^，。；,.]*(正面|侧面)", r"(?i)rep\s*(\d+)[^,.]*(front|side)")
_RANGE = rf"{_N}\s*[-~到至]\s*{_N}[^，。；,.]*(正面|侧面)"
_FIRST = {"front": (rf"前{_N}个[^，。；]*正面", r"first\s+(\d+)[^,.]*front"), "side": (rf"前{_N}个[^，。；]*侧面", r"first\s+(\d+)[^,.]*side")}
_LAST = {"front": (rf"后{_N}个[^，。；]*正面", r"last\s+(\d+)[^,.]*front"), "side": (rf"后{_N}个[^，。；]*侧面", r"last\s+(\d+)[^,.]*side")}
#: Words for raised heels, and how notes say which repetitions have them.
_HEEL_EN = "heel[- ]?elevated|heels elevated|heel lift|heel lifted|heels lifted|heel raised|heels raised|heel off floor|heels off floor|board under heels|fms board"
_HEEL_ZH = "脚后跟垫高|脚跟垫高|垫脚跟|垫高脚跟|脚后跟抬起|脚跟抬起|脚后跟离地|脚跟离地|FMS板|fms板"
_TO, _UNIT = "(?:-|–|—|~|到|至)", "(?:个|次|段|rep)"
_HEEL_RANGES = (
    rf"(?i)rep\s*{_N}\s*{_TO}\s*{_N}[^.;；，。\n]*?(?:{_HEEL_EN})",
    rf"(?i)(?:第\s*{_N}\s*{_TO}\s*{_N}\s*{_UNIT}?|{_N}\s*{_UNIT}\s*{_TO}\s*{_N}\s*{_UNIT}?|{_N}\s*{_TO}\s*{_N}\s*{_UNIT})[^；，。\n]*?(?:{_HEEL_ZH})",
)
_HEEL_ONE = (rf"(?i)rep\s*{_N}[^.;；，。\n]*?(?:{_HEEL_EN})", rf"(?i)第\s*{_N}\s*{_UNIT}?[^；，。\n]*?(?:{_HEEL_ZH})")
_BUT_FIRST = (
    r"(?i)(?:except|besides|other than|apart from)\s+(?:the\s+)?first|all\s+but\s+(?:the\s+)?first",
    r"除了?\s*第?\s*[一1]\s*(?:个|次|段|rep)?(?:以外|之外)?[^；，。.\n]*(?:都|其余|其他|后面)",
    r"(?:其余|其他|后面)[^；，。.\n]*(?:都)?[^；，。.\n]*(?:脚后跟垫高|脚跟垫高|垫脚跟|垫高脚跟|脚后跟抬起|脚跟抬起|脚后跟离地|脚跟离地)",
)


def _rule(first: Column, last: Column, says: Column | str) -> Column:
    """An interval of repetitions; null unless both ends are numbers other than 0."""
    word = F.lit(says) if isinstance(says, str) else says
    return F.when((first != 0) & (last != 0), F.struct(F.least(first, last).cast("int").alias("first"), F.greatest(first, last).cast("int").alias("last"), word.alias("says")))


def _matches(text: Column, pattern: str, rule: Callable[[Column, str], Column]) -> Column:
    """The rule of each match of a pattern, in their order."""
    return F.transform(F.regexp_extract_all(text, F.lit(pattern), F.lit(0)), lambda m: rule(m, pattern))


def _number(text: Column, pattern: str, group: int = 1) -> Column:
    return numeral(F.regexp_extract(text, pattern, group))


def _view(text: Column, pattern: str, group: int) -> Column:
    said = F.lower(F.regexp_extract(text, pattern, group))
    return F.when(said.isin("侧面", "side"), "side").otherwise("front")


def view_rules(notes: Column, count: Column) -> Column:
    """Rules for views, in the order in which they decide: single repetitions, ranges, the first n, the last n; where notes
    name the first of one view and the last of the other, the second view is that of all between too."""
    text = F.coalesce(notes, F.lit(""))
    one = [_matches(text, p, lambda m, p: _rule(_number(m, p), _number(m, p), _view(m, p, 2))) for p in _ONE]
    ranges = _matches(text, _RANGE, lambda m, p: F.when(_number(m, p) <= _number(m, p, 2), _rule(_number(m, p), _number(m, p, 2), _view(m, p, 3))))
    counted = lambda pair: F.coalesce(F.nullif(_number(text, pair[0]), F.lit(0)), F.nullif(_number(F.lower(text), pair[1]), F.lit(0)))
    first, last = ({view: counted(pair) for view, pair in kind.items()} for kind in (_FIRST, _LAST))
    whole = F.when(count > 0, count)
    rest = [_rule(F.lit(1), first[v], v) for v in ("front", "side")]
    # more of the last ones than there are reach back to the first
    rest += [F.when(last[v].isNotNull(), _rule(F.greatest(F.lit(1), whole - last[v] + 1), whole, v)) for v in ("front", "side")]
    between = [F.when(first[a].isNotNull() & last[b].isNotNull(), _rule(F.lit(1), whole, b)) for a, b in (("front", "side"), ("side", "front"))]
    return F.array_compact(F.concat(*one, ranges, F.array(*rest, *between)))


def heel_rules(notes: Column, count: Column) -> Column:
    """Intervals of repetitions with raised heels: ranges, single ones, the last two, all but the first."""
    text = F.coalesce(notes, F.lit(""))

    def ends(pairs: int) -> Callable[[Column, str], Column]:
        """A range whose two numbers are in the first pair of groups that matched."""
        end = lambda m, p, at: F.coalesce(*[F.when(F.regexp_extract(m, p, 2 * k + at) != "", _number(m, p, 2 * k + at)) for k in range(pairs)])
        return lambda m, p: _rule(end(m, p, 1), end(m, p, 2), "raised")

    ranges = [_matches(text, p, ends(pairs)) for p, pairs in zip(_HEEL_RANGES, (1, 3), strict=True)]
    one = [_matches(text, p, lambda m, p: _rule(_number(m, p), _number(m, p), "raised")) for p in _HEEL_ONE]
    heels = text.rlike(f"(?i){_HEEL_EN}") | text.rlike(f"(?i){_HEEL_ZH}")
    last_two = F.when((count > 0) & heels & (F.contains(text, F.lit("后两个")) | F.contains(F.lower(text), F.lit("last two"))), F.struct((count - 1).cast("int").alias("first"), count.cast("int").alias("last"), F.lit("raised").alias("says")))
    others = F.when((count > 1) & heels & (text.rlike(_BUT_FIRST[0]) | text.rlike(_BUT_FIRST[1]) | text.rlike(_BUT_FIRST[2])), _rule(F.lit(2), count, "raised"))
    return F.array_compact(F.concat(*ranges, *one, F.array(last_two, others)))


def repetition_rules(rows: DataFrame, keys: Sequence[str], notes: str, count: str) -> DataFrame:
    """(keys, repetition, view, raised) for each of the `count` repetitions that the notes of a row are about; a view is null
    where no rule holds, and no count, or none above 0, gives no rows."""
    ruled = rows.where(F.col(count) > 0).select(*keys, F.col(count).alias("_count"), view_rules(F.col(notes), F.col(count)).alias("_views"), heel_rules(F.col(notes), F.col(count)).alias("_heels"))
    each = ruled.select(*keys, "_views", "_heels", F.explode(F.sequence(F.lit(1), F.col("_count").cast("int"))).alias("repetition"))
    holds = lambda r: (r["first"] <= F.col("repetition")) & (F.col("repetition") <= r["last"])
    return each.select(*keys, "repetition", F.get(F.filter("_views", holds), F.lit(0))["says"].alias("view"), F.exists("_heels", holds).alias("raised"))
