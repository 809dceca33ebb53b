"""Scores from ratings, adjudication of raters, tiers, gates and staged attempts, as ordered conditions."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tempora.functions.scalars import list_of, rating_score


def suggestion(ratings: Sequence[Column], visibility: Column, timing: Column) -> tuple[Column, Column]:
    """The least sub-score of the ratings, and a confidence of .45 coverage + .35 visibility + .2 timing coverage."""
    total = F.least(*[rating_score(r) for r in ratings]) if len(ratings) > 1 else rating_score(ratings[0])
    rated = sum(((r != "not_applicable").cast("int") for r in ratings), F.lit(0)) / len(ratings)
    return total, F.round(rated * 0.45 + visibility * 0.35 + timing * 0.2, 4)


def adjudicated(ai: Column, a: Column, b: Column) -> tuple[Column, Column, Column]:
    """(status, source, final score) of two reviewers and a suggestion.

    Without both reviewers it is pending. Equal reviewers are the consensus. Else a suggestion that equals either of
    them decides, however far apart they are; without one the label is invalid.
    """
    match = F.coalesce((ai == a) | (ai == b), F.lit(False))
    status = F.when(a.isNull() | b.isNull(), "pending").when((a == b) | match, "valid").otherwise("invalid")
    source = F.when(status != "valid", "none").when(a == b, "human_consensus").otherwise("ai_human_match")
    return status, source, F.when(source == "human_consensus", a).when(source == "ai_human_match", ai)


def audit_class(first: Column, second: Column, historical: Column) -> Column:
    """How a historical score stands to the consensus of two blind rounds; both rounds need one. The names are fixed values."""
    return (
        F.when(first.isNull() | second.isNull(), "no_numeric_consensus_in_both_rounds")
        .when(first != second, "blind_consensus_changed_between_rounds")
        .when(historical.isNull(), "stable_blind_historical_label_missing")
        .when(first == historical, "confirmed_audited_weak_label")
        .otherwise("stable_blind_disagrees_with_historical")
    )


def tier(**tests: Column) -> Column:
    """The name of the first test that holds; 'other' if none does."""
    out = None
    for name, test in tests.items():
        out = F.when(test, name) if out is None else out.when(test, name)
    return out.otherwise("other")


def eligibility(excluding: Sequence[tuple[Column, str]], pending: Sequence[tuple[Column, str]]) -> tuple[Column, Column]:
    """(status, reasons): excluded if a condition of the first kind holds, else pending by the second, else eligible."""
    any_of = lambda tests: F.coalesce(F.greatest(F.lit(False), *[c for c, _ in tests]), F.lit(False))
    status = F.when(any_of(excluding), "excluded").when(any_of(pending), "pending").otherwise("eligible")
    return status, list_of(*excluding, *pending)


def staged_score(rows: DataFrame, keys: Sequence[str], score: str, elevated: Column) -> DataFrame:
    """(keys, final_score, status, reason, attempts, scorable): the final score of a subject's attempts, each with its own
    score (null: it can't be scored) and whether heels were elevated.

    An attempt that scored 0 makes it 0. Of those that can be scored, one on the floor with 3 makes it 3, one with elevated
    heels and 2 or more makes it 2, any other with elevated heels 1; floor attempts alone below 3 ask for one with elevated
    heels. The names are fixed values.
    """
    s, raised = F.col(score), F.coalesce(elevated, F.lit(False))
    any_ = lambda c: F.coalesce(F.bool_or(c), F.lit(False))
    outcomes = [
        (any_(s == 0), 0, "pain_zero", "pain_or_clearing_zero"), (~any_(s.isNotNull()), None, "insufficient_evidence", "no_scorable_attempts"), (any_(~raised & (s == 3)), 3, "final_ready", "floor_attempt_earned_three"),
        (any_(raised & (s >= 2)), 2, "final_ready", "heel_elevated_attempt_earned_two"), (any_(raised & s.isNotNull()), 1, "final_ready", "heel_elevated_attempt_below_two"),
    ]
    final = F.struct(F.lit(None).cast("int").alias("score"), F.lit("needs_heel_elevated_attempt").alias("status"), F.lit("floor_attempt_no_three_needs_board").alias("reason"))
    for test, value, status, reason in reversed(outcomes):
        final = F.when(test, F.struct(F.lit(value).cast("int").alias("score"), F.lit(status).alias("status"), F.lit(reason).alias("reason"))).otherwise(final)
    found = rows.groupBy(*keys).agg(final.alias("_"), F.count("*").alias("attempts"), F.count(s).alias("scorable"))
    return found.select(*keys, F.col("_.score").alias("final_score"), "_.status", "_.reason", "attempts", "scorable")
