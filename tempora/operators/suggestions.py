"""Suggested scores of repetitions from their ratings: one plan that takes each row through the model of its action and version."""

from __future__ import annotations

from collections.abc import Mapping
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tempora.functions.scalars import clamp
from tempora.operators.movements import computed


@dataclass(frozen=True)
class Model:
    """Which ratings make the three sub-scores (the least of each group counts), which of them are lowered by `limited` alone,
    which are evidence for the confidence, and what follows from low totals: `staged` asks for an attempt with raised heels
    below 3, `manual_at` hands totals up to it to a reviewer. `shown` names a metric of visibility that counts .55 beside the timing's."""

    groups: tuple[tuple[str, ...], ...]
    evidence: tuple[str, ...]
    lenient: tuple[str, ...] = ()
    staged: bool = False
    manual_at: int = 0
    shown: str | None = None


_HURDLE = (("clearance",), ("stance_leg_control", "pelvis_trunk_control"), ("step_leg_alignment", "side_confidence"))
_HURDLE_EVIDENCE = ("clearance", "stance_leg_control", "pelvis_trunk_control", "step_leg_alignment", "side_confidence")
#: The models, by action and version; the highest version of an action is the one that is used unless a row asks for another.
MODELS: dict[tuple[str, int], Model] = {
    ("deep_squat", 2): Model((("depth",), ("knee_alignment",), ("torso_control",)), ("depth", "knee_alignment", "torso_control"), staged=True),
    ("active_leg_raise", 3): Model((("leg_raise",), ("down_leg_control", "pelvic_stability"), ("knee_extension", "side_confidence")), ("leg_raise", "knee_extension", "down_leg_control", "pelvic_stability", "side_confidence"), lenient=("knee_extension",)),
    ("hurdle_step", 2): Model(_HURDLE, _HURDLE_EVIDENCE),
    ("hurdle_step", 3): Model(_HURDLE, _HURDLE_EVIDENCE, manual_at=1),
    ("inline_lunge", 2): Model((("depth_zone",), ("trunk_pelvis_control", "rear_leg_control"), ("knee_foot_line", "side_confidence")), ("depth_zone", "trunk_pelvis_control", "rear_leg_control", "knee_foot_line", "side_confidence")),
    ("shoulder_mobility", 1): Model((("reach_distance",), ("reach_distance", "shoulder_reference"), ("hand_visibility", "side_context")), ("reach_distance", "hand_visibility", "shoulder_reference", "side_context"), shown="hand_visibility"),
    ("trunk_stability", 1): Model((("core_stability", "trunk_visibility"), ("push_up", "arm_extension"), ("compensation",)), ("push_up", "core_stability", "arm_extension", "compensation", "trunk_visibility")),
}
#: Confidences that are high and medium, and that of a total which a reviewer has to judge.
HIGH, MEDIUM, MANUAL = 0.72, 0.52, 0.48


def _suggested(model: Model) -> Column:
    """(status, total, raw, subscores, confidence) of a row of features."""
    rating = lambda name: F.try_element_at("ratings", F.lit(name))

    def score(name: str) -> Column:
        low = F.when(rating(name) == "limited", 1)
        return (low if name in model.lenient else low.when(rating(name) == "watch", 2)).otherwise(3)

    parts = [F.least(*map(score, g)) if len(g) > 1 else score(g[0]) for g in model.groups]
    raw = F.least(*parts)
    rated = sum((F.coalesce(rating(n) != "not_applicable", F.lit(False)).cast("int") for n in model.evidence), F.lit(0)) / len(model.evidence)
    seen = F.coalesce("visibility", F.lit(0.0))
    if model.shown:
        metric = F.try_element_at("metrics", F.lit(model.shown))
        seen = clamp(F.coalesce(metric, F.col("visibility"), F.lit(0.0)) * 0.55 + F.coalesce(F.col("visibility"), metric, F.lit(0.0)) * 0.45, 0.0, 1.0)
    confidence = F.round(F.round(clamp(rated * 0.45 + seen * 0.35 + F.coalesce("coverage", F.lit(0.0)) * 0.2, 0.0, 1.0), 9), 2)
    raised = F.coalesce("raised", F.lit(False)) if model.staged else F.lit(False)
    manual, asks = (raw <= model.manual_at) if model.manual_at else F.lit(False), ~raised & (raw < 3) if model.staged else F.lit(False)
    status = F.when(manual, "needs_manual_review").when(asks, "needs_heel_elevated_attempt").otherwise("suggested")
    total = F.when(~manual & ~asks, F.when(raised, F.least(raw, F.lit(2))).otherwise(raw))
    subscores = F.array(*[F.when(raised, F.least(p, F.lit(2))).otherwise(p) for p in parts])
    return F.struct(status.alias("status"), total.alias("total"), raw.alias("raw"), subscores.alias("subscores"), F.when(manual, MANUAL).otherwise(confidence).alias("confidence"))


def suggestions(rows: DataFrame, models: Mapping[tuple[str, int], Model] | None = None) -> DataFrame:
    """Rows of anchors.features() (action, status, metrics, ratings, ...) with visibility and coverage of their timing, `raised`
    (heels) and `version` (null: the latest of the action), with suggestion_status, total, raw, subscores, confidence,
    confidence_label and model (the version used).

    Rows without features have insufficient_evidence, those of an action or version without a model are unsupported.
    """
    models = models or MODELS
    newest = {action: max(v for a, v in models if a == action) for action, _ in models}
    wanted = F.lit(None).cast("int")
    for action, version in newest.items():
        wanted = F.when(F.col("action") == action, version).otherwise(wanted)
    out = rows.withColumn("_version", F.coalesce(F.col("version").cast("int"), wanted))
    out = computed(out)
    for k, ((action, version), model) in enumerate(models.items()):
        own = (F.col("action") == action) & (F.col("_version") == version) & (F.col("status") == "ok")
        out = computed(out.withColumn(f"_made_{k}", F.when(own, _suggested(model))))
    out = out.withColumn("_made", F.coalesce(F.lit(None).cast("struct<status:string,total:int,raw:int,subscores:array<int>,confidence:double>"), *[F.col(f"_made_{k}") for k in range(len(models))]))
    has = F.lit(False)
    for action, version in models:
        has = has | ((F.col("action") == action) & (F.col("_version") == version))
    has = F.coalesce(has, F.lit(False))
    status = F.when(~has, "unsupported").when(F.col("status") != "ok", "insufficient_evidence").otherwise(F.col("_made.status"))
    confidence = F.coalesce("_made.confidence", F.lit(0.0))
    label = F.when(confidence >= HIGH, "high").when(confidence >= MEDIUM, "medium").otherwise("low")
    return out.select(*rows.columns, status.alias("suggestion_status"), "_made.total", "_made.raw", "_made.subscores", confidence.alias("confidence"), label.alias("confidence_label"), F.when(has, F.col("_version")).alias("model"))
