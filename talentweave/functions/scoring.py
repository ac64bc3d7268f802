"""Scores of role pairs and of evidence, as Column expressions."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column
from pyspark.sql import functions as F


@dataclass(frozen=True)
class NeighbourWeights:
    """Weights of the provisional neighbour score; fixed values."""

    readiness: float = 0.55
    activities: float = 0.30
    sub_family: float = 0.10
    grade: float = 0.05
    grade_span: int = 4
    neighbours: int = 25


@dataclass(frozen=True)
class MoveWeights:
    """Parameters of the career-move score; fixed values."""

    plain: float = 0.30
    rare: float = 0.30
    occupation: float = 0.20
    adjacency: float = 0.10
    grade: float = 0.10
    floor: float = 0.12
    family: float = 0.34
    same_sub_family: float = 0.33
    same_specialisation: float = 0.33
    tiers: tuple[float, ...] = (1.0, 0.5, 0.0)
    steps: tuple[float, ...] = (1.0, 0.8, 0.5, 0.3)
    most_up: int = 3
    most_down: int = 2
    down_factor: float = 0.6
    down_by_default: bool = False


def cosine(a: Column, b: Column) -> Column:
    """Cosine of two arrays; 0 if either is empty or all zero, or if their lengths differ."""
    a, b = a.cast("array<double>"), b.cast("array<double>")
    total = lambda x: F.aggregate(x, F.lit(0.0), lambda s, y: s + y)
    norms = F.sqrt(total(F.transform(a, lambda x: x * x))) * F.sqrt(total(F.transform(b, lambda x: x * x)))
    dot = total(F.zip_with(a, b, lambda x, y: x * y))
    return F.when((F.size(a) == 0) | (F.size(a) != F.size(b)) | (norms == 0), F.lit(0.0)).otherwise(dot / norms)


def unit(a: Column) -> Column:
    """The vector at length 1; a zero vector stays."""
    norm = F.sqrt(F.aggregate(F.transform(a, lambda x: x * x), F.lit(0.0), lambda s, y: s + y))
    return F.when(norm > 0, F.transform(a, lambda x: x / norm)).otherwise(a)


def dot(a: Column, b: Column, size: int | None = None) -> Column:
    """Product of two arrays, 0 if their lengths differ; a known common length of up to 512 is written out as one sum,
    which stays inside generated code."""
    if size and size <= 512:
        total = F.get(a, F.lit(0)) * F.get(b, F.lit(0))
        for k in range(1, size):
            total = total + F.get(a, F.lit(k)) * F.get(b, F.lit(k))
        return total
    product = F.aggregate(F.zip_with(a, b, lambda x, y: x * y), F.lit(0.0), lambda s, y: s + y)
    return F.when(F.size(a) == F.size(b), product).otherwise(F.lit(0.0))


def overlap_coefficient(shared: Column, size_a: Column, size_b: Column) -> Column:
    small = F.least(size_a, size_b)
    return F.when(small > 0, F.coalesce(shared, F.lit(0)) / small).otherwise(F.lit(0.0))


def weighted_jaccard(shared: Column, total_a: Column, total_b: Column) -> Column:
    """From the weight that both sets share and the weight of each; 0 if the union weighs nothing."""
    shared = F.coalesce(shared, F.lit(0.0))
    union = F.coalesce(total_a, F.lit(0.0)) + F.coalesce(total_b, F.lit(0.0)) - shared
    return F.when(union > 0, shared / union).otherwise(F.lit(0.0))


def grade_proximity(delta: Column, span: int = 4) -> Column:
    return F.when(delta.isNull(), F.lit(0.0)).otherwise(F.greatest(F.lit(0.0), 1 - F.abs(delta) / span))


def neighbour_score(readiness: Column, activities: Column, same_sub_family: Column, grade: Column, w: NeighbourWeights = NeighbourWeights()) -> Column:
    return w.readiness * readiness + w.activities * activities + w.sub_family * same_sub_family.cast("double") + w.grade * grade


def occupation_value(same_family: Column, same_sub: Column, same_spec: Column, w: MoveWeights = MoveWeights()) -> Column:
    more = F.when(same_sub, w.same_sub_family).otherwise(0.0) + F.when(same_spec, w.same_specialisation).otherwise(0.0)
    return F.when(same_family, F.least(F.lit(1.0), w.family + more)).otherwise(F.lit(0.0))


def adjacency_value(tier: Column, w: MoveWeights = MoveWeights()) -> Column:
    """Value of a tier between different families; a missing tier is worth 0, an unknown one is an error."""
    value = F.when(tier.isNull(), F.lit(0.0))
    for k, v in enumerate(w.tiers):
        value = value.when(tier == k, F.lit(v))
    return value.otherwise(F.raise_error(F.concat(F.lit("unknown adjacency tier "), tier.cast("string"))).cast("double"))


def grade_value(delta: Column, w: MoveWeights = MoveWeights()) -> Column:
    """Positive deltas lead to more senior grades; beyond the table a step is worth 0."""
    step = F.lit(0.0)
    for k, v in reversed(list(enumerate(w.steps))):
        step = F.when(F.abs(delta) == k, F.lit(v)).otherwise(step)
    return F.when(delta.isNull(), F.lit(0.0)).when(delta >= 0, step).otherwise(step * w.down_factor)


def move_reason(activities_a: Column, activities_b: Column, family_a: Column, family_b: Column, tier: Column, delta: Column, score: Column, w: MoveWeights = MoveWeights(), down: bool | None = None) -> Column:
    """Why a move isn't offered, the first reason that applies; null if it is. `down` allows downward moves."""
    allowed = w.down_by_default if down is None else down
    none = lambda n: F.coalesce(n, F.lit(0)) == 0
    reason = F.when(none(activities_a) | none(activities_b), "missing_activities")
    reason = reason.when(family_a.isNull() | family_b.isNull(), "missing_family")
    reason = reason.when((family_a != family_b) & tier.isNull(), "missing_adjacency_tier")
    reason = reason.when(delta.isNull(), "missing_grade_rung")
    reason = reason.when(delta > w.most_up, "more_than_three_rungs_up")
    if not allowed:
        reason = reason.when(delta < 0, "downward_move_disabled")
    reason = reason.when(delta < -w.most_down, "more_than_two_rungs_down")
    return reason.when(score < w.floor, "below_floor")


def evidence_score(best: Column, top3: Column, validated: Column, n: Column) -> Column:
    """Weight of k-nearest-neighbour evidence: best, mean of the three best, share validated, and number up to three."""
    return 0.25 * best + 0.60 * top3 + 0.03 * validated / n + 0.12 * (F.least(n, F.lit(3)) - 1) / 2


def confidence(n: Column, validated: Column, best: Column, score: Column, second: Column) -> Column:
    high = (n >= 3) & (validated >= 2) & (best >= 0.85) & (score >= 1.03 * F.coalesce(second, F.lit(0.0)))
    return F.when(high, "High").when((n >= 2) & (best >= 0.60), "Medium").otherwise("Low")


def guide_score(evidence: Column, framework: Column) -> Column:
    return 0.80 * evidence + 0.20 * framework


def feature_status(no_activities: Column, no_family: Column, no_rung: Column) -> Column:
    """`ready`, or what is missing joined by `_and_` behind `missing_`."""
    parts = [F.when(c, F.lit(n)) for c, n in ((no_activities, "activities"), (no_family, "family"), (no_rung, "grade_rung"))]
    missing = F.concat_ws("_and_", *parts)
    return F.when(missing == "", "ready").otherwise(F.concat(F.lit("missing_"), missing))


def common_prefix(a: Column, b: Column) -> Column:
    """Length of the longest common prefix of two short codes."""
    places = F.sequence(F.lit(0), F.least(F.length(a), F.length(b)))
    return F.array_max(F.filter(places, lambda n: a.substr(F.lit(1), n) == b.substr(F.lit(1), n)))
