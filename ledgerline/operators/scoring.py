"""Scoring of company rows against a stored model: column expressions only, no shuffle."""

from dataclasses import dataclass, field

from pyspark.sql import DataFrame, functions as F

from .. import constants as C
from ..functions.scalars import case_map, num, require_columns, rule_holds, sealed, text, with_exprs
from .features import engineer, feature_coverage


@dataclass
class Model:
    """A fitted model: k centroids, one median per feature, a label and rank per cluster.

    Its size is k x features, whatever the size of the data; it enters plans as literals.
    """

    segment: str
    features: list
    centroids: list
    medians: dict
    labels: dict
    ranks: dict
    caps: dict | None = None
    version: str = C.MODEL_VERSION
    meta: dict = field(default_factory=dict)
    profile: object | None = None
    profile_ranks: dict = field(default_factory=dict)

    @property
    def k(self) -> int:
        return len(self.centroids)

    @property
    def near_default(self) -> int | None:
        """The cluster with the highest rank stands for near-default companies; a model without ranks of its own takes
        them from its stored, ranked profile."""
        ranks = self.ranks or self.profile_ranks
        return max(ranks, key=lambda c: ranks[c]) if ranks else None


def resolve_model(models: dict, segment: str) -> Model:
    if segment not in models:
        raise KeyError(f"No model for segment {segment!r}; available: {sorted(models)}")
    return models[segment]


def imputed(features, medians: dict) -> dict:
    return {f"x_{f}": f"coalesce({f}, {num(medians[f])})" for f in features}


def distance(point, centroid) -> str:
    return "sqrt(" + " + ".join(f"({x} - {num(c)}) * ({x} - {num(c)})" for x, c in zip(point, centroid)) + ")"


def nearest(distances) -> str:
    """Index of the smallest distance; the lowest index wins a tie."""
    listed = ", ".join(distances)
    return f"cast(array_position(array({listed}), least({listed})) - 1 as int)"


def with_distances(df: DataFrame, model: Model, prefix: str = "cluster_") -> DataFrame:
    """cluster_i_distance to every centroid, after filling gaps with the training medians."""
    df = with_exprs(df, imputed(model.features, model.medians))
    point = [f"x_{f}" for f in model.features]
    out = with_exprs(df, {f"{prefix}{i}_distance": distance(point, c) for i, c in enumerate(model.centroids)})
    return out.drop(*point)


def assign_clusters(df: DataFrame, model: Model, name: str = "cluster") -> DataFrame:
    names = [f"tmp_{i}_distance" for i in range(model.k)]
    out = with_distances(df, model, "tmp_")
    return with_exprs(out, {name: nearest(names)}).drop(*names)


def affinities(distances: list, temperature: float) -> dict:
    """Soft membership e^(-d/T), normalised over the clusters."""
    if temperature <= 0:
        raise ValueError("temperature must be positive")
    parts = [f"exp(-{d} / {num(temperature)})" for d in distances]
    return {d.replace("_distance", "_affinity"): f"{p} / ({' + '.join(parts)})" for d, p in zip(distances, parts)}


def warning_flags() -> str:
    hits = ", ".join(f"if(coalesce({c} {op} {num(t)}, false), {text(f)}, null)" for f, c, op, t in C.WARNINGS)
    return f"coalesce(nullif(concat_ws(', ', {hits}), ''), 'none')"


def score_features(df: DataFrame, model: Model, temperature: float = 1.0, near_default="worst") -> DataFrame:
    """Assignment, distances, affinities, label, rank, coverage and flags for engineered rows."""
    require_columns(df, model.features, "scored data")
    worst = model.near_default if near_default == "worst" else near_default
    names = [f"cluster_{i}_distance" for i in range(model.k)]
    out = with_distances(df, model)
    out = with_exprs(out, {
        "assigned_cluster": nearest(names),
        "distance_to_assigned_cluster": f"least({', '.join(names)})",
        **affinities(names, temperature),
    }).transform(sealed)
    reach = worst is not None and 0 <= worst < model.k
    return sealed(with_exprs(out, {
        "cluster_label": case_map("assigned_cluster", model.labels),
        "risk_rank": f"cast({case_map('assigned_cluster', model.ranks)} as int)",
        "cluster_affinity": f"greatest({', '.join(f'cluster_{i}_affinity' for i in range(model.k))})",
        "near_default_affinity": f"cluster_{worst}_affinity" if reach else "cast(null as double)",
        "feature_coverage_pct": feature_coverage(model.features),
        "warning_flags": warning_flags(),
    }))


def score_companies(
    df: DataFrame,
    model: Model,
    *,
    temperature: float = 1.0,
    fx: float = 1.0,
    fx_rates: DataFrame | None = None,
    minimum: float | None = None,
    near_default="worst",
    names: str = "whole_column",
) -> DataFrame:
    """Raw company rows to scored rows.  minimum=None takes the default denominator."""
    engineered = engineer(
        df, caps=model.caps, fx=fx, fx_rates=fx_rates, names=names,
        minimum=C.MIN_DENOMINATOR if minimum is None else minimum,
    )
    return score_features(engineered, model, temperature, near_default)


def score_band(c: str = "scorecard_credit_score") -> str:
    return (
        f"case when {c} < 20 then 'Strong model-relative profile' when {c} < 40 then 'Generally sound profile' "
        f"when {c} < 60 then 'Elevated / mixed risk profile' when {c} < 80 then 'Weak profile' "
        f"when {c} is not null then 'Distress-like profile' end"
    )


def affinity_band(c: str = "cluster_affinity") -> str:
    return f"case when {c} > 0.70D then 'clear' when {c} >= 0.40D then 'moderate' when {c} is not null then 'borderline' end"


def coverage_band(c: str = "feature_coverage_pct") -> str:
    return (
        f"case when {c} >= 1D then 'full' when {c} >= 0.80D then 'strong' "
        f"when {c} >= 0.67D then 'acceptable' when {c} is not null then 'weak' end"
    )


def near_default_band(c: str = "near_default_affinity") -> str:
    return (
        f"case when {c} < 0.10D then 'low' when {c} < 0.25D then 'some' "
        f"when {c} <= 0.50D then 'review' when {c} is not null then 'dominant' end"
    )
