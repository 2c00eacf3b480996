"""Stability studies: how much do labels, scores and flags move when an assumption moves?"""

import numpy as np
from pyspark.sql import DataFrame, functions as F

from .. import constants as C
from ..functions.scalars import num, text, with_exprs
from ..session import stored
from . import cluster as Cl, features as Fe, metrics as Me
from .quantiles import median_row

STABILITY_SCHEMA = "model string, rows bigint, inertia double, ari double, nmi double, rank_kept boolean"


def rank_kept(base: np.ndarray, other: np.ndarray, overlap: dict) -> bool:
    """Do the clusters keep their risk order when each is matched to its largest overlap?"""
    w = np.array([C.SCORE_WEIGHTS[d] for d in C.DOMAINS])
    order = sorted(range(len(base)), key=lambda c: float(base[c] @ w))
    matched = [overlap.get(c) for c in order]
    scores = [float(other[m] @ w) for m in matched if m is not None]
    return len(set(matched)) == len(order) and all(a <= b for a, b in zip(scores, scores[1:]))


def stability(points: DataFrame, n_features: int, baseline: list, groups: dict) -> DataFrame:
    """Compare model groups with a baseline: all of them are fitted in the same passes.

    baseline and each group are restart lists; the best restart stands for its
    group.  Labels are compared over all rows, in one scan.
    """
    specs = list(baseline) + [s for g in groups.values() for s in g]
    fits = Cl.fit_many(points, n_features, specs)
    at, best = len(baseline), {}
    base = Cl.best_fit(fits[:at])
    for name, g in groups.items():
        best[name] = Cl.best_fit(fits[at:at + len(g)])
        at += len(g)
    base_text = f"{Cl.label_text(base.centroids, n_features)} as base"
    labelled = Cl.long_labels(points.selectExpr("*", base_text), best, n_features, keep=["base"])
    cells = Me.contingency(labelled, "base", "label", ["model"]).collect()
    agree = {r["model"]: r for r in Me.agreement(labelled, "base", "label", ["model"]).collect()}
    rows = []
    for name, f in best.items():
        mine = [r for r in cells if r["model"] == name]
        overlap = {}
        for r in sorted(mine, key=lambda r: r["n"]):
            overlap[r["a"]] = r["b"]
        kept = rank_kept(base.centroids, f.centroids, overlap) if n_features == len(C.DOMAINS) else None
        rows.append((name, sum(r["n"] for r in mine), float(f.inertia), agree[name]["ari"], agree[name]["nmi"], kept))
    return points.sparkSession.createDataFrame(rows, STABILITY_SCHEMA)


def seed_stability(points, n_features, seeds=tuple(C.STABILITY_SEEDS), n_init: int = C.N_INIT, k: int = C.K_CLUSTERS):
    groups = {f"seed_{s}": Cl.restarts(k, n_init, s, tag=f"s{s}") for s in seeds}
    return stability(points, n_features, Cl.restarts(k, n_init, C.SEED, tag="base"), groups)


def bootstrap_stability(points, n_features, samples: int = 30, share: float = 0.8, n_init: int = C.N_INIT, k: int = C.K_CLUSTERS):
    """Each replicate is one seeded row share that all its restarts see, drawn inside the passes; the best restart stands for
    it.  Scoring covers all rows."""
    groups = {f"sample_{i}": Cl.restarts(k, n_init, 1000 + i, tag=f"b{i}", share=share, sample=1000 + i) for i in range(samples)}
    return stability(points, n_features, Cl.restarts(k, n_init, C.SEED, tag="base"), groups)


def leave_one_out(points, features: list, n_init: int = C.N_INIT, k: int = C.K_CLUSTERS):
    d = len(features)
    groups = {
        f"without_{f}": Cl.restarts(k, n_init, C.SEED, tag=f"l{i}", mask=tuple(0.0 if j == i else 1.0 for j in range(d)))
        for i, f in enumerate(features)
    }
    return stability(points, d, Cl.restarts(k, n_init, C.SEED, tag="base"), groups)


def refit_stability(variants: dict, features: list, keys: list, baseline: str, n_init: int = C.N_INIT, k: int = C.K_CLUSTERS) -> DataFrame:
    """Fit every variant of the engineered rows anew and compare its labels with the baseline's on their common rows.

    variants: name -> (rows, fill value of each feature, or None for the variant's own medians)."""
    d, labels = len(features), {}
    for name, (rows, fill) in variants.items():
        points = stored(Cl.point_table(rows, features, fill or median_row(rows, features), keys), "points")
        fit = Cl.kmeans(points, d, k, n_init)
        labels[name] = points.selectExpr(*keys, f"{Cl.label_text(fit.centroids, d)} as label")
    base = labels[baseline].withColumnRenamed("label", "base")
    both = None
    for name, df in labels.items():
        pair = df.join(base, keys).select(F.lit(name).alias("variant"), "base", "label")
        both = pair if both is None else both.unionByName(pair)
    both = stored(both, "refits")
    counts = both.groupBy("variant").agg(F.count("*").alias("common_rows"))
    return counts.join(Me.agreement(both, "base", "label", ["variant"]), "variant")


def scaled_rules(factor: float) -> dict:
    """All thresholds of the component rules times 1 + factor."""
    return {n: (s, d, a * (1 + factor), b * (1 + factor)) for n, (s, d, a, b) in C.COMPONENT_RULES.items()}


def rescore(feats: DataFrame, rules: dict | None = None) -> DataFrame:
    """Risks and score again from stored ratios; no ratio is recomputed."""
    out = feats.transform(Fe.component_risks, rules).transform(Fe.structural_distress).transform(Fe.domain_risks)
    return with_exprs(out, {"scorecard_credit_score": Fe.credit_score()})


def weight_table(feats: DataFrame, sets: dict, keep: list) -> DataFrame:
    """One row per company and weight set, from one scan."""
    rows = ", ".join(
        f"named_struct('weight_set', {text(name)}, 'score', {Fe.credit_score(w)})" for name, w in sets.items())
    return feats.selectExpr(*keep, f"inline(array({rows}))")


def dirichlet_sets(n: int, seed: int = C.SEED) -> dict:
    draws = np.random.default_rng(seed).dirichlet(np.ones(len(C.DOMAINS)), n)
    return {f"draw_{i}": dict(zip(C.DOMAINS, map(float, w))) for i, w in enumerate(draws)}


def scaled_guardrails(families: dict) -> list:
    """Rule table with the thresholds of some families or columns scaled."""
    return [
        (flag, fam, col, op, limit * families.get(col, families.get(fam, 1.0)), sev)
        for flag, fam, col, op, limit, sev in C.GUARDRAILS
    ]


GUARDRAIL_VARIANTS = {
    "baseline": {},
    "tighter_leverage": {"leverage": 0.9},
    "looser_leverage": {"leverage": 1.1},
    "tighter_liquidity": {"liquidity": 1.1},
    "higher_interest_coverage": {"interest_coverage": 1.25},
}
