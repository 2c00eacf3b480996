"""Neighbouring buckets of a scored row, and the outlook read from their distances."""

from pyspark.sql import DataFrame, functions as F

from .. import constants as C
from ..functions.scalars import case_map, num, require_columns, text, with_exprs
from .scoring import Model


def adjacent_buckets(df: DataFrame, model: Model) -> DataFrame:
    """Cluster, label and distance of rank-1 (upper) and rank+1 (lower), from the distances already there."""
    require_columns(df, ["assigned_cluster", "risk_rank", "distance_to_assigned_cluster"], "scored data")
    by_rank = {rank: cluster for cluster, rank in model.ranks.items()}
    clusters = {}
    for side, step in (("upper", -1), ("lower", 1)):
        near = {rank: by_rank[rank + step] for rank in by_rank if rank + step in by_rank}
        body = case_map("risk_rank", near) if near else "null"
        clusters[f"{side}_bucket_cluster"] = f"cast({body} as int)"
    df = with_exprs(df, clusters)
    out = {}
    for side in ("upper", "lower"):
        which = f"{side}_bucket_cluster"
        hits = " ".join(f"when {i} then cluster_{i}_distance" for i in range(model.k))
        out[f"{side}_bucket_label"] = case_map(which, model.labels)
        out[f"distance_to_{side}_bucket"] = f"case {which} {hits} end"
    df = with_exprs(df, out)
    return with_exprs(df, {
        f"{side}_distance_ratio_to_assigned": (
            f"case when distance_to_assigned_cluster > 0 "
            f"then distance_to_{side}_bucket / distance_to_assigned_cluster end"
        )
        for side in ("upper", "lower")
    })


def outlook(
    df: DataFrame,
    neutral_band: float = C.NEUTRAL_BAND,
    up_boundary: float = C.BOUNDARY,
    down_boundary: float = C.BOUNDARY,
) -> DataFrame:
    """Positive / Neutral / Negative position between the neighbours, with its reason."""
    d, up, low = "distance_to_assigned_cluster", "distance_to_upper_bucket", "distance_to_lower_bucket"
    near_up = f"{up} <= {d} * {num(up_boundary)}"
    near_low = f"{low} <= {d} * {num(down_boundary)}"
    band = f"{d} * {num(neutral_band)}"
    reasons = [
        ("risk_rank is null", None),
        (f"{d} is null", "missing"),
        (f"{up} is null and {low} is null", "no_neighbours"),
        (f"{up} is null and {near_low}", "lower_near"),
        (f"{up} is null", "lower_far"),
        (f"{low} is null and {near_up}", "upper_near"),
        (f"{low} is null", "upper_far"),
        (f"{low} - {up} > {band} and {near_up}", "positive"),
        (f"{low} - {up} < -({band}) and {near_low}", "negative"),
    ]
    chain = " ".join(f"when {cond} then {text(code)}" for cond, code in reasons)
    flags = {"lower_near": "Negative", "negative": "Negative", "upper_near": "Positive", "positive": "Positive"}
    df = with_exprs(df, {"reason_code": f"case {chain} else 'neutral' end"})
    return with_exprs(df, {
        "outlook_flag": f"case when reason_code is not null then {case_map('reason_code', flags, 'Neutral')} end",
        "outlook_reason": case_map("reason_code", C.OUTLOOK_TEXT),
    }).drop("reason_code")


def with_outlook(df: DataFrame, model: Model, **options) -> DataFrame:
    return outlook(adjacent_buckets(df, model), **options)
