"""A fitted model as a set of small Parquet tables."""

from pyspark.sql import DataFrame, SparkSession, functions as F

from .. import constants as C
from ..operators.scoring import Model
from .tables import exists

METRICS = ("inertia", "silhouette_squared", "calinski_harabasz", "davies_bouldin")
TABLES = {
    "model_meta": "segment string, version string, k int, feature_count int, primary_segment boolean",
    "model_features": "segment string, position int, feature string",
    "model_centroids": "segment string, cluster int, feature string, value double",
    "model_imputer": "segment string, feature string, median double",
    "model_labels": "segment string, cluster int, risk_rank int, label string",
    "winsor_caps": "segment string, feature string, low double, high double",
    "model_metrics": f"segment string, status string, rows bigint, {', '.join(f'{m} double' for m in METRICS)}",
    "model_sizes": "segment string, cluster int, rows bigint",
}


def validate(model: Model) -> Model:
    problems = []
    if not model.features:
        problems.append("features")
    if not model.centroids or any(len(c) != len(model.features) for c in model.centroids):
        problems.append("centroids")
    if set(model.features) - set(model.medians):
        problems.append("medians")
    if set(model.ranks) - set(range(model.k)) or set(model.labels) - set(range(model.k)):
        problems.append("labels")
    if problems:
        raise ValueError(f"Model for segment {model.segment!r} has missing or inconsistent parts: {problems}")
    return model


def save(spark: SparkSession, models: dict, folder: str, primary: str = C.TARGET_SEGMENT, profile: DataFrame | None = None) -> str:
    """Write all segments; sizes are segments x clusters x features."""
    rows = {name: [] for name in TABLES}
    for segment, m in models.items():
        validate(m)
        rows["model_meta"].append((segment, m.version, m.k, len(m.features), segment == primary))
        rows["model_features"] += [(segment, i, f) for i, f in enumerate(m.features)]
        rows["model_centroids"] += [(segment, c, f, float(v)) for c, p in enumerate(m.centroids) for f, v in zip(m.features, p)]
        rows["model_imputer"] += [(segment, f, float(m.medians[f])) for f in m.features]
        rows["model_labels"] += [(segment, c, m.ranks.get(c), m.labels.get(c)) for c in range(m.k)]
        rows["model_metrics"].append((segment, m.meta.get("status"), m.meta.get("rows"), *[m.meta.get(k) for k in METRICS]))
        rows["model_sizes"] += [(segment, c, n) for c, n in sorted(m.meta.get("sizes", {}).items())]
        rows["winsor_caps"] += [(segment, f, low, high) for f, (low, high) in (m.caps or {}).items()]
    for name, schema in TABLES.items():
        spark.createDataFrame(rows[name], schema).coalesce(1).write.mode("overwrite").parquet(f"{folder}/{name}")
    profiles = [profile] if profile is not None else [m.profile for m in models.values() if m.profile is not None]
    profile = profiles[0] if profiles else None
    for more in profiles[1:]:
        profile = profile.unionByName(more, allowMissingColumns=True)
    if profile is not None:
        profile.write.mode("overwrite").parquet(f"{folder}/model_profile")
    return folder


def load(spark: SparkSession, folder: str) -> dict:
    """Segment -> model with its metrics, cluster sizes and profile (if stored), with checks on what is missing."""
    stored_profile = spark.read.parquet(f"{folder}/model_profile") if exists(spark, f"{folder}/model_profile") else None
    data = {name: spark.read.schema(schema).parquet(f"{folder}/{name}").collect() for name, schema in TABLES.items()}
    models = {}
    for meta in data["model_meta"]:
        mine = {name: [r for r in rows if r["segment"] == meta["segment"]] for name, rows in data.items()}
        features = [r["feature"] for r in sorted(mine["model_features"], key=lambda r: r["position"])]
        values = {(r["cluster"], r["feature"]): r["value"] for r in mine["model_centroids"]}
        missing = [(c, f) for c in range(meta["k"]) for f in features if (c, f) not in values]
        if missing:
            raise ValueError(f"Model store {folder}: centroids missing for {missing[:3]}")
        profile = None if stored_profile is None else stored_profile.filter(F.col(C.SEGMENT_COL) == meta["segment"])
        # One row per cluster.
        profile_ranks = {} if profile is None or "rating_style_rank" not in profile.columns else {
            r[0]: r[1] for r in profile.select("cluster", "rating_style_rank").collect() if r[1] is not None}
        metrics = mine["model_metrics"][0].asDict() if mine["model_metrics"] else {}
        models[meta["segment"]] = validate(Model(
            profile=profile, profile_ranks=profile_ranks,
            meta={k: v for k, v in metrics.items() if k != "segment" and v is not None}
            | {"sizes": {r["cluster"]: r["rows"] for r in mine["model_sizes"]}},
            segment=meta["segment"], features=features, version=meta["version"],
            centroids=[[values[c, f] for f in features] for c in range(meta["k"])],
            medians={r["feature"]: r["median"] for r in mine["model_imputer"]},
            labels={r["cluster"]: r["label"] for r in mine["model_labels"] if r["label"] is not None},
            ranks={r["cluster"]: r["risk_rank"] for r in mine["model_labels"] if r["risk_rank"] is not None},
            caps={r["feature"]: (r["low"], r["high"]) for r in mine["winsor_caps"]} or None,
        ))
    return models


def summary(spark: SparkSession, folder: str) -> DataFrame:
    """One row per segment: version, size and worst cluster."""
    read = lambda name: spark.read.schema(TABLES[name]).parquet(f"{folder}/{name}")
    labels = read("model_labels").groupBy("segment").agg(
        F.count("*").alias("labels"), F.max_by("cluster", "risk_rank").alias("near_default_cluster"))
    return read("model_meta").join(labels, "segment", "left")
