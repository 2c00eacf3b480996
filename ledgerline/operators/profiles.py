"""Cluster profiles, ranks, representatives and label comparisons."""

from pyspark.sql import DataFrame, Window as W, functions as F

from .. import constants as C
from ..functions.scalars import case_map, existing, numeric, rounded, with_exprs
from .panel import first_per_group
from .quantiles import label_medians, label_quantiles

SEGMENT_CLUSTER = [C.SEGMENT_COL, "cluster"]


def _join(left: DataFrame, right: DataFrame, keys) -> DataFrame:
    """Null-safe join of two tables with one row per label."""
    named = right.withColumnsRenamed({k: f"r_{k}" for k in keys})
    cond = [F.col(k).eqNullSafe(F.col(f"r_{k}")) for k in keys]
    return left.join(named, cond).drop(*[f"r_{k}" for k in keys])


def cluster_sizes(df: DataFrame, keys=("cluster",)) -> DataFrame:
    issuers = F.count_distinct("ticker") if "ticker" in df.columns else F.count("*")
    return df.groupBy(*keys).agg(F.count("*").alias("issuer_years"), issuers.alias("issuers"))


def cluster_profile(df: DataFrame, keys=None, features=None) -> DataFrame:
    """Sizes and exact medians per segment and cluster; the medians run apart from the distinct count."""
    keys = list(keys or SEGMENT_CLUSTER)
    df = df.dropna(subset=keys)
    features = numeric(df, features or C.PROFILE_FEATURES)
    sizes = cluster_sizes(df, keys)
    return _join(sizes, label_medians(df, keys, features), keys)


def cluster_medians(df: DataFrame, keys=None, features=None, digits: int = 3) -> DataFrame:
    keys = list(keys or SEGMENT_CLUSTER)
    df = df.dropna(subset=keys)
    features = numeric(df, features or C.PROFILE_FEATURES)
    out = label_medians(df, keys, features, prefix="")
    return out.selectExpr(*keys, *[f"{rounded(c, digits)} as {c}" for c in features])


def model_profile(df: DataFrame, digits: int = 6) -> DataFrame:
    """The wide median table that is stored with a model."""
    return cluster_medians(df, ["cluster"], C.MODEL_PROFILE, digits)


def feature_extremes(df: DataFrame, features=None, probs=None, digits: int = 3) -> DataFrame:
    features = numeric(df, features or C.PROFILE_FEATURES)
    long = label_quantiles(df, [], features, list(probs or C.EXTREME_QUANTILES))
    return with_exprs(long, {"value": rounded("value", digits)})


def industry_mix(df: DataFrame, sector: str = "major_sector") -> DataFrame:
    """Rows per segment, cluster and sector; the window runs over the few grouped rows only."""
    counts = (
        df.dropna(subset=[*SEGMENT_CLUSTER, sector])
        .groupBy(*SEGMENT_CLUSTER, sector).agg(F.count("*").alias("row_count"))
    )
    out = counts.withColumn("cluster_total", F.sum("row_count").over(W.partitionBy(*SEGMENT_CLUSTER)))
    return out.withColumn("pct_of_cluster", F.col("row_count") / F.col("cluster_total")).orderBy(
        *SEGMENT_CLUSTER, F.desc("pct_of_cluster"), sector)


def rating_ranks(profile: DataFrame, score: str = "median_scorecard_credit_score", labels=None) -> DataFrame:
    """Rank the clusters of a segment by median score, the least risky first."""
    labels = labels or C.RANK_LABELS
    if score not in profile.columns:
        return profile.withColumns({
            "rating_style_rank": F.lit(None).cast("int"), "rating_style_label": F.lit(C.UNRANKED)})
    order = W.partitionBy(C.SEGMENT_COL).orderBy(F.col(score).asc_nulls_last(), F.desc("issuer_years"), "cluster")
    ranked = profile.withColumn("rating_style_rank", F.when(F.col(score).isNotNull(), F.row_number().over(order)))
    return with_exprs(ranked, {"rating_style_label": case_map("rating_style_rank", labels, C.UNRANKED)})


def label_maps(ranked: DataFrame, segment: str = C.TARGET_SEGMENT) -> tuple[dict, dict]:
    """Cluster -> label and cluster -> rank of one segment (one row per cluster)."""
    rows = ranked.filter(F.col(C.SEGMENT_COL) == segment).select(
        "cluster", "rating_style_label", "rating_style_rank").dropna(subset=["cluster"]).collect()
    labels = {int(x["cluster"]): x["rating_style_label"] for x in rows}
    return labels, {int(x["cluster"]): int(x["rating_style_rank"]) for x in rows if x["rating_style_rank"] is not None}


def label_table(ranked: DataFrame, segment: str = C.TARGET_SEGMENT) -> DataFrame:
    """cluster, label, rank of one segment as a table."""
    return ranked.filter(F.col(C.SEGMENT_COL) == segment).dropna(subset=["cluster"]).select(
        F.col("cluster").cast("int").alias("cluster"), F.col("rating_style_label").alias("label"), F.col("rating_style_rank").cast("int").alias("rank"))


def _unique_text(c: str, n: int, separator: str):
    pairs = F.array_sort(F.collect_list(F.when(F.col(c).isNotNull(), F.struct("row_in_group", F.col(c).cast("string").alias("v")))))
    return F.array_join(F.slice(F.array_distinct(F.transform(pairs, lambda p: p["v"])), 1, n), separator)


def representatives(df: DataFrame, n: int = 10, features=None) -> DataFrame:
    """Companies nearest to the median of their cluster.

    Each task keeps its n nearest rows per cluster before the shuffle, so the
    texts are put together from n rows, however large the cluster is.
    """
    keys = SEGMENT_CLUSTER
    df = df.dropna(subset=keys)
    features = existing(df, features or C.DOMAINS)
    medians = label_medians(df, keys, features, prefix="m_").withColumnsRenamed({k: f"r_{k}" for k in keys})
    # One row per cluster: the broadcast is bounded by the number of clusters.
    joined = df.join(F.broadcast(medians), [F.col(k).eqNullSafe(F.col(f"r_{k}")) for k in keys])
    gap = " + ".join(f"coalesce(pow({f} - m_{f}, 2), 0D)" for f in features)
    near = with_exprs(joined, {"distance": f"round(sqrt({gap}), 10)"})
    order = ["distance", *existing(df, ["ticker", "fiscal_year"])]
    top = first_per_group(near, keys, order, n)
    texts = {
        "representative_tickers": ("ticker", n, ", "),
        "sample_companies": ("company_name", 5, " | "),
        "sample_years": ("fiscal_year", n, ", "),
    }
    have = set(df.columns)
    return top.groupBy(*keys).agg(*[
        _unique_text(c, m, sep).alias(name) for name, (c, m, sep) in texts.items() if c in have
    ])


def with_representatives(ranked: DataFrame, chosen: DataFrame) -> DataFrame:
    return ranked.join(chosen, SEGMENT_CLUSTER, "left")


def profile_by_label(df: DataFrame, label: str, features) -> DataFrame:
    """Rows and medians by any label column; a null label is a group of its own.

    The label must be a clustering result: the median step broadcasts one row per label.
    """
    features = existing(df, features)
    rows = df.groupBy(label).agg(F.count("*").alias("rows"))
    return _join(rows, label_medians(df, [label], features), [label])


def crosstab(df: DataFrame, a: str, b: str, normalize: str | None = None) -> DataFrame:
    """Contingency table of two labelings in long form: counts, or shares of row, column or all."""
    counts = df.dropna(subset=[a, b]).groupBy(a, b).agg(F.count("*").alias("n"))
    if normalize is None:
        return counts
    over = {"index": W.partitionBy(a), "columns": W.partitionBy(b), "all": W.partitionBy(F.lit(1))}[normalize]
    return counts.withColumn("share", F.col("n") / F.sum("n").over(over))


def crosstab_shares(df: DataFrame, a: str, b: str) -> DataFrame:
    """Counts of all label pairs with their shares of row, column and whole table, from one count."""
    counts = df.dropna(subset=[a, b]).groupBy(a, b).agg(F.count("*").alias("n"))
    over = {"row_share": W.partitionBy(a), "column_share": W.partitionBy(b), "share": W.partitionBy(F.lit(1))}  # label pairs only
    return counts.withColumns({name: F.col("n") / F.sum("n").over(w) for name, w in over.items()})


def monotonicity(ranked: DataFrame, features=None) -> DataFrame:
    """Does each risk median rise with the rank?  One row per feature and rank."""
    features = [f"median_{f}" for f in (features or [*C.DOMAINS, "scorecard_credit_score"])]
    long = ranked.filter("rating_style_rank is not null").select(C.SEGMENT_COL, "rating_style_rank", *features).unpivot(
        [C.SEGMENT_COL, "rating_style_rank"], features, "feature", "value")
    order = W.partitionBy(C.SEGMENT_COL, "feature").orderBy("rating_style_rank")
    return with_exprs(long.withColumn("previous", F.lag("value").over(order)), {"weakens": "value >= previous"})
