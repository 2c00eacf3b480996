"""Row and feature filters that decide what may be clustered."""

import math

from pyspark.sql import DataFrame, functions as F

from .. import constants as C
from ..functions.scalars import count_present, existing, sealed, text, with_exprs


def segment_rows(df: DataFrame, segment: str = C.TARGET_SEGMENT, column: str = C.SEGMENT_COL) -> DataFrame:
    return df.filter(F.col(column).cast("string") == segment)


def drop_null_keys(df: DataFrame, keys=("ticker", "fiscal_year")) -> DataFrame:
    return df.dropna(subset=existing(df, keys))


def segment_features(segment: str, column: str = C.SEGMENT_COL, mapping: dict | None = None) -> list:
    """Features a segment is clustered on; financial and unknown firms have none."""
    if column == C.SEGMENT_COL:
        known = mapping or {"Financial": [], C.TARGET_SEGMENT: list(C.DOMAINS), "Unknown": []}
        return list(known.get(segment, []))
    return [] if segment == C.FINANCE_SECTOR else list(C.DOMAINS)


def availability(df: DataFrame, features=None) -> DataFrame:
    """Share of rows that have each feature, best first: one aggregation, then an unpivot of one row."""
    features = existing(df, features or C.DOMAINS)
    one = df.agg(*[F.expr(f"count({c}) / count(*) as {c}") for c in features])
    return one.unpivot([], features, "feature", "availability").orderBy(F.desc("availability"), "feature")


def select_features(df: DataFrame, requested=None, min_coverage: float = 0.0) -> list:
    """Usable features, best covered first; at most one small row per feature reaches the driver."""
    rows = availability(df, requested).collect()
    return [r["feature"] for r in rows if (r["availability"] or 0) >= min_coverage and (r["availability"] or 0) > 0]


def min_present(n_features: int, min_features: int = C.MIN_FEATURES, share: float = C.ROW_COVERAGE) -> int:
    return min_features if n_features <= 0 else max(min_features, math.ceil(n_features * share))


def row_coverage(df: DataFrame, features=None, min_features: int = C.MIN_FEATURES, share: float = C.ROW_COVERAGE) -> DataFrame:
    features = list(C.DOMAINS if features is None else features)
    if not features:
        return df
    return sealed(df).filter(f"{count_present(features)} >= {min_present(len(features), min_features, share)}")


def eligible_rows(df: DataFrame, segment: str = C.TARGET_SEGMENT, column: str = C.SEGMENT_COL, features=None) -> DataFrame:
    return df.transform(segment_rows, segment, column).transform(drop_null_keys).transform(row_coverage, features)


def segment_status(
    df: DataFrame, targets=(C.TARGET_SEGMENT,), column: str = C.SEGMENT_COL, min_rows: int = C.MIN_SEGMENT_ROWS
) -> DataFrame:
    """Which segments can be clustered: one grouped pass over all of them."""
    need = min_present(len(C.DOMAINS))
    enough = f"{count_present(C.DOMAINS)} >= {need} and ticker is not null and fiscal_year is not null"
    counts = df.filter(f"{column} is not null").groupBy(column).agg(
        F.expr(f"count(*) as all_rows"),
        F.expr(f"count(*) filter (where {enough}) as usable_rows"),
        F.expr("cast(" + " + ".join(f"if(count({d}) > 0, 1, 0)" for d in C.DOMAINS) + " as int) as usable_features"),
    )
    wanted = ", ".join(text(t) for t in targets)
    out = with_exprs(counts, {"status": (
        f"case when {column} not in ({wanted}) then 'skipped_not_target_segment' "
        f"when usable_rows < {min_rows} or usable_features < {C.MIN_FEATURES} then 'skipped' else 'clustered' end"
    )})
    return with_exprs(out, {
        "rows": "if(status = 'skipped_not_target_segment', all_rows, usable_rows)",
        "features": "if(status = 'skipped_not_target_segment', 0, usable_features)",
    }).select(F.col(column).alias("segment"), "status", "rows", "features")


def deterministic_sample(df: DataFrame, n: int, keys, seed: int = C.SEED) -> DataFrame:
    """At most n rows, chosen by a seeded hash of the key: the same rows on every cluster layout.

    Ordered by the hash with a limit: each task keeps its first n rows only.
    """
    tag = F.md5(F.concat_ws("|", F.lit(str(seed)), *[F.col(k).cast("string") for k in keys]))
    return df.withColumn("sample_hash", tag).orderBy("sample_hash", *keys).limit(n).drop("sample_hash")
