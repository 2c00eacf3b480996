"""Report tables: column selections and unpivots of scored rows, for every company at once."""

from pyspark.sql import DataFrame, functions as F

from .. import constants as C
from ..functions.scalars import existing, text, with_exprs


def pick(df: DataFrame, names) -> DataFrame:
    """The columns of a report that the data has, in report order, each once."""
    return df.select(*existing(df, names))


def score_summary(scored):
    return pick(scored, C.SUMMARY_COLUMNS)


def company_ratios(scored):
    return pick(scored, ["company_name", *C.RATIOS])


def scored_file(scored):
    """Summary and ratios side by side, taken from the same row: repeated names cannot multiply rows."""
    return pick(scored, [*C.SUMMARY_COLUMNS, *C.RATIOS])


def scenario_inputs(scenarios):
    return pick(scenarios, C.SCENARIO_INPUTS)


def scenario_summary(scored):
    return pick(scored, C.SCENARIO_SUMMARY_COLUMNS)


def scenario_ratios(scored):
    return pick(scored, ["scenario", *C.RATIOS])


def scenario_file(scored, display: bool = False):
    extra = C.SCENARIO_DIAGNOSTICS if display else C.RATIOS
    return pick(scored, [*C.SCENARIO_SUMMARY_COLUMNS, *extra])


def guardrails_table(scored: DataFrame | None, scenarios: DataFrame | None) -> DataFrame:
    """Base rows and scenario rows in one audit table."""
    columns = [*C.GUARDRAIL_CONTEXT, *C.GUARDRAIL_COLUMNS]
    frames = []
    if scored is not None:
        base = scored.withColumn("scope", F.lit("base_case"))
        frames.append(base if "scenario" in base.columns else base.withColumn("scenario", F.lit("base")))
    if scenarios is not None:
        frames.append(scenarios.withColumn("scope", F.lit("scenario")))
    if not frames:
        raise ValueError("guardrails_table needs scored rows, scenario rows or both")
    frames = [pick(f, columns) for f in frames]
    out = frames[0] if len(frames) == 1 else frames[0].unionByName(frames[1], allowMissingColumns=True)
    return pick(out, columns)


def named_rows(df: DataFrame, keys, pairs, name_col: str, value_col: str, keep_null: bool = True) -> DataFrame:
    """Unpivot to display names: one row per key and listed metric."""
    have = set(df.columns)
    pairs = [(label, c) for label, c in pairs if c in have]
    body = ", ".join(f"{text(label)}, cast({c} as double)" for label, c in pairs)
    out = df.selectExpr(*keys, f"stack({len(pairs)}, {body}) as ({name_col}, {value_col})")
    return out if keep_null else out.filter(F.col(value_col).isNotNull())


def dimension_table(scored, keys):
    return named_rows(scored, keys, C.DIMENSION_NAMES, "dimension", "score")


def scale_table(scored, keys):
    return named_rows(scored, keys, C.SCALE_NAMES, "metric", "value", keep_null=False)


def key_ratio_table(scored, keys):
    return named_rows(scored, keys, C.KEY_RATIO_NAMES, "ratio", "value")


def narrative() -> str:
    parts = (
        text(C.NARRATIVE_TEXT)
        .replace("{company}", "', coalesce(company_name, 'The company'), '")
        .replace("{label}", "', coalesce(cluster_label, 'unlabelled risk group'), '")
        .replace("{score}", "', case when scorecard_credit_score is null then 'n/a' else format_string('%.1f', round(round(scorecard_credit_score, 10), 1)) end, '")
        .replace("{outlook}", "', coalesce(outlook_flag, 'Neutral'), '")
    )
    return f"concat({parts})"


def kpi_table(scored: DataFrame, model, keys) -> DataFrame:
    """Key figures with the metadata of the model; the metadata are a few literals."""
    currency = "coalesce(currency, 'n/a')" if "currency" in scored.columns else "'n/a'"
    return scored.selectExpr(
        *keys, "cluster_label", "risk_rank", "scorecard_credit_score", "outlook_flag", "near_default_affinity",
        f"{text(model.version)} as model_version", f"{text(model.segment)} as segment",
        "'KMeans credit risk clustering' as model_type", f"{currency} as currency",
    )


def compare_to_profile(scored: DataFrame, profile: DataFrame, keys) -> DataFrame:
    """Company metrics next to the medians of its cluster: difference and position.

    profile has one row per cluster, so its size is the number of clusters.
    """
    have, there = set(scored.columns), set(profile.columns)
    metrics = []
    for m in C.COMPARE_METRICS:
        source = m if m in there else f"median_{m}"
        if m in have and source in there:
            metrics.append((m, source))
    if not metrics:
        raise ValueError("No comparable metrics found in the scored rows and the profile.")
    side = profile.selectExpr("cast(cluster as int) as assigned_cluster", *[f"cast({s} as double) as p_{m}" for m, s in metrics])
    joined = scored.select(*keys, "assigned_cluster", *[m for m, _ in metrics]).join(F.broadcast(side), "assigned_cluster")
    body = ", ".join(f"{text(m)}, cast({m} as double), p_{m}" for m, _ in metrics)
    long = joined.selectExpr(
        *keys, "assigned_cluster",
        f"stack({len(metrics)}, {body}) as (metric, company_value, assigned_cluster_median)",
    )
    out = with_exprs(long, {"difference": "company_value - assigned_cluster_median"})
    return with_exprs(out, {"relative_position": (
        "case when difference > 0 then 'above_cluster_median' when difference < 0 then 'below_cluster_median' "
        "else 'equal_to_cluster_median' end"
    )})
