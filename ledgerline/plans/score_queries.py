"""Queries: scoring, outlook, guardrails, scenarios and report tables (K*, D*, R*)."""

from pyspark.sql import Window as W, functions as F

from .. import constants as C
from ..functions import scalars as X
from ..operators import guardrails as Gu, outlook as Ou, profiles as Pr, reports as Re, scenarios as Sn, scoring as Sc
from ..sources import model_store as Ms
from .oracle import CTES, RANKS, SCENARIO_SQL, cols, guard_ctes, hits, kind, lit, r
from .registry import Data, query, shape

KEYS = ["ticker", "fiscal_year"]
FIVE = range(5)
DIST = [f"cluster_{i}_distance" for i in FIVE]
AFF = [f"cluster_{i}_affinity" for i in FIVE]


def scored(key, names):
    names = [*KEYS, *names]

    @query(key, f"SELECT {cols(names)} FROM scored")
    def run(d: Data):
        return shape(d.scored(), names)


def guarded(key, names):
    names = [*KEYS, *names]

    @query(key, f"SELECT {cols(names)} FROM guarded")
    def run(d: Data):
        return shape(d.guarded(), names)


scored("score_companies", [
    "company_name", "assigned_cluster", "cluster_label", "risk_rank", "distance_to_assigned_cluster", "cluster_affinity",
    "near_default_affinity", *DIST, *AFF, "scorecard_credit_score", "feature_coverage_pct", "warning_flags",
])
scored("centroid_distances", DIST)
scored("soft_affinity", AFF)
scored("cluster_affinity", ["assigned_cluster", "cluster_affinity", *AFF])
scored("near_default_affinity", ["near_default_affinity"])
scored("warning_flags", ["warning_flags"])
_adjacent = [
    "assigned_cluster", "risk_rank", "upper_bucket_cluster", "upper_bucket_label", "distance_to_upper_bucket",
    "lower_bucket_cluster", "lower_bucket_label", "distance_to_lower_bucket",
]
scored("adjacent_rank_join", _adjacent)
scored("adjacent_bucket_distances", [*_adjacent, "upper_distance_ratio_to_assigned", "lower_distance_ratio_to_assigned"])
scored("outlook_flag", ["outlook_flag", "outlook_reason"])


@query("infer_near_default_cluster", "SELECT assigned_cluster AS cluster, risk_rank, count(*) AS n FROM scored WHERE risk_rank=(SELECT max(risk_rank) FROM scored) GROUP BY 1,2")
def _(d):
    model = d.model()
    s = d.scored().filter(f"assigned_cluster = {model.near_default}")
    return s.groupBy(F.col("assigned_cluster").alias("cluster"), "risk_rank").agg(F.count("*").alias("n"))


@query("resolve_segment_model", "SELECT assigned_cluster, count(*) AS n FROM scored GROUP BY 1")
def _(d):
    models = {C.TARGET_SEGMENT: d.model()}
    model = Sc.resolve_model(models, C.TARGET_SEGMENT)
    return Sc.assign_clusters(d.stored_feats(), model, "assigned_cluster").groupBy("assigned_cluster").agg(F.count("*").alias("n"))


def band(key, builder, source, sql_case):
    @query(key, f"SELECT ticker, fiscal_year, {sql_case} AS band FROM scored")
    def run(d: Data):
        return d.scored().selectExpr(*KEYS, f"{builder()} as band")


band("score_band", Sc.score_band, "scorecard_credit_score", "CASE WHEN scorecard_credit_score IS NULL THEN NULL WHEN scorecard_credit_score<20 THEN 'Strong model-relative profile' WHEN scorecard_credit_score<40 THEN 'Generally sound profile' WHEN scorecard_credit_score<60 THEN 'Elevated / mixed risk profile' WHEN scorecard_credit_score<80 THEN 'Weak profile' ELSE 'Distress-like profile' END")
band("affinity_band", Sc.affinity_band, "cluster_affinity", "CASE WHEN cluster_affinity>0.7 THEN 'clear' WHEN cluster_affinity>=0.4 THEN 'moderate' ELSE 'borderline' END")
band("coverage_band", Sc.coverage_band, "feature_coverage_pct", "CASE WHEN feature_coverage_pct=1 THEN 'full' WHEN feature_coverage_pct>=0.8 THEN 'strong' WHEN feature_coverage_pct>=0.67 THEN 'acceptable' ELSE 'weak' END")
band("near_default_band", Sc.near_default_band, "near_default_affinity", "CASE WHEN near_default_affinity<0.1 THEN 'low' WHEN near_default_affinity<0.25 THEN 'some' WHEN near_default_affinity<=0.5 THEN 'review' ELSE 'dominant' END")

# --- guardrails -------------------------------------------------------------
CTES["flagged"] = " UNION ALL ".join(
    f"SELECT ticker, fiscal_year, risk_rank, '{f}' AS flag, '{fam}' AS family, '{sev}' AS severity FROM scored WHERE {c}"
    for f, fam, sev, c in hits())


@query("unpivot_flags", "SELECT ticker, fiscal_year, flag, family, severity FROM flagged")
def _(d):
    return Gu.guardrail_hits(d.scored(), KEYS)


@query("ratio_guardrails", "SELECT ticker, fiscal_year, flag, severity FROM flagged WHERE family IN ('leverage','debt_service','liquidity','structural')")
def _(d):
    return Gu.guardrail_hits(d.scored().drop("risk_rank"), KEYS).select(*KEYS, "flag", "severity")


@query("contradiction_guardrails", "SELECT ticker, fiscal_year, flag, severity FROM flagged WHERE family='contradiction'")
def _(d):
    return Gu.guardrail_hits(d.scored(), KEYS).filter("family = 'contradiction'").select(*KEYS, "flag", "severity")


guarded("apply_guardrails", C.GUARDRAIL_COLUMNS)
guarded("guardrail_summary_text", ["guardrail_summary"])
guarded("analyst_interpretation_text", ["analyst_interpretation"])
guarded("commercial_conclusion_text", ["commercial_conclusion"])

_ratings = ["Ba2 / BB", "BBB-", "B+", "stable", "", "Debt BBB", "AA+ stable", "CCC", None, "outlook A-"]
_bad = {"Ba2 / BB", "B+", "Debt BBB", "CCC"}
_rating = "CASE length(ticker)+fiscal_year%7 " + " ".join(f"WHEN {i + 2} THEN {'NULL' if t is None else lit(t)}" for i, t in enumerate(_ratings)) + " END"


@query("external_rating_guardrail", f"SELECT ticker, fiscal_year, rating, coalesce(rating IN ({', '.join(lit(t) for t in sorted(_bad))}), false) AS speculative FROM (SELECT ticker, fiscal_year, {_rating} AS rating FROM panel)")
def _(d):
    hits_ = " ".join(f"when {i + 2} then {X.text(t)}" for i, t in enumerate(_ratings))
    p = X.with_exprs(d.panel(), {"rating": f"case length(ticker) + fiscal_year % 7 {hits_} end"})
    return p.selectExpr(*KEYS, "rating", f"{Gu.speculative_rating('rating')} as speculative")


_families = ["leverage", "debt_service", "liquidity", "structural", "contradiction"]


@query("guardrail_family_rates", " UNION ALL ".join(
    f"SELECT '{f}' AS family, (SELECT count(*) FROM (SELECT DISTINCT ticker, fiscal_year FROM flagged WHERE family='{f}')) AS companies_hit, (SELECT count(*) FROM scored) AS companies"
    for f in _families))
def _(d):
    return Gu.family_rates(d.scored(), KEYS).select("family", F.col("companies_hit").cast("bigint").alias("companies_hit"), "companies")


# --- profile comparison -----------------------------------------------------
CTES["cprof"] = "SELECT cluster, " + ", ".join(f"median({m}) AS p_{m}" for m in C.COMPARE_METRICS) + " FROM clustered GROUP BY 1"
_cmp = " UNION ALL ".join(
    f"SELECT ticker, fiscal_year, '{m}' AS metric, {m} AS v, p_{m} AS p FROM scored JOIN cprof ON assigned_cluster=cluster" for m in C.COMPARE_METRICS)
COMPARE = f"""SELECT ticker, fiscal_year, metric, {r('v', 4)} AS company_value, {r('p', 4)} AS assigned_cluster_median, {r('v-p', 4)} AS difference,
 CASE WHEN v-p>1e-9 THEN 'above_cluster_median' WHEN v-p<-1e-9 THEN 'below_cluster_median' ELSE 'equal_to_cluster_median' END AS relative_position FROM ({_cmp})"""


def compared(d):
    c = d.clustered()
    profile = Pr.cluster_medians(c, ["cluster"], C.COMPARE_METRICS, digits=10)
    out = Re.compare_to_profile(d.scored(), profile, KEYS)
    near = "case when abs(difference) <= 1e-9D then 'equal_to_cluster_median' else relative_position end"
    return out.selectExpr(*KEYS, "metric", *[f"{X.rounded(x, 4)} as {x}" for x in ("company_value", "assigned_cluster_median", "difference")], f"{near} as relative_position")


@query("compare_to_cluster_profile", COMPARE)
def _(d):
    return compared(d)


@query("cluster_comparison", COMPARE)
def _(d):
    return compared(d)


@query("company_vs_profile_join", f"SELECT ticker, fiscal_year, assigned_cluster, {r('current_ratio')} AS current_ratio, {r('p_current_ratio')} AS p_current_ratio FROM scored JOIN cprof ON assigned_cluster=cluster")
def _(d):
    profile = Pr.cluster_medians(d.clustered(), ["cluster"], ["current_ratio"], digits=10).selectExpr("cluster as assigned_cluster", "current_ratio as p_current_ratio")
    out = d.scored().select(*KEYS, "assigned_cluster", "current_ratio").join(F.broadcast(profile), "assigned_cluster")
    return shape(out, [*KEYS, "assigned_cluster", "current_ratio", "p_current_ratio"])


# --- scenarios --------------------------------------------------------------
INPUTS = [c for c in C.SCENARIO_INPUTS if c != "ebitda"]


@query("make_scenarios", f"SELECT {cols([*KEYS, *INPUTS])} FROM scen")
def _(d):
    return shape(Sn.make_scenarios(d.panel()), [*KEYS, *INPUTS])


@query("scenario_rescoring", f"SELECT {cols([*KEYS, *C.SCENARIO_SUMMARY_COLUMNS])} FROM sguarded")
def _(d):
    return shape(d.scenarios(), [*KEYS, *C.SCENARIO_SUMMARY_COLUMNS])


_lvl = "list_position([" + ", ".join(lit(s) for s in C.SEVERITIES) + "], {})"


CTES["srank"] = f"""SELECT ticker, fiscal_year, scenario, risk_rank, scorecard_credit_score AS s, outlook_flag,
 {_lvl.format('guardrail_level')} AS lvl FROM sguarded"""
_base = "max({}) FILTER (WHERE scenario='base') OVER (PARTITION BY ticker, fiscal_year)"


@query("scenario_migration", f"""SELECT ticker, fiscal_year, scenario, CAST(risk_rank-{_base.format('risk_rank')} AS INTEGER) AS rank_change,
 {r(f"s-{_base.format('s')}")} AS score_change, outlook_flag<>{_base.format('outlook_flag')} AS outlook_changed,
 CAST(lvl-{_base.format('lvl')} AS INTEGER) AS level_change FROM srank""")
def _(d):
    out = Sn.scenario_migration(d.scenarios(), KEYS)
    return out.selectExpr(*KEYS, "scenario", "rank_change", f"{X.rounded('score_change')} as score_change", "outlook_changed", "level_change")


# --- migration over years ---------------------------------------------------
CTES["moves"] = """SELECT ticker, fiscal_year, risk_rank, scorecard_credit_score AS s, lag(risk_rank) OVER w AS previous_rank,
 lag(scorecard_credit_score) OVER w AS ps, lag(fiscal_year) OVER w AS py FROM scored WINDOW w AS (PARTITION BY ticker ORDER BY fiscal_year)"""


def moves(d):
    w = W.partitionBy("ticker").orderBy("fiscal_year")
    s = d.scored().select(*KEYS, "risk_rank", "scorecard_credit_score")
    return s.withColumns({
        "previous_rank": F.lag("risk_rank").over(w), "previous_year": F.lag("fiscal_year").over(w),
        "previous_score": F.lag("scorecard_credit_score").over(w)})


@query("issuer_year_migration", f"SELECT ticker, fiscal_year, risk_rank, previous_rank, py AS previous_year, risk_rank-previous_rank AS rank_change, {r('s-ps')} AS score_change FROM moves")
def _(d):
    return moves(d).selectExpr(*KEYS, "risk_rank", "previous_rank", "previous_year", "risk_rank - previous_rank as rank_change", f"{X.rounded('scorecard_credit_score - previous_score')} as score_change")


@query("migration_matrix", "SELECT previous_rank, risk_rank, count(*) AS n FROM moves WHERE py=fiscal_year-1 GROUP BY 1,2")
def _(d):
    return moves(d).filter("previous_year = fiscal_year - 1").groupBy("previous_rank", "risk_rank").agg(F.count("*").alias("n"))


# --- report tables ----------------------------------------------------------
def report(key, build, names, source, keys=KEYS):
    names = list(dict.fromkeys([*keys, *names]))

    @query(key, f"SELECT {cols(names)} FROM {source}")
    def run(d: Data):
        return shape(build(d), names)


def keyed(fn, source):
    """Report selection plus the issuer key, so that rows of equal names stay apart."""
    def build(d):
        df = source(d)
        return df.select(*dict.fromkeys([*KEYS, *fn(df).columns]))
    return build


_g, _s = (lambda d: d.guarded()), (lambda d: d.scenarios())
report("score_summary", keyed(Re.score_summary, _g), C.SUMMARY_COLUMNS, "guarded")
report("company_ratios", keyed(Re.company_ratios, _g), ["company_name", *C.RATIOS], "guarded")
report("scored_file", keyed(Re.scored_file, _g), [*C.SUMMARY_COLUMNS, *C.RATIOS], "guarded")
report("join_score_ratios", keyed(Re.scored_file, _g), ["company_name", "risk_rank", "scorecard_credit_score", *C.RATIOS[:12]], "guarded")
report("scenario_input_snapshot", keyed(Re.scenario_inputs, _s), C.SCENARIO_INPUTS, "sguarded")
report("scenario_score_summary", keyed(Re.scenario_summary, _s), C.SCENARIO_SUMMARY_COLUMNS, "sguarded")
report("scenario_ratios", keyed(Re.scenario_ratios, _s), ["scenario", *C.RATIOS], "sguarded")
report("scenario_file", keyed(lambda df: Re.scenario_file(df, display=True), _s), [*C.SCENARIO_SUMMARY_COLUMNS, *C.SCENARIO_DIAGNOSTICS], "sguarded")
_gt = [*C.GUARDRAIL_CONTEXT, *C.GUARDRAIL_COLUMNS]


@query("guardrails_table", f"SELECT {cols([c for c in _gt if c not in ('scope', 'scenario')])}, 'base_case' AS scope, 'base' AS scenario FROM guarded UNION ALL SELECT {cols([c for c in _gt if c not in ('scope', 'scenario')])}, 'scenario' AS scope, scenario FROM sguarded")
def _(d):
    return shape(Re.guardrails_table(d.guarded(), d.scenarios()), _gt)


def named_sql(pairs, name_col, value_col, keep_null=True):
    out = " UNION ALL ".join(
        f"SELECT ticker, fiscal_year, {lit(n)} AS {name_col}, {r(c, 2 if kind(c) == 'money' else 6)} AS {value_col} FROM scored" + ("" if keep_null else f" WHERE {c} IS NOT NULL")
        for n, c in pairs)
    return out


@query("scorecard_dimension_table", named_sql(C.DIMENSION_NAMES, "dimension", "score"))
def _(d):
    return X.with_exprs(Re.dimension_table(d.scored(), KEYS), {"score": X.rounded("score")})


@query("financial_scale_table", named_sql(C.SCALE_NAMES, "metric", "value", keep_null=False))
def _(d):
    return X.with_exprs(Re.scale_table(d.scored(), KEYS), {"value": X.rounded("value", 2)})


@query("key_ratio_table", named_sql(C.KEY_RATIO_NAMES, "ratio", "value"))
def _(d):
    return X.with_exprs(Re.key_ratio_table(d.scored(), KEYS), {"value": X.rounded("value")})


_nar = lit(C.NARRATIVE_TEXT).replace("{company}", "'||company_name||'").replace("{label}", "'||cluster_label||'").replace(
    "{score}", "'||coalesce(CAST(CAST(round(CAST(scorecard_credit_score AS DECIMAL(38,10)), 1) AS DECIMAL(10,1)) AS VARCHAR), 'n/a')||'").replace("{outlook}", "'||outlook_flag||'")


@query("executive_narrative", f"SELECT ticker, fiscal_year, {_nar} AS narrative FROM scored")
def _(d):
    return d.scored().selectExpr(*KEYS, f"{Re.narrative()} as narrative")


@query("kpi_table", f"SELECT ticker, fiscal_year, cluster_label, risk_rank, {r('scorecard_credit_score')} AS scorecard_credit_score, outlook_flag, {r('near_default_affinity')} AS near_default_affinity, 'v4_scorecard_ebitda' AS model_version, 'Non-financial' AS segment, 'KMeans credit risk clustering' AS model_type, 'n/a' AS currency FROM scored")
def _(d):
    out = Re.kpi_table(d.scored(), d.model(), KEYS)
    return X.with_exprs(out, {c: X.rounded(c) for c in ("scorecard_credit_score", "near_default_affinity")})
