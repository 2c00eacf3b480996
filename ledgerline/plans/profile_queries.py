"""Queries: filters, profiles, windows and joins (P*, G*, W*, J*)."""

from pyspark.sql import functions as F

from .. import constants as C
from ..functions import scalars as X
from ..operators import filters as Fi, profiles as Pr, scoring as Sc
from ..operators.quantiles import label_medians
from .oracle import CTES, PRESENT, cols, lit, r
from .registry import Data, query, shape

KEYS = ["ticker", "fiscal_year"]
MEDS = [f"median_{f}" for f in C.PROFILE_FEATURES]
CTES["prof"] = "SELECT financial_flag, cluster, count(*) AS issuer_years, count(DISTINCT ticker) AS issuers, " + ", ".join(
    f"median({f}) AS median_{f}" for f in C.PROFILE_FEATURES) + " FROM clustered GROUP BY 1,2"
_labels = "CASE rating_style_rank " + " ".join(f"WHEN {k} THEN {lit(v)}" for k, v in C.RANK_LABELS.items()) + " ELSE 'Unranked' END"
CTES["ranked"] = f"""SELECT *, {_labels} AS rating_style_label FROM (SELECT *, CAST(row_number() OVER (PARTITION BY financial_flag
 ORDER BY median_scorecard_credit_score, issuer_years DESC, cluster) AS INTEGER) AS rating_style_rank FROM prof)"""
PROFILE = ["financial_flag", "cluster", "issuer_years", "issuers", *MEDS]


def ranked(d: Data):
    return Pr.rating_ranks(Pr.cluster_profile(d.clustered()))


@query("segment_filter", "SELECT ticker, fiscal_year, financial_flag FROM panel WHERE financial_flag='Non-financial'")
def _(d):
    return Fi.segment_rows(d.panel()).select(*KEYS, "financial_flag")


@query("drop_null_keys", "SELECT ticker, sic, fiscal_year FROM panel WHERE sic IS NOT NULL AND fiscal_year IS NOT NULL")
def _(d):
    return Fi.drop_null_keys(d.panel(), ["sic", "fiscal_year"]).select("ticker", "sic", "fiscal_year")


@query("feature_availability", " UNION ALL ".join(
    f"SELECT '{f}' AS feature, {r(f'count({f})/count(*)::DOUBLE')} AS availability FROM feat WHERE financial_flag='Non-financial'" for f in C.DOMAINS))
def _(d):
    return Fi.availability(d.non_financial()).selectExpr("feature", f"{X.rounded('availability')} as availability")


@query("min_non_null_features", " UNION ALL ".join(
    f"SELECT {n} AS k, greatest(4, CAST(ceil({n}*0.6) AS INTEGER)) AS features_present, (SELECT count(*) FROM feat WHERE {PRESENT}>=greatest(4, CAST(ceil({n}*0.6) AS INTEGER))) AS rows"
    for n in (4, 6, 8)))
def _(d):
    feats = d.feats().selectExpr(f"{X.count_present(C.DOMAINS)} as have").groupBy("have").agg(F.count("*").alias("c"))
    limits = d.spark.createDataFrame([(n, Fi.min_present(n)) for n in (4, 6, 8)], "k int, features_present int")
    # At most seven counted rows against three limits.
    joined = limits.join(feats, feats["have"] >= limits["features_present"], "left")
    return joined.groupBy("k", "features_present").agg(F.coalesce(F.sum("c"), F.lit(0)).alias("rows"))


@query("row_coverage_filter", f"SELECT ticker, fiscal_year, {PRESENT} AS features_present FROM feat WHERE {PRESENT}>=4")
def _(d):
    return Fi.row_coverage(d.feats()).selectExpr(*KEYS, f"{X.count_present(C.DOMAINS)} as features_present")


_usable = f"count(*) FILTER (WHERE {PRESENT}>=4 AND ticker IS NOT NULL AND fiscal_year IS NOT NULL)"
_nf = "(" + "+".join(f"CAST(count({f})>0 AS INTEGER)" for f in C.DOMAINS) + ")"
STATUS = f"""SELECT financial_flag AS segment, CASE WHEN financial_flag<>'Non-financial' THEN 'skipped_not_target_segment'
 WHEN {_usable}<500 OR {_nf}<4 THEN 'skipped' ELSE 'clustered' END AS status,
 CASE WHEN financial_flag<>'Non-financial' THEN count(*) ELSE {_usable} END AS rows,
 CASE WHEN financial_flag<>'Non-financial' THEN 0 ELSE {_nf} END AS features FROM feat GROUP BY financial_flag"""


@query("segment_eligibility", STATUS)
def _(d):
    return Fi.segment_status(d.feats())


@query("segment_metrics", f"SELECT s.*, 4 AS min_non_null_features FROM ({STATUS}) s")
def _(d):
    return Fi.segment_status(d.feats()).withColumn("min_non_null_features", F.lit(Fi.min_present(len(C.DOMAINS))))


_ops = [("current_ratio", "<", 1.0), ("debt_to_assets", ">=", 0.45), ("quick_ratio", "<=", 0.5), ("cash_to_assets", ">", 0.1), ("negative_equity_flag", "==", 1.0)]


@query("rule_compare", "SELECT ticker, fiscal_year, " + ", ".join(
    f"coalesce({c} {'=' if op == '==' else op} {t}, false) AS rule_{i}" for i, (c, op, t) in enumerate(_ops)) + " FROM feat")
def _(d):
    rules = {f"rule_{i}": X.rule_holds(c, op, t) for i, (c, op, t) in enumerate(_ops)}
    return X.with_exprs(d.feats(), rules).select(*KEYS, *rules)


@query("deterministic_sample", "SELECT ticker, fiscal_year FROM feat WHERE financial_flag='Non-financial' ORDER BY md5('42|'||ticker||'|'||fiscal_year), ticker, fiscal_year LIMIT 1000")
def _(d):
    return Fi.deterministic_sample(d.non_financial(), 1000, KEYS).select(*KEYS)


@query("cluster_profile", f"SELECT {cols(PROFILE)} FROM prof")
def _(d):
    return shape(Pr.cluster_profile(d.clustered()), PROFILE)


@query("cluster_medians", "SELECT financial_flag, cluster, " + ", ".join(f"{r(f'median_{f}', 3)} AS {f}" for f in C.PROFILE_FEATURES) + " FROM prof")
def _(d):
    return Pr.cluster_medians(d.clustered())


_probs = "[" + ", ".join(str(p) for p in C.EXTREME_QUANTILES) + "]"
CTES["extremes"] = "SELECT " + ", ".join(f"quantile_cont({f}, {_probs}) AS {f}" for f in C.PROFILE_FEATURES) + " FROM clustered"


@query("feature_extremes", f"""SELECT feature, prob::DOUBLE AS prob, {r('v', 3)} AS value FROM (
 SELECT feature, unnest({_probs}) AS prob, unnest(vals) AS v FROM (UNPIVOT extremes ON {', '.join(C.PROFILE_FEATURES)} INTO NAME feature VALUE vals))""")
def _(d):
    return Pr.feature_extremes(d.clustered())


@query("industry_cluster_mix", f"SELECT *, {r('row_count/cluster_total::DOUBLE')} AS pct_of_cluster FROM (SELECT financial_flag, cluster, major_sector, count(*) AS row_count, CAST(sum(count(*)) OVER (PARTITION BY financial_flag, cluster) AS BIGINT) AS cluster_total FROM clustered GROUP BY 1,2,3)")
def _(d):
    return X.with_exprs(Pr.industry_mix(d.clustered()), {"pct_of_cluster": X.rounded("pct_of_cluster")})


@query("share_within_group", f"SELECT fiscal_year, major_sector, n, {r('n/sum(n) OVER (PARTITION BY fiscal_year)::DOUBLE')} AS share FROM (SELECT fiscal_year, major_sector, count(*) AS n FROM panel GROUP BY 1,2)")
def _(d):
    return X.with_exprs(Pr.crosstab(d.panel(), "fiscal_year", "major_sector", "index"), {"share": X.rounded("share")})


@query("cluster_sizes", "SELECT cluster, issuer_years, issuers FROM prof")
def _(d):
    return Pr.cluster_sizes(d.clustered())


@query("artifact_profile", "SELECT cluster, " + ", ".join(f"{r(f'median({f})')} AS {f}" for f in C.MODEL_PROFILE) + " FROM clustered GROUP BY 1")
def _(d):
    return Pr.model_profile(d.clustered())


_alt = "CASE WHEN scorecard_credit_score>=20 THEN CAST(floor(scorecard_credit_score/20) AS INTEGER) END"
CTES["alt"] = f"SELECT *, {_alt} AS band FROM clustered"


def with_band(d: Data):
    """A second labeling: 20-point bands of the score, none below 20."""
    return X.with_exprs(d.clustered(), {"band": "case when scorecard_credit_score >= 20 then cast(floor(scorecard_credit_score / 20) as int) end"})


@query("profile_by_label", f"SELECT band, count(*) AS rows, {', '.join(r(f'median({f})') + f' AS median_{f}' for f in C.DOMAINS)} FROM alt GROUP BY 1")
def _(d):
    out = Pr.profile_by_label(with_band(d), "band", C.DOMAINS)
    return out.selectExpr("band", "rows", *[f"{X.rounded(f'median_{f}')} as median_{f}" for f in C.DOMAINS])


CTES["xtab"] = "SELECT cluster, band, count(*) AS n FROM alt WHERE band IS NOT NULL GROUP BY 1,2"


@query("label_crosstab", f"SELECT cluster, band, n, {r('n/sum(n) OVER (PARTITION BY cluster)::DOUBLE')} AS row_share, {r('n/sum(n) OVER (PARTITION BY band)::DOUBLE')} AS column_share, {r('n/sum(n) OVER ()::DOUBLE')} AS share FROM xtab")
def _(d):
    table = Pr.crosstab_shares(with_band(d).select("cluster", "band"), "cluster", "band")
    return X.with_exprs(table, {name: X.rounded(name) for name in ("row_share", "column_share", "share")})


@query("profile_monotonicity", " UNION ALL ".join(
    f"SELECT financial_flag, rating_style_rank, 'median_{f}' AS feature, {r(f'median_{f}')} AS value, {r(f'lag(median_{f}) OVER w')} AS previous, median_{f}>=lag(median_{f}) OVER w AS weakens FROM ranked WINDOW w AS (PARTITION BY financial_flag ORDER BY rating_style_rank)"
    for f in [*C.DOMAINS, "scorecard_credit_score"]))
def _(d):
    return X.with_exprs(Pr.monotonicity(ranked(d)), {"value": X.rounded("value"), "previous": X.rounded("previous")})


@query("rating_style_rank", "SELECT financial_flag, cluster, issuer_years, rating_style_rank FROM ranked")
def _(d):
    return ranked(d).select("financial_flag", "cluster", "issuer_years", "rating_style_rank")


@query("rating_style_label", "SELECT financial_flag, cluster, rating_style_label FROM ranked")
def _(d):
    return ranked(d).select("financial_flag", "cluster", "rating_style_label")


@query("rating_label_maps", "SELECT cluster, rating_style_label AS label, rating_style_rank AS rank FROM ranked WHERE financial_flag='Non-financial'")
def _(d):
    return Pr.label_table(ranked(d))


_gap = "+".join(f"coalesce(pow(c.{f}-m.{f},2),0)" for f in C.DOMAINS)
CTES["dmed"] = "SELECT financial_flag, cluster, " + ", ".join(f"median({f}) AS {f}" for f in C.DOMAINS) + " FROM clustered GROUP BY 1,2"
CTES["near"] = f"""SELECT * FROM (SELECT c.financial_flag, c.cluster, ticker, company_name, fiscal_year, row_number() OVER (
 PARTITION BY c.financial_flag, c.cluster ORDER BY {r(f'sqrt({_gap})', 10)}, ticker, fiscal_year) AS rn
 FROM clustered c JOIN dmed m USING (financial_flag, cluster)) WHERE rn<=10"""


def _texts(c, n, sep):
    return f"(SELECT array_to_string(list(v ORDER BY o)[1:{n}], '{sep}') FROM (SELECT CAST({c} AS VARCHAR) AS v, min(rn) AS o FROM near x WHERE x.cluster=near.cluster AND x.financial_flag=near.financial_flag GROUP BY 1))"


CTES["reps"] = f"SELECT DISTINCT financial_flag, cluster, {_texts('ticker', 10, ', ')} AS representative_tickers, {_texts('company_name', 5, ' | ')} AS sample_companies, {_texts('fiscal_year', 10, ', ')} AS sample_years FROM near"


@query("representatives", "SELECT * FROM reps")
def _(d):
    return Pr.representatives(d.clustered())


@query("merge_profile_representatives", "SELECT financial_flag, cluster, issuer_years, rating_style_rank, representative_tickers, sample_companies, sample_years FROM ranked LEFT JOIN reps USING (financial_flag, cluster)")
def _(d):
    c = d.clustered()
    out = Pr.with_representatives(Pr.rating_ranks(Pr.cluster_profile(c)), Pr.representatives(c))
    return out.select("financial_flag", "cluster", "issuer_years", "rating_style_rank", "representative_tickers", "sample_companies", "sample_years")


@query("label_map_join", f"SELECT ticker, fiscal_year, cluster, rating_style_label AS cluster_label, rating_style_rank AS risk_rank FROM clustered JOIN ranked USING (financial_flag, cluster)")
def _(d):
    c = d.clustered()
    maps = Pr.rating_ranks(Pr.cluster_profile(c, features=["scorecard_credit_score"])).selectExpr(
        "financial_flag", "cluster", "rating_style_label as cluster_label", "rating_style_rank as risk_rank")
    # One row per cluster.
    return c.join(F.broadcast(maps), ["financial_flag", "cluster"], "left").select(*KEYS, "cluster", "cluster_label", "risk_rank")


@query("union_frames", f"SELECT ticker, fiscal_year, {r('assets', 2)} AS assets, CAST(NULL AS DOUBLE) AS risk FROM panel WHERE financial_flag='Financial' UNION ALL SELECT ticker, fiscal_year, NULL, {r('leverage_risk')} FROM feat WHERE financial_flag<>'Financial'")
def _(d):
    feats = d.feats()
    a = shape(feats.filter("financial_flag = 'Financial'"), [*KEYS, "assets"])
    b = feats.filter("financial_flag <> 'Financial'").selectExpr(*KEYS, f"{X.rounded('leverage_risk')} as risk")
    return a.unionByName(b, allowMissingColumns=True)


@query("best_row_select", f"SELECT cluster, issuer_years, {r('median_scorecard_credit_score')} AS score FROM prof ORDER BY issuer_years DESC, cluster LIMIT 1")
def _(d):
    p = Pr.cluster_profile(d.clustered(), features=["scorecard_credit_score"])
    return p.orderBy(F.desc("issuer_years"), "cluster").limit(1).selectExpr("cluster", "issuer_years", f"{X.rounded('median_scorecard_credit_score')} as score")
