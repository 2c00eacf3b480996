"""Queries: robustness jobs (X*)."""

from pyspark.sql import functions as F

from .. import constants as C
from ..functions import scalars as X
from ..operators import cluster as Cl, filters as Fi, guardrails as Gu, robustness as Ro, scoring as Sc
from ..operators.quantiles import label_quantiles
from .ml_queries import KEYS, keyed_points
from .oracle import CENTROIDS, CTES, PRESENT, feature_ctes, guard_ctes, mean_of, r
from .registry import POINTS, Data, query

FACTORS = {"minus20": -0.2, "minus10": -0.1, "plus10": 0.1, "plus20": 0.2}


@query("seed_stability")
def _(d):
    return Ro.seed_stability(keyed_points(d), 6)


@query("bootstrap_stability")
def _(d):
    return Ro.bootstrap_stability(keyed_points(d), 6)


@query("leave_one_domain_out")
def _(d):
    return Ro.leave_one_out(keyed_points(d), C.DOMAINS)


for _name, _factor in FACTORS.items():
    feature_ctes(f"t{_name[0]}{'b' if '20' in _name else 'a'}", "panel", rules=Ro.scaled_rules(_factor))


@query("threshold_sensitivity", " UNION ALL ".join(
    f"""SELECT '{n}' AS variant, count(*) AS rows, {r('avg(v.scorecard_credit_score-f.scorecard_credit_score)')} AS mean_shift,
 {r('max(abs(v.scorecard_credit_score-f.scorecard_credit_score))')} AS max_shift FROM t{n[0]}{'b' if '20' in n else 'a'} v JOIN feat f USING (ticker, fiscal_year)"""
    for n in FACTORS))
def _(d):
    """All variants are scored in one scan; only their shifts leave it."""
    base = d.stored_feats().withColumn("base_score", F.col("scorecard_credit_score"))
    for name, factor in FACTORS.items():
        base = Ro.rescore(base, Ro.scaled_rules(factor)).withColumn(f"moved_{name}", F.col("scorecard_credit_score") - F.col("base_score"))
    rows = ", ".join(f"named_struct('variant', '{n}', 'shift', moved_{n})" for n in FACTORS)
    return base.selectExpr(f"inline(array({rows}))").groupBy("variant").agg(
        F.count("*").alias("rows"), F.avg("shift").alias("mean_shift"), F.max(F.abs("shift")).alias("max_shift"),
    ).selectExpr("variant", "rows", f"{X.rounded('mean_shift')} as mean_shift", f"{X.rounded('max_shift')} as max_shift")


def refits(d, variants, baseline="baseline"):
    out = Ro.refit_stability(variants, C.DOMAINS, KEYS, baseline)
    return out.select("variant", "common_rows", "ari", "nmi")


@query("threshold_refit")
def _(d):
    """Thresholds moved, features engineered and KMeans fitted anew: agreement with the baseline labels."""
    feats = d.stored_feats()
    variants = {"baseline": (Fi.eligible_rows(feats), None)}
    variants |= {n: (Fi.eligible_rows(Ro.rescore(feats, Ro.scaled_rules(f))), None) for n, f in FACTORS.items()}
    return refits(d, variants)


@query("imputation_refit")
def _(d):
    """Gaps filled in other ways and KMeans fitted anew."""
    rows = Fi.eligible_rows(d.stored_feats())
    high = {q["feature"]: q["value"] for q in label_quantiles(rows, [], C.DOMAINS, [0.75]).collect()}
    return refits(d, {
        "baseline": (rows, None), "complete_case": (rows.dropna(subset=C.DOMAINS), None),
        "midpoint": (rows, dict.fromkeys(C.DOMAINS, 0.5)), "conservative": (rows, high)})


@query("coverage_refit")
def _(d):
    """Stricter and looser rules on how many features a row needs, KMeans fitted anew on what they keep."""
    use = Fi.drop_null_keys(Fi.segment_rows(d.stored_feats()))
    variants = {f"min_{m}": (use.filter(f"{X.count_present(C.DOMAINS)} >= {m}"), None) for m in (3, 4, 5, 6)}
    return refits(d, variants, "min_4")


@query("weight_sensitivity", " UNION ALL ".join(
    f"SELECT '{n}' AS weight_set, cluster, count(*) AS rows, {r('avg(100*' + mean_of(w) + ')')} AS mean_score FROM clustered GROUP BY cluster"
    for n, w in C.WEIGHT_SETS.items()))
def _(d):
    scores = Ro.weight_table(d.clustered(), C.WEIGHT_SETS, ["cluster"])
    return scores.groupBy("weight_set", "cluster").agg(F.count("*").alias("rows"), F.expr(f"{X.rounded('avg(score)')} as mean_score"))


@query("weight_sensitivity_dirichlet")
def _(d):
    """Per random weight vector: is the risk order of the clusters that of the default weights?"""
    sets = {"baseline": C.SCORE_WEIGHTS, **Ro.dirichlet_sets(40)}
    means = Ro.weight_table(d.clustered(), sets, ["cluster"]).groupBy("weight_set", "cluster").agg(F.avg("score").alias("s"))
    order = means.groupBy("weight_set").agg(F.expr("transform(array_sort(collect_list(struct(s, cluster))), t -> t.cluster) as ladder"))
    base = order.filter("weight_set = 'baseline'").select(F.col("ladder").alias("base_ladder"))
    joined = order.filter("weight_set <> 'baseline'").withColumn("k_", F.lit(1)).join(base.withColumn("k_", F.lit(1)), "k_")
    return joined.selectExpr("weight_set", "ladder = base_ladder as order_kept")


CTES["worse"] = "SELECT " + ", ".join(f"quantile_cont({f}, 0.75) AS w_{f}" for f in C.DOMAINS) + " FROM feat WHERE financial_flag='Non-financial'"


def _near(fills):
    d2 = ["(" + "+".join(f"({x}-{v})*({x}-{v})" for x, v in zip(fills, c)) + ")" for c in CENTROIDS]
    return f"CASE {' '.join(f'WHEN {x}=least({chr(44).join(d2)}) THEN {i}' for i, x in enumerate(d2))} END"


CTES["imputed"] = f"""SELECT cluster, {PRESENT} AS have, {_near([f'coalesce({f}, 0.5)' for f in C.DOMAINS])} AS mid,
 {_near([f'coalesce({f}, w_{f})' for f in C.DOMAINS])} AS worse FROM clustered, worse"""


@query("imputation_sensitivity", """SELECT 'complete_case' AS variant, count(*) FILTER (WHERE have=6) AS rows, count(*) FILTER (WHERE have=6) AS same FROM imputed
 UNION ALL SELECT 'midpoint', count(*), count(*) FILTER (WHERE mid=cluster) FROM imputed
 UNION ALL SELECT 'conservative', count(*), count(*) FILTER (WHERE worse=cluster) FROM imputed""")
def _(d):
    """Rows that keep their cluster when gaps are filled in another way (fixed centroids)."""
    use = d.stored_feats().filter("financial_flag = 'Non-financial'")
    high = {q["feature"]: q["value"] for q in label_quantiles(use, [], C.DOMAINS, [0.75]).collect()}
    c = d.clustered()

    def label(fill):
        # Text of the nearest-centroid rule over columns filled another way.
        names = {f"x_{i}": f"coalesce({f}, {X.num(fill[f])})" for i, f in enumerate(C.DOMAINS)}
        body = Cl.label_text(CENTROIDS, 6)
        for x, e in names.items():
            body = body.replace(x, e)
        return body

    both = c.selectExpr(
        "cluster", f"{X.count_present(C.DOMAINS)} as have",
        f"{label(dict.fromkeys(C.DOMAINS, 0.5))} as mid", f"{label(high)} as worse")
    rows = both.selectExpr("""inline(array(
        named_struct('variant', 'complete_case', 'used', have = 6, 'same', have = 6),
        named_struct('variant', 'midpoint', 'used', true, 'same', mid = cluster),
        named_struct('variant', 'conservative', 'used', true, 'same', worse = cluster)))""")
    return rows.groupBy("variant").agg(
        F.expr("count(*) filter (where used) as rows"), F.expr("count(*) filter (where same) as same"))


@query("coverage_sensitivity", " UNION ALL ".join(
    f"SELECT {m} AS min_features, (SELECT count(*) FROM feat WHERE financial_flag='Non-financial' AND {PRESENT}>={m}) AS rows" for m in (3, 4, 5, 6)))
def _(d):
    have = d.stored_feats().filter("financial_flag = 'Non-financial'").selectExpr(f"{X.count_present(C.DOMAINS)} as have")
    settings = ", ".join(f"named_struct('min_features', {m}, 'kept', have >= {m})" for m in (3, 4, 5, 6))
    return have.selectExpr(f"inline(array({settings}))").groupBy("min_features").agg(F.expr("count(*) filter (where kept) as rows"))


for _i, _v in enumerate(Ro.GUARDRAIL_VARIANTS.values()):
    guard_ctes(f"gv{'abcde'[_i]}", "scored", rules=Ro.scaled_guardrails(_v))


@query("guardrail_sensitivity", " UNION ALL ".join(
    f"SELECT '{n}' AS variant, guardrail_level, count(*) AS rows FROM gv{'abcde'[i]} GROUP BY 2" for i, n in enumerate(Ro.GUARDRAIL_VARIANTS)))
def _(d):
    variants = {name: Ro.scaled_guardrails(v) for name, v in Ro.GUARDRAIL_VARIANTS.items()}
    return Gu.guardrail_levels(d.scored(), variants).groupBy("variant", "guardrail_level").agg(F.count("*").alias("rows"))


def _soft(t):
    total = "(" + "+".join(f"exp(-cluster_{i}_distance/{t})" for i in range(5)) + ")"
    return f"exp(-distance_to_assigned_cluster/{t})/{total}", f"exp(-cluster_2_distance/{t})/{total}"


@query("temperature_sensitivity", " UNION ALL ".join(
    f"SELECT {t}::DOUBLE AS temperature, {r(f'avg({_soft(t)[0]})')} AS mean_affinity, {r(f'avg({_soft(t)[1]})')} AS mean_near_default, count(*) FILTER (WHERE {_soft(t)[0]}>0.7) AS clear FROM scored"
    for t in C.TEMPERATURES))
def _(d):
    names = [f"cluster_{i}_distance" for i in range(5)]
    rows = []
    for t in C.TEMPERATURES:
        a = Sc.affinities(names, t)
        top = f"greatest({', '.join(a.values())})"
        rows.append(f"named_struct('temperature', {X.num(t)}, 'affinity', {top}, 'near', {a['cluster_2_affinity']})")
    long = d.scored().select(*names).selectExpr(f"inline(array({', '.join(rows)}))")
    return long.groupBy("temperature").agg(
        F.expr(f"{X.rounded('avg(affinity)')} as mean_affinity"), F.expr(f"{X.rounded('avg(near)')} as mean_near_default"),
        F.expr("count(*) filter (where affinity > 0.7D) as clear"))
