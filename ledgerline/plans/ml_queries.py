"""Queries: clustering, validity, agreement and alternative methods (M*)."""

from pyspark.sql import functions as F

from .. import constants as C
from ..functions import scalars as X
from ..operators import cluster as Cl, density as De, filters as Fi, hierarchy as Hi, metrics as Me, projection as Pj, training as Tr
from ..operators.quantiles import median_row
from ..session import new_folder, stored, stored_alone
from ..sources import model_store as Ms
from .oracle import CENTROIDS, CTES, r
from .registry import POINTS, Data, query
from .profile_queries import with_band

KEYS = ["ticker", "fiscal_year"]
CTES["pts"] = "SELECT ticker, fiscal_year, cluster, scorecard_credit_score, " + ", ".join(f"x{i} AS x_{i}" for i in range(6)) + " FROM clustered"
_d2 = ["(" + "+".join(f"(x_{i}-{v})*(x_{i}-{v})" for i, v in enumerate(c)) + ")" for c in CENTROIDS]
_all = "least(" + ", ".join(_d2) + ")"


def points(d: Data, *more):
    return d.clustered().select(*KEYS, "cluster", *POINTS, *more)


def keyed_points(d: Data):
    """Stored points with their row key, for the iterative fits."""
    return d.once("points", lambda: stored(
        d.clustered().select(*KEYS, "cluster", *POINTS).withColumn("row_key", F.xxhash64(*KEYS)), "points"))


@query("median_impute", "SELECT " + ", ".join(["ticker", "fiscal_year"] + [f"{r(f'coalesce({f}, m_{f})')} AS {f}" for f in C.DOMAINS]) + " FROM feat, med WHERE financial_flag='Non-financial'")
def _(d):
    use = d.stored_feats().filter("financial_flag = 'Non-financial'")
    medians = median_row(use, C.DOMAINS)
    filled = X.with_exprs(use, {f: f"coalesce({f}, {X.num(medians[f])})" for f in C.DOMAINS})
    return filled.selectExpr(*KEYS, *[f"{X.rounded(f)} as {f}" for f in C.DOMAINS])


@query("feature_matrix", "SELECT ticker, fiscal_year, " + ", ".join(f"{r(p)} AS {p}" for p in POINTS) + " FROM pts")
def _(d):
    return points(d).selectExpr(*KEYS, *[f"{X.rounded(p)} as {p}" for p in POINTS])


def fitted(d: Data):
    """The best of all restarts on the clustered panel: the KMeans that other methods are compared with."""
    return d.once("kmeans", lambda: Cl.kmeans(keyed_points(d), 6))


def fitted_points(d: Data):
    """Stored points with the clusters of the fitted KMeans."""
    return d.once("fitted_points", lambda: stored(
        keyed_points(d).selectExpr(*KEYS, *POINTS, "row_key", f"{Cl.label_text(fitted(d).centroids, 6)} as cluster"), "fitted"))


@query("kmeans_fit")
def _(d):
    fit = fitted(d)
    body = f"{Cl.label_text(fit.centroids, 6)} as cluster"
    return keyed_points(d).selectExpr(body, *POINTS).groupBy("cluster").agg(
        F.count("*").alias("rows"), *[F.avg(p).alias(p) for p in POINTS])


@query("kmeans_fit_facts", """SELECT count(*) AS rows, 5 AS clusters, true AS stationary, true AS sizes_sum_up, true AS inertia_agrees,
 true AS best_of_all FROM pts""")
def _(d):
    """What must hold of the fitted centroids, from plain aggregations of the points: they are the means of the rows nearest to
    them, the stored inertia is the sum of the rows' distances, and no worse than after three passes from fixed starts."""
    import numpy as np

    fit, table = fitted(d), keyed_points(d)
    best = f"least({', '.join(Cl.distance_text(c, 6) for c in fit.centroids)})"
    rows = table.selectExpr(f"{Cl.label_text(fit.centroids, 6)} as c", f"{best} as d", *POINTS).groupBy("c").agg(
        F.count("*").alias("n"), F.sum("d").alias("d"), *[F.avg(p).alias(p) for p in POINTS]).collect()  # one row per cluster
    moved = sum(float(((np.array([r[p] for p in POINTS]) - fit.centroids[r["c"]]) ** 2).sum()) for r in rows)
    spread = float(np.mean(table.agg(*[F.var_pop(p) for p in POINTS]).first()))
    inertia = sum(r["d"] for r in rows)
    fixed = Cl.fit_many(table, 6, [Cl.Spec("fixed")], max_iter=STEPS, tol=0.0, init=[np.array(CENTROIDS)])[0]
    facts = (sum(r["n"] for r in rows), len(rows), moved <= C.TOL * spread, fit.rows == sum(r["n"] for r in rows),
             abs(inertia - fit.inertia) <= 1e-9 * inertia, fit.inertia <= fixed.inertia * (1 + 1e-9))
    return d.spark.createDataFrame([facts], "rows bigint, clusters int, stationary boolean, sizes_sum_up boolean, inertia_agrees boolean, best_of_all boolean")


@query("kmeans_assign", f"SELECT ticker, fiscal_year, CAST(CASE {' '.join(f'WHEN {x}={_all} THEN {i}' for i, x in enumerate(_d2))} END AS INTEGER) AS cluster FROM pts")
def _(d):
    return points(d).selectExpr(*KEYS, f"{Cl.label_text(CENTROIDS, 6)} as cluster")


@query("lloyd_step", "SELECT cluster, count(*) AS rows, " + ", ".join(f"{r(f'avg({p})')} AS {p}" for p in POINTS) + " FROM pts GROUP BY 1")
def _(d):
    import numpy as np

    cells = Cl.lloyd_pass(keyed_points(d), 6, [Cl.Spec("fixed")], [np.array(CENTROIDS)])
    rows = [(c, int(cell[0]), *[float(v / cell[0]) for v in cell[2:]]) for c, cell in enumerate(cells[0]) if cell[0]]
    out = d.spark.createDataFrame(rows, "cluster int, rows bigint, " + ", ".join(f"{p} double" for p in POINTS))
    return out.selectExpr("cluster", "rows", *[f"{X.rounded(p)} as {p}" for p in POINTS])


STEPS = 3
CTES["step0"] = "SELECT * FROM (VALUES " + ", ".join(f"({i}, {', '.join(f'{v}::DOUBLE' for v in c)})" for i, c in enumerate(CENTROIDS)) + ") v(c, " + ", ".join(f"c{i}" for i in range(6)) + ")"
_to = "+".join(f"(x_{i}-c{i})*(x_{i}-c{i})" for i in range(6))
for _t in range(STEPS):
    CTES[f"near{_t}"] = f"SELECT ticker, fiscal_year, arg_min(c, {_to}) AS c, min({_to}) AS d FROM pts, step{_t} GROUP BY 1, 2"
    CTES[f"step{_t + 1}"] = f"SELECT n.c, {', '.join(f'avg(x_{i}) AS c{i}' for i in range(6))} FROM pts JOIN near{_t} n USING (ticker, fiscal_year) GROUP BY 1"
CTES[f"near{STEPS}"] = f"SELECT ticker, fiscal_year, min({_to}) AS d FROM pts, step{STEPS} GROUP BY 1, 2"


@query("kmeans_fit_from_starts", f"SELECT c AS cluster, {', '.join(f'{r(f"c{i}")} AS x_{i}' for i in range(6))}, (SELECT {r('sum(d)')} FROM near{STEPS}) AS inertia FROM step{STEPS}")
def _(d):
    """The fit itself, with given starts and a fixed number of passes, so that SQL can follow it."""
    import numpy as np

    fit = Cl.fit_many(keyed_points(d), 6, [Cl.Spec("fixed")], max_iter=STEPS, tol=0.0, init=[np.array(CENTROIDS)])[0]
    rows = [(c, *map(float, centre), fit.inertia) for c, centre in enumerate(fit.centroids)]
    out = d.spark.createDataFrame(rows, "cluster int, " + ", ".join(f"{p} double" for p in POINTS) + ", inertia double")
    return out.selectExpr("cluster", *[f"{X.rounded(p)} as {p}" for p in POINTS], f"{X.rounded('inertia')} as inertia")


@query("kmeans_inertia", f"SELECT count(*) AS rows, {r(f'sum({_all})')} AS inertia FROM pts")
def _(d):
    best = f"least({', '.join(Cl.distance_text(c, 6) for c in CENTROIDS)})"
    return points(d).selectExpr(f"{best} as d").agg(F.count("*").alias("rows"), F.expr(f"{X.rounded('sum(d)')} as inertia"))


CTES["csum"] = "SELECT cluster, count(*)::DOUBLE AS n, " + ", ".join(f"sum({p}) AS s{i}, avg({p}) AS c{i}" for i, p in enumerate(POINTS)) + ", sum(" + "+".join(f"{p}*{p}" for p in POINTS) + ") AS q FROM pts GROUP BY 1"
_mean = "+".join(f"pow((SELECT avg({p}) FROM pts), 2)" for p in POINTS)
_own = "+".join(f"pow(x_{i}-c{i},2)" for i in range(6))
CTES["within"] = f"SELECT sum({_own}) AS w, count(*) AS n FROM pts JOIN csum USING (cluster)"
CTES["between"] = "SELECT sum(n*(" + "+".join(f"pow(c{i}-(SELECT avg(x_{i}) FROM pts),2)" for i in range(6)) + ")) AS b, count(*) AS k FROM csum"
CH = f"SELECT {r('(b/(k-1))/(w/(n-k))')} AS calinski_harabasz FROM within, between"
CTES["spread"] = f"SELECT cluster, avg(sqrt({_own})) AS s, " + ", ".join(f"any_value(c{i}) AS c{i}" for i in range(6)) + " FROM pts JOIN csum USING (cluster) GROUP BY 1"
_apart = "sqrt(" + "+".join(f"pow(a.c{i}-b.c{i},2)" for i in range(6)) + ")"
DB = f"SELECT {r('avg(m)')} AS davies_bouldin FROM (SELECT a.cluster, max((a.s+b.s)/{_apart}) AS m FROM spread a JOIN spread b ON a.cluster<>b.cluster GROUP BY 1)"
_dot = "+".join(f"x_{i}*s{i}" for i in range(6))
_sq = "+".join(f"x_{i}*x_{i}" for i in range(6))
CTES["meand"] = f"SELECT p.ticker, p.fiscal_year, p.cluster AS own, c.cluster, c.n, {_sq}-2*({_dot})/n+q/n AS d FROM pts p, csum c"
SIL = f"""SELECT {r('avg(CASE WHEN n=1 THEN 0 ELSE (b-a)/greatest(a,b) END)')} AS silhouette_squared FROM (
 SELECT ticker, fiscal_year, max(CASE WHEN own=cluster THEN n END) AS n, max(CASE WHEN own=cluster THEN d*n/nullif(n-1,0) END) AS a,
 min(CASE WHEN own<>cluster THEN d END) AS b FROM meand GROUP BY 1,2)"""


def validity(d):
    return Me.validity(points(d), "cluster", POINTS)


@query("calinski_harabasz", CH)
def _(d):
    return validity(d).selectExpr(f"{X.rounded('calinski_harabasz')} as calinski_harabasz")


@query("davies_bouldin", DB)
def _(d):
    return validity(d).selectExpr(f"{X.rounded('davies_bouldin')} as davies_bouldin")


@query("silhouette_squared", SIL)
def _(d):
    return validity(d).selectExpr(f"{X.rounded('silhouette_squared')} as silhouette_squared")


CTES["apart"] = "SELECT a.ticker, a.fiscal_year, a.cluster AS own, b.cluster, count(*) AS n, sum(sqrt(" + "+".join(f"(a.x_{i}-b.x_{i})*(a.x_{i}-b.x_{i})" for i in range(6)) + ")) AS s FROM pts a, pts b GROUP BY 1, 2, 3, 4"
CTES["euclid"] = """SELECT avg(CASE WHEN n=1 THEN 0 ELSE (b-a)/greatest(a,b) END) AS s, count(*) AS rows FROM (
 SELECT ticker, fiscal_year, max(CASE WHEN own=cluster THEN n END) AS n, max(CASE WHEN own=cluster THEN s/nullif(n-1,0) END) AS a,
 min(CASE WHEN own<>cluster THEN s/n END) AS b FROM apart GROUP BY 1,2)"""


@query("silhouette", f"SELECT {r('s')} AS silhouette FROM euclid")
def _(d):
    """The Euclidean index; exact while a cluster has at most 4096 rows, an estimate over all rows beyond."""
    return Me.silhouette_euclidean(keyed_points(d), "cluster", POINTS).selectExpr(f"{X.rounded('silhouette_euclidean')} as silhouette")


@query("silhouette_euclidean", f"SELECT rows, {r('s')} AS silhouette_euclidean, 0::DOUBLE AS standard_error FROM euclid")
def _(d):
    return Me.silhouette_euclidean(keyed_points(d), "cluster", POINTS).selectExpr(
        "rows", f"{X.rounded('silhouette_euclidean')} as silhouette_euclidean", f"{X.rounded('standard_error')} as standard_error")


@query("valid_metric_guard", "SELECT 'cluster' AS labels, count(DISTINCT cluster) AS clusters, count(*) AS rows, count(DISTINCT cluster)>=2 AND count(DISTINCT cluster)<count(*) AS valid FROM pts UNION ALL SELECT 'one', 1, count(*), false FROM pts")
def _(d):
    both = points(d).selectExpr("inline(array(named_struct('labels', 'cluster', 'v', cluster), named_struct('labels', 'one', 'v', 1)))", *POINTS)
    out = Me.validity(both, "v", POINTS, ["labels"])
    return out.selectExpr("labels", "clusters", "rows", "calinski_harabasz is not null as valid")


@query("cluster_segment")
def _(d):
    fit = d.once("fit", lambda: Tr.fit_segment(d.stored_feats(), C.TARGET_SEGMENT))
    if fit.clustered is None:
        return d.spark.createDataFrame([fit.metrics], Tr.METRIC_SCHEMA)
    return fit.clustered.select(*KEYS, "cluster", "cluster_key", *C.DOMAINS)


@query("cluster_segments")
def _(d):
    return Tr.fit_segments(d.stored_feats())[1]


@query("evaluate_k_range")
def _(d):
    return Tr.evaluate_k_range(d.stored_feats())


@query("evaluate_segments_k_range")
def _(d):
    return Tr.evaluate_segments(d.stored_feats())


@query("features_for_segment", "SELECT financial_flag, count(*) AS rows, CASE WHEN financial_flag='Non-financial' THEN 6 ELSE 0 END AS features FROM panel GROUP BY 1")
def _(d):
    """Segments of the panel with the number of features each is clustered on."""
    counts = d.panel().groupBy("financial_flag").agg(F.count("*").alias("rows"))
    n = {s: len(Fi.segment_features(s)) for s in ("Financial", C.TARGET_SEGMENT, "Unknown")}
    return X.with_exprs(counts, {"features": X.case_map("financial_flag", n)})


@query("model_store")
def _(d):
    fit = d.once("fit", lambda: Tr.fit_segment(d.stored_feats(), C.TARGET_SEGMENT))
    model = fit.model or d.model()
    folder = Ms.save(d.spark, {model.segment: model}, new_folder(d.spark, "model"), profile=fit.profile)
    loaded = Ms.load(d.spark, folder)[model.segment]
    from ..operators.scoring import assign_clusters

    return assign_clusters(d.stored_feats(), loaded).groupBy("cluster").agg(F.count("*").alias("rows"))


@query("model_store_summary", f"SELECT 'Non-financial' AS segment, 'v4_scorecard_ebitda' AS version, 5 AS k, 6 AS feature_count, true AS primary_segment, 5::BIGINT AS labels, 2 AS near_default_cluster, (SELECT count(*) FROM scored WHERE assigned_cluster=2) AS near_default_rows")
def _(d):
    folder = Ms.save(d.spark, {C.TARGET_SEGMENT: d.model()}, new_folder(d.spark, "model"))
    summary = Ms.summary(d.spark, folder)
    rows = d.scored().groupBy(F.col("assigned_cluster").alias("near_default_cluster")).agg(F.count("*").alias("near_default_rows"))
    return summary.join(rows, "near_default_cluster", "left")


# --- agreement of two labelings --------------------------------------------
CTES["lab"] = "SELECT cluster AS a, CAST(floor(scorecard_credit_score/20) AS INTEGER) AS b FROM clustered WHERE scorecard_credit_score>=20"
CTES["tab"] = "SELECT a, b, count(*)::DOUBLE AS n FROM lab GROUP BY 1,2"
_c2 = "sum(n*(n-1)/2)"
CTES["rand"] = f"""SELECT (SELECT {_c2} FROM tab) AS t, (SELECT {_c2} FROM (SELECT sum(n) AS n FROM tab GROUP BY a)) AS ta,
 (SELECT {_c2} FROM (SELECT sum(n) AS n FROM tab GROUP BY b)) AS tb, (SELECT sum(n)*(sum(n)-1)/2 FROM tab) AS tt"""
CTES["info"] = """SELECT (SELECT sum(tab.n/g.n*ln(tab.n*g.n/(x.n*y.n))) FROM tab, (SELECT sum(n) AS n FROM tab) g,
  (SELECT a, sum(n) AS n FROM tab GROUP BY a) x, (SELECT b, sum(n) AS n FROM tab GROUP BY b) y WHERE x.a=tab.a AND y.b=tab.b) AS mi,
 (SELECT -sum(x.n/g.n*ln(x.n/g.n)) FROM (SELECT a, sum(n) AS n FROM tab GROUP BY a) x, (SELECT sum(n) AS n FROM tab) g) AS ha,
 (SELECT -sum(x.n/g.n*ln(x.n/g.n)) FROM (SELECT b, sum(n) AS n FROM tab GROUP BY b) x, (SELECT sum(n) AS n FROM tab) g) AS hb"""


@query("adjusted_rand_index", f"SELECT {r('(t-ta*tb/tt)/((ta+tb)/2-ta*tb/tt)')} AS ari FROM rand")
def _(d):
    return Me.agreement(with_band(d).select("cluster", "band"), "cluster", "band").selectExpr(f"{X.rounded('ari')} as ari")


@query("normalized_mutual_info", f"SELECT {r('mi/((ha+hb)/2)')} AS nmi FROM info")
def _(d):
    return Me.agreement(with_band(d).select("cluster", "band"), "cluster", "band").selectExpr(f"{X.rounded('nmi')} as nmi")


# --- alternative methods ----------------------------------------------------
@query("param_grid", f"SELECT 'Agglomerative' AS method, k, NULL::DOUBLE AS eps, NULL::INTEGER AS min_samples, (SELECT count(*) FROM pts) AS rows FROM (VALUES {','.join(f'({k})' for k in C.WARD_K)}) v(k) UNION ALL SELECT 'DBSCAN', NULL, e::DOUBLE, m, (SELECT count(*) FROM pts) FROM (VALUES {','.join(f'({e})' for e in C.DBSCAN_EPS)}) a(e), (VALUES {','.join(f'({m})' for m in C.DBSCAN_MIN_SAMPLES)}) b(m)")
def _(d):
    """Every alternative setting with the number of rows it would run on."""
    grid = [("Agglomerative", k, None, None) for k in C.WARD_K] + [
        ("DBSCAN", None, e, m) for e in C.DBSCAN_EPS for m in C.DBSCAN_MIN_SAMPLES]
    settings = ", ".join(
        f"named_struct('method', '{m}', 'k', cast({k or 'null'} as int), 'eps', cast({e or 'null'} as double), 'min_samples', cast({s or 'null'} as int))"
        for m, k, e, s in grid)
    return points(d).agg(F.count("*").alias("rows")).selectExpr("rows", f"inline(array({settings}))")


def ward_table(d):
    points = fitted_points(d)
    wide = d.once("ward", lambda: stored_alone(d.spark, lambda: Hi.ward_labels(points, 6, keep=["cluster"]), "ward"))
    rows = ", ".join(f"named_struct('k', {k}, 'label', ward_{k})" for k in C.WARD_K)
    long = wide.selectExpr("cluster", *POINTS, f"inline(array({rows}))")
    return Me.validity(long, "label", POINTS, ["k"]).join(Me.agreement(long, "cluster", "label", ["k"]), "k")


@query("ward_hierarchy")
def _(d):
    return ward_table(d).selectExpr("'Agglomerative' as method", "k", "'ward' as linkage", "clusters", "silhouette_squared",
                                    "calinski_harabasz", "davies_bouldin", "ari as ari_vs_kmeans", "nmi as nmi_vs_kmeans")


_cov = [(a, b) for i, a in enumerate(POINTS) for b in POINTS[i:]]


@query("pca_covariance", " UNION ALL ".join(f"SELECT '{a}' AS a, '{b}' AS b, {r(f'covar_samp({a}, {b})')} AS covariance FROM pts" for a, b in _cov))
def _(d):
    return X.with_exprs(Pj.covariance(points(d), POINTS), {"covariance": X.rounded("covariance")})


@query("pca_projection")
def _(d):
    return Pj.pca(points(d), POINTS, 2, [*KEYS, "cluster"])


def dbscan_labels(d):
    """One row per row and setting, from a stored table with one row per row."""
    keep, points = [*KEYS, "cluster"], fitted_points(d)
    return De.by_setting(d.once("dbscan", lambda: stored_alone(d.spark, lambda: De.dbscan_labels(points, 6, keep=keep), "dbscan")), 6, keep=keep)


def dbscan_report(d):
    return d.once("dbscan_report", lambda: stored(De.grid_report(dbscan_labels(d), 6, "cluster"), "dbscan_report"))


_pair = "+".join(f"(a.x_{i}-b.x_{i})*(a.x_{i}-b.x_{i})" for i in range(6))
CTES["ball"] = "SELECT ticker, fiscal_year, " + ", ".join(f"count(*) FILTER (WHERE d<={e}::DOUBLE*{e}::DOUBLE) AS n{i}" for i, e in enumerate(C.DBSCAN_EPS)) + f" FROM (SELECT a.ticker, a.fiscal_year, {_pair} AS d FROM pts a, pts b) GROUP BY 1,2"
CTES["reach"] = "SELECT ticker, fiscal_year, " + ", ".join(f"max(CASE WHEN d<={e}::DOUBLE*{e}::DOUBLE THEN n{i} END) AS r{i}" for i, e in enumerate(C.DBSCAN_EPS)) + f""" FROM (
 SELECT a.ticker, a.fiscal_year, {_pair} AS d, n0, n1, n2, n3, n4, n5, n6 FROM pts a, (SELECT * FROM pts JOIN ball USING (ticker, fiscal_year)) b) GROUP BY 1,2"""


@query("dbscan_core_flags", " UNION ALL ".join(
    f"SELECT ticker, fiscal_year, {e}::DOUBLE AS eps, {m} AS min_samples, n{i}>={m} AS core FROM ball"
    for i, e in enumerate(C.DBSCAN_EPS) for m in C.DBSCAN_MIN_SAMPLES))
def _(d):
    """Is a row a core point?  Neighbours are counted up to the largest min_samples, which decides all settings."""
    points = keyed_points(d)
    table = stored_alone(d.spark, lambda: De.neighbour_arrays(points, 6, C.DBSCAN_EPS, max(C.DBSCAN_MIN_SAMPLES)), "near")
    flags = ", ".join(f"named_struct('eps', {X.num(e)}, 'min_samples', {m}, 'core', near[{i}] >= {m})" for i, e in enumerate(C.DBSCAN_EPS) for m in C.DBSCAN_MIN_SAMPLES)
    return points.join(table, POINTS).selectExpr(*KEYS, f"inline(array({flags}))")


@query("dbscan_noise", " UNION ALL ".join(
    f"SELECT {e}::DOUBLE AS eps, {m} AS min_samples, count(*) AS rows, count(*) FILTER (WHERE r{i}<{m}) AS noise FROM reach"
    for i, e in enumerate(C.DBSCAN_EPS) for m in C.DBSCAN_MIN_SAMPLES))
def _(d):
    return dbscan_labels(d).groupBy("eps", "min_samples").agg(
        F.count("*").alias("rows"), F.expr("count(*) filter (where label = -1) as noise"))


@query("dbscan_grid")
def _(d):
    return dbscan_report(d)


@query("dbscan_select")
def _(d):
    return De.practical_candidate(dbscan_report(d))


CTES["nlab"] = "SELECT CASE WHEN scorecard_credit_score<30 THEN -1 ELSE cluster END AS label FROM clustered"


@query("dbscan_diagnostics", f"""SELECT count(DISTINCT label) FILTER (WHERE label<>-1) AS clusters_ex_noise, {r('count(*) FILTER (WHERE label=-1)/count(*)::DOUBLE')} AS noise_share,
 {r('(SELECT max(n) FROM (SELECT count(*) AS n FROM nlab WHERE label<>-1 GROUP BY label))/count(*) FILTER (WHERE label<>-1)::DOUBLE')} AS largest_cluster_share FROM nlab""")
def _(d):
    """Diagnostics of a labeling that treats low scores (and missing ones never) as noise."""
    labels = d.clustered().selectExpr("if(coalesce(scorecard_credit_score < 30, false), -1, cluster) as label")
    out = Me.noise_report(labels, "label")
    return out.selectExpr("clusters_ex_noise", f"{X.rounded('noise_share')} as noise_share", f"{X.rounded('largest_cluster_share')} as largest_cluster_share")


@query("method_comparison")
def _(d):
    """The fitted KMeans, the best Ward cut by squared silhouette and the practical DBSCAN setting (if any) side by side."""
    names = ["clusters", "silhouette_squared", "calinski_harabasz", "davies_bouldin", "ari_vs_kmeans", "nmi_vs_kmeans"]
    base = Me.validity(fitted_points(d), "cluster", POINTS).selectExpr("'KMeans' as id", "clusters", *names[1:4], "1D as ari_vs_kmeans", "1D as nmi_vs_kmeans")
    ward = ward_table(d).withColumnsRenamed({"ari": "ari_vs_kmeans", "nmi": "nmi_vs_kmeans"})
    ward = ward.orderBy(F.col("silhouette_squared").desc_nulls_last(), F.desc("ari_vs_kmeans"), "k").limit(1).selectExpr("'Agglomerative' as id", *names)
    dense = De.practical_candidate(dbscan_report(d)).selectExpr("'DBSCAN' as id", "clusters_ex_noise as clusters", *names[1:])
    out = base.unionByName(ward).unionByName(dense)
    texts = {f"{c}": X.case_map("id", {k: v[i] for k, v in C.METHOD_TEXT.items()}) for i, c in enumerate(("method", "selected_role", "comment"))}
    return X.with_exprs(out, texts).select("method", "selected_role", *names, "comment")
