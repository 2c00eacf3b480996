"""Quantiles, clustering, validity and streaming against brute force."""

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from ledgerline import constants as C
from ledgerline.operators import cluster as Cl, density as De, filters as Fi, hierarchy as Hi, metrics as Me, panel as P, profiles as Pr, projection as Pj, quantiles as Qu, robustness as Ro, training as Tr
from ledgerline.operators.components import components
from ledgerline import session as Se
from ledgerline.session import stored


def frame(spark, x, **more):
    pdf = pd.DataFrame(x, columns=[f"x_{i}" for i in range(x.shape[1])]).assign(**more)
    df = spark.createDataFrame(pdf)
    return stored(df.withColumn("row_key", F.xxhash64(*df.columns)), "points")


@pytest.fixture(scope="module")
def blobs(spark):
    rng = np.random.default_rng(3)
    centres = np.array([[0.15, 0.2, 0.2], [0.8, 0.75, 0.3], [0.4, 0.85, 0.85]])
    label = rng.integers(0, 3, 400)
    x = np.clip(centres[label] + rng.normal(0, 0.06, (400, 3)), 0, 1)
    x[:25] = x[25:50]  # repeated points
    label[:25] = label[25:50]
    return x, label


def test_grouped_median_with_a_hot_group(spark):
    """One key holds most rows, and one value most rows of another key."""
    rng = np.random.default_rng(1)
    pdf = pd.DataFrame({"k": ["hot"] * 30_001 + ["a"] * 4 + ["b"] * 3, "v": rng.normal(size=30_008).round(3)})
    pdf = pd.concat([pdf, pd.DataFrame({"k": "same", "v": [1.5] * 20_000 + [2.5] * 19_999})], ignore_index=True)
    pdf = pd.concat([pdf[pdf.k != "b"], pdf[pdf.k == "b"]], ignore_index=True)
    pdf.loc[pdf.index[-2:], "k"] = None
    got = Qu.grouped_median(spark.createDataFrame(pdf), ["k"], "v", carry={"top": F.max("k")}).toPandas()
    want = pdf.groupby("k", dropna=False)["v"].median()
    assert len(got) == 5
    for _, r in got.iterrows():
        expect = want[want.index.isna()].iloc[0] if r["k"] is None else want[r["k"]]
        assert r["v"] == pytest.approx(expect, abs=1e-12)


@pytest.mark.parametrize("most", [1_000_000, 50])
def test_grouped_median_moves_rows_once(spark, monkeypatch, most):
    """Groups that fit a task are not written to tables on the way; hot ones (more than `most` rows) give the same values."""
    tables = []
    monkeypatch.setattr(Qu, "GROUP_ROWS", most, raising=False)
    monkeypatch.setattr(Qu, "stored", lambda df, name="step": tables.append(name) or stored(df, name))
    rng = np.random.default_rng(6)
    pdf = pd.DataFrame({"k": rng.integers(0, 40, 900), "y": rng.integers(0, 3, 900), "v": rng.normal(size=900).round(1), "name": rng.choice(["a", "b", "c"], 900)})
    pdf.loc[pdf.k == 7, "v"] = -0.0
    pdf = pd.concat([pdf, pdf[:1].assign(k=50, v=np.nan), pd.DataFrame({"k": 60, "y": 1, "v": np.arange(400.0), "name": "z"})], ignore_index=True)
    df = spark.createDataFrame(pdf.astype(object).where(pdf.notna(), None), "k int, y int, v double, name string").withColumn("k", F.expr("nullif(k, 3)"))
    got = Qu.grouped_median(df, ["k", "y"], "v", carry={"top": F.max("name")}, deal=["k"]).collect()
    assert bool(tables) == (most == 50)
    pdf.loc[pdf.k == 3, "k"] = -1
    want = pdf.dropna().groupby(["k", "y"]).agg(v=("v", "median"), top=("name", "max")).to_dict("index")
    assert {(-1 if r["k"] is None else r["k"], r["y"]): {"v": r["v"], "top": r["top"]} for r in got} == want and len(got) == len(want)
    assert not any(np.signbit(r["v"]) for r in got if r["v"] == 0)


@pytest.mark.parametrize("last", [10_000, 5])
def test_label_quantiles_equal_numpy(spark, monkeypatch, last):
    """Also when the last step may hold a few values only."""
    monkeypatch.setattr(Qu, "LAST", last)
    monkeypatch.setattr(Qu, "SLICES", 7 if last == 5 else 1000)
    rng = np.random.default_rng(2)
    pdf = pd.DataFrame({"g": rng.choice([0, 1, 2], 20_000, p=[0.9, 0.0999, 0.0001]), "v": rng.lognormal(size=20_000), "w": rng.integers(0, 5, 20_000).astype(float)})
    pdf.loc[::7, "v"] = None
    df = spark.createDataFrame(pdf.astype(object).where(pdf.notna(), None), "g int, v double, w double")
    probs = [0.001, 0.05, 0.5, 0.95, 0.999]
    for r in Qu.label_quantiles(df, ["g"], ["v", "w"], probs).collect():
        values = pdf.loc[pdf.g == r["g"], r["feature"]].dropna()
        assert r["value"] == pytest.approx(values.quantile(r["prob"]), abs=1e-9), r
    whole = {(r["feature"], r["prob"]): r["value"] for r in Qu.label_quantiles(df, [], ["v"], probs).collect()}
    assert all(v == pytest.approx(pdf["v"].quantile(p)) for (_, p), v in whole.items())


def test_kmeans_finds_blobs_and_never_gets_worse(spark, blobs):
    x, label = blobs
    points = frame(spark, x, truth=label)
    fits = Cl.fit_many(points, 3, Cl.restarts(3, 4, seed=1))
    for f in fits:
        assert all(b <= a + 1e-9 for a, b in zip(f.history, f.history[1:]))
    best = Cl.best_fit(fits)
    labelled = points.selectExpr("truth", "x_0", "x_1", "x_2", f"{Cl.label_text(best.centroids, 3)} as label")
    agree = Me.agreement(labelled, "truth", "label").first()
    assert agree["ari"] == pytest.approx(1.0) and agree["nmi"] == pytest.approx(1.0)
    again = Cl.best_fit(Cl.fit_many(points.repartition(7), 3, Cl.restarts(3, 4, seed=1)))
    assert np.allclose(best.centroids, again.centroids), "the layout of the rows must not matter"


def euclid_silhouette(x, y):
    d = np.sqrt(((x[:, None] - x[None]) ** 2).sum(2))
    out = []
    for i in range(len(x)):
        own = y == y[i]
        if own.sum() == 1:
            out.append(0.0)
            continue
        a = d[i, own].sum() / (own.sum() - 1)
        b = min(d[i, y == k].mean() for k in set(y) if k != y[i])
        out.append((b - a) / max(a, b))
    return float(np.mean(out))


def test_validity_against_brute_force(spark, blobs):
    x, label = blobs
    points = frame(spark, x, label=label, i=np.arange(len(x)))
    got = Me.validity(points, "label", ["x_0", "x_1", "x_2"]).first()
    n, k = len(x), 3
    cents = np.array([x[label == c].mean(0) for c in range(k)])
    within = sum(((x[label == c] - cents[c]) ** 2).sum() for c in range(k))
    between = sum((label == c).sum() * ((cents[c] - x.mean(0)) ** 2).sum() for c in range(k))
    assert got["calinski_harabasz"] == pytest.approx((between / (k - 1)) / (within / (n - k)))
    s = [np.sqrt(((x[label == c] - cents[c]) ** 2).sum(1)).mean() for c in range(k)]
    db = np.mean([max((s[a] + s[b]) / np.linalg.norm(cents[a] - cents[b]) for b in range(k) if b != a) for a in range(k)])
    assert got["davies_bouldin"] == pytest.approx(db)
    d2 = ((x[:, None] - x[None]) ** 2).sum(2)
    sq = []
    for i in range(n):
        own = label == label[i]
        a = d2[i, own].sum() / (own.sum() - 1)
        b = min(d2[i, label == c].mean() for c in range(k) if c != label[i])
        sq.append((b - a) / max(a, b))
    assert got["silhouette_squared"] == pytest.approx(np.mean(sq))
    sample = Me.silhouette_sample(points, "label", ["x_0", "x_1", "x_2"], ["i"], 10_000).first()
    assert sample["rows"] == n and sample["silhouette"] == pytest.approx(euclid_silhouette(x, label))


def test_euclidean_silhouette_and_its_error(spark):
    rng = np.random.default_rng(9)
    x = np.vstack([rng.normal(m, s, (n, 3)) for m, s, n in ((0.2, 0.1, 900), (0.5, 0.15, 500), (0.8, 0.05, 40))] + [np.full((5, 3), 0.2), [[0.9, 0.1, 0.9]]])
    y = np.r_[np.repeat([4, 7, 9], [900, 500, 40]), np.full(5, 4), 11]
    points, xs = frame(spark, x, label=y), ["x_0", "x_1", "x_2"]
    exact = euclid_silhouette(x, y)
    whole = Me.silhouette_euclidean(points, "label", xs).first()
    assert whole["rows"] == len(x) and whole["silhouette_euclidean"] == pytest.approx(exact, abs=1e-9) and whole["standard_error"] == 0
    errors = []
    for i in range(6):  # other values of the hash, other samples
        moved = points.selectExpr("label", *[f"{c} + {i}D as {c}" for c in xs])
        got = Me.silhouette_euclidean(moved, "label", xs, per_cluster=100).first()
        errors.append((got["silhouette_euclidean"] - exact) / got["standard_error"])
        assert 0 < got["standard_error"] < 0.02
    assert max(map(abs, errors)) < 4 and np.mean(np.square(errors)) < 4
    assert Me.silhouette_euclidean(points.filter("label = 4"), "label", xs).first()["silhouette_euclidean"] is None


def brute_dbscan(x, eps, m):
    near = ((x[:, None] - x[None]) ** 2).sum(2) <= eps * eps
    core = near.sum(1) >= m
    label = np.full(len(x), -1)
    c = 0
    for i in range(len(x)):
        if core[i] and label[i] < 0:
            todo = [i]
            while todo:
                j = todo.pop()
                if label[j] >= 0:
                    continue
                label[j] = c
                todo += [t for t in np.flatnonzero(near[j] & core) if label[t] < 0]
            c += 1
    touch = [set(label[near[i] & core]) for i in range(len(x))]
    return core, label, touch


@pytest.mark.parametrize("hot", [1 / 1000, 1 / 20])
def test_dbscan_equals_brute_force(spark, monkeypatch, hot):
    monkeypatch.setattr(De, "HOT", hot)
    rng = np.random.default_rng(5)
    x = np.vstack([rng.normal(0.25, 0.05, (120, 3)), rng.normal(0.7, 0.04, (120, 3)), rng.random((60, 3))]).clip(0, 1)
    x = np.vstack([x, x[:10]])
    points = frame(spark, x, i=np.arange(len(x)))
    settings = [(e, m) for e in (0.06, 0.1, 0.2) for m in (4, 10)]
    got = De.dbscan_grid(points, 3, (0.06, 0.1, 0.2), (4, 10), keep=["i"]).toPandas()
    for eps, m in settings:
        mine = got[(got.eps == eps) & (got.min_samples == m)].sort_values("i")
        assert len(mine) == len(x)
        core, label, touch = brute_dbscan(x, eps, m)
        lab = mine["label"].to_numpy()
        pairs = {(a, b) for a, b in zip(lab[core], label[core])}
        assert len(pairs) == len({a for a, _ in pairs}) == len({b for _, b in pairs}), "core clusters match one to one"
        name = dict((b, a) for a, b in pairs)
        for i in np.flatnonzero(~core):
            allowed = {name[t] for t in touch[i]}
            assert lab[i] == (min(allowed) if allowed else -1)


def test_dbscan_writes_no_row_per_setting(spark, blobs, monkeypatch):
    """What is written of the points has one row per distinct point, and `stored_alone` leaves only the result."""
    x = np.vstack([blobs[0], blobs[0][:50]])
    points, sizes, real = frame(spark, x, i=np.arange(len(x))), {}, De.stored

    def seen(df, name="step"):
        out = real(df, name)
        sizes[name] = max(sizes.get(name, 0), out.count())
        return out

    monkeypatch.setattr(De, "stored", seen)
    eps, least = (0.1, 0.2, 0.4), (3, 5, 9)
    made = Se._made.setdefault(spark.sparkContext.applicationId, [])
    before = len(made)
    wide = Se.stored_alone(spark, lambda: De.dbscan_labels(points, 3, eps, least, keep=["i"]), "dbscan")
    n = len(np.unique(x, axis=0))
    assert "core" not in sizes and "placed" not in sizes and sizes["neighbours"] == sizes["found"] == n
    assert len(made) == before + 1 and wide.count() == len(x)
    long = De.by_setting(wide, 3, eps, least, keep=["i"])
    assert long.count() == len(x) * 9
    near = {(r["x_0"], r["x_1"], r["x_2"]): r["near"] for r in De.neighbour_arrays(points, 3, eps, 9).collect()}
    for r in De.neighbour_table(points, 3, eps, 9).collect():
        assert near[r["x_0"], r["x_1"], r["x_2"]][r["e"]] == r["neighbours"] == min(9, (((x - [r["x_0"], r["x_1"], r["x_2"]]) ** 2).sum(1) <= eps[r["e"]] ** 2).sum())


def test_dbscan_rejects_cells_without_numbers(spark, blobs):
    with pytest.raises(ValueError, match="too small"):
        De.neighbour_table(frame(spark, blobs[0]), 3, (1e-7,), 10)


def test_dbscan_settles_what_boxes_leave_open(spark):
    """Two rows of points, just in reach of each other at one place only: the last link needs the finest boxes."""
    t = np.arange(0.05, 0.95, 0.01)
    x = np.vstack([np.c_[t, 0 * t + 0.2], np.c_[t, 0.31 + 0.1 * t], [[0.05, 0.256]]])
    every = De.dbscan_grid(frame(spark, x, i=np.arange(len(x))), 2, (0.0585, 0.0595, 0.07), (2,), keep=["i"]).toPandas().sort_values("i")
    for eps, got in every.groupby("eps"):
        core, label, _ = brute_dbscan(x, eps, 2)
        assert core.all() and len(set(zip(got["label"], label))) == len(set(label)) == got["label"].nunique()


def test_dbscan_select_finds_a_setting(spark):
    rng = np.random.default_rng(2)
    x = np.clip(np.vstack([rng.normal(m, 0.02, (150, 3)) for m in (0.2, 0.5, 0.8)] + [rng.random((20, 3))]), 0, 1)
    points = frame(spark, x, truth=np.r_[np.repeat([0, 1, 2], 150), np.full(20, 3)])
    report = De.grid_report(De.dbscan_grid(points, 3, (0.05, 0.1, 1.5), (5, 20), keep=["truth"]), 3, "truth")
    best = De.practical_candidate(report).collect()
    assert len(best) == 1 and best[0]["clusters_ex_noise"] == 3 and best[0]["eps"] < 1 and best[0]["ari_vs_kmeans"] > 0.9


def test_components(spark):
    rng = np.random.default_rng(6)
    edges = [(g, int(a), int(b)) for g in (0, 1) for a, b in rng.integers(0, 120, (70, 2))] + [(2, i, i + 1) for i in range(200)] + [(3, 5, i) for i in range(50)]
    up = {}

    def find(v):
        while up.setdefault(v, v) != v:
            v = up[v]
        return v

    for g, a, b in edges:
        if a != b:
            ends = sorted([find((g, a)), find((g, b))])
            up[ends[1]] = ends[0]
    got = components(spark.createDataFrame(edges, "g int, a long, b long").repartition(3), ["g"]).collect()
    assert {(r["g"], r["node"], r["label"]) for r in got} == {(*v, find(v)[1]) for v in up} and len(got) == len(up)
    assert components(spark.createDataFrame([(1, 2, 2)], "g int, a long, b long"), ["g"]).count() == 0


def test_ward_merges_like_the_definition():
    rng = np.random.default_rng(0)
    c, w = rng.random((12, 2)), rng.integers(1, 9, 12).astype(float)
    groups = {i: [i] for i in range(12)}
    for i, j in Hi.ward_merges(c, w):
        def cost(a, b):
            wa, wb = w[groups[a]], w[groups[b]]
            ca, cb = np.average(c[groups[a]], 0, wa), np.average(c[groups[b]], 0, wb)
            return wa.sum() * wb.sum() / (wa.sum() + wb.sum()) * ((ca - cb) ** 2).sum()
        best = min(((cost(a, b), a, b) for a in groups for b in groups if a < b))
        assert cost(i, j) == pytest.approx(best[0])
        groups[i] += groups.pop(j)


def test_ward_of_a_small_table_is_exact(spark):
    """Every cell is a row: the cuts are those of the plain greedy method over all rows, repeated rows included."""
    rng = np.random.default_rng(12)
    x = np.vstack([rng.random((90, 3)), rng.random((10, 3)).repeat(3, 0)])
    groups = {i: [i] for i in range(len(x))}
    want = {}
    while len(groups) > 1:
        if len(groups) <= 8:
            want[len(groups)] = [frozenset(g) for g in groups.values()]
        cost = lambda a, b: len(groups[a]) * len(groups[b]) / (len(groups[a]) + len(groups[b])) * ((x[groups[a]].mean(0) - x[groups[b]].mean(0)) ** 2).sum()
        _, a, b = min((cost(a, b), a, b) for a in groups for b in groups if a < b)
        groups[a] += groups.pop(b)
    got = Hi.ward_labels(frame(spark, x, i=np.arange(len(x))), 3, (3, 5, 8), keep=["i"]).toPandas().sort_values("i")
    for k in (3, 5, 8):
        assert {frozenset(g) for g in got.groupby(f"ward_{k}")["i"].apply(list)} == set(want[k])


def test_ward_of_more_rows_than_cells_follows_the_exact_tree(spark):
    rng = np.random.default_rng(13)
    x = np.vstack([rng.normal(m, 0.05, (400, 3)) for m in (0.2, 0.4, 0.6, 0.8)])
    points = frame(spark, x, i=np.arange(len(x)))
    exact = Hi.ward_labels(points, 3, (4,), keep=["i"]).withColumnRenamed("ward_4", "exact")
    for groups, least in ((200, 0.9), (20, 0.5)):
        both = Hi.ward_labels(points, 3, (4,), groups=groups, keep=["i"]).join(exact.select("i", "exact"), "i")
        assert Me.agreement(both, "exact", "ward_4").first()["ari"] > least
    assert Hi.summaries(points, 3, 20)[1].count() <= 20


def test_ward_of_many_cells_is_the_exact_tree(spark):
    """More rows than a cell holds, in rounds: the same cuts as one chain over all rows, far pairs and repeated rows included."""
    rng = np.random.default_rng(14)
    far = np.array([[9.0, 9.0, 9.0], [9.1, 9.0, 9.0], [-7.0, 0.0, 0.0]])
    x = np.vstack([rng.random((700, 3)), rng.normal(0.5, 0.02, (300, 3)), far, rng.random((20, 3)).repeat(4, 0)])
    distinct, n = np.unique(x, axis=0, return_counts=True)
    merges = Hi.ward_merges(distinct, n.astype(float))
    ks = (2, 3, 5, 8)
    for groups in (40, 300, 4000):
        got = Hi.ward_labels(frame(spark, x, i=np.arange(len(x))), 3, ks, groups=groups, keep=["i"]).toPandas().sort_values("i")
        assert len(got) == len(x)
        for k in ks:
            want = dict(zip(map(tuple, distinct), Hi.cut(merges, len(distinct), k)))
            assert got[f"ward_{k}"].tolist() == [want[tuple(r)] for r in x]


def test_ward_labels_and_pca(spark, blobs):
    x, label = blobs
    points = frame(spark, x, truth=label)
    wide = Hi.ward_labels(points, 3, (2, 3), groups=30, keep=["truth"])
    assert Me.agreement(wide, "truth", "ward_3").first()["ari"] > 0.95
    out = Pj.pca(points, ["x_0", "x_1", "x_2"], 2).toPandas()
    values = np.sort(np.linalg.eigvalsh(np.cov(x.T)))[::-1]
    assert out["PC1"].var() == pytest.approx(values[0]) and out["PC2"].var() == pytest.approx(values[1])
    assert out["explained_variance_ratio_sum"][0] == pytest.approx(values[:2].sum() / values.sum())


def test_stability_jobs(spark):
    rng = np.random.default_rng(8)
    x = np.clip(np.vstack([rng.normal(m, 0.03, (80, 6)) for m in (0.1, 0.3, 0.5, 0.7, 0.9)]), 0, 1)
    points = frame(spark, x)
    rows = Ro.seed_stability(points, 6, seeds=(1, 7), n_init=4).collect()
    assert all(r["ari"] > 0.99 and r["rank_kept"] and r["rows"] == 400 for r in rows)
    rows = Ro.bootstrap_stability(points, 6, samples=2, n_init=4).collect()
    assert all(r["ari"] > 0.9 for r in rows)


def test_bootstrap_replicate_is_one_sample(spark):
    """All restarts of a replicate see the same rows: the fit equals Lloyd's method on that sample, done by hand."""
    rng = np.random.default_rng(3)
    x = np.vstack([rng.normal(m, 0.06, (90, 2)) for m in (0.2, 0.5, 0.8)])
    points = frame(spark, x)
    pdf = points.toPandas()
    xs, keys = pdf[["x_0", "x_1"]].to_numpy(), pdf["row_key"].to_numpy()
    inside = Cl._uniform(keys, 1000 * 7919 + 17) < 0.8
    assert 0.7 < inside.mean() < 0.9
    specs = Cl.restarts(3, 5, 1000, share=0.8, sample=1000)
    starts = Cl.seed_centroids(points, 2, specs)
    for spec, start, fit in zip(specs, starts, Cl.fit_many(points, 2, specs, init=[s.copy() for s in starts])):
        assert all((np.abs(xs[inside] - row).sum(1) < 1e-12).any() for row in start), "starts are rows of the sample"
        c, limit = start, C.TOL * xs.var(0).mean()
        for _ in range(C.MAX_ITER):
            d = ((xs[inside][:, None] - c[None]) ** 2).sum(2)
            new = np.array([xs[inside][d.argmin(1) == j].mean(0) for j in range(3)])
            moved, c = ((new - c) ** 2).sum(), new if ((new - c) ** 2).sum() > limit else c
            if moved <= limit:
                break
        order = lambda v: v[np.lexsort(v.T)]
        assert fit.rows == inside.sum() and np.allclose(order(fit.centroids), order(c))
        assert fit.inertia == pytest.approx(((xs[inside][:, None] - c[None]) ** 2).sum(2).min(1).sum())
        assert len(fit.history) == fit.iterations + 1


def test_seeding_draws_by_distance_with_few_distances(spark, monkeypatch):
    """Each centre is the row with the smallest -ln(u) / distance, found by hand; distances are computed for few rows only."""
    rng = np.random.default_rng(9)
    points = frame(spark, rng.random((3000, 3)))
    pdf = points.toPandas()
    xs, keys = pdf[["x_0", "x_1", "x_2"]].to_numpy(), pdf["row_key"].to_numpy()
    specs = [Cl.Spec("a", 4, 3), Cl.Spec("b", 3, 4, mask=(1.0, 0.0, 1.0)), Cl.Spec("c", 3, 5, share=0.5, sample=8)]
    for m, (s, got) in enumerate(zip(specs, Cl.seed_centroids(points, 3, specs))):
        want = np.empty((0, 3))
        for step in range(s.k):
            d = ((xs[:, None] - want[None]) ** 2 * (s.mask or (1.0,) * 3)).sum(2).min(1) if step else np.ones(len(xs))
            gap = -np.log(Cl._uniform(keys, s.seed * 1000003 + m * 101 + step)) / np.maximum(d, 1e-300)
            if s.share < 1:
                gap[Cl._uniform(keys, s.salt) >= s.share] = np.inf
            want = np.vstack([want, xs[gap.argmin()]])
        assert np.allclose(got, want, atol=1e-12, rtol=0)
    # within a task: the logarithm is taken of few numbers
    asked = []
    real = np.log
    monkeypatch.setattr(Cl.np, "log", lambda v: asked.append(v.size) or real(v))
    class Once:
        def select(self, *_):
            return self
        def mapInPandas(self, draw, schema):
            got = pd.concat(draw([pdf]))
            return spark.createDataFrame(got, schema)
    many = [Cl.Spec(str(i), 2, i) for i in range(200)]
    Cl.seed_centroids(Once(), 3, many)
    assert 0 < sum(asked) < 0.5 * 2 * len(xs) * len(many)


def test_pass_agrees_with_plain_sums(spark):
    """Ties go to the first centroid; masks, shares and numbers of clusters mixed in one pass."""
    rng = np.random.default_rng(10)
    x = rng.random((2000, 3)).round(1)
    points = frame(spark, x)
    pdf = points.toPandas()
    xs, keys = pdf[["x_0", "x_1", "x_2"]].to_numpy(), pdf["row_key"].to_numpy()
    specs = [Cl.Spec("a", 3), Cl.Spec("b", 4, mask=(1.0, 1.0, 0.0)), Cl.Spec("c", 3, share=0.5, sample=2), Cl.Spec("d", 3)]
    starts = [xs[[5, 5, 9]], xs[[1, 2, 3, 4]], xs[[7, 8, 11]], np.array([[0.25, 0.5, 0.5], [0.75, 0.5, 0.5], [0.5, 0.5, 5.0]])]
    for s, start, got in zip(specs, starts, Cl.lloyd_pass(points, 3, specs, starts).values()):
        use = xs[Cl._uniform(keys, s.salt) < s.share] if s.share < 1 else xs
        d = ((use[:, None] - start[None]) ** 2 * (s.mask or (1.0,) * 3)).sum(2)
        if s.name in "ac":
            assert got[:, 0].tolist() == [(d.round(12).argmin(1) == c).sum() for c in range(s.k)]
        assert got[:, 0].sum() == len(use) and got[:, 1].sum() == pytest.approx(d.min(1).sum())
        assert np.allclose(got[:, 2:].sum(0), use.sum(0))


def test_blocks_of_close_rows_are_added_as_a_whole(spark, monkeypatch):
    """Many models over rows in near order: the totals are those of comparing all rows, most of which are not compared."""
    rng = np.random.default_rng(21)
    x = np.vstack([rng.normal(m, 0.1, (1500, 3)) for m in (0.1, 0.5, 0.9)] + [np.full((300, 3), 0.5)]).clip(0, 1)
    points = Cl.close_rows(frame(spark, x).repartition(3), 3).toPandas()
    assert sorted(map(tuple, points[["x_0", "x_1", "x_2"]].to_numpy())) == sorted(map(tuple, x))
    xs, keys = points[["x_0", "x_1", "x_2"]].to_numpy(), points["row_key"].to_numpy()
    specs = [Cl.Spec(str(i), 4, mask=(1.0, 0.0, 1.0) if i % 2 else None, share=0.6 if i % 3 else 1.0, sample=4) for i in range(600)]
    centres = [xs[rng.integers(0, len(xs), 4)] for _ in specs]
    centres[0] = np.array([[0.5] * 3, [0.5] * 3, [0.2] * 3, [0.9] * 3])  # two equal ones
    compared, real = [], Cl.Stack._compared
    monkeypatch.setattr(Cl.Stack, "_compared", lambda self, rows, columns, cross: compared.append(len(rows) * cross.shape[2]) or real(self, rows, columns, cross))
    stacks = Cl._stacks(specs, centres, 3, close=True)
    for stack in stacks:
        stack.add(xs, keys)
    seen = sum(s.sums()[:, 0].sum() for s in stacks)
    assert 0 < sum(compared) < 0.6 * seen
    for stack in stacks:
        for at, m in list(enumerate(stack.members))[:40]:
            use = xs if specs[m].share == 1 else xs[Cl._uniform(keys, specs[m].salt) < 0.6]
            w = np.array(specs[m].mask or (1.0,) * 3)
            d = (w * centres[m] ** 2).sum(1) - 2 * use @ (w * centres[m]).T
            own = d.argmin(1)
            got = stack.sums()[:, :, at]
            assert got[:, 0].tolist() == np.bincount(own, minlength=4).tolist()
            assert np.allclose(got[:, 2:], [use[own == c].sum(0) for c in range(4)])
            assert got[:, 1].sum() == pytest.approx(((use ** 2) @ w + d.min(1)).sum())
    # the same models whether rows are stored in near order or not
    few = [Cl.Spec(str(i), 4, i) for i in range(5)]
    plain = Cl.fit_many(frame(spark, x), 3, few)
    monkeypatch.setattr(Cl, "MANY", 1)
    for a, b in zip(plain, Cl.fit_many(frame(spark, x), 3, few)):
        assert np.allclose(a.centroids, b.centroids) and a.inertia == pytest.approx(b.inertia) and a.iterations == b.iterations


def test_equal_models_stand_for_each_other(spark, blobs):
    points = frame(spark, blobs[0])
    twins = [Cl.Spec("a", 3, 5), Cl.Spec("b", 3, 6), Cl.Spec("masked", 3, 6, mask=(1.0, 1.0, 0.0))]
    start = Cl.seed_centroids(points, 3, twins[:1])[0]
    a, b, masked = Cl.fit_many(points, 3, twins, init=[start, start[[2, 0, 1]], start])
    alone = Cl.fit_many(points, 3, twins[:1], init=[start])[0]
    assert np.allclose(np.sort(a.centroids, 0), np.sort(b.centroids, 0)) and a.inertia == pytest.approx(alone.inertia) == b.inertia
    assert b.spec.name == "b" and b.iterations == a.iterations and len(b.history) == len(a.history) and masked.inertia < a.inertia


def test_segment_pipeline_states(spark):
    rng = np.random.default_rng(4)
    pdf = pd.DataFrame(rng.random((600, 6)), columns=C.DOMAINS).assign(
        ticker=[f"T{i}" for i in range(600)], fiscal_year=2024, financial_flag="Non-financial", scorecard_credit_score=rng.random(600) * 100)
    pdf.loc[:9, C.DOMAINS[:3]] = None
    pdf.loc[590:, "financial_flag"] = "Financial"
    df = stored(spark.createDataFrame(pdf.astype(object).where(pdf.notna(), None), ", ".join(
        [f"{d} double" for d in C.DOMAINS] + ["ticker string", "fiscal_year int", "financial_flag string", "scorecard_credit_score double"])), "panel")
    clustered, table, models = Tr.fit_segments(df, n_init=3)
    rows = {r["segment"]: r for r in table.collect()}
    assert rows["Financial"]["status"] == "skipped_not_target_segment"
    assert rows["Non-financial"]["status"] == "clustered" and rows["Non-financial"]["rows"] == 580
    assert clustered.count() == 580 and sorted(models["Non-financial"].ranks.values()) == [1, 2, 3, 4, 5]
    small = Tr.fit_segment(df.limit(50), "Non-financial", n_init=1)
    assert small.status == "skipped" and small.model is None
    assert [Fi.min_present(n) for n in (0, 4, 6, 8)] == [4, 4, 4, 5]


def test_sample_does_not_depend_on_the_layout(spark):
    df = spark.range(1000)
    a = {r[0] for r in Fi.deterministic_sample(df, 50, ["id"]).collect()}
    b = {r[0] for r in Fi.deterministic_sample(df.repartition(9), 50, ["id"]).collect()}
    assert a == b and len(a) == 50


def test_fact_columns_and_pick(spark):
    df = spark.createDataFrame([(1.0, "x")], "Value double, end string")
    assert P.detect_value_column(df) == "Value" and P.detect_sort_column(df) == "end"
    with pytest.raises(ValueError):
        P.detect_value_column(df.select("end"))
    assert P.normalize_names(spark.createDataFrame([(1, 2)], "`  SIC Code` int, `Industry-Title` int")).columns == ["sic", "industry_title"]


def test_filters_on_derived_columns_stay_small(spark):
    """A filter on the last column of the chain must not copy the chain into its condition."""
    from ledgerline.operators import features as Fe

    df = spark.createDataFrame([(2e6, 1e6)], "assets double, liabilities double").withColumn("financial_flag", F.lit("Non-financial"))
    plan = Fi.row_coverage(Fe.engineer(df))._jdf.queryExecution().optimizedPlan().toString()
    conditions = [line for line in plan.splitlines() if "Filter" in line]
    assert conditions and max(map(len, conditions)) < 2_000


def test_panel_is_built_in_the_tasks_of_the_medians(spark, monkeypatch):
    from ledgerline.operators import panel as P, quantiles as Q
    from ledgerline.plans.registry import Data

    monkeypatch.setattr(Q, "TASK_ROWS", 50)
    Data.forget(spark)
    facts = spark.createDataFrame(
        [(f"C{i % 40}", str(i % 40), f"N{i % 3}", "3711", 2021 + i % 2, "FY", tag, float(i) if i % 7 else None)
         for i in range(600) for tag in ("us-gaap:Assets", "us-gaap:Revenues")],
        "ticker string, cik string, company_name string, sic string, fiscal_year int, fiscal_period string, concept string, value double")
    iyf = P.issuer_year_facts(facts)
    assert iyf.rdd.getNumPartitions() == 21  # 1,028 rows, 50 a task, whatever their bytes
    direct, apart = (df.collect() for df in (P.pivot_panel(iyf), P.pivot_panel(spark.createDataFrame(iyf.collect(), iyf.schema))))
    assert sorted(map(str, direct)) == sorted(map(str, apart)) and len(direct) == 40
    plan = P.pivot_panel(iyf)._jdf.queryExecution().executedPlan().toString()
    assert plan.split("Window")[0].count("Exchange") == 0 and plan.split("Window")[0].count("Sort [") == 0
    data = Data(spark, "/root/testdata/sf0.001")
    assert data.panel().count() > 0 and not [k for k in Data.shared if k[-1] == "iyf"]
    Data.forget(spark)
