"""Cluster validity and label agreement, from sums per cluster.

`points` frames hold one row per point: the label, the feature columns without
gaps, and optional `by` columns that tell several labelings apart.
"""

from pyspark.sql import DataFrame, Window as W, functions as F

from ..functions.scalars import with_exprs


def cluster_sums(points: DataFrame, label: str, features: list, by: list = ()) -> DataFrame:
    """Count, sums and sums of squares per cluster: one pass with map-side partial sums."""
    return points.filter(f"{label} is not null").groupBy(*by, label).agg(
        F.count("*").alias("n"),
        *[F.sum(f).alias(f"s_{f}") for f in features],
        F.sum(F.expr(" + ".join(f"{f} * {f}" for f in features))).alias("sq"),
    )


def _norm(parts) -> str:
    return "(" + " + ".join(parts) + ")"


def calinski_harabasz(sums: DataFrame, features: list, by: list = ()) -> DataFrame:
    """(between / (k - 1)) / (within / (n - k)); null where it is not defined."""
    between = _norm(f"s_{f} * s_{f} / n" for f in features)
    total = sums.groupBy(*by).agg(
        F.count("*").alias("clusters"), F.sum("n").alias("rows"), F.sum("sq").alias("sq"),
        F.sum(F.expr(between)).alias("between_sq"), *[F.sum(f"s_{f}").alias(f"s_{f}") for f in features],
    )
    grand = _norm(f"s_{f} * s_{f} / rows" for f in features)
    return with_exprs(total, {
        "inertia": "sq - between_sq",
        "calinski_harabasz": (
            f"case when clusters >= 2 and clusters < rows and sq - between_sq > 0 then "
            f"((between_sq - {grand}) / (clusters - 1)) / ((sq - between_sq) / (rows - clusters)) end"
        ),
    }).select(*by, "clusters", "rows", "inertia", "calinski_harabasz")


def davies_bouldin(points: DataFrame, sums: DataFrame, label: str, features: list, by: list = ()) -> DataFrame:
    """Mean over clusters of the worst (s_i + s_j) / d_ij.

    The centroid table has one row per cluster; its pairs are an equi-join on
    the labeling, bounded by the square of the number of clusters.
    """
    keys = [*by, label]
    centres = sums.selectExpr(*keys, *[f"s_{f} / n as c_{f}" for f in features])
    named = centres.withColumnsRenamed({k: f"k_{k}" for k in keys})
    d = "sqrt" + _norm(f"({f} - c_{f}) * ({f} - c_{f})" for f in features)
    spread = (
        points.join(F.broadcast(named), [F.col(k) == F.col(f"k_{k}") for k in keys])
        .groupBy(*keys).agg(F.avg(F.expr(d)).alias("spread"), *[F.first(f"c_{f}").alias(f"c_{f}") for f in features])
    )
    group = list(by) or ["one_"]
    spread = spread if by else spread.withColumn("one_", F.lit(1))
    other = spread.withColumnsRenamed({c: f"o_{c}" for c in spread.columns})
    pairs = spread.join(other, [*[F.col(g) == F.col(f"o_{g}") for g in group], F.col(label) != F.col(f"o_{label}")])
    apart = "sqrt" + _norm(f"(c_{f} - o_c_{f}) * (c_{f} - o_c_{f})" for f in features)
    worst = pairs.groupBy(*group, label).agg(F.max(F.expr(f"(spread + o_spread) / nullif({apart}, 0D)")).alias("worst"))
    out = worst.groupBy(*group).agg(F.avg("worst").alias("davies_bouldin"))
    return out if by else out.drop("one_")


def silhouette_squared(points: DataFrame, sums: DataFrame, label: str, features: list, by: list = ()) -> DataFrame:
    """Mean silhouette for squared Euclidean distance: exact and linear in the rows.

    The mean squared distance of a point to a cluster follows from the sums of
    that cluster, so no pairs of points are formed.
    """
    group = list(by) or ["one_"]
    if not by:
        points, sums = points.withColumn("one_", F.lit(1)), sums.withColumn("one_", F.lit(1))
    parts = sums.groupBy(*group).agg(F.collect_list(F.struct(
        F.col(label).alias("label"), "n", (F.col("sq") / F.col("n")).alias("q"),
        *[(F.col(f"s_{f}") / F.col("n")).alias(f"c_{f}") for f in features],
    )).alias("parts")).withColumnsRenamed({g: f"k_{g}" for g in group})
    norm = _norm(f"{f} * {f}" for f in features)
    dot = _norm(f"{f} * p.c_{f}" for f in features)
    own = F.expr(f"element_at(filter(transform(parts, p -> named_struct('l', p.label, 'n', p.n, 'd', {norm} - 2 * {dot} + p.q)), t -> t.l = {label}), 1)")
    others = F.expr(f"array_min(transform(filter(parts, p -> p.label <> {label}), p -> {norm} - 2 * {dot} + p.q))")
    # One row per labeling, holding its clusters.
    joined = points.filter(f"{label} is not null").join(F.broadcast(parts), [F.col(g) == F.col(f"k_{g}") for g in group])
    scored = joined.withColumns({"own_": own, "b_": others})
    scored = with_exprs(scored, {"a_": "case when own_.n > 1 then greatest(own_.d, 0D) * own_.n / (own_.n - 1) end"})
    s = "case when b_ is null then null when a_ is null then 0D else (greatest(b_, 0D) - a_) / nullif(greatest(a_, b_), 0D) end"
    out = scored.groupBy(*group).agg(F.avg(F.expr(f"coalesce({s}, if(b_ is null, null, 0D))")).alias("silhouette_squared"))
    return out if by else out.drop("one_")


def silhouette_sample(points: DataFrame, label: str, features: list, keys: list, n: int) -> DataFrame:
    """Mean Euclidean silhouette over a deterministic sample of at most n rows.

    The Euclidean form needs all pairs of its rows.  It is therefore a sampling
    operator: the sample has a fixed size, is broadcast once, and its rows are
    spread over the tasks.  silhouette_squared covers whole tables.
    """
    import numpy as np
    import pandas as pd

    from .filters import deterministic_sample

    spark = points.sparkSession
    sample = deterministic_sample(points.filter(f"{label} is not null"), n, keys).select(
        F.col(label).cast("bigint").alias("label"), *[F.col(f).cast("double").alias(f) for f in features])
    local = sample.toPandas()
    x, y = local[features].to_numpy(), local["label"].to_numpy()
    labels = np.unique(y)
    shared = spark.sparkContext.broadcast((x, y, labels))

    def score(batches):
        ref, ref_y, names = shared.value
        onehot = (ref_y[:, None] == names[None, :]).astype(float)
        counts = onehot.sum(axis=0)
        for pdf in batches:
            out = []
            for at in range(0, len(pdf), 256):
                rows = pdf.iloc[at:at + 256]
                px = ref[rows["i"].to_numpy()]
                dist = np.sqrt(((px[:, None, :] - ref[None, :, :]) ** 2).sum(axis=2))
                sums = dist @ onehot
                mine = np.searchsorted(names, ref_y[rows["i"].to_numpy()])
                own = counts[mine]
                a = sums[np.arange(len(rows)), mine] / np.maximum(own - 1, 1)
                rest = sums / counts
                rest[np.arange(len(rows)), mine] = np.inf
                b = rest.min(axis=1)
                s = np.where(own > 1, (b - a) / np.maximum(np.maximum(a, b), 1e-300), 0.0)
                out.append(s)
            yield pd.DataFrame({"s": np.concatenate(out) if out else np.array([])})

    if not 2 <= len(labels) < max(len(y), 1):
        return spark.range(1).selectExpr(f"cast({len(y)} as bigint) as rows", "cast(null as double) as silhouette")
    ids = spark.range(0, len(y), 1, max(1, min(len(y) // 500, spark.sparkContext.defaultParallelism * 4))).withColumnRenamed("id", "i")
    return ids.mapInPandas(score, "s double").agg(F.count("*").alias("rows"), F.avg("s").alias("silhouette"))


def silhouette_euclidean(points: DataFrame, label: str, features: list, per_cluster: int = 4096) -> DataFrame:
    """rows, silhouette_euclidean and its standard_error, over all rows.

    Each row's mean distance to a cluster is estimated from a sample of about `per_cluster` of that cluster's rows, drawn with
    probability in proportion to (distance to the centroid + its mean) and weighted by the inverse, which is unbiased; a
    cluster of at most `per_cluster` rows is taken whole, so small tables give the exact value and an error of 0.  The
    broadcast holds about clusters x `per_cluster` rows.  The error is the linearised one of Poisson sampling: each sampled
    row's influence on the result is summed over all rows in the same pass.
    """
    import numpy as np
    import pandas as pd

    spark = points.sparkSession
    rows = points.filter(f"{label} is not null").select(F.col(label).cast("bigint").alias("l"), *[F.col(f).cast("double").alias(f) for f in features])
    sums = {r["l"]: r for r in cluster_sums(rows, "l", features).collect()}  # one row per cluster
    names, total = sorted(sums), sum(r["n"] for r in sums.values())
    if not 2 <= len(names) < total:
        return spark.range(1).selectExpr(f"cast({total} as bigint) as rows", "cast(null as double) as silhouette_euclidean", "cast(null as double) as standard_error")
    by_label = lambda values: "map(" + ", ".join(f"{l}L, {v!r}D" for l, v in values.items()) + ")[l]"
    away = "sqrt" + _norm(f"pow({f} - {by_label({l: float(r[f's_{f}'] / r['n']) for l, r in sums.items()})}, 2)" for f in features)
    away = rows.withColumn("away", F.expr(away))
    spread = {r["l"]: max(float(r["s"]), 1e-300) for r in away.groupBy("l").agg(F.sum("away").alias("s")).collect()}
    # the sizes away + mean(away) sum to twice sum(away)
    odds = "case " + " ".join(
        f"when l = {l} then " + ("1D" if sums[l]["n"] <= per_cluster else f"least(1D, {per_cluster}D * (away + {spread[l] / sums[l]['n']!r}D) / {2 * spread[l]!r}D)")
        for l in names) + " end"
    # equal rows are told apart by their place; a task that runs again finds the same places
    draw = (F.pmod(F.xxhash64(*features, F.monotonically_increasing_id()), F.lit(1 << 40)) + 0.5) / float(1 << 40)
    sample = away.withColumn("p", F.expr(odds)).withColumn("u", draw).filter("u < p").select("l", "p", *features).toPandas()
    x = sample[features].to_numpy()
    own = np.searchsorted(names, sample["l"].to_numpy())
    order = np.argsort(own, kind="stable")
    x, own, p = x[order], own[order], sample["p"].to_numpy()[order]
    starts = np.searchsorted(own, np.arange(len(names)))
    sizes = np.array([sums[l]["n"] for l in names], float)
    shared = spark.sparkContext.broadcast((x, p, own, starts, sizes, np.array(names)))

    def score(batches):
        x, p, own, starts, sizes, names = shared.value
        square, weight, influence = (x * x).sum(1), 1 / p, np.zeros(len(x))
        n, s = 0, 0.0
        for pdf in batches:
            for at in range(0, len(pdf), 512):
                part = pdf.iloc[at:at + 512]
                y, mine, i = part[features].to_numpy(), np.searchsorted(names, part["l"].to_numpy()), np.arange(len(part))
                d = (y * y).sum(1)[:, None] - 2 * (y @ x.T) + square[None]
                d = np.sqrt(np.maximum(d, 0.0, out=d), out=d)
                d[d < 1e-7] = 0.0  # equal rows up to rounding
                mean = np.add.reduceat(d * weight, starts, axis=1) / sizes
                many = sizes[mine] > 1
                a = mean[i, mine] * sizes[mine] / np.maximum(sizes[mine] - 1, 1)
                mean[i, mine] = np.inf
                near = mean.argmin(1)
                b = mean[i, near]
                top = np.maximum(np.maximum(a, b), 1e-300)
                s += float(np.where(many, (b - a) / top, 0.0).sum())
                n += len(part)
                # derivatives of (b - a) / max(a, b) by the two sums of distances
                da = np.where(a < b, -1 / top, -b / (top * top)) * many / np.maximum(sizes[mine] - 1, 1)
                db = np.where(a < b, a / (top * top), 1 / top) * many / sizes[near]
                slope = np.zeros((len(part), len(names)))
                slope[i, mine] = da
                slope[i, near] += db
                for c in range(len(names)):
                    here = slice(starts[c], starts[c + 1] if c + 1 < len(starts) else len(x))
                    influence[here] += slope[:, c] @ d[:, here]
        out = pd.DataFrame({"j": np.arange(len(x)), "z": influence})
        yield pd.concat([pd.DataFrame({"j": [-1], "z": [s]}), out[(p < 1) & (influence != 0)]])[["j", "z"]]

    got = rows.mapInPandas(score, "j long, z double").groupBy("j").agg(F.sum("z").alias("z"))
    shares = spark.createDataFrame(pd.DataFrame({"j": np.arange(len(p)), "p": p})[p < 1], "j long, p double")
    both = got.join(F.broadcast(shares), "j", "left")
    return both.agg(
        F.lit(total).cast("bigint").alias("rows"), (F.sum(F.expr("case when j = -1 then z end")) / total).alias("silhouette_euclidean"),
        (F.sqrt(F.coalesce(F.sum(F.expr("case when j >= 0 then (1 - p) * z * z / (p * p) end")), F.lit(0.0))) / total).alias("standard_error"))


def validity(points: DataFrame, label: str, features: list, by: list = ()) -> DataFrame:
    """All indices of one or many labelings in one table.

    silhouette_squared uses squared distances and is not comparable with the Euclidean silhouette, which
    `silhouette_euclidean` estimates over all rows."""
    sums = cluster_sums(points, label, features, by)
    by = list(by)
    if not by:
        points, sums, by_ = points.withColumn("all_", F.lit(1)), sums.withColumn("all_", F.lit(1)), ["all_"]
    else:
        by_ = by
    out = (
        calinski_harabasz(sums, features, by_)
        .join(davies_bouldin(points, sums, label, features, by_), by_, "left")
        .join(silhouette_squared(points, sums, label, features, by_), by_, "left")
    )
    ok = "clusters >= 2 and clusters < rows"
    out = with_exprs(out, {c: f"case when {ok} then {c} end" for c in ("silhouette_squared", "calinski_harabasz", "davies_bouldin")})
    return out.select(*by, "clusters", "rows", "inertia", "silhouette_squared", "calinski_harabasz", "davies_bouldin")


def contingency(df: DataFrame, a: str, b: str, by: list = ()) -> DataFrame:
    return df.filter(f"{a} is not null and {b} is not null").groupBy(*by, F.col(a).alias("a"), F.col(b).alias("b")).agg(
        F.count("*").alias("n"))


def agreement(df: DataFrame, a: str, b: str, by: list = ()) -> DataFrame:
    """Adjusted Rand index and normalised mutual information of two labelings (or many, by `by`).

    Rows are counted into the label pairs first; everything after runs over that small table.
    """
    by = list(by)
    cells = contingency(df, a, b, by)

    def pairs(c):
        return f"cast({c} as double) * ({c} - 1) / 2"

    wa, wb, wall = (W.partitionBy(*by, x) for x in ("a", "b", F.lit(0)))
    full = cells.withColumns({
        "na": F.sum("n").over(wa), "nb": F.sum("n").over(wb), "total": F.sum("n").over(wall),
        "ra": F.row_number().over(wa.orderBy("b")), "rb": F.row_number().over(wb.orderBy("a")),
    })
    one = full.groupBy(*by).agg(*[F.expr(e) for e in (
        "max(total) as total",
        f"sum({pairs('n')}) as cell_pairs",
        f"sum({pairs('na')}) filter (where ra = 1) as a_pairs",
        f"sum({pairs('nb')}) filter (where rb = 1) as b_pairs",
        "sum(n / total * ln(n * cast(total as double) / (cast(na as double) * nb))) as mutual",
        "-sum(na / total * ln(na / total)) filter (where ra = 1) as a_entropy",
        "-sum(nb / total * ln(nb / total)) filter (where rb = 1) as b_entropy",
    )])
    return with_exprs(one, {
        "expected": f"a_pairs * b_pairs / nullif({pairs('total')}, 0D)",
        "best": "(a_pairs + b_pairs) / 2",
        "mean_entropy": "(a_entropy + b_entropy) / 2",
    }).selectExpr(
        *by,
        "case when best = expected then 1D else (cell_pairs - expected) / (best - expected) end as ari",
        "case when mean_entropy <= 1e-15 then 1D else greatest(mutual, 0D) / mean_entropy end as nmi",
    )


def noise_report(df: DataFrame, label: str, by: list = ()) -> DataFrame:
    """Clusters without noise (-1), share of noise, share of the largest cluster among the rest."""
    sizes = df.groupBy(*by, label).agg(F.count("*").alias("n"))
    real = f"{label} <> -1"
    return sizes.groupBy(*by).agg(*[F.expr(e) for e in (
        f"count(*) filter (where {real}) as clusters_ex_noise",
        f"coalesce(sum(n) filter (where {label} = -1), 0) / sum(n) as noise_share",
        f"max(n) filter (where {real}) / sum(n) filter (where {real}) as largest_cluster_share",
    )])
