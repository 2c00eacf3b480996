"""KMeans with many restarts: all models of a run advance in the same pass over the data.

A run is a list of `Spec`s (seed, number of clusters, feature mask, row share).
Every pass ships the current centroids to the tasks (models x k x features
numbers) and brings back one partial sum per model and cluster; the rows stay
where they are.  Restarts, k sweeps, seed, bootstrap and leave-one-out studies
are all just more specs.

Rows that lie close together are stored one after another.  Where the box of such a block of rows lies on one side of all
borders between a model's centroids, the sums of the block are added as they are; only for the other pairs of block and
model rows are compared one by one, so every row still goes to its nearest centroid.
"""

from dataclasses import dataclass, field

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, functions as F

from .. import constants as C
from ..functions.scalars import num, text
from ..session import delete, new_folder, stored

MASK64 = (1 << 64) - 1
# Distances that are held at a time: few enough for a core's cache.
CELLS = 100_000
# Rows of a block; rows x models from which on it is worth to store close rows together; rows that a task puts in order at a time.
BLOCK = 64
MANY = 200_000_000
CHUNK = 250_000


@dataclass
class Spec:
    """One model to fit: name, clusters, seed, weight of each feature, share of rows it sees and the number of that sample
    (models with the same number see the same rows; by default the seed)."""

    name: str
    k: int = C.K_CLUSTERS
    seed: int = C.SEED
    mask: tuple | None = None
    share: float = 1.0
    sample: int | None = None

    @property
    def salt(self) -> int:
        return (self.seed if self.sample is None else self.sample) * 7919 + 17


@dataclass
class Fit:
    spec: Spec
    centroids: np.ndarray
    inertia: float
    iterations: int
    rows: int
    history: list = field(default_factory=list)


def point_table(df: DataFrame, features: list, medians: dict, keep=()) -> DataFrame:
    """Gap-free feature columns x_0.. and a row key that does not depend on the layout of the data."""
    points = [f"coalesce({f}, {num(medians[f])}) as x_{i}" for i, f in enumerate(features)]
    table = df.selectExpr(*keep, *points)
    key = F.xxhash64(*(list(keep) or table.columns))
    return table.withColumn("row_key", key)


def _bits(keys: np.ndarray, salts: np.ndarray) -> np.ndarray:
    """53 random bits per row (and salt) from its key: the same on every run and every partitioning."""
    with np.errstate(over="ignore"):
        z = keys.astype(np.uint64) + salts
        for shift, factor in ((30, 0xBF58476D1CE4E5B9), (27, 0x94D049BB133111EB)):
            z ^= z >> np.uint64(shift)
            z *= np.uint64(factor)
        z ^= z >> np.uint64(31)
        z >>= np.uint64(11)
    return z


def _salts(salt) -> np.ndarray:
    return np.asarray([int(s) * 0x9E3779B97F4A7C15 & MASK64 for s in np.atleast_1d(salt)], np.uint64)


def _part(bits: np.ndarray) -> np.ndarray:
    return bits.astype(float) / 9007199254740992.0 + 1e-17


def _uniform(keys: np.ndarray, salt) -> np.ndarray:
    """Uniform (0, 1) per row (and salt)."""
    out = _part(_bits(keys[:, None], _salts(salt)))
    return out if np.ndim(salt) else out[:, 0]


class Stack:
    """Models with the same number of centroids and the same rows, compared with rows in one matrix product.

    With feature weights w the squared distance is w.x^2 - 2 x.(w c) + w.c^2, so masks only change the matrices; w.x^2 is the
    same for all centroids, so only the rest is compared."""

    def __init__(self, members: list, specs: list, centres: list, n_features: int, close: bool = False):
        self.members, self.k, self.n_features, self.close = members, len(centres[members[0]]), n_features, close
        first = specs[members[0]]
        self.share, self.salt = first.share, first.salt
        w = np.array([specs[m].mask if specs[m].mask is not None else [1.0] * n_features for m in members], float)
        c = np.array([centres[m] for m in members], float)
        self.weights, self.weight_of = np.unique(w, axis=0, return_inverse=True)
        wc = w[:, None] * c
        # per centroid: features and a constant x models
        self.cross = np.ascontiguousarray(np.concatenate([-2.0 * wc, (wc * c).sum(2)[..., None]], 2).transpose(1, 2, 0))
        #: per centroid: row count and feature sums x models
        self.totals = np.zeros((self.k, 1 + n_features, len(members)))
        #: sums of w.x^2 for each of the weights: the same for all centroids that the rows may go to
        self.squares = np.zeros(len(self.weights))
        if close:
            #: models x centroids x features and a constant, and totals of the same form
            self.by_model = np.ascontiguousarray(self.cross.transpose(2, 0, 1))
            self.dealt = np.zeros(self.by_model.shape)

    def add(self, x: np.ndarray, keys: np.ndarray) -> None:
        """Assign rows to their nearest centroid (the first of equal ones) and add them up."""
        if self.share < 1:
            x = x[_uniform(keys, self.salt) < self.share]
        if not len(x):
            return
        self.squares += self.weights @ (x * x).sum(0)
        ones = np.ones((len(x), 1))
        rows, columns = np.hstack([x, ones]), np.ascontiguousarray(np.hstack([ones, x]).T)
        models = len(self.members)
        if not self.close:
            size = max(1, CELLS // (self.k * models))
            for at in range(0, len(x), size):
                self.totals += self._compared(rows[at:at + size], columns[:, at:at + size], self.cross)
            return
        starts = np.arange(0, len(x), BLOCK)
        low, high, sums = np.minimum.reduceat(x, starts), np.maximum.reduceat(x, starts), np.add.reduceat(columns, starts, 1)
        size, width = max(1, CELLS // (self.k * models)), max(1, CELLS // (self.k * BLOCK))
        places = np.arange(1, self.k + 1, dtype=np.int8)[:, None, None]
        for at in range(0, len(starts), size):
            open_ = self._open(low[at:at + size], high[at:at + size])
            count = np.add.reduce(open_.view(np.int8), 0, dtype=np.int8)
            self.totals += np.matmul(sums[:, at:at + size], (open_ & (count == 1)).astype(float))
            last = (places * open_.view(np.int8)).max(0) - 1
            first = self.k - (places[::-1] * open_.view(np.int8)).max(0)
            for b in np.flatnonzero((count > 1).any(1)):
                here = slice(starts[at + b], starts[at + b] + BLOCK)
                some = np.flatnonzero(count[b] == 2)
                if len(some):
                    self._divide(rows[here], columns[:, here], sums[:, at + b], some, first[b, some], last[b, some])
                some = np.flatnonzero(count[b] > 2)
                for to in range(0, len(some), width):
                    part = some[to:to + width]
                    got = self._compared(rows[here], columns[:, here], np.take(self.cross, part, 2))
                    self.dealt[part] += got.transpose(2, 0, 1)

    def _divide(self, rows: np.ndarray, columns: np.ndarray, sums: np.ndarray, models: np.ndarray, a: np.ndarray, b: np.ndarray) -> None:
        """Deal rows to the two centroids a and b (a before b) of some models: one product, the rest of the sums goes to a."""
        to_b = np.matmul(columns, (np.matmul(rows, (self.by_model[models, b] - self.by_model[models, a]).T) < 0).astype(float)).T
        self.dealt[models, b] += to_b
        self.dealt[models, a] += sums - to_b

    def _compared(self, rows: np.ndarray, columns: np.ndarray, cross: np.ndarray) -> np.ndarray:
        """The totals of rows that are compared one by one with the centroids of some models."""
        d = np.matmul(rows, cross)
        own = d == d.min(0)
        if np.count_nonzero(own) != d.shape[1] * d.shape[2]:
            own &= np.cumsum(own, 0) == 1
        return np.matmul(columns, own.astype(float))

    def _open(self, low: np.ndarray, high: np.ndarray) -> np.ndarray:
        """Centroids x boxes x models: may the centroid be the nearest one for some place of the box?

        The difference of two squared distances is linear, so over a box it leaves its value in the middle by no more than the
        box's half widths allow.  What is equal up to rounding is left open."""
        middle, width = (low + high) / 2, high - low
        d = np.matmul(np.hstack([middle, np.ones((len(low), 1))]), self.cross)
        spare = 1e-12 * max(1.0, float(np.abs(self.cross).max())) * max(1.0, float(np.abs(middle).max()))
        open_ = np.ones(d.shape, bool)
        for i in range(self.k):
            for j in range(i + 1, self.k):
                reach = width @ (np.abs(self.cross[i, :-1] - self.cross[j, :-1]) / 2) + spare
                ahead = d[j] - d[i]
                open_[j] &= ahead <= reach
                open_[i] &= -ahead <= reach
        return open_

    def sums(self) -> np.ndarray:
        """Clusters x (row count, squared distance, feature sums) x models.

        Of the squared distances only the sum over a model's clusters has a meaning: w.x^2 is dealt to them by their rows."""
        totals = self.totals + self.dealt.transpose(1, 2, 0) if self.close else self.totals
        n, s = totals[:, :1], totals[:, 1:]
        squares = self.squares[self.weight_of.ravel()] * n / np.maximum(n.sum(0), 1)
        return np.concatenate([n, squares + (self.cross * np.concatenate([s, n], 1)).sum(1, keepdims=True), s], 1)


def _stacks(specs: list, centres: list, n_features: int, close: bool = False) -> list:
    """The models that have centres, by their number of centroids and their rows."""
    groups: dict = {}
    for m, c in enumerate(centres):
        if c is not None:
            groups.setdefault((len(c), specs[m].share < 1 and (specs[m].share, specs[m].salt)), []).append(m)
    return [Stack(members, specs, centres, n_features, close) for members in groups.values()]


def seed_centroids(points: DataFrame, n_features: int, specs: list) -> list:
    """k-means++ over all rows: in each round, one pass picks one new centre for every model.

    Drawing a row with probability proportional to its squared distance is the
    same as taking the smallest -ln(u) / distance, so a task returns one
    candidate row per model and the smallest key wins.  No distance is larger than
    that to the far corner of the rows' box, so a row whose u is too small for that
    cannot win; only for the few others distances are computed.
    """
    names = [f"x_{i}" for i in range(n_features)]
    centres = [np.empty((0, n_features)) for _ in specs]
    schema = "m int, score double, row_key long, " + ", ".join(f"{n} double" for n in names)
    for step in range(max(s.k for s in specs)):
        open_models = [m for m, s in enumerate(specs) if s.k > step]

        def draw(batches, start=centres, step=step, open_models=open_models):
            mine = [specs[m] for m in open_models]
            salts = _salts([s.seed * 1000003 + m * 101 + step for m, s in zip(open_models, mine)])
            shares, samples = np.array([s.share for s in mine]), _salts([s.salt for s in mine])
            w = np.array([s.mask if s.mask is not None else [1.0] * n_features for s in mine], float)
            c = np.array([start[m] for m in open_models], float)
            best = np.full(len(mine), np.inf)
            best_key, best_x = np.zeros(len(mine), np.int64), np.zeros((len(mine), n_features))
            size = max(1, CELLS // len(mine))
            for pdf in batches:
                every_x, every_key = pdf[names].to_numpy(), pdf["row_key"].to_numpy()
                if not len(pdf):
                    continue
                far = np.ones(len(mine))
                if step:
                    corner = np.maximum(every_x.max(0) - c, c - every_x.min(0))
                    far = (w[:, None] * corner * corner).sum(2).min(1) * (1 + 1e-9)
                for at in range(0, len(pdf), size):
                    keys = every_key[at:at + size]
                    bits = _bits(keys[:, None], salts)
                    with np.errstate(invalid="ignore"):
                        least = np.exp(-np.where(np.isfinite(best), best * far, np.inf)) * (1 - 1e-9) * 9007199254740992.0 - 2
                    i, m = np.nonzero(bits >= np.maximum(least, 0.0).astype(np.uint64))
                    if not len(i):
                        continue
                    key, x = keys[i], every_x[at + i]
                    gap = -np.log(_part(bits[i, m]))
                    if step:
                        d = np.full(len(i), np.inf)
                        for j in range(step):
                            np.minimum(d, (w[m] * (x - c[m, j]) ** 2).sum(1), out=d)
                        gap = np.where(d > 1e-12, gap / np.maximum(d, 1e-12), np.inf)
                    gap[_part(_bits(key, samples[m])) >= np.where(shares[m] < 1, shares[m], np.inf)] = np.inf
                    order = np.lexsort((key, gap, m))
                    first = order[np.unique(m[order], return_index=True)[1]]
                    to, low, key = m[first], gap[first], key[first]
                    better = (low < best[to]) | ((low == best[to]) & (key < best_key[to]))
                    to = to[better]
                    best[to], best_key[to], best_x[to] = low[better], key[better], x[first[better]]
            found = np.isfinite(best)
            yield pd.DataFrame({"m": np.array(open_models, np.int32)[found], "score": best[found], "row_key": best_key[found]}
                               | {n: best_x[found, j] for j, n in enumerate(names)})

        picked = (
            points.select(*names, "row_key").mapInPandas(draw, schema)
            .groupBy("m").agg(F.min_by(F.struct(*names), F.struct("score", "row_key")).alias("row")).selectExpr("m", "row.*").toPandas()
        )
        rows = dict(zip(picked["m"], picked[names].to_numpy()))
        # A model that has seen all distinct rows already repeats its last centre.
        centres = [c if m not in open_models else np.vstack([c, rows[m] if m in rows else c[-1]]) for m, c in enumerate(centres)]
    return centres


def lloyd_pass(points: DataFrame, n_features: int, specs: list, centres: list, close: bool = False) -> dict:
    """One assign-and-sum pass: per live model an array clusters x (row count, squared distance, feature sums); the squared
    distances are to be added up over the clusters.  close: the points are stored by `close_rows`."""
    names = [f"x_{i}" for i in range(n_features)]
    schema = "m int, c int, n long, inertia double, " + ", ".join(f"s_{i} double" for i in range(n_features))

    def sums(batches):
        stacks = _stacks(specs, centres, n_features, close)
        for pdf in batches:
            x, keys = pdf[names].to_numpy(), pdf["row_key"].to_numpy()
            for stack in stacks:
                stack.add(x, keys)
        for stack in stacks:
            part = stack.sums().transpose(1, 2, 0).reshape(2 + n_features, -1)
            yield pd.DataFrame(
                {"m": np.repeat(np.array(stack.members, np.int32), stack.k), "c": np.tile(np.arange(stack.k, dtype=np.int32), len(stack.members)),
                 "n": np.rint(part[0]).astype(np.int64), "inertia": part[1]} | {f"s_{i}": part[2 + i] for i in range(n_features)})

    got = points.select(*names, "row_key").mapInPandas(sums, schema).groupBy("m", "c").agg(
        F.sum("n").alias("n"), F.sum("inertia").alias("inertia"), *[F.sum(f"s_{i}").alias(f"s_{i}") for i in range(n_features)]).toPandas()
    out = {m: np.zeros((len(c), 2 + n_features)) for m, c in enumerate(centres) if c is not None}
    values = got[["n", "inertia", *[f"s_{i}" for i in range(n_features)]]].to_numpy(float)
    for m, c, row in zip(got["m"], got["c"], values):
        out[m][c] = row
    return out


def spread(points: DataFrame, models: int) -> DataFrame:
    """The stored points in enough files for all task slots where many models make a small table much work."""
    slots = points.sparkSession.sparkContext.defaultParallelism
    if models < 100 or len(points.inputFiles()) >= slots:
        return points
    return stored(points.repartition(slots, "row_key"), "points")


def _near_order(x: np.ndarray) -> np.ndarray:
    """An order of the rows in which each block of BLOCK rows lies close together: halves along the widest dimension."""
    out, todo = [], [np.arange(len(x))]
    while todo:
        rows = todo.pop()
        if len(rows) <= BLOCK:
            out.append(rows)
            continue
        part = x[rows]
        half = -(-(len(rows) // 2) // BLOCK) * BLOCK
        order = np.argpartition(part[:, (part.max(0) - part.min(0)).argmax()], half if half < len(rows) else half - 1)
        todo += [rows[order[half:]], rows[order[:half]]]
    return np.concatenate(out) if out else np.arange(0)


def close_rows(points: DataFrame, n_features: int) -> DataFrame:
    """The points (x_.., row_key) in tasks of neighbours, in each of which close rows follow one another.

    Tasks hold ranges of interleaved coarse places; equal places are divided by the row key, so no task grows with a hot place."""
    names = [f"x_{i}" for i in range(n_features)]
    ends = points.agg(*[F.min(n) for n in names], *[F.max(n) for n in names], F.count(F.lit(1))).first()
    low, high, rows = ends[:n_features], ends[n_features:-1], ends[-1]
    places = [f"coalesce(cast(least(7D, floor(({n} - {num(a)}) / {num((b - a) / 8)})) as int), 0)" for n, a, b in zip(names, low, high) if rows and b > a]
    bits = [f"((shiftright({p}, {2 - level}) & 1) = 1)" for level in range(3) for p in places]
    key = [F.expr(f"array({', '.join(bits)})")] if bits else []
    slots = points.sparkSession.sparkContext.defaultParallelism
    tasks = max(1, -(-rows // (CHUNK * slots))) * slots  # as many in the last wave as in the others

    def ordered(batches):
        held, n = [], 0
        for pdf in batches:
            held, n = [*held, pdf], n + len(pdf)
            if n >= CHUNK:
                every, held, n = pd.concat(held), [], 0
                yield every.iloc[_near_order(every[names].to_numpy())]
        if held:
            every = pd.concat(held)
            yield every.iloc[_near_order(every[names].to_numpy())]

    some = points.select(*names, "row_key")
    return some.repartitionByRange(tasks, *key, "row_key").mapInPandas(ordered, some.schema)


def fit_many(points: DataFrame, n_features: int, specs: list, max_iter: int = C.MAX_ITER, tol: float = C.TOL, init: list | None = None) -> list:
    """Fit every spec; a model leaves the passes when its centroids stop moving.

    Models of the same rows and features that reach the same centroids, in whatever order, go the same way from there:
    one of them stays in the passes and stands for the others.  points must be a stored table: it is read once per pass.
    """
    facts = points.agg(F.count(F.lit(1)), *[F.var_pop(f"x_{i}") for i in range(n_features)]).first()
    rows, variances = facts[0], facts[1:]
    close = rows * len(specs) >= MANY
    folder = new_folder(points.sparkSession, "close") if close else None
    if close:
        close_rows(points, n_features).write.parquet(folder)
        points = points.sparkSession.read.parquet(folder)
    else:
        points = spread(points, len(specs))
    centres = init or seed_centroids(points, n_features, specs)
    limit = tol * float(np.mean([v or 0.0 for v in variances]))
    live = list(centres)
    fits = [Fit(s, np.asarray(c), float("inf"), 0, 0) for s, c in zip(specs, centres)]
    stands_for: dict = {}
    for step in range(max_iter + 1):
        cells = lloyd_pass(points, n_features, specs, live, close)
        for m, got in cells.items():
            old, fit = live[m], fits[m]
            fit.inertia, fit.rows = max(float(got[:, 1].sum()), 0.0), int(got[:, 0].sum())
            fit.centroids, fit.iterations = old, step
            fit.history.append(fit.inertia)
            # A cluster that lost all its rows keeps its place.
            new = np.where(got[:, :1] > 0, got[:, 2:] / np.maximum(got[:, :1], 1), old)
            done = step == max_iter or float(((new - old) ** 2).sum()) <= limit
            live[m] = None if done else new
        met: dict = {}
        for m, centre in enumerate(live):
            if centre is not None:
                s = specs[m]
                place = (s.mask, s.share, s.share < 1 and s.salt, centre[np.lexsort(centre.T)].tobytes())
                if met.setdefault(place, m) != m:
                    stands_for[m], live[m] = met[place], None
        if all(c is None for c in live):
            break
    if folder:
        delete(points.sparkSession, folder)
    for m in sorted(stands_for, reverse=True):
        first = m
        while first in stands_for:
            first = stands_for[first]
        end = fits[first]
        fits[m] = Fit(specs[m], end.centroids, end.inertia, end.iterations, end.rows, fits[m].history + end.history[len(fits[m].history):])
    return fits


def best_fit(fits: list) -> Fit:
    return min(fits, key=lambda f: (f.inertia, f.spec.seed, f.spec.name))


def restarts(k: int = C.K_CLUSTERS, n_init: int = C.N_INIT, seed: int = C.SEED, tag: str = "run", **kw) -> list:
    return [Spec(f"{tag}_{i}", k, seed * 100_003 + i, **kw) for i in range(n_init)]


def kmeans(points: DataFrame, n_features: int, k: int = C.K_CLUSTERS, n_init: int = C.N_INIT, seed: int = C.SEED) -> Fit:
    """Best of n_init restarts by inertia."""
    return best_fit(fit_many(points, n_features, restarts(k, n_init, seed)))


def distance_text(centroid, n_features: int, mask=None) -> str:
    w = [1.0] * n_features if mask is None else mask
    return " + ".join(f"{num(w[i])} * (x_{i} - {num(v)}) * (x_{i} - {num(v)})" for i, v in enumerate(centroid))


def label_text(centroids, n_features: int, mask=None) -> str:
    """Nearest centroid of the x_ columns as one expression; the lowest index wins ties."""
    listed = ", ".join(distance_text(c, n_features, mask) for c in centroids)
    return f"transform(array(array({listed})), d -> cast(array_position(d, array_min(d)) - 1 as int))[0]"


def long_labels(points: DataFrame, fits: dict, n_features: int, keep=()) -> DataFrame:
    """One row per point and model: (model, label), from one scan of the points."""
    rows = ", ".join(
        f"named_struct('model', {text(name)}, 'label', {label_text(f.centroids, n_features, f.spec.mask)})"
        for name, f in fits.items())
    xs = [f"x_{i}" for i in range(n_features)]
    return points.selectExpr(*keep, *xs, f"inline(array({rows}))")
