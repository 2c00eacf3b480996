"""Principal components from one covariance pass; the projection itself is a column expression."""

import numpy as np
from pyspark.sql import DataFrame, functions as F

from ..functions.scalars import num


def covariance(points: DataFrame, features: list) -> DataFrame:
    """Sample covariance in long form, from one aggregation."""
    pairs = [(a, b) for i, a in enumerate(features) for b in features[i:]]
    body = ", ".join(f"named_struct('a', '{a}', 'b', '{b}', 'covariance', covar_samp({a}, {b}))" for a, b in pairs)
    return points.selectExpr(f"array({body}) as cells").selectExpr("inline(cells)")


def pca(points: DataFrame, features: list, n: int = 2, labels: list = ()) -> DataFrame:
    """PC1..PCn of centred rows, the label columns and the explained share.

    Only the feature x feature matrix reaches the driver.  Signs are fixed: the
    largest loading of a component is positive.
    """
    if n not in (2, 3):
        raise ValueError("n must be 2 or 3")
    size = len(features)
    at = {f: i for i, f in enumerate(features)}
    matrix = np.zeros((size, size))
    for r in covariance(points, features).collect():
        matrix[at[r["a"]], at[r["b"]]] = matrix[at[r["b"]], at[r["a"]]] = r["covariance"]
    mean = points.agg(*[F.avg(f).alias(f) for f in features]).first()
    values, vectors = np.linalg.eigh(matrix)
    order = np.argsort(values)[::-1][:n]
    share = float(values[order].sum() / values.sum())
    out = []
    for place, column in enumerate(order, 1):
        v = vectors[:, column]
        v = v * np.sign(v[np.argmax(np.abs(v))])
        body = " + ".join(f"({f} - {num(mean[f])}) * {num(v[i])}" for i, f in enumerate(features))
        out.append(f"{body} as PC{place}")
    return points.selectExpr(*labels, *out, f"{num(share)} as explained_variance_ratio_sum")
