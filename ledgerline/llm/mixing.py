"""Mixing sources to target weights by Poisson replication, in DataFrame functions only."""

from collections.abc import Mapping

from pyspark.sql import Column, DataFrame, functions as F

#: Largest mean of one Poisson draw; a larger mean is a sum of draws, so that exp(-mean) stays far from zero.
PIECE = 16.0
#: Counts tried for one draw: at a mean of 16 the chance of more is below the 52 bits of the uniform number.
TERMS = 80


def uniform(seed: int, *parts: Column) -> Column:
    """A number in [0, 1) from the first 52 bits of an MD5 of seed and parts: the same on every engine."""
    text = F.concat_ws("|", F.lit(str(seed)), *[F.coalesce(p.cast("string"), F.lit("")) for p in parts])
    return F.conv(F.substring(F.md5(text.cast("binary")), 1, 13), 16, 10).cast("long") / F.lit(2.0**52)


def poisson_count(u: Column, mean: Column) -> Column:
    """The inverse of the Poisson distribution function: the number of counts k with P(X <= k) <= u."""
    state = F.aggregate(
        F.sequence(F.lit(1), F.lit(TERMS)),
        F.struct(F.exp(-mean).alias("term"), F.exp(-mean).alias("sum"), F.lit(0).alias("n")),
        lambda s, k: F.when(
            u >= s["sum"],
            F.struct((s["term"] * mean / k).alias("term"), (s["sum"] + s["term"] * mean / k).alias("sum"), (s["n"] + 1).alias("n"))
        ).otherwise(s))
    return state["n"]


def source_means(docs: DataFrame, weights: Mapping[str, float], rest: float, epochs: float) -> DataFrame:
    """bucket, mean: target repetition rate of each named source and of all others together.

    The rate is (target share x wanted total) / size; sizes are UTF-8 bytes + 1 of all rows and the wanted
    total is `epochs` times the size of the sources with a positive weight.  At most one row per name in
    `weights` and one more: the table is bounded by the parameters, not by the data.
    """
    size = docs.groupBy(bucket(weights).alias("bucket")).agg(
        F.sum(F.coalesce(F.octet_length("text"), F.lit(0)).cast("long") + 1).alias("bytes"))
    goal = F.coalesce(F.create_map(*[F.lit(x) for k, w in weights.items() for x in (k, millionths(w))])[F.col("bucket")], F.lit(millionths(rest)))
    size = size.withColumn("weight", goal.cast("long")).filter("weight > 0")
    total = size.agg(F.sum("weight").alias("all_weight"), F.sum("bytes").alias("all_bytes"))
    return size.join(F.broadcast(total)).select(  # one row
        "bucket", (F.col("weight") / F.col("all_weight") * (F.lit(float(epochs)) * F.col("all_bytes")) / F.col("bytes")).alias("mean"))


def millionths(weight: float) -> int:
    """Weights are added as whole numbers, so that their sum does not depend on an order."""
    return round(weight * 1_000_000)


def bucket(weights: Mapping[str, float]) -> Column:
    """The name of a source that has a weight of its own; the empty string for all others, null included."""
    return F.when(F.col("source").isin(*weights), F.col("source")).otherwise(F.lit(""))


def mix_sources(docs: DataFrame, weights: Mapping[str, float], rest: float = 0.0, epochs: float = 1.0, seed: int = 17) -> DataFrame:
    """Repeat every document a Poisson number of times and deal the copies out in a new global order.

    Reads `doc_id`, `text`, `source`; returns all columns of `docs` and mix_mean (double), mix_copy (int, from 1)
    and mix_key (double, the place in the global order; rows are dealt to partitions by it and sorted by it).
    Columns of these names in `docs` are replaced.  A document's count inverts a Poisson distribution with the
    mean of its source at a number hashed from seed and doc_id, so it does not depend on layout or retries.
    `weights` names sources (not empty); all others, null included, share the weight `rest`.  Without
    weight a source is left out: that is its target.  Null and empty texts count as one byte.  Rows that
    repeat a doc_id get the same count.  An empty table gives an empty result.
    """
    if not weights or any(w < 0 for w in [*weights.values(), rest]):
        raise ValueError("weights must name at least one source and be 0 or more")
    if "" in weights:
        raise ValueError("the empty name stands for all other sources")
    own = [c for c in docs.columns if c not in ("mix_mean", "mix_copy", "mix_key")]
    means = source_means(docs, weights, rest, epochs).withColumnsRenamed({"mean": "mix_mean"})
    pieces = F.greatest(F.ceil(F.col("mix_mean") / PIECE).cast("int"), F.lit(1))
    doc = F.col("row.doc_id")
    draws = F.transform(F.sequence(F.lit(1), pieces), lambda k: poisson_count(uniform(seed, doc, k), F.col("mix_mean") / pieces))
    count = F.aggregate(draws, F.lit(0), lambda a, n: a + n)
    # the columns of `docs` travel in one struct, so none of them can meet a name that is used here
    return (
        docs.select(F.struct(*own).alias("row"), bucket(weights).alias("bucket")).join(F.broadcast(means), "bucket")  # bounded by `weights`
        .select("row", "mix_mean", count.alias("copies")).filter("copies > 0")
        .select("row", "mix_mean", F.explode(F.sequence(F.lit(1), F.col("copies"))).alias("mix_copy"))
        .withColumn("mix_key", uniform(seed + 1, doc, F.col("mix_copy")))
        .repartition("mix_key").sortWithinPartitions("mix_key")
        .select("row.*", "mix_mean", "mix_copy", "mix_key")
    )


def mixing_sql(weights: Mapping[str, float], rest: float, epochs: float, seed: int, columns: str, docs: str = "documents") -> str:
    """The same selection in DuckDB's SQL (means up to one piece a draw are cut in the same way)."""
    names = ", ".join(f"'{k}'" for k in weights)
    goal = " ".join(f"WHEN '{k}' THEN {millionths(v)}" for k, v in weights.items())
    u = f"(('0x' || substr(md5('{seed}|' || coalesce(doc_id::VARCHAR, '') || '|' || k), 1, 13))::BIGINT / 4503599627370496.0::DOUBLE)"
    key = f"(('0x' || substr(md5('{seed + 1}|' || coalesce(doc_id::VARCHAR, '') || '|' || mix_copy), 1, 13))::BIGINT / 4503599627370496.0::DOUBLE)"
    return f"""WITH RECURSIVE d AS MATERIALIZED (SELECT *, CASE WHEN source IN ({names}) THEN source ELSE '' END AS bucket FROM {docs}),
 size AS (SELECT bucket, sum(coalesce(strlen(text), 0) + 1) AS bytes, CASE bucket {goal} ELSE {millionths(rest)} END::BIGINT AS weight FROM d GROUP BY 1),
 means AS MATERIALIZED (SELECT bucket, weight::DOUBLE / (SELECT sum(weight) FROM size WHERE weight > 0)::DOUBLE
  * ({float(epochs)!r}::DOUBLE * (SELECT sum(bytes) FROM size WHERE weight > 0)::DOUBLE) / bytes::DOUBLE AS mean FROM size WHERE weight > 0),
 parts AS MATERIALIZED (SELECT bucket, mean, greatest(ceil(mean / {PIECE}), 1)::INT AS pieces FROM means),
 terms AS (SELECT bucket, 0 AS k, exp(-(mean / pieces)) AS term, exp(-(mean / pieces)) AS total, mean / pieces AS m FROM parts
  UNION ALL SELECT bucket, k + 1, term * m / (k + 1), total + term * m / (k + 1), m FROM terms WHERE k + 1 < {TERMS}),
 steps AS MATERIALIZED (SELECT bucket, list(total ORDER BY k) AS totals FROM terms GROUP BY 1),
 counted AS (SELECT d.*, mean AS mix_mean, list_sum([len([t FOR t IN totals IF t <= {u}]) FOR k IN range(1, pieces + 1)])::INT AS n
  FROM d JOIN parts USING (bucket) JOIN steps USING (bucket)),
 copies AS (SELECT *, unnest(range(1, n + 1))::INT AS mix_copy FROM counted WHERE n > 0)
 SELECT {columns.replace('mix_key', key + ' AS mix_key')} FROM copies"""
