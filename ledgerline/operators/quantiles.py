"""Exact quantiles for groups of any size, with a bounded last step and one path for all sizes.

Spark's own exact `percentile` keeps every distinct value of a group in one
buffer.  Here no task ever needs a whole group: values are counted first, and
ranks follow from sums over parts of a group.
"""

from pyspark.sql import DataFrame, Window as W, functions as F

from ..session import stored

# Rank band around a wanted quantile; wider than the sketch error, so it always contains it.
BAND = 1e-3
BAND_ACCURACY = 5_000
# Values of one group and quantile that the last step may sort, and slices of one narrowing step.
LAST = 10_000
SLICES = 1_000
# Rows that a task sorts for the median of groups (some 100 MB, so that the sort stays in memory), those of one hash that may lie
# in one task, and the number of hashes.
TASK_ROWS = 500_000
GROUP_ROWS = 1_000_000
BUCKETS = 1 << 16


def grouped_median(df: DataFrame, keys: list, value: str, carry: dict | None = None, deal: list | None = None) -> DataFrame:
    """Exact median per group, for many groups of any size; carry: more aggregates of a group by name.

    Rows move once, dealt by `deal` (some of the keys, all by default), and are sorted within their task, where the middle
    rows are found.  A first pass counts rows by a hash of the `deal` columns: it gives the number of tasks, and groups
    whose hash has more than GROUP_ROWS rows go by `_spread_median`, so that no task holds a hot group."""
    carry, deal = carry or {}, deal or keys
    df = df.filter(F.col(value).isNotNull())
    bucket = F.pmod(F.xxhash64(*deal), F.lit(BUCKETS))
    counts = df.groupBy(bucket.alias("bucket_")).agg(F.count(F.lit(1)).alias("rows_"))
    rows, hot = counts.agg(F.sum("rows_"), F.collect_list(F.when(F.col("rows_") > GROUP_ROWS, F.col("bucket_")))).first()  # at most BUCKETS numbers
    if not hot:
        return _sorted_median(df, keys, value, carry, deal, rows or 0)
    cold = _sorted_median(df.filter(~bucket.isin(hot)), keys, value, carry, deal, rows)
    return cold.unionByName(_spread_median(df.filter(bucket.isin(hot)), keys, value, carry))


def _sorted_median(df: DataFrame, keys: list, value: str, carry: dict, deal: list, rows: int) -> DataFrame:
    """The median of groups that fit a task: one shuffle and one sort, in enough tasks for `rows` rows.

    The number of tasks is given, because Spark would merge parts by their compressed size, which says little about the sort.
    The result is dealt by `deal` and ordered by `keys`."""
    few = min(df.sparkSession.sparkContext.defaultParallelism, rows // (TASK_ROWS // 10))
    df = df.repartition(max(1, few, -(-rows // TASK_ROWS)), *deal)
    if dict(df.dtypes)[value] in ("double", "float"):
        df = df.withColumn(value, F.col(value) + F.lit(0).cast(dict(df.dtypes)[value]))  # no -0.0
    order = W.partitionBy(*keys).orderBy(value)
    whole = order.rowsBetween(W.unboundedPreceding, W.unboundedFollowing)
    ranked = df.select(
        *keys, F.col(value).alias("v_"), F.lag(value).over(order).alias("last_"), F.row_number().over(order).alias("rank_"),
        F.count(F.lit(1)).over(whole).alias("n_"), *[c.over(whole).alias(name) for name, c in carry.items()])
    low = F.when(F.col("n_") % 2 == 0, F.col("last_")).otherwise(F.col("v_"))
    return ranked.filter("rank_ = n_ div 2 + 1").select(*keys, *carry, ((low + F.col("v_")) / 2).alias(value))


def _spread_median(df: DataFrame, keys: list, value: str, carry: dict) -> DataFrame:
    """The median of groups of any size.

    Rows are counted by (group, value), which merges a hot value before the shuffle, and dealt to tasks by ranges
    of (group, value), which spreads a hot group.  A part's ranks start where the group's parts before it end, so
    the middle values are found where they lie.  Sorting spills; nothing is collected per group.
    """
    counted = df.groupBy(*keys, F.col(value).alias("v_")).agg(
        F.count("*").alias("c_"), *[c.alias(name) for name, c in carry.items()])
    n = int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    counted = stored(counted, "counted")  # dealing by ranges reads it twice: once to find them
    parts = stored(counted.repartitionByRange(n, *keys, "v_").withColumn("part_", F.spark_partition_id()), "parts")
    totals = parts.groupBy(*keys, "part_").agg(F.sum("c_").alias("rows_"), *[F.max(c).alias(c) for c in carry])
    group = W.partitionBy(*keys)  # one row per part of a group
    totals = totals.select(
        *[F.col(k).alias(f"k_{k}") for k in keys], F.col("part_").alias("k_part_"), "rows_",
        F.sum("rows_").over(group).alias("n_"),
        F.coalesce(F.sum("rows_").over(group.orderBy("part_").rowsBetween(W.unboundedPreceding, -1)), F.lit(0)).alias("before_"),
        *[F.max(c).over(group).alias(f"k_{c}") for c in carry])
    low, high = F.expr("(n_ + 1) div 2"), F.expr("n_ div 2 + 1")  # ranks from 1
    totals = totals.filter((F.col("before_") < high) & (F.col("before_") + F.col("rows_") >= low))
    same = [F.col(k).eqNullSafe(F.col(f"k_{k}")) for k in [*keys, "part_"]]
    inside = parts.drop(*carry).join(totals, same)
    run = W.partitionBy(*keys, "part_").orderBy("v_").rowsBetween(W.unboundedPreceding, 0)
    ranked = inside.withColumn("end_", F.sum("c_").over(run) + F.col("before_"))
    middle = ranked.filter((F.col("end_") >= low) & (F.col("end_") - F.col("c_") < high))
    at = lambda rank: F.max(F.when((F.col("end_") >= rank) & (F.col("end_") - F.col("c_") < rank), F.col("v_")))
    return middle.groupBy(*keys).agg(
        *[F.max(f"k_{c}").alias(c) for c in carry], ((at(low) + at(high)) / 2).alias(value)).select(*keys, *carry, value)


def _ranked(counted: DataFrame, keys: list) -> DataFrame:
    """keys (rank_ among them, from 0), n_, value: the value at rank_, from rows (keys, n_, below_, v_, c_).

    Until every group has at most LAST values, its values are cut into SLICES and the one slice that holds the rank
    stays; what lies below it joins below_.  A round shrinks the range of a group by that factor, so the loop ends when
    few values, or one, are left."""
    same = lambda other: [F.col(k).eqNullSafe(F.col(f"{other}{k}")) for k in keys]
    holds = (F.col("end_") > F.col("rank_")) & (F.col("end_") - F.col("s_") <= F.col("rank_"))
    while True:
        ends = counted.groupBy(*keys).agg(F.min("v_").alias("lo_"), F.max("v_").alias("hi_"), F.count("*").alias("values_"))
        ends = ends.select(*[F.col(k).alias(f"e_{k}") for k in keys], "lo_", "hi_", "values_")
        rows = ends.collect()  # one row per label, column and rank
        if not any(r["values_"] > LAST and r["hi_"] - r["lo_"] > abs(r["hi_"]) * 1e-13 for r in rows):
            break
        ends = F.broadcast(counted.sparkSession.createDataFrame(rows, ends.schema))
        slice_ = F.least(F.floor((F.col("v_") - F.col("lo_")) / (F.col("hi_") - F.col("lo_")) * SLICES), F.lit(SLICES - 1)).cast("int")
        sliced = counted.join(ends, same("e_")).withColumn("slice_", F.when(F.col("hi_") > F.col("lo_"), slice_).otherwise(0)).select(*counted.columns, "slice_")
        upto = W.partitionBy(*keys).orderBy("slice_").rowsBetween(W.unboundedPreceding, 0)  # at most SLICES rows
        sums = sliced.groupBy(*keys, "n_", "below_", "slice_").agg(F.sum("c_").alias("s_"))
        left = sums.withColumn("end_", F.sum("s_").over(upto) + F.col("below_")).filter(holds).select(
            *[F.col(k).alias(f"s_{k}") for k in keys], F.col("slice_").alias("at_"), (F.col("end_") - F.col("s_")).alias("now_"))
        counted = stored(sliced.join(left, [*same("s_"), F.col("slice_") == F.col("at_")]).select(
            *keys, "n_", F.col("now_").alias("below_"), "v_", "c_"), "narrowed")
    order = W.partitionBy(*keys).orderBy("v_").rowsBetween(W.unboundedPreceding, 0)  # at most LAST rows
    return counted.withColumnRenamed("c_", "s_").withColumn("end_", F.sum("s_").over(order) + F.col("below_")).filter(holds).select(
        *keys, "n_", F.col("v_").alias("value"))


def _pick(counted: DataFrame, keys: list, prob) -> DataFrame:
    """Linear-interpolated quantile from (keys, n_, below_, v_, c_): below_ rows lie below the values given.  The ranks on both
    sides of the quantile are found in the same rounds."""
    place = prob * (F.col("n_") - 1)
    ranks = F.explode(F.array_distinct(F.array(F.floor(place), F.ceil(place)))).alias("rank_")
    found = _ranked(counted.select("*", ranks), [*keys, "rank_"]).groupBy(*keys, "n_").agg(
        F.min_by("value", "rank_").alias("a_"), F.max_by("value", "rank_").alias("b_"))
    share = place - F.floor(place)
    value = F.when(F.col("a_") == F.col("b_"), F.col("a_")).otherwise(F.col("a_") + (F.col("b_") - F.col("a_")) * share)
    return found.select(*keys, value.alias("picked_"))


def label_quantiles(df: DataFrame, keys: list, cols: list, probs: list) -> DataFrame:
    """Exact quantiles of many columns for few groups (labels): keys, feature, prob, value.

    keys must be model labels (segment, cluster, rank ...): the sketch table has
    one row per label and is broadcast, so its size is bounded by the number of
    labels and columns.  Rows are never gathered per label: they are counted by
    value within a thin band, which spreads even a label holding most rows.
    """
    marker = not keys
    if marker:
        df, keys = df.withColumn("all_", F.lit(1)), ["all_"]
    df = df.select(*keys, *[F.col(c).cast("double").alias(c) for c in cols])
    probs = [float(p) for p in probs]
    ends = [min(max(x, 0.0), 1.0) for p in probs for x in (p - BAND, p + BAND)]
    sketch = df.groupBy(keys).agg(*[
        F.struct(
            F.count(c).alias("n"), F.min(c).alias("lo"), F.max(c).alias("hi"),
            F.percentile_approx(c, ends, BAND_ACCURACY).alias("q"),
        ).alias(f"s_{i}")
        for i, c in enumerate(cols)
    ])
    renamed = sketch.withColumnsRenamed({k: f"k_{k}" for k in keys})
    joined = df.join(F.broadcast(renamed), [F.col(k).eqNullSafe(F.col(f"k_{k}")) for k in keys])

    # Values inside the band are listed one by one; of those below it only the number is kept.
    inside, below = [], []
    for i, c in enumerate(cols):
        s, v = F.col(f"s_{i}"), F.col(c)
        for j, p in enumerate(probs):
            # A band of less than a few ranks says nothing; then it is the whole group of at most 3 / BAND rows.
            thin = s["n"] * BAND < 3
            low = F.when(thin, s["lo"]).otherwise(s["q"][2 * j])
            high = F.when(thin, s["hi"]).otherwise(s["q"][2 * j + 1])
            inside.append(F.when((v >= low) & (v <= high), F.struct(F.lit(i).alias("i_"), F.lit(j).alias("j_"), s["n"].alias("n_"), v.alias("v_"))))
            below.append(F.count_if(v < low).alias(f"b_{i}_{j}"))
    under = joined.groupBy(*keys).agg(*below)
    under = under.select(*[F.col(k).alias(f"u_{k}") for k in keys], F.explode(F.array(*[
        F.struct(F.lit(i).alias("u_i_"), F.lit(j).alias("u_j_"), F.col(f"b_{i}_{j}").alias("below_"))
        for i in range(len(cols)) for j in range(len(probs))])).alias("u")).select(*[f"u_{k}" for k in keys], "u.*")
    hits = joined.select(*keys, F.explode(F.array_compact(F.array(*inside))).alias("h")).select(*keys, "h.*")
    counted = hits.groupBy(*keys, "i_", "j_", "n_", "v_").agg(F.count("*").alias("c_"))
    same = [F.col(k).eqNullSafe(F.col(f"u_{k}")) for k in [*keys, "i_", "j_"]]
    counted = stored(counted.join(under, same).select(*keys, "i_", "j_", "n_", "below_", "v_", "c_"), "counted")
    prob = F.array(*[F.lit(p) for p in probs])[F.col("j_")]
    out = _pick(counted, [*keys, "i_", "j_"], prob).select(
        *([] if marker else keys),
        F.array(*[F.lit(c) for c in cols])[F.col("i_")].alias("feature"),
        F.array(*[F.lit(p) for p in probs])[F.col("j_")].alias("prob"),
        F.col("picked_").alias("value"),
    )
    return out


def label_medians(df: DataFrame, keys: list, cols: list, prefix: str = "median_") -> DataFrame:
    """Wide exact medians per label: keys and one column per feature."""
    long = label_quantiles(df, keys, cols, [0.5])
    picks = [F.max(F.when(F.col("feature") == c, F.col("value"))).alias(f"{prefix}{c}") for c in cols]
    return long.groupBy(keys).agg(*picks) if keys else long.agg(*picks)


def median_row(df: DataFrame, cols: list) -> dict:
    """Exact medians of a few columns as plain numbers: one value per column reaches the driver."""
    row = label_medians(df, [], cols, prefix="").first()
    return {c: row[c] for c in cols}
