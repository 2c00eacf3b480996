"""Sharding by a k-d tree over document metadata, balanced by bytes."""

from math import ceil, log2

from pyspark.sql import DataFrame, functions as F
from pyspark.sql.window import Window

from ..session import stored

#: Slices of a bracket in one counting pass.
SLICES = 1024
DIMENSIONS = ("d_size", "d_source", "d_lang", "d_place")


def metadata(docs: DataFrame) -> DataFrame:
    """doc_id, size, text_crc32, four dimensions scaled to about [0, 1], and a tie hash in [0, 1).

    Dimensions: logarithm of the size, source and language as hashes, and the place of doc_id in the range
    that the table covers."""
    text = F.coalesce(F.col("text"), F.lit("")).cast("binary")
    hashed = lambda *c: (F.xxhash64(*c).bitwiseAND(F.lit((1 << 52) - 1)) / F.lit(float(1 << 52)))
    rows = docs.select(
        "doc_id", F.col("source").alias("source"), F.col("lang").alias("lang"),
        (F.octet_length(text).cast("long") + 1).alias("size"), F.crc32(text).alias("text_crc32"))
    return rows.select(
        "doc_id", "size", "text_crc32", (F.log2(F.col("size").cast("double")) / 32).alias("d_size"),
        hashed(F.coalesce("source", F.lit(""))).alias("d_source"), hashed(F.coalesce("lang", F.lit(""))).alias("d_lang"),
        hashed(F.lit("tie"), "doc_id", "text_crc32").alias("tie"))


def kd_tree(points: DataFrame, shards: int) -> DataFrame:
    """The points with `shard`: every node is cut at the weighted median of its widest dimension.

    A node stands for `leaves` shards from number `shard` on; it is cut in two with the bytes in the ratio of
    the leaves on either side.  The median comes from counting passes over all points: sums per slice of the
    node's bracket, then per slice of the slice that holds the median, and so on until that slice holds one
    value; the rows with this value are ordered by a hash.  Each pass returns one row per node.
    """
    spark = points.sparkSession
    tree = points.select("*", F.lit(0).alias("shard"), F.lit(shards).alias("leaves"))
    for _ in range(ceil(log2(shards)) if shards > 1 else 0):
        dims = [F.struct((F.max(d) - F.min(d)).alias("width"), F.lit(i).alias("dim"), F.min(d).alias("low"), F.max(d).alias("high"))
                for i, d in enumerate(DIMENSIONS)]
        nodes = stored(
            tree.filter("leaves > 1").groupBy("shard", "leaves").agg(F.sum("size").alias("bytes"), F.greatest(*dims).alias("widest"))
            .select("shard", "leaves", "widest.*", F.expr("cast(bytes as double) * ((leaves + 1) div 2) / leaves").alias("goal"),
                    F.lit(0.0).alias("before")), "nodes")
        value = F.element_at(F.array(*DIMENSIONS), F.col("dim") + 1)
        by_tie = False
        while True:
            inside = tree.join(nodes.drop("leaves"), "shard").withColumn("value", value).filter("value >= low and value <= high")
            place = F.col("tie") if by_tie else F.when(F.col("high") > F.col("low"), (F.col("value") - F.col("low")) / (F.col("high") - F.col("low"))).otherwise(0.0)
            inside = inside.withColumn("slice", F.least(F.floor(place * SLICES), F.lit(SLICES - 1)).cast("int"))
            sums = inside.groupBy("shard", "slice").agg(
                F.sum("size").alias("bytes"), F.min("value").alias("lo"), F.max("value").alias("hi"),
                *[F.first(c).alias(c) for c in ("dim", "low", "high", "goal", "before")])
            upto = Window.partitionBy("shard").orderBy("slice")  # at most SLICES rows a node
            sums = sums.withColumn("sum", F.sum("bytes").over(upto) + F.col("before"))
            # the slice in which the running sum reaches the goal
            cut = sums.withColumn("nth", F.row_number().over(Window.partitionBy("shard", F.col("sum") >= F.col("goal")).orderBy("slice"))) \
                .filter("sum >= goal and nth = 1")
            if by_tie:
                # of the two ends of the slice take the one nearer to the goal
                over = F.col("sum") - F.col("goal") > F.col("goal") - (F.col("sum") - F.col("bytes"))
                cut = cut.select("shard", "dim", "low", "high", ((F.col("slice") + F.when(over, 0).otherwise(1)) / F.lit(float(SLICES))).alias("tie_cut"))
            else:
                cut = cut.select("shard", "dim", F.col("lo").alias("low"), F.col("hi").alias("high"), "goal", (F.col("sum") - F.col("bytes")).alias("before"))
            nodes = stored(cut if by_tie else cut.withColumn("leaves", F.lit(0)), "nodes")
            if by_tie:
                break
            by_tie = not nodes.filter("high > low").limit(1).count()
        left = (F.col("value") < F.col("low")) | ((F.col("value") <= F.col("high")) & (F.col("tie") < F.col("tie_cut")))
        half = F.expr("(leaves + 1) div 2")
        tree = stored(
            tree.join(nodes, "shard", "left").withColumn("value", value)
            .withColumn("left", F.coalesce(left, F.lit(True)))
            .select(*points.columns,
                    F.when(F.col("dim").isNull() | F.col("left"), F.col("shard")).otherwise(F.col("shard") + half).cast("int").alias("shard"),
                    F.when(F.col("leaves") == 1, F.col("leaves")).when(F.col("left"), half).otherwise(F.col("leaves") - half).cast("int").alias("leaves")),
            "tree")
    return tree


def with_slots(rows: DataFrame, key: str, order: list[str], name: str) -> DataFrame:
    """`name`: gapless numbers from 0 within `key`, without a key's rows meeting in one task.

    Rows are dealt by ranges of (key, order); a part's numbers start where the parts before it end."""
    n = int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    parts = stored(
        rows.repartitionByRange(n, key, *order).sortWithinPartitions(key, *order)
        .withColumn("__part", F.spark_partition_id()).withColumn("__seq", F.monotonically_increasing_id()), "slots")
    heads = parts.groupBy(key, "__part").agg(F.count(F.lit(1)).alias("__n"), F.min("__seq").alias("__first"))
    before = Window.partitionBy(key).orderBy("__part").rowsBetween(Window.unboundedPreceding, -1)  # one row per part
    heads = heads.withColumn("__before", F.coalesce(F.sum("__n").over(before), F.lit(0)))
    return parts.join(heads, [key, "__part"]).withColumn(
        name, (F.col("__before") + F.col("__seq") - F.col("__first")).cast("long")).drop("__part", "__seq", "__n", "__first", "__before")


def kd_shards(docs: DataFrame, shards: int | None = None, target_bytes: int | None = None) -> DataFrame:
    """Every document in one of `shards` shards of nearly equal bytes, or of about `target_bytes` each.

    Reads doc_id, text, source, lang; other columns are ignored.  Returns doc_id, size (UTF-8 bytes + 1),
    text_crc32, law ('bytes'), shard, slot (gapless from 0 by doc_id), grown_shard (null: the law is not
    'key').  Null texts count as empty, null sources and languages as empty names.  Equal coordinates,
    copies and repeated rows included, are split by a hash of doc_id and text, so a hot value cannot fill a
    shard; rows that repeat both stay together.  An empty table gives an empty result.
    """
    points = metadata(docs)
    ends = points.agg(F.min("doc_id").alias("a"), F.max("doc_id").alias("b"), F.sum("size").alias("bytes")).first()
    if shards is None:
        shards = max(1, ceil((ends["bytes"] or 0) / target_bytes))
    a, b = ends["a"] or 0, ends["b"] or 0
    points = points.withColumn("d_place", F.coalesce((F.col("doc_id") - F.lit(a)).cast("double") / float(max(1, b - a)), F.lit(0.0)))
    tree = kd_tree(stored(points, "points"), shards)
    out = with_slots(tree.select("doc_id", "size", "text_crc32", "shard"), "shard", ["doc_id", "text_crc32"], "slot")
    return out.select("doc_id", "size", "text_crc32", F.lit("bytes").alias("law"), "shard", F.col("slot"), F.lit(None).cast("int").alias("grown_shard"))
