"""Exact deduplication by a tree merge of sorted digest runs."""

from math import ceil, log

from pyspark.sql import Column, DataFrame, functions as F
from pyspark.sql.window import Window

BLANKS = r"[\x20\x09-\x0D]"


def normalised(text: Column) -> Column:
    """The text without blanks; null counts as empty."""
    return F.regexp_replace(F.coalesce(text, F.lit("")), BLANKS, "")


def digests(docs: DataFrame) -> DataFrame:
    """doc_id, text_sha256, check (a second hash and the length of the normalised text), n_chars (code points
    of the original text)."""
    text = F.coalesce(F.col("text"), F.lit(""))
    return (
        docs.select("doc_id", text.alias("text"), normalised(F.col("text")).alias("plain"))
        .select(
            "doc_id", F.sha2(F.col("plain").cast("binary"), 256).alias("text_sha256"),
            F.struct(F.xxhash64("plain").alias("hash"), F.octet_length("plain").alias("bytes")).alias("check"),
            F.char_length("text").cast("long").alias("n_chars"))
    )


def merge_runs(marked: DataFrame, runs: int, fan_in: int) -> DataFrame:
    """One row per digest: the best document and the size of its group.

    The digests of a scan task are a run.  In every round the runs whose numbers agree after division by
    `fan_in` are merged: Spark sorts each incoming run by digest and one merge pass keeps, per digest, the
    document with the most code points and then the smallest identifier.  Two entries only merge when digest,
    second hash and length agree.  A run is spread over tasks by digest, so no task holds a whole run, and a
    digest that a third of all rows share arrives as one row per run.
    """
    best = F.max(F.struct("n_chars", "minus_id")).alias("best")
    level = marked.select(
        F.pmod(F.spark_partition_id(), F.lit(runs)).alias("run"), "text_sha256", "check", "n_chars",
        (-F.col("doc_id").cast("decimal(20,0)")).alias("minus_id"), F.lit(1).cast("long").alias("rows"))
    for _ in range(max(1, ceil(log(runs, fan_in) - 1e-9))):
        level = (
            level.groupBy(F.floor(F.col("run") / fan_in).cast("int").alias("run"), "text_sha256", "check")
            .agg(best, F.sum("rows").alias("rows"))
            .select("run", "text_sha256", "check", "best.n_chars", "best.minus_id", "rows")
        )
    return level.select(
        "text_sha256", "check", F.col("n_chars").alias("keep_chars"),
        (-F.col("minus_id")).cast("long").alias("keep_id"), F.col("rows").alias("group_size"))


def exact_dedup(docs: DataFrame, runs: int | None = None, fan_in: int = 16) -> DataFrame:
    """Groups of texts that are equal once blanks are deleted, one row per document.

    Reads `doc_id` (integer) and `text`; other columns are ignored, so their names cannot clash.  Returns
    doc_id, keep_id, group_size, kept, text_sha256.  The document with the most code points stays, then the
    one with the smallest doc_id; a null doc_id loses against any other.  Null texts count as empty and form a
    group with the empty and the blank ones.  Of rows that repeat doc_id and text one is kept.  An empty
    table gives an empty result.
    """
    spark = docs.sparkSession
    runs = runs or max(2, spark.sparkContext.defaultParallelism, int(spark.conf.get("spark.sql.shuffle.partitions")))
    marked = digests(docs)
    winners = merge_runs(marked, runs, fan_in)
    rows = marked.join(winners, ["text_sha256", "check"]).withColumn(
        "wins", F.col("doc_id").eqNullSafe(F.col("keep_id")) & (F.col("n_chars") == F.col("keep_chars")))
    out = ["doc_id", "keep_id", "group_size", "kept", "text_sha256"]
    losers = rows.filter(~F.col("wins")).withColumn("kept", F.lit(False)).select(*out)
    # Only rows that repeat the kept document meet here: one row per group, unless the table repeats rows.
    first = Window.partitionBy("text_sha256", "check").orderBy("n_chars")
    return rows.filter("wins").withColumn("kept", F.row_number().over(first) == 1).select(*out).unionByName(losers)


def drop_copies(docs: DataFrame, runs: int | None = None, fan_in: int = 16) -> DataFrame:
    """The documents that stay, with all their columns; of rows that repeat a doc_id with equal text, one."""
    names = docs.columns
    keep = exact_dedup(docs, runs, fan_in).filter("kept").select(
        F.col("doc_id").alias("__keep_id"), F.col("text_sha256").alias("__keep_sha"))
    sha = F.sha2(normalised(F.col("text")).cast("binary"), 256)
    chars = F.char_length(F.coalesce(F.col("text"), F.lit("")))
    found = docs.withColumn("__sha", sha).withColumn("__chars", chars).join(
        keep, F.col("doc_id").eqNullSafe(F.col("__keep_id")) & (F.col("__sha") == F.col("__keep_sha")))
    same = Window.partitionBy("__keep_id", "__sha").orderBy(F.desc("__chars"))
    return found.withColumn("__nth", F.row_number().over(same)).filter("__nth = 1").select(*names)
