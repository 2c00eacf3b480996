"""Structured Streaming twins of the batch jobs: resumable ingest, scoring and manifest."""

from pyspark.sql import DataFrame, SparkSession, functions as F

from ..operators.guardrails import apply_guardrails
from ..operators.outlook import with_outlook
from ..operators.scoring import Model, score_companies
from ..session import delete, listed, stored


def read_stream(spark: SparkSession, folder: str, schema, files_per_trigger: int | None = None) -> DataFrame:
    reader = spark.readStream.schema(schema)
    if files_per_trigger:
        reader = reader.option("maxFilesPerTrigger", files_per_trigger)
    return reader.parquet(folder)


def ingest_facts(stream: DataFrame, out: str, checkpoint: str, available_now: bool = True):
    """New fact files to year folders; every file is taken once, also after a restart."""
    writer = (
        stream.filter("numeric_value is not null and fiscal_period in ('FY', 'Q1', 'Q2', 'Q3', 'Q4')")
        .writeStream.format("parquet").partitionBy("fiscal_year")
        .option("path", out).option("checkpointLocation", checkpoint).outputMode("append")
    )
    return (writer.trigger(availableNow=True) if available_now else writer).start()


def score_stream(stream: DataFrame, model: Model, out: str, checkpoint: str, **options):
    """Stateless scoring of arriving company rows: the column chain of the batch job, row-wise name aliases."""
    scored = score_companies(stream, model, names="row", **options)
    result = apply_guardrails(with_outlook(scored, model))
    return (
        result.writeStream.format("parquet").option("path", out).option("checkpointLocation", checkpoint)
        .outputMode("append").trigger(availableNow=True).start()
    )


MANIFEST_KEYS = ["ticker", "cik", "company_name", "sic"]


def manifest_stream(stream: DataFrame, out: str, checkpoint: str, buckets: int = 32):
    """Running coverage per issuer, as one table in hash buckets (`merge_manifest`)."""
    totals = stream.groupBy(*MANIFEST_KEYS).agg(
        F.min("fiscal_year").alias("min_fiscal_year"), F.max("fiscal_year").alias("max_fiscal_year"),
        F.count("*").alias("row_count"),
    )
    return (
        totals.writeStream.outputMode("update").option("checkpointLocation", checkpoint)
        .foreachBatch(lambda batch, number: merge_manifest(batch, number, out, buckets)).trigger(availableNow=True).start()
    )


def merge_manifest(batch: DataFrame, batch_id: int, out: str, buckets: int = 32) -> None:
    """Rewrite the buckets of the issuers in the batch, and only those: the newest version of a bucket before this batch, with
    the batch's totals in place of the old ones, becomes the version named by the batch.

    The version it came from stays until the next batch touches the bucket, so a batch that is replayed finds what it had
    found and overwrites what it had written; older versions are deleted.  A bucket therefore has two versions at most,
    however long the stream runs."""
    spark = batch.sparkSession
    fresh = stored(batch.withColumn("bucket", F.pmod(F.xxhash64(*MANIFEST_KEYS), F.lit(buckets)).cast("int")), "batch")
    touched = [r["bucket"] for r in fresh.select("bucket").distinct().collect()]  # at most `buckets`
    if not touched:
        return
    versions = manifest_versions(spark, out)
    base = {b: max(v for v in versions[b] if v < batch_id) for b in touched if any(v < batch_id for v in versions.get(b, ()))}
    rows = fresh
    if base:
        paths = [f"{out}/bucket={b}/version={v}" for b, v in base.items()]
        old = spark.read.option("basePath", out).schema(f"{_schema_text(fresh)}, version bigint").parquet(*paths)
        same = [F.col(k).eqNullSafe(F.col(f"n_{k}")) for k in MANIFEST_KEYS]
        newer = fresh.select(*[F.col(k).alias(f"n_{k}") for k in MANIFEST_KEYS])
        rows = fresh.unionByName(old.select(*fresh.columns).join(newer, same, "left_anti"))
    rows.withColumn("version", F.lit(batch_id)).repartition(len(touched), "bucket").write.mode("overwrite").option(
        "partitionOverwriteMode", "dynamic").partitionBy("bucket", "version").parquet(out)
    for b in touched:
        for v in versions.get(b, ()):
            if v < base.get(b, 0):
                delete(spark, f"{out}/bucket={b}/version={v}")


def _schema_text(df: DataFrame) -> str:
    return ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in df.schema)


def manifest_versions(spark: SparkSession, out: str) -> dict:
    """bucket -> versions that are there, from the names of the folders."""
    found: dict = {}
    for bucket in listed(spark, out, folders=True):
        if bucket.startswith("bucket="):
            found[int(bucket[7:])] = [int(v[8:]) for v in listed(spark, f"{out}/{bucket}", folders=True) if v.startswith("version=")]
    return found


def latest_manifest(spark: SparkSession, out: str) -> DataFrame:
    """One row per issuer: the newest version of every bucket."""
    rows = spark.read.parquet(out)
    newest = [f"(bucket = {b} and version = {max(v)})" for b, v in manifest_versions(spark, out).items() if v]
    return rows.filter(" or ".join(newest)).drop("bucket", "version")
