"""Queries: streaming jobs (ST*)."""

from pyspark.sql import functions as F

from .. import constants as C
from ..session import new_folder
from ..streaming import jobs as J
from .oracle import cols
from .registry import Data, query, shape

KEYS = ["ticker", "fiscal_year"]


def arrivals(d: Data, df, batches: int = 2):
    """The rows as a folder of files, written by the tasks that made them, and how many files a batch should take."""
    folder = new_folder(d.spark, "arrivals")
    df.write.parquet(folder)
    files = d.spark.read.format("binaryFile").load(folder).count()
    return folder, max(1, -(-files // batches))


@query("stream_ingest_facts", "SELECT fiscal_year, count(*) AS n FROM facts WHERE numeric_value IS NOT NULL AND fiscal_period IN ('FY','Q1','Q2','Q3','Q4') GROUP BY 1")
def _(d):
    facts = d.facts()
    (source, each), out = arrivals(d, facts), new_folder(d.spark, "ingested")
    for _ in range(2):  # the second start finds nothing new
        J.ingest_facts(J.read_stream(d.spark, source, facts.schema, each), out, f"{out}-state").awaitTermination()
    return d.spark.read.parquet(out).groupBy("fiscal_year").agg(F.count("*").alias("n"))


STREAMED = [*KEYS, "company_name", "assigned_cluster", "cluster_label", "risk_rank", "cluster_affinity",
            "scorecard_credit_score", "outlook_flag", "warning_flags", "guardrail_level", "guardrail_flags"]


@query("stream_score_companies", f"SELECT {cols(STREAMED)} FROM guarded")
def _(d):
    panel = d.panel()
    (source, each), out = arrivals(d, panel), new_folder(d.spark, "scored")
    J.score_stream(J.read_stream(d.spark, source, panel.schema, each), d.model(), out, f"{out}-state").awaitTermination()
    return shape(d.spark.read.parquet(out), STREAMED)


@query("stream_manifest", "SELECT * FROM manifest")
def _(d):
    facts = d.facts().select("ticker", "cik", "company_name", "sic", "fiscal_year")
    (source, each), out = arrivals(d, facts), new_folder(d.spark, "manifest")
    J.manifest_stream(J.read_stream(d.spark, source, facts.schema, each), out, f"{out}-state").awaitTermination()
    return J.latest_manifest(d.spark, out)
