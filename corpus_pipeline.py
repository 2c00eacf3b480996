"""Corpus pipeline: clean, deduplicate, mix and tokenise a table of documents, stage by stage.

Every stage takes the documents that its predecessor kept, all of them and whole, and returns documents with
their columns; the last one returns tokens.  `run` writes the result of each stage as Parquet in the shared
folder and reads it again for the next one.
"""

from pyspark.sql import DataFrame, SparkSession, functions as F

from ledgerline.llm.bpe import decode_tokens, encode_texts
from ledgerline.llm.exact_dedup import drop_copies
from ledgerline.llm.mixing import mix_sources
from ledgerline.llm.ngram_join import drop_near_copies
from ledgerline.llm.settings import EPOCHS, REST, SEED, VOCABULARY, WEIGHTS
from ledgerline.llm.toxicity import drop_toxic
from ledgerline.session import stored


def toxicity(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the noisy-or model, learned from the labels, does not reject."""
    return drop_toxic(docs, spark.read.parquet(f"{sf_dir}/labels.parquet"))


def exact_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of equal texts."""
    return drop_copies(docs)


def ngram_join(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group linked by n-gram similarity."""
    return drop_near_copies(docs)


def mixing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents repeated so that their sources reach the target weights, in a new global order."""
    return mix_sources(docs, WEIGHTS, REST, EPOCHS, SEED).select(*docs.columns)


def bpe(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """doc_id, n_tokens, token_ids and the SHA-256 of the decoded text of every copy."""
    decoded = decode_tokens(encode_texts(docs, VOCABULARY), VOCABULARY)
    return decoded.select("doc_id", "n_tokens", "token_ids", F.sha2(F.col("decoded").cast("binary"), 256).alias("decoded_sha256"))


STAGES = [("toxicity", toxicity), ("exact_dedup", exact_dedup), ("ngram_join", ngram_join), ("mixing", mixing), ("bpe", bpe)]

#: The toxicity model is fitted step by step, which SQL cannot express.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES:
        docs = stored(stage(spark, docs, sf_dir), f"pipeline-{name}")
    return docs
