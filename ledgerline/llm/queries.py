"""Registered queries of the operators: whole tables, production parameters."""

import corpus_pipeline
from pyspark.sql import DataFrame, SparkSession, functions as F

from .bpe import decode_tokens, encode_texts
from .conversation_trie import conversation_trie, ends_digest
from .exact_dedup import exact_dedup
from .licenses import scan_licenses
from .mixing import mix_sources, mixing_sql
from .ngram_join import ngram_components
from .packing import pack
from .periodic import longest_run, periodic_runs, run_lines, with_planted_tails
from .repetition import repetition_rules
from .settings import BYTE_VOCABULARY, EPOCHS, REST, SEED, VOCABULARY, WEIGHTS
from .sharding import kd_shards
from .token_files import read_tokens, write_tokens
from .toxicity import held_out, score_toxicity, train
from .warc import read_warc, write_warc

QUERIES: dict = {}
ORACLES: dict = {}


def query(key: str, oracle: str | None = None):
    def register(fn):
        QUERIES[key] = fn
        if oracle is not None:
            ORACLES[key] = oracle
        return fn

    return register


def table(spark: SparkSession, folder: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{folder}/{name}.parquet")


@query("op3_exact_dedup", r"""WITH d AS (SELECT doc_id, length(coalesce(text, '')) AS n,
 sha256(regexp_replace(coalesce(text, ''), '[\x20\x09-\x0D]', '', 'g')) AS text_sha256 FROM documents)
SELECT doc_id, first_value(doc_id) OVER w AS keep_id, count(*) OVER (PARTITION BY text_sha256) AS group_size,
 row_number() OVER w = 1 AS kept, text_sha256 FROM d WINDOW w AS (PARTITION BY text_sha256 ORDER BY n DESC, doc_id)""")
def _(spark: SparkSession, folder: str) -> DataFrame:
    return exact_dedup(table(spark, folder, "documents"))


@query("op4_poisson_mixing", mixing_sql(WEIGHTS, REST, EPOCHS, SEED, "doc_id, text, lang, source, n_chars, mix_mean, mix_copy, mix_key"))
def _(spark: SparkSession, folder: str) -> DataFrame:
    docs = table(spark, folder, "documents").select("doc_id", "text", "lang", "source", "n_chars")
    return mix_sources(docs, WEIGHTS, REST, EPOCHS, SEED)


@query("op7_kd_sharding")
def _(spark: SparkSession, folder: str) -> DataFrame:
    return kd_shards(table(spark, folder, "documents"), shards=16)


BASE32 = "ABCDEFGHIJKLMNOPQRSTUVWXYZ234567"
DIGEST = " || ".join(
    f"substr('{BASE32}', 1 + ((('0x' || substr(h, {1 + 5 * g}, 5))::BIGINT >> {shift}) & 31)::INT, 1)" for g in range(8) for shift in (15, 10, 5, 0))


@query("op1_warc", f"""WITH p AS (SELECT page_id, strlen(coalesce(html, '')) AS payload_bytes, sha1(coalesce(html, '')) AS h FROM pages),
 r AS (SELECT *, row_number() OVER w AS nth, first_value(page_id) OVER w AS keep_id FROM p WINDOW w AS (PARTITION BY h ORDER BY page_id DESC))
SELECT page_id, payload_bytes, {DIGEST} AS payload_digest, CASE WHEN nth = 1 THEN 'response' ELSE 'revisit' END AS record_type,
 CASE WHEN nth > 1 THEN keep_id END AS refers_to FROM r""")
def _(spark: SparkSession, folder: str) -> DataFrame:
    written, files = write_warc(table(spark, folder, "pages"))
    return read_warc(spark, written, files, payload=False).select("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to")


@query("op5_toxicity")
def _(spark: SparkSession, folder: str) -> DataFrame:
    docs = table(spark, folder, "documents").select("doc_id", "text")
    model = train(docs, table(spark, folder, "labels").select("doc_id", "toxic"))
    return score_toxicity(docs, model).select("doc_id", held_out(F.col("doc_id")).alias("held_out"), "score", "predicted", "n_sentences", "offending")


@query("op2_license_scan")
def _(spark: SparkSession, folder: str) -> DataFrame:
    return scan_licenses(table(spark, folder, "documents"))


@query("op6_token_files")
def _(spark: SparkSession, folder: str) -> DataFrame:
    written, files = write_tokens(table(spark, folder, "documents"), VOCABULARY, end_id=1)
    return read_tokens(spark, written, files).select("doc_id", "start", "n_tokens", F.crc32("token_ids").alias("ids_crc32"), "offset", "file")


@query("op8_bpe")
def _(spark: SparkSession, folder: str) -> DataFrame:
    encoded = encode_texts(table(spark, folder, "documents"), VOCABULARY)
    return decode_tokens(encoded, VOCABULARY).select(
        "doc_id", "n_tokens", F.sha2("token_ids", 256).alias("ids_sha256"), F.sha2(F.col("decoded").cast("binary"), 256).alias("decoded_sha256"))


@query("op9_repetition")
def _(spark: SparkSession, folder: str) -> DataFrame:
    return repetition_rules(table(spark, folder, "documents"))


@query("op10_ngram_join")
def _(spark: SparkSession, folder: str) -> DataFrame:
    return ngram_components(table(spark, folder, "documents"))


@query("op11_packing")
def _(spark: SparkSession, folder: str) -> DataFrame:
    return pack(table(spark, folder, "documents"), BYTE_VOCABULARY)


@query("op12_periodic_runs")
def _(spark: SparkSession, folder: str) -> DataFrame:
    found = periodic_runs(with_planted_tails(table(spark, folder, "documents"))).withColumn("top", longest_run(F.col("runs")))
    return found.select(
        "doc_id", F.size("runs").cast("long").alias("n_runs"), F.expr("-top.start").alias("start"), F.col("top.length").alias("length"),
        F.expr("-top.period").alias("period"), F.expr("1000 * top.length div -top.period").alias("exponent_milli"),
        F.sha2(run_lines(F.col("runs")).cast("binary"), 256).alias("runs_sha256"), F.sha2(F.col("collapsed").cast("binary"), 256).alias("collapsed_sha256"))


CRC_TABLE = "[list_reduce([i] || range(8), lambda c, k: CASE WHEN c & 1 = 1 THEN xor(3988292384, c >> 1) ELSE c >> 1 END) FOR i IN range(256)]"


@query("op13_conversation_trie", f"""WITH crc AS (SELECT {CRC_TABLE} AS tab),
 t AS (SELECT conv_id AS c, coalesce(role, '') AS role, coalesce(text, '') AS text,
  row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST, coalesce(role, ''), coalesce(text, '')) AS place FROM conversations WHERE conv_id IS NOT NULL),
 ids AS (SELECT DISTINCT c FROM t),
 heads AS (SELECT c, c - c % 100 AS base, xor(4294967295, list_reduce([4294967295] || [ord(x) FOR x IN string_split(c::VARCHAR, '')],
  lambda a, b: xor(a >> 8, tab[1 + (xor(a, b) & 255)]))) % 6 AS h FROM ids, crc),
 built AS (SELECT h.c, place, role, text, 0 AS own FROM heads h JOIN t ON t.c = h.base AND place <= h.h
  UNION ALL SELECT h.c, place, role, text, 1 FROM heads h JOIN t ON t.c = h.c AND place > h.h),
 steps AS (SELECT c, length(text) AS chars, row_number() OVER w AS depth, string_agg(sha256(strlen(role) || ':' || role || text), '') OVER w AS path
  FROM built WINDOW w AS (PARTITION BY c ORDER BY own, place)),
 prefixes AS (SELECT c, depth, path, chars FROM steps UNION ALL SELECT c, 0, '', 0 FROM ids),
 ends AS (SELECT c, max(depth) AS depth, max_by(path, depth) AS path FROM prefixes GROUP BY c),
 enders AS (SELECT path, string_agg(c::VARCHAR, ',' ORDER BY c) AS list FROM ends GROUP BY path),
 nodes AS (SELECT path, depth, min(c) AS conv_id, count(*) AS n_convs, (count(*) - 1) * any_value(chars) AS saved, substr(path, 1, (64 * (depth - 1))::BIGINT) AS up FROM prefixes GROUP BY path, depth),
 kids AS (SELECT up, count(*) AS n FROM nodes WHERE depth > 0 GROUP BY up),
 above AS (SELECT x.path AS path, y.saved, y.path NOT IN (SELECT up FROM kids) AS leaf FROM nodes y, LATERAL (SELECT DISTINCT substr(y.path, 1, 64 * k) AS path FROM range(y.depth + 1) r(k)) x)
SELECT n.conv_id, n.depth, CASE WHEN n.depth > 0 THEN p.conv_id END AS parent_conv_id, n.n_convs, coalesce(k.n, 0) AS n_children,
 s.n_leaves, s.saved_tokens, sha256(coalesce(e.list, '')) AS ends_sha256
FROM nodes n LEFT JOIN nodes p ON p.path = n.up LEFT JOIN kids k ON k.up = n.path LEFT JOIN enders e ON e.path = n.path
JOIN (SELECT path, count(*) FILTER (WHERE leaf)::BIGINT AS n_leaves, sum(saved)::BIGINT AS saved_tokens FROM above GROUP BY path) s ON s.path = n.path""")
def _(spark: SparkSession, folder: str) -> DataFrame:
    trie = conversation_trie(table(spark, folder, "conversations"))
    return trie.nodes.join(ends_digest(trie.ends), "key", "left").select(
        "conv_id", "depth", "parent_conv_id", "n_convs", "n_children", "n_leaves", F.col("saved").alias("saved_tokens"),
        F.coalesce("ends_sha256", F.sha2(F.lit("").cast("binary"), 256)).alias("ends_sha256"))


@query("pipeline", corpus_pipeline.ORACLE_SQL)
def _(spark: SparkSession, folder: str) -> DataFrame:
    return corpus_pipeline.run(spark, folder)
