"""Reading, checking, converting and writing tables."""

from pathlib import PurePosixPath

from pyspark.sql import DataFrame, SparkSession, functions as F, types as T

from .. import constants as C
from ..functions.scalars import require_columns
from ..session import listed

FACT_SCHEMA = (
    "ticker string, cik string, company_name string, sic string, concept string, label string, "
    "numeric_value double, fiscal_year int, fiscal_period string, filing_date date"
)
#: Slots that keys are hashed to: 64 of them are a row of some 40 bytes.
SLOTS = 1 << 24
COMPANY_TEXT = ["company_name", "currency", "major_sector", "financial_flag"]
COMPANY_SCHEMA = T.StructType(
    [T.StructField("company_name", T.StringType()), T.StructField("fiscal_year", T.IntegerType())]
    + [T.StructField(c, T.StringType()) for c in COMPANY_TEXT[1:]]
    + [T.StructField(c, T.DoubleType()) for c in (
        "revenue", "assets", "current_assets", "cash", "receivables", "inventory", "equity",
        "current_liabilities", "liabilities", "long_term_debt", "short_term_debt", "net_income", "cfo",
        "capex", "operating_income", "interest_expense", "depreciation_amortization", "ebitda",
    )]
)


def read_csv(spark: SparkSession, path: str, schema, optional=(), label: str = "table") -> DataFrame:
    """CSV with a header, columns taken by name: their order does not matter, and a column that is left out is named in
    the error unless it is `optional` (then null).  Values that do not fit their type become null.  Files of a folder must
    agree in their headers."""
    schema = T._parse_datatype_string(schema) if isinstance(schema, str) else schema
    raw = spark.read.option("header", True).option("enforceSchema", False).csv(path)
    at = {c.strip().lower(): c for c in raw.columns}
    require_columns(raw.withColumnsRenamed({v: k for k, v in at.items()}), [f.name for f in schema if f.name not in optional], label)
    column = lambda f: F.col(f"`{at[f.name]}`").try_cast(f.dataType) if f.name in at else F.lit(None).cast(f.dataType)
    return raw.select(*[column(f).alias(f.name) for f in schema])


def load_table(spark: SparkSession, path: str, required=(), label: str = "table", schema=None) -> DataFrame:
    """CSV or Parquet by suffix (folders count as Parquet); missing columns are named in the error."""
    suffix = PurePosixPath(path).suffix.lower()
    if suffix == ".csv":
        df = spark.read.option("header", True).csv(path) if schema is None else read_csv(spark, path, schema, label=label)
    elif suffix in (".parquet", ".pq", ""):
        df = spark.read.parquet(path)
    else:
        raise ValueError(f"{label}: unsupported file type {suffix!r}; use .csv or .parquet")
    return require_columns(df, required, label)


def read_company_input(spark: SparkSession, path: str) -> DataFrame:
    """Manual company CSV, read by column name with fixed types; only ebitda may be left out."""
    return read_csv(spark, path, COMPANY_SCHEMA, optional=("ebitda",), label="company input")


def register_facts(spark: SparkSession, path: str, view: str = "raw_facts") -> DataFrame:
    df = spark.read.parquet(path)
    df.createOrReplaceTempView(view)
    return df


def ingest_csv(spark: SparkSession, csv_path: str, out: str, schema: str = FACT_SCHEMA, rows_per_file: int = C.FACTS_PER_FILE) -> DataFrame:
    """CSV to Parquet, split by year, so that a later year filter reads only its folders."""
    df = read_csv(spark, csv_path, schema, label="facts")
    write_facts(df, out, rows_per_file)
    return spark.read.parquet(out)


def write_facts(df: DataFrame, out: str, rows_per_file: int = C.FACTS_PER_FILE, mode: str = "overwrite") -> None:
    """The rebalance hint brings a year's rows together and lets Spark split a year by its size, so that the number of
    tasks follows the data."""
    df.hint("rebalance", "fiscal_year").write.mode(mode).option("maxRecordsPerFile", rows_per_file).partitionBy("fiscal_year").parquet(out)


def exists(spark: SparkSession, path: str) -> bool:
    at = spark._jvm.org.apache.hadoop.fs.Path(path)
    return at.getFileSystem(spark._jsc.hadoopConfiguration()).exists(at)


def rows_by_keys(df: DataFrame, keys: DataFrame, key: str, how: str) -> DataFrame:
    """`df.join(keys, key, how)` for how = left_semi or left_anti where most rows stay in place; df is read twice.

    The keys of df that are in `keys` and those that are not are marked in two sets of SLOTS bits (a table of fixed size, which is
    broadcast).  A row whose slot is marked in one set only is settled; only rows of slots marked in both move to a join."""
    slot = F.pmod(F.xxhash64(key), F.lit(SLOTS))
    own = df.select(key).filter(F.col(key).isNotNull()).distinct()
    keys = keys.select(key).filter(F.col(key).isNotNull()).distinct()
    sides = own.join(keys.withColumn("in_", F.lit(True)), key, "left").withColumn("slot_", slot)
    at = "cast(slot_ % 64 as int)"
    words = sides.groupBy(F.expr("slot_ div 64").alias("word_")).agg(*[
        F.expr(f"coalesce(bit_or(shiftleft(1L, {at})) filter (where in_ is {side}), 0L) as {name}") for side, name in (("not null", "in_bits_"), ("null", "out_bits_"))])
    marked = df.withColumn("slot_", slot).withColumn("word_", F.expr("slot_ div 64")).join(F.broadcast(words), "word_", "left")
    sure, unsure = ("in_bits_", "out_bits_") if how == "left_semi" else ("out_bits_", "in_bits_")
    none = f"{key} is null" if how == "left_anti" else "false"
    settled = marked.filter(f"{none} or ({key} is not null and getbit({sure}, {at}) = 1 and getbit({unsure}, {at}) = 0)")
    open_ = marked.filter(f"{key} is not null and getbit({sure}, {at}) = 1 and getbit({unsure}, {at}) = 1")
    # as plain joins with distinct keys: Spark would push a semi or anti join below the marks, to all rows
    found = open_.select(*df.columns).join(keys.withColumn("in_", F.lit(True)), key, "inner" if how == "left_semi" else "left")
    found = found if how == "left_semi" else found.filter("in_ is null")
    return settled.select(*df.columns).unionByName(found.select(*df.columns))


def batches_done(spark: SparkSession, out: str) -> DataFrame:
    """batch_id of every load that has ended.  Their list lies in a folder that readers of the facts skip."""
    path = f"{out}/_batches"
    return spark.read.schema("batch_id string").parquet(path) if exists(spark, path) else spark.createDataFrame([], "batch_id string")


def batch_name(rows: DataFrame) -> str:
    """A name that the same rows always get, in whatever order."""
    count, total = rows.agg(F.count("*"), F.sum(F.xxhash64(*rows.columns).cast("decimal(38,0)"))).first()
    return f"{count}-{total or 0}"


def ingest_remaining(spark: SparkSession, incoming: DataFrame, out: str, key: str = "ticker", batch: str | None = None) -> DataFrame:
    """Add the keys that no ended load has brought; a repeated call adds nothing.

    Rows carry the load's `batch_id` (by default made from the rows) as a partition column.  A load writes its partitions, and
    its name last; one that was stopped in between has no name, so the same call finds the same keys missing and replaces
    the partitions that are there.  A store that is there but cannot be read is an error, not an empty store.

    incoming is read several times: pass a stored table.  Its rows are written by the tasks that read them, without a move by year."""
    odd = [f for f in listed(spark, out) if not f.startswith(("batch_id=", "_", "."))]
    if odd:
        raise ValueError(f"{out} is not a store of loads: it holds {odd[0]}")
    batch = batch or batch_name(incoming)
    done = batches_done(spark, out)
    if not done.filter(F.col("batch_id") == batch).limit(1).count():
        stored = exists(spark, out) and done.limit(1).count()
        rest = rows_by_keys(incoming, stored_facts(spark, out), key, "left_anti") if stored else incoming
        rest.withColumn("batch_id", F.lit(batch)).write.mode("overwrite").option("partitionOverwriteMode", "dynamic").option("maxRecordsPerFile", C.FACTS_PER_FILE).partitionBy(
            "batch_id", "fiscal_year").parquet(out)
        spark.createDataFrame([(batch,)], "batch_id string").coalesce(1).write.mode("append").parquet(f"{out}/_batches")
    return stored_facts(spark, out)


def stored_facts(spark: SparkSession, out: str) -> DataFrame:
    """The facts of all loads that have ended; what a stopped load left is not shown."""
    return spark.read.parquet(out).join(batches_done(spark, out), "batch_id", "left_semi").drop("batch_id")


def footprint(spark: SparkSession, path: str) -> DataFrame:
    """Files and gigabytes of a table, from the listing of its files; their content is not read."""
    files = spark.read.format("binaryFile").option("recursiveFileLookup", True).option("pathGlobFilter", "*.parquet").load(path).select("path", "length")
    return files.agg(F.count("*").alias("files"), F.sum("length").alias("bytes"), F.expr("sum(length) / 1e9 as gigabytes"))


def write_results(tables: dict, folder: str, run_id: str, fmt: str = "parquet") -> dict:
    """Each named result under <folder>/<name>/run_id=<run>; returns the paths."""
    paths = {}
    for name, df in tables.items():
        path = f"{folder}/{name}/run_id={run_id}"
        writer = df.write.mode("overwrite")
        if fmt == "csv":
            writer.option("header", True).csv(path)
        else:
            writer.parquet(path)
        paths[name] = path
    return paths
