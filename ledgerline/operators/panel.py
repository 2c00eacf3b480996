"""Facts -> issuer-year panel, company universe and refresh audits."""

from pyspark.sql import DataFrame, SparkSession, Window as W, functions as F

from .. import constants as C
from ..functions.scalars import ensure_columns, with_exprs
from .quantiles import grouped_median

FACT_KEYS = ["ticker", "cik", "sic", "fiscal_year", "canonical_feature"]
PANEL_KEYS = ["ticker", "cik", "sic", "fiscal_year"]


def concept_lookup(spark: SparkSession, concepts: dict | None = None) -> DataFrame:
    """Canonical item, concept and its place in the preference list; size fixed by the map."""
    rows = [
        (item, tag, place)
        for item, tags in (concepts or C.CONCEPTS).items()
        for place, tag in enumerate(tags)
    ]
    return spark.createDataFrame(rows, "canonical_feature string, concept string, place int")


def detect_value_column(df: DataFrame) -> str:
    lower = {c.lower(): c for c in df.columns}
    for name in ("numeric_value", "value"):
        if name in lower:
            return lower[name]
    raise ValueError("Facts need a numeric_value or value column.")


def detect_sort_column(df: DataFrame) -> str | None:
    lower = {c.lower(): c for c in df.columns}
    for name in ("filing_date", "filed", "period_end", "end", "start"):
        if name in lower:
            return lower[name]
    return None


def sic_number(c: str = "sic") -> str:
    return f"try_cast(try_cast({c} as double) as int)"


def sic_division(c: str = "sic") -> str:
    code = sic_number(c)
    hits = " ".join(f"when {code} >= {first} and {code} < {end} then '{name}'" for first, end, name in C.SIC_DIVISIONS)
    return f"case when {code} is null then 'Unknown' {hits} else 'Other' end"


def financial_flag(c: str = "sic") -> str:
    code = sic_number(c)
    first, end = C.FINANCIAL_RANGE
    return (
        f"case when {code} is null then 'Unknown' "
        f"when {code} >= {first} and {code} < {end} then 'Financial' else 'Non-financial' end"
    )


def keep_numeric_periods(facts: DataFrame) -> DataFrame:
    return facts.filter(
        F.col("numeric_value").isNotNull() & F.col("fiscal_period").isin("FY", "Q1", "Q2", "Q3", "Q4")
    )


def year_window(facts: DataFrame, first: int, last: int) -> DataFrame:
    return facts.filter(F.col("fiscal_year").between(first, last))


def issuer_year_facts(
    facts: DataFrame,
    first: int = 2020,
    last: int = 2025,
    period: str = "FY",
    concepts: dict | None = None,
    pick: str = "median",
) -> DataFrame:
    """One value per issuer, year and canonical item.

    pick="median": exact median over every mapped tag and filing.
    pick="priority": the value of the most preferred tag, latest filing first.
    """
    value = detect_value_column(facts)
    # The lookup is a literal table of a few dozen rows: a fixed, known broadcast size.
    lookup = F.broadcast(concept_lookup(facts.sparkSession, concepts))
    mapped = (
        facts.filter((F.col("fiscal_period") == period))
        .filter(F.expr("try_cast(fiscal_year as int)").between(first, last))
        .join(lookup, "concept")
        .select(
            "ticker",
            F.col("cik").cast("string").alias("cik"),
            "company_name",
            F.expr("try_cast(sic as int)").alias("sic"),
            F.expr("try_cast(fiscal_year as int)").alias("fiscal_year"),
            "canonical_feature",
            "place",
            F.expr(f"try_cast(`{value}` as double)").alias("value"),
            *([F.col(detect_sort_column(facts)).alias("sorted_by")] if detect_sort_column(facts) else []),
        )
        .filter(F.col("value").isNotNull() & ~F.isnan("value"))
    )
    if pick == "priority":
        latest = F.col("sorted_by") if "sorted_by" in mapped.columns else F.lit(0)
        best = F.min_by(F.struct("company_name", "value"), F.struct("place", -F.unix_date(latest) if "sorted_by" in mapped.columns else latest, "value"))
        return mapped.groupBy(FACT_KEYS).agg(best.alias("b")).select(*FACT_KEYS, "b.company_name", "b.value")
    # dealt by issuer-year, so that its items are stored together and a pivot meets them in one task
    return grouped_median(mapped, FACT_KEYS, "value", carry={"company_name": F.max("company_name")}, deal=PANEL_KEYS)


def pivot_panel(iyf: DataFrame, items=None) -> DataFrame:
    """One row per issuer-year; the item list is fixed, so the plan needs no extra pass to find it."""
    items = list(items or C.CONCEPTS)
    return iyf.groupBy(PANEL_KEYS).agg(
        F.max("company_name").alias("company_name"),
        *[F.expr(f"max(value) filter (where canonical_feature = '{i}') as {i}") for i in items],
    )


def complete_panel(panel: DataFrame) -> DataFrame:
    return with_exprs(
        ensure_columns(panel, C.CONCEPTS),
        {"major_sector": sic_division(), "financial_flag": financial_flag()},
    )


def issuer_year_panel(facts: DataFrame, first: int = 2020, last: int = 2025, **options) -> DataFrame:
    return complete_panel(pivot_panel(issuer_year_facts(facts, first, last, **options)))


def min_assets(panel: DataFrame, limit: float = C.MIN_TRAINING_ASSETS) -> DataFrame:
    return panel.filter(F.col("assets") >= limit)


def normalize_names(df: DataFrame) -> DataFrame:
    """Trimmed lower-case names with underscores; the code column is called sic."""
    def clean(name: str) -> str:
        name = name.strip().lower().replace(" ", "_").replace("-", "_")
        return {"sic_code": "sic"}.get(name, name)

    return df.toDF(*[clean(c) for c in df.columns])


def clean_sic(df: DataFrame) -> DataFrame:
    return with_exprs(df, {"sic": sic_number()}).filter(F.col("sic").isNotNull())


def enrich_universe(universe: DataFrame, sic: DataFrame) -> DataFrame:
    """Left join of industry titles; whether to broadcast is left to Spark's own size check."""
    known = with_exprs(universe, {"sic": sic_number()}).dropna(subset=["sic", "ticker"])
    return with_exprs(known.join(sic, "sic", "left").drop("sic_description"), {"industry": sic_division()})


def first_per_group(df: DataFrame, keys, order, n: int) -> DataFrame:
    """First n rows of each group.  Spark keeps only n rows per task and group before the shuffle."""
    w = W.partitionBy(*keys).orderBy(*order)
    return df.withColumn("row_in_group", F.row_number().over(w)).filter(F.col("row_in_group") <= n)


def ordered_text(c: str, by: str, separator: str):
    """Joined text of a group that is already limited to a few rows."""
    pairs = F.array_sort(F.collect_list(F.struct(by, c)))
    return F.array_join(F.transform(pairs, lambda p: p[c]), separator)


def sic_audit(universe: DataFrame, title: str = "industry_title", tickers: int = 10, names: int = 5) -> DataFrame:
    """Companies per industry with a few examples; samples are cut per task, never collected whole."""
    use = universe.filter(F.col("sic").isNotNull() & F.col(title).isNotNull())
    keys = ["sic", title]
    counts = use.groupBy(keys).agg(F.count("ticker").alias("company_count"))
    sample = first_per_group(use, keys, ["ticker"], tickers).groupBy(keys).agg(
        ordered_text("ticker", "row_in_group", ", ").alias("sample_tickers"),
        F.array_join(
            F.transform(
                F.array_sort(F.collect_list(F.when(F.col("row_in_group") <= names, F.struct("row_in_group", "name")))),
                lambda p: p["name"],
            ), " | ",
        ).alias("sample_names"),
    )
    return counts.join(sample, keys).orderBy(F.desc("company_count"), "sic")


def value_counts(df: DataFrame, c: str) -> DataFrame:
    return df.filter(F.col(c).isNotNull()).groupBy(c).agg(F.count("*").alias("n")).orderBy(F.desc("n"), c)


def value_counts_of(df: DataFrame, cols: list) -> DataFrame:
    """what (the column), value (as text), n for the values of several columns, from one scan."""
    pairs = ", ".join(f"named_struct('what', '{c}', 'value', cast({c} as string))" for c in cols)
    return df.selectExpr(f"inline(array({pairs}))").filter("value is not null").groupBy("what", "value").agg(F.count("*").alias("n"))


def facts_summary(facts: DataFrame) -> DataFrame:
    return facts.agg(
        F.count("*").alias("rows"),
        F.count_distinct("ticker").alias("tickers"),
        F.count_distinct("concept").alias("concepts"),
        F.min("fiscal_year").alias("min_year"),
        F.max("fiscal_year").alias("max_year"),
    )


def facts_by_year(facts: DataFrame, limit: int = 30) -> DataFrame:
    return facts.groupBy("fiscal_year").agg(F.count("*").alias("n")).orderBy("fiscal_year").limit(limit)


def concept_coverage(facts: DataFrame, top: int | None = None) -> DataFrame:
    out = (
        facts.groupBy("concept", "label")
        .agg(F.count("*").alias("row_count"), F.count_distinct("ticker").alias("ticker_coverage"))
        .orderBy(F.desc("ticker_coverage"), F.desc("row_count"), "concept", "label")
    )
    return out.limit(top) if top else out


def target_coverage(facts: DataFrame, targets=None) -> DataFrame:
    """Coverage of a wanted list; wanted concepts that never occur show up with zeros."""
    targets = list(targets or C.TARGET_CONCEPTS)
    wanted = facts.sparkSession.createDataFrame([(t,) for t in targets], "concept string")
    found = facts.filter(F.col("concept").isin(targets)).groupBy("concept").agg(
        F.count("*").alias("row_count"), F.count_distinct("ticker").alias("ticker_coverage")
    )
    return wanted.join(found, "concept", "left").fillna(0, ["row_count", "ticker_coverage"])


def semi_join_concepts(facts: DataFrame, wanted: DataFrame) -> DataFrame:
    return facts.join(wanted.select("concept"), "concept", "left_semi")


def feature_coverage_table(iyf: DataFrame) -> DataFrame:
    return (
        iyf.groupBy("canonical_feature")
        .agg(F.count("*").alias("row_count"), F.count_distinct("ticker").alias("ticker_count"))
        .orderBy(F.desc("ticker_count"), "canonical_feature")
    )


def missing_keys(new: DataFrame, done: DataFrame, key: str = "ticker") -> DataFrame:
    """Rows of new whose key is not in done: the remainder of a resumed job."""
    return new.join(done.select(key).filter(F.col(key).isNotNull()).distinct(), key, "left_anti")


def ticker_difference(left: DataFrame, right: DataFrame) -> DataFrame:
    def tickers(df):
        return df.select("ticker").filter(F.col("ticker").isNotNull())

    return tickers(left).subtract(tickers(right))


def ticker_intersection(left: DataFrame, right: DataFrame) -> DataFrame:
    return left.select("ticker").dropna().intersect(right.select("ticker").dropna())


def manifest(facts: DataFrame, stamp: bool = False) -> DataFrame:
    out = facts.groupBy("ticker", "cik", "company_name", "sic").agg(
        F.min("fiscal_year").alias("min_fiscal_year"),
        F.max("fiscal_year").alias("max_fiscal_year"),
        F.count("*").alias("row_count"),
    )
    return out.withColumn("last_audited_at", F.current_date()) if stamp else out


def stale_tickers(audit: DataFrame, target_year: int) -> DataFrame:
    return audit.filter((F.col("max_fiscal_year") < target_year) & F.col("ticker").isNotNull()).select("ticker")
