"""Queries: sources, universe, facts to panel (S*, E*)."""

from pyspark.sql import functions as F

from .. import constants as C
from ..operators import panel as P
from ..session import delete, new_folder
from ..sources import filings as S, tables as T
from .oracle import CTES, FIRST_YEAR, LAST_YEAR, SIC, cols, sector, segment, r
from .registry import Data, query, shape

FACT_COLUMNS = ["ticker", "cik", "company_name", "sic", "concept", "label", "fiscal_year", "fiscal_period"]
FACT_SQL = f"{', '.join(FACT_COLUMNS)}, {r('numeric_value', 2)} AS numeric_value"
CTES["universe"] = f"""SELECT 'C'||c_custkey AS ticker, c_custkey AS cik, c_name AS name, {SIC} AS sic,
  upper(c_mktsegment[1])||lower(c_mktsegment[2:]) AS sic_description FROM customer"""
CTES["sictable"] = """SELECT sic, industry_title FROM (SELECT DISTINCT CASE c_mktsegment WHEN 'AUTOMOBILE' THEN 3711
  WHEN 'FURNITURE' THEN 5712 WHEN 'MACHINERY' THEN 4911 WHEN 'HOUSEHOLD' THEN 7311 END AS sic,
  upper(c_mktsegment[1])||lower(c_mktsegment[2:])||' goods' AS industry_title FROM customer) WHERE sic IS NOT NULL"""
CTES["enriched"] = f"""SELECT u.ticker, u.cik, u.name, u.sicn AS sic, industry_title, {sector('u.sicn')} AS industry
  FROM (SELECT *, TRY_CAST(sic AS INTEGER) AS sicn FROM universe) u LEFT JOIN sictable t ON u.sicn=t.sic WHERE u.sicn IS NOT NULL"""
CTES["manifest"] = "SELECT ticker, cik, company_name, sic, min(fiscal_year) AS min_fiscal_year, max(fiscal_year) AS max_fiscal_year, count(*) AS row_count FROM facts GROUP BY 1,2,3,4"
CTES["base"] = f"SELECT * FROM facts WHERE fiscal_year BETWEEN {FIRST_YEAR} AND {LAST_YEAR}"


def fact_shape(df):
    return df.selectExpr(*FACT_COLUMNS, "round(round(numeric_value, 6), 2) as numeric_value")


def base(d: Data):
    return P.year_window(d.facts(), FIRST_YEAR, LAST_YEAR)


def enriched(d: Data):
    table = S.sic_table(d.spark, d.folder).transform(P.normalize_names).transform(P.clean_sic)
    return P.enrich_universe(S.universe(d.spark, d.folder), table)


@query("scan_table_validated", "SELECT o_orderpriority, count(*) AS n FROM orders GROUP BY 1")
def _(d):
    df = T.load_table(d.spark, f"{d.folder}/orders.parquet", ["o_orderkey", "o_orderpriority"], "orders")
    return df.groupBy("o_orderpriority").agg(F.count("*").alias("n"))


@query("scan_facts_glob", "SELECT concept, count(*) AS n FROM facts GROUP BY 1")
def _(d):
    d.facts().createOrReplaceTempView("raw_facts")
    return d.spark.sql("select concept, count(*) as n from raw_facts group by concept")


@query("ingest_csv_to_parquet", "SELECT fiscal_year, count(*) AS n FROM facts GROUP BY 1")
def _(d):
    folder = new_folder(d.spark, "files")
    d.facts().write.option("header", True).csv(f"{folder}/csv")
    T.ingest_csv(d.spark, f"{folder}/csv", f"{folder}/facts")
    return d.spark.read.parquet(f"{folder}/facts").groupBy("fiscal_year").agg(F.count("*").alias("n"))


@query("ingest_resumable", f"SELECT {FACT_SQL} FROM facts")
def _(d):
    """Companies with a non-negative balance are loaded first; a second run adds the others and a third one nothing."""
    out, raw = new_folder(d.spark, "resumed"), new_folder(d.spark, "facts")
    d.facts().write.parquet(raw)  # the loads read them several times
    facts = d.spark.read.parquet(raw)
    some = d.table("customer").filter("c_acctbal >= 0").selectExpr("concat('C', c_custkey) as ticker")
    T.ingest_remaining(d.spark, T.rows_by_keys(facts, some, "ticker", "left_semi"), out)
    for _ in range(2):
        T.ingest_remaining(d.spark, facts, out)
    delete(d.spark, raw)
    return fact_shape(T.stored_facts(d.spark, out))


@query("parquet_footprint")
def _(d):
    return T.footprint(d.spark, f"{d.folder}/lineitem.parquet")


COMPANY_COLUMNS = [f.name for f in T.COMPANY_SCHEMA]


@query("read_company_input", f"""SELECT {cols(COMPANY_COLUMNS)} FROM (SELECT *, CAST(NULL AS VARCHAR) AS currency,
 assets_current AS current_assets, liabilities_current AS current_liabilities FROM panel)""")
def _(d):
    """The panel written as company CSV and read back with the input schema."""
    folder = new_folder(d.spark, "files")
    panel = d.panel().withColumnsRenamed({"assets_current": "current_assets", "liabilities_current": "current_liabilities"})
    have = {f.name for f in T.COMPANY_SCHEMA if f.name in panel.columns}
    panel.selectExpr(*[
        f.name if f.name in have else f"cast(null as {f.dataType.simpleString()}) as {f.name}" for f in T.COMPANY_SCHEMA
    ]).write.option("header", True).csv(f"{folder}/companies")
    return shape(T.read_company_input(d.spark, f"{folder}/companies"), COMPANY_COLUMNS)


@query("write_result_tables", "SELECT * FROM manifest")
def _(d):
    folder = new_folder(d.spark, "files")
    tables = {"manifest": P.manifest(d.facts()), "by_year": P.facts_by_year(d.facts())}
    paths = T.write_results(tables, folder, "r1")
    return d.spark.read.parquet(paths["manifest"])


@query("detect_value_column", """SELECT 'numeric_value' AS value_column, count(numeric_value) AS "values" FROM facts""")
def _(d):
    facts = d.facts()
    return facts.groupBy().agg(F.lit(P.detect_value_column(facts)).alias("value_column"), F.count(P.detect_value_column(facts)).alias("values"))


@query("detect_sort_column", "SELECT 'filing_date' AS sort_column, CAST(max(filing_date) AS VARCHAR) AS latest FROM facts")
def _(d):
    facts = d.facts()
    c = P.detect_sort_column(facts)
    return facts.groupBy().agg(F.lit(c).alias("sort_column"), F.max(c).cast("string").alias("latest"))


@query("facts_keep_numeric_periods", f"SELECT {FACT_SQL} FROM facts WHERE numeric_value IS NOT NULL AND fiscal_period IN ('FY','Q1','Q2','Q3','Q4')")
def _(d):
    return fact_shape(P.keep_numeric_periods(d.facts()))


@query("normalize_column_names", f"SELECT industry_title, sic FROM (SELECT CAST(sic AS VARCHAR) AS sic, industry_title FROM sictable UNION ALL SELECT 'code '||n_name, n_name FROM nation)")
def _(d):
    return P.normalize_names(S.sic_table(d.spark, d.folder))


@query("sic_numeric_clean", "SELECT sic, industry_title FROM sictable")
def _(d):
    return S.sic_table(d.spark, d.folder).transform(P.normalize_names).transform(P.clean_sic)


@query("universe_sic_enrich", "SELECT * FROM enriched")
def _(d):
    return enriched(d).select("ticker", "cik", "name", "sic", "industry_title", "industry")


@query("join_sic_left", "SELECT ticker, sic, industry_title FROM enriched")
def _(d):
    return enriched(d).select("ticker", "sic", "industry_title")


@query("sic_major_division", f"SELECT ticker, {sector('TRY_CAST(sic AS INTEGER)')} AS major_sector FROM universe")
def _(d):
    return S.universe(d.spark, d.folder).selectExpr("ticker", f"{P.sic_division()} as major_sector")


@query("financial_flag", f"SELECT ticker, {segment('TRY_CAST(sic AS INTEGER)')} AS financial_flag FROM universe")
def _(d):
    return S.universe(d.spark, d.folder).selectExpr("ticker", f"{P.financial_flag()} as financial_flag")


@query("sic_value_counts", """SELECT 'sic' AS what, CAST(sic AS VARCHAR) AS value, count(*) AS n FROM enriched GROUP BY ALL
 UNION ALL SELECT 'industry_title', industry_title, count(*) FROM enriched WHERE industry_title IS NOT NULL GROUP BY ALL
 UNION ALL SELECT 'industry', industry, count(*) FROM enriched GROUP BY ALL""")
def _(d):
    return P.value_counts_of(enriched(d), ["sic", "industry_title", "industry"])


@query("sic_audit", """SELECT sic, industry_title, count(*) AS company_count,
  array_to_string(list(ticker ORDER BY ticker)[1:10], ', ') AS sample_tickers,
  array_to_string(list(name ORDER BY ticker)[1:5], ' | ') AS sample_names
 FROM enriched WHERE industry_title IS NOT NULL GROUP BY sic, industry_title""")
def _(d):
    return P.sic_audit(enriched(d))


@query("head_per_group", "SELECT sic, ticker FROM (SELECT sic, ticker, row_number() OVER (PARTITION BY sic ORDER BY ticker) AS rn FROM enriched) WHERE rn<=10")
def _(d):
    return P.first_per_group(enriched(d), ["sic"], ["ticker"], 10).select("sic", "ticker")


@query("ticker_spot_check", "SELECT ticker, cik, name, sic, industry FROM enriched WHERE ticker='C17'")
def _(d):
    return enriched(d).filter("ticker = 'C17'").select("ticker", "cik", "name", "sic", "industry")


@query("facts_summary", "SELECT count(*) AS rows, count(DISTINCT ticker) AS tickers, count(DISTINCT concept) AS concepts, min(fiscal_year) AS min_year, max(fiscal_year) AS max_year FROM facts")
def _(d):
    return P.facts_summary(d.facts())


@query("facts_by_year", "SELECT fiscal_year, count(*) AS n FROM facts GROUP BY 1 ORDER BY 1 LIMIT 30")
def _(d):
    return P.facts_by_year(d.facts())


@query("model_base_window", f"SELECT {FACT_SQL} FROM base")
def _(d):
    return fact_shape(base(d))


COVERAGE = "SELECT concept, label, count(*) AS row_count, count(DISTINCT ticker) AS ticker_coverage FROM base GROUP BY 1,2"


@query("concept_coverage", COVERAGE)
def _(d):
    return P.concept_coverage(base(d))


@query("concept_coverage_top200", COVERAGE + " ORDER BY 4 DESC, 3 DESC, 1, 2 LIMIT 200")
def _(d):
    return P.concept_coverage(base(d), 200)


@query("topk_coverage", COVERAGE + " ORDER BY 4 DESC, 3 DESC, 1, 2 LIMIT 7")
def _(d):
    return P.concept_coverage(base(d), 7)


_targets = ",".join(f"('{t}')" for t in C.TARGET_CONCEPTS)


@query("target_concept_coverage", f"""SELECT w.concept, count(b.ticker) AS row_count, count(DISTINCT b.ticker) AS ticker_coverage
 FROM (VALUES {_targets}) w(concept) LEFT JOIN base b USING (concept) GROUP BY 1""")
def _(d):
    return P.target_coverage(base(d))


@query("semi_join_target_concepts", f"SELECT {FACT_SQL} FROM base WHERE concept IN (SELECT * FROM (VALUES {_targets}))")
def _(d):
    wanted = d.spark.createDataFrame([(t,) for t in C.TARGET_CONCEPTS], "concept string")
    return fact_shape(P.semi_join_concepts(base(d), wanted))


@query("concept_lookup", "SELECT canonical_feature, concept, count(f.concept) AS facts_found FROM lookup LEFT JOIN facts f USING (concept) GROUP BY 1,2")
def _(d):
    found = d.facts().groupBy("concept").agg(F.count("*").alias("facts_found"))
    return P.concept_lookup(d.spark).join(found, "concept", "left").fillna(0, ["facts_found"]).select("canonical_feature", "concept", "facts_found")


IYF_COLUMNS = ["ticker", "cik", "sic", "fiscal_year", "canonical_feature", "company_name"]


@query("issuer_year_facts", f"SELECT {', '.join(IYF_COLUMNS)}, {r('value', 2)} AS value FROM iyf")
def _(d):
    return d.iyf().selectExpr(*IYF_COLUMNS, "round(round(value, 6), 2) as value")


@query("join_concept_lookup", "SELECT canonical_feature, concept, count(*) AS n FROM facts JOIN lookup USING (concept) GROUP BY 1,2")
def _(d):
    joined = d.facts().join(F.broadcast(P.concept_lookup(d.spark)), "concept")
    return joined.groupBy("canonical_feature", "concept").agg(F.count("*").alias("n"))


@query("issuer_year_facts_priority", f"""SELECT ticker, cik, TRY_CAST(sic AS INTEGER) AS sic, fiscal_year, canonical_feature, {r('numeric_value', 2)} AS value FROM (
 SELECT *, row_number() OVER (PARTITION BY ticker, cik, sic, fiscal_year, canonical_feature ORDER BY place, filing_date DESC, numeric_value) AS rn
 FROM facts JOIN lookup USING (concept) WHERE fiscal_period='FY' AND numeric_value IS NOT NULL AND fiscal_year BETWEEN {FIRST_YEAR} AND {LAST_YEAR}) WHERE rn=1""")
def _(d):
    out = P.issuer_year_facts(d.facts(), FIRST_YEAR, LAST_YEAR, pick="priority")
    return out.selectExpr("ticker", "cik", "sic", "fiscal_year", "canonical_feature", "round(round(value, 6), 2) as value")


@query("facts_feature_coverage", "SELECT canonical_feature, count(*) AS row_count, count(DISTINCT ticker) AS ticker_count FROM iyf GROUP BY 1")
def _(d):
    return P.feature_coverage_table(d.iyf())


PIVOT_COLUMNS = ["ticker", "cik", "company_name", "sic", "fiscal_year", *C.CONCEPTS]


@query("issuer_year_pivot", f"SELECT {cols(PIVOT_COLUMNS)} FROM pivoted")
def _(d):
    return shape(P.pivot_panel(d.iyf()), PIVOT_COLUMNS)


@query("panel_ensure_columns", f"SELECT {cols([*PIVOT_COLUMNS, 'major_sector', 'financial_flag'])} FROM panel")
def _(d):
    return shape(d.panel(), [*PIVOT_COLUMNS, "major_sector", "financial_flag"])


@query("panel_min_assets", f"SELECT ticker, fiscal_year, {r('assets', 2)} AS assets FROM panel WHERE assets>=1000000")
def _(d):
    return shape(P.min_assets(d.panel()), ["ticker", "fiscal_year", "assets"])


def snapshots(d):
    """Two universe snapshots: companies with filings up to 1997, and from 1998 on."""
    facts = d.facts()
    return facts.filter("fiscal_year <= 1997").select("ticker").distinct(), facts.filter("fiscal_year >= 1998").select("ticker").distinct()


CTES["oldt"] = "SELECT DISTINCT ticker FROM facts WHERE fiscal_year<=1997"
CTES["newt"] = "SELECT DISTINCT ticker FROM facts WHERE fiscal_year>=1998"


@query("new_tickers", "SELECT ticker FROM newt EXCEPT SELECT ticker FROM oldt")
def _(d):
    old, new = snapshots(d)
    return P.ticker_difference(new, old)


@query("removed_tickers", "SELECT ticker FROM oldt EXCEPT SELECT ticker FROM newt")
def _(d):
    old, new = snapshots(d)
    return P.ticker_difference(old, new)


@query("except_tickers", "SELECT 'new' AS side, ticker FROM (SELECT ticker FROM newt EXCEPT SELECT ticker FROM oldt) UNION ALL SELECT 'removed', ticker FROM (SELECT ticker FROM oldt EXCEPT SELECT ticker FROM newt)")
def _(d):
    old, new = snapshots(d)
    return P.ticker_difference(new, old).selectExpr("'new' as side", "ticker").unionByName(
        P.ticker_difference(old, new).selectExpr("'removed' as side", "ticker"))


@query("intersect_tickers", "SELECT ticker FROM newt INTERSECT SELECT ticker FROM oldt")
def _(d):
    return P.ticker_intersection(*snapshots(d))


@query("anti_join_completed", "SELECT ticker, count(*) AS n FROM facts WHERE ticker NOT IN (SELECT ticker FROM oldt) GROUP BY 1")
def _(d):
    return P.missing_keys(d.facts(), snapshots(d)[0]).groupBy("ticker").agg(F.count("*").alias("n"))




@query("coverage_manifest", "SELECT * FROM manifest")
def _(d):
    return P.manifest(d.facts())


@query("stale_tickers", f"SELECT ticker FROM manifest WHERE max_fiscal_year<{LAST_YEAR}")
def _(d):
    return P.stale_tickers(P.manifest(d.facts()), LAST_YEAR)
