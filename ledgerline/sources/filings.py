"""The given order tables read as company filings.

One order is one filing, one (customer, order year) is one issuer-year.  Sums
are taken over whole cents, so that they do not depend on the order of rows.
"""

from pyspark.sql import DataFrame, SparkSession, functions as F

from .. import constants as C
from ..functions.scalars import with_exprs

ITEMS = [
    "assets", "equity", "liabilities", "assets_current", "liabilities_current", "cash",
    "receivables", "long_term_debt", "short_term_debt", "revenue", "net_income", "cfo",
    "operating_income", "interest_expense", "depreciation_amortization", "capex",
]

SEGMENT_CODE = (
    "case c_mktsegment when 'AUTOMOBILE' then '3711' when 'FURNITURE' then '5712' when 'MACHINERY' then '4911' "
    "when 'HOUSEHOLD' then '7311' when 'BUILDING' then '6022' end"
)
SIC_CODE = f"case when c_custkey % 50 = 1 then 'n/a' when c_custkey % 50 <> 0 then {SEGMENT_CODE} end"


#: Lines of a task that adds them up (an order has a few): some 100 MB with their orders, so that hashes and sorts stay in memory.
#: Up to FEW tasks a shuffle writes without a buffer of its own; larger tables get more lines a task before they get more tasks.
TASK_LINES = 500_000
MOST_LINES = 1_500_000
FEW = 200


def read(spark: SparkSession, folder: str, table: str) -> DataFrame:
    return spark.read.parquet(f"{folder}/{table}.parquet")


def tasks_for(spark: SparkSession, rows: int) -> int | None:
    """Tasks for the joins of so many lines; none where Spark's own choice leaves each task few enough.

    Spark merges parts by their compressed size and down to the number of slots, which says little about a hash table or a sort."""
    if rows <= TASK_LINES * spark.sparkContext.defaultParallelism:
        return None
    least = int(spark.conf.get("spark.sql.shuffle.partitions"))  # a join deals anew what is dealt to fewer
    return max(least, min(FEW, -(-rows // TASK_LINES)), -(-rows // MOST_LINES))


def dealt(df: DataFrame, tasks: int | None, key: str) -> DataFrame:
    return df.repartition(tasks, key) if tasks else df


def statements(spark: SparkSession, folder: str) -> DataFrame:
    """One wide row per filing."""
    items = read(spark, folder, "lineitem")
    tasks = tasks_for(spark, items.count())  # from the footers of the files
    lines = (
        items.selectExpr(
            "l_orderkey", "l_returnflag", "l_linestatus", "l_quantity",
            "cast(round(l_extendedprice * 100) as bigint) as cents",
            "cast(round(l_discount * 100) as bigint) as discount",
            "cast(round(l_tax * 100) as bigint) as tax",
        )
        .transform(dealt, tasks, "l_orderkey")
        .groupBy("l_orderkey")
        .agg(*[F.expr(e) for e in (
            "sum(cents) as all_cents",
            "coalesce(sum(cents) filter (where l_returnflag = 'R'), 0) as r_cents",
            "coalesce(sum(cents) filter (where l_linestatus = 'O'), 0) as o_cents",
            "sum(discount) as discounts",
            "sum(tax) as taxes",
            "sum(l_quantity) as q",
            "count(*) as n",
        )])
    )
    base = (
        read(spark, folder, "orders")
        .join(lines, F.col("o_orderkey") == F.col("l_orderkey"))
        .join(read(spark, folder, "customer").transform(dealt, tasks, "c_custkey"), F.col("o_custkey") == F.col("c_custkey"))
        .selectExpr(
            "concat('C', o_custkey) as ticker",
            "cast(c_custkey as string) as cik",
            "c_name as company_name",
            f"{SIC_CODE} as sic",
            "year(o_orderdate) as fiscal_year",
            "case when o_orderkey % 20 = 0 then 'Q1' when o_orderkey % 37 = 3 then 'H1' else 'FY' end as fiscal_period",
            "to_date(o_orderdate) as filing_date",
            "o_orderkey as filing_id",
            "c_custkey as k",
            "o_orderstatus as s",
            "o_orderpriority as p",
            "o_totalprice * 20 * (1 + c_nationkey) as a",
            "c_acctbal / 10000 as e",
            "r_cents / all_cents as r",
            "o_cents / all_cents as o",
            "discounts / (100D * n) as d",
            "taxes / (100D * n) as t",
            "q",
        )
    )
    formulas = {
        "assets": "a",
        "equity": "a*e",
        "liabilities": "a*(1-e)",
        "assets_current": "a*(0.2D+0.6D*o)",
        "liabilities_current": "a*(1-e)*(0.3D+0.5D*r)",
        "cash": "case when s<>'P' then a*1.5D*d end",
        "receivables": "case when s<>'F' then a*0.3D*o end",
        "long_term_debt": "case when p<>'4-NOT SPECIFIED' then a*(1-e)*0.5D*(1-r) end",
        "short_term_debt": "case when p not in ('4-NOT SPECIFIED','5-LOW') then a*(1-e)*0.1D*o end",
        "revenue": "a*(0.2D+q/200D)",
        "net_income": "a*(2.5D*t-0.08D)",
        "cfo": "a*(0.25D*(1-r)-0.05D)",
        "operating_income": "a*(3D*t-0.06D)",
        "interest_expense": "case when p<>'5-LOW' then a*(1-e)*0.02D end",
        "depreciation_amortization": "case when p<>'1-URGENT' then a*0.04D end",
        "capex": "a*0.03D*o",
    }
    gaps = {
        "net_income": "k%10=2", "equity": "k%10=3", "liabilities": "k%10=3",
        "cfo": "k%25=4", "long_term_debt": "k%25=4", "short_term_debt": "k%25=4",
        "interest_expense": "k%25=4",
    }
    keep = ("assets", "revenue", "capex")
    columns = {}
    for item, formula in formulas.items():
        gone = [g for g in [gaps.get(item), None if item in keep else "k%25=5"] if g]
        columns[item] = f"case when not ({' or '.join(gone)}) then {formula} end" if gone else formula
    return with_exprs(base, columns)


def raw_facts(spark: SparkSession, folder: str) -> DataFrame:
    """Long facts: one row per filing and reported item; some filings list cash without a value."""
    wide = statements(spark, folder)
    long = wide.unpivot(
        ["ticker", "cik", "company_name", "sic", "fiscal_year", "fiscal_period", "filing_date", "filing_id"],
        ITEMS, "item", "numeric_value",
    ).filter("numeric_value is not null or (filing_id % 41 = 5 and item = 'cash')")
    hits = []
    for item in ITEMS:
        tags = C.CONCEPTS[item]
        even, odd = tags[0], tags[1] if len(tags) > 1 else tags[0]
        hits.append(f"when '{item}' then " + (f"'{even}'" if even == odd else f"if(filing_id % 2 = 0, '{even}', '{odd}')"))
    return long.selectExpr(
        "ticker", "cik", "company_name", "sic",
        f"case item {' '.join(hits)} end as concept",
        "replace(item, '_', ' ') as label",
        "numeric_value", "fiscal_year", "fiscal_period", "filing_date",
    )


def universe(spark: SparkSession, folder: str) -> DataFrame:
    """Company list: one row per customer with its industry code as text."""
    return read(spark, folder, "customer").selectExpr(
        "concat('C', c_custkey) as ticker", "c_custkey as cik", "c_name as name",
        f"{SIC_CODE} as sic", "initcap(c_mktsegment) as sic_description",
    )


def sic_table(spark: SparkSession, folder: str) -> DataFrame:
    """Industry titles as they come: odd header spelling, text codes, and rows without a usable code."""
    good = read(spark, folder, "customer").select("c_mktsegment").distinct().selectExpr(
        f"{SEGMENT_CODE} as `  SIC Code`", "concat(initcap(c_mktsegment), ' goods') as `Industry-Title`"
    ).filter("`  SIC Code` <> '6022'")
    bad = read(spark, folder, "nation").selectExpr(
        "concat('code ', n_name) as `  SIC Code`", "n_name as `Industry-Title`"
    )
    return good.unionByName(bad)
