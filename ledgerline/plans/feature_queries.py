"""Queries: feature scalars and projections (F*)."""

from pyspark.sql import functions as F

from .. import constants as C
from ..functions import scalars as X
from ..operators import features as Fe
from ..operators.quantiles import label_quantiles
from .oracle import CTES, SCENARIO_SQL, bounded, cols, div, feature_ctes, mean_of, r
from .registry import Data, query, shape

KEYS = ["ticker", "fiscal_year"]


def feat(key, names, source="feat"):
    """A query that shows some engineered columns over the whole panel."""
    names = [*KEYS, *names]

    @query(key, f"SELECT {cols(names)} FROM {source}")
    def run(d: Data):
        return shape(d.feats(), names)


@query("safe_divide", f"SELECT ticker, fiscal_year, {r(div('net_income','interest_expense',None))} AS plain, {r(div('net_income','interest_expense',1e6))} AS with_minimum FROM panel")
def _(d):
    p = X.with_exprs(d.panel(), {
        "plain": X.safe_divide("net_income", "interest_expense"),
        "with_minimum": X.safe_divide("net_income", "interest_expense", 1e6),
    })
    return shape(p, [*KEYS, "plain", "with_minimum"])


@query("clip01", f"SELECT ticker, fiscal_year, {r(bounded('equity/assets'))} AS clipped FROM panel")
def _(d):
    p = X.with_exprs(d.panel(), {"share": "equity / assets"})
    return shape(X.with_exprs(p, {"clipped": X.clip01("share")}), [*KEYS, "clipped"])


@query("linear_risk_bad_high", f"SELECT ticker, fiscal_year, {r(bounded('(liabilities/assets-0.3::DOUBLE)/0.65::DOUBLE'))} AS risk FROM panel")
def _(d):
    p = X.with_exprs(d.panel(), {"share": "liabilities / assets"})
    return shape(X.with_exprs(p, {"risk": X.risk_when_high("share", 0.30, 0.95)}), [*KEYS, "risk"])


@query("linear_risk_bad_low", f"SELECT ticker, fiscal_year, {r(bounded('(0.15::DOUBLE-cash/assets)/0.145::DOUBLE'))} AS risk FROM panel")
def _(d):
    p = X.with_exprs(d.panel(), {"share": "cash / assets"})
    return shape(X.with_exprs(p, {"risk": X.risk_when_low("share", 0.15, 0.005)}), [*KEYS, "risk"])


_w = {"cash_buffer_risk": 0.5, "coverage_risk": 0.3, "fcf_risk": 0.2}


@query("weighted_risk", f"SELECT ticker, fiscal_year, {r(mean_of(_w))} AS risk FROM feat")
def _(d):
    return shape(X.with_exprs(d.feats(), {"risk": X.weighted_mean(_w)}), [*KEYS, "risk"])


@query("ensure_columns", f"SELECT ticker, fiscal_year, {r('assets', 2)} AS assets, CAST(NULL AS DOUBLE) AS minority_interest FROM panel")
def _(d):
    p = X.ensure_columns(d.panel(), ["assets", "minority_interest"])
    return shape(p, [*KEYS, "assets", "minority_interest"])


CTES["rates"] = "SELECT 'N'||n_nationkey AS currency, 1+n_nationkey/100.0::DOUBLE AS fx_rate FROM nation"
CTES["priced"] = """SELECT p.* EXCLUDE (currency_key), fx_rate FROM (SELECT panel.*, 'N'||c_nationkey AS currency_key FROM panel
 JOIN customer ON ticker='C'||c_custkey) p LEFT JOIN rates ON currency_key=currency"""


@query("coerce_and_fx", f"SELECT ticker, fiscal_year, {r('assets*fx_rate', 2)} AS assets, {r('cfo*fx_rate', 2)} AS cfo, {r('net_income*fx_rate', 2)} AS net_income FROM priced")
def _(d):
    nations = d.table("customer").selectExpr("concat('C', c_custkey) as ticker", "concat('N', c_nationkey) as currency")
    rates = d.table("nation").selectExpr("concat('N', n_nationkey) as currency", "1 + n_nationkey / 100D as fx_rate")
    # Amounts as text on purpose: the coercion turns them back into numbers.
    p = d.panel().join(nations, "ticker").withColumn("assets", F.col("assets").cast("string"))
    return shape(Fe.coerce_money(p, fx_rates=rates), [*KEYS, "assets", "cfo", "net_income"])


@query("standardize_current_names", f"SELECT ticker, fiscal_year, {r('assets_current', 2)} AS assets_current, {r('liabilities_current', 2)} AS liabilities_current FROM panel")
def _(d):
    """The panel with its current columns under the business names, and empty columns in their place."""
    p = d.panel().withColumnsRenamed({"assets_current": "current_assets", "liabilities_current": "current_liabilities"})
    return shape(Fe.standardize_names(X.ensure_columns(p, ["assets_current"])), [*KEYS, "assets_current", "liabilities_current"])


feat("derived_debt", ["long_term_debt", "short_term_debt", "total_debt", "debt"])
feat("derived_fcf", ["capex", "fcf", "free_cash_flow"])
feat("derived_net_debt", ["net_debt"])
feat("derived_ebitda", ["ebitda"])
feat("base_ratios", [
    "log_assets", "liabilities_to_assets", "equity_to_assets", "cash_to_assets", "revenue_to_assets",
    "net_income_to_assets", "cfo_to_assets", "debt_to_assets", "debt_to_equity", "current_ratio",
])
feat("quick_ratio", ["quick_ratio"])
feat("diagnostic_ratios", ["gross_margin", "operating_margin", "interest_coverage", "cfo_to_liabilities", "fcf_to_debt", "capex_to_revenue"])
feat("ebitda_metrics", ["ebitda_margin", "debt_to_ebitda", "net_debt_to_ebitda", "ebitda_interest_coverage"])
feat("size_flags", C.SIZE_FLAGS)
feat("asset_size_band", ["asset_size_band"])
feat("component_risks", list(C.COMPONENT_RULES))
feat("cfo_to_debt", ["cfo_to_debt", "cfo_to_debt_risk"])
feat("negative_ebitda_flag", ["negative_ebitda_flag"])
feat("structural_flags", ["negative_equity_flag", "liabilities_exceed_assets_flag"])
feat("structural_distress_risk", ["structural_distress_risk"])
feat("domain_risks", [d for d in C.DOMAINS if d != "structural_distress_risk"])
feat("debt_service_risk", ["debt_service_risk", "debt_service_risk_legacy"])
feat("scorecard_credit_score", ["scorecard_credit_score"])
FULL = [
    "company_name", "major_sector", "financial_flag", "asset_size_band", "total_debt", "net_debt", "fcf", "ebitda",
    *[c for c in C.RATIOS if c not in ("total_debt", "net_debt", "ebitda")], *C.COMPONENTS, *C.SIZE_FLAGS,
]
feat("engineer_credit_features", FULL)


@query("financial_ebitda_mask", f"SELECT financial_flag, count(*) AS rows, count(ebitda) AS with_ebitda, count(debt_to_ebitda) AS with_leverage FROM feat GROUP BY 1")
def _(d):
    return d.feats().groupBy("financial_flag").agg(
        F.count("*").alias("rows"), F.count("ebitda").alias("with_ebitda"), F.count("debt_to_ebitda").alias("with_leverage"))


CAP_COLUMNS = ["interest_coverage", "debt_to_equity", "current_ratio"]


@query("winsor_cap_fit", " UNION ALL ".join(
    f"SELECT '{c}' AS feature, {r(f'quantile_cont({c}, 0.01)')} AS low, {r(f'quantile_cont({c}, 0.99)')} AS high FROM feat" for c in CAP_COLUMNS))
def _(d):
    return fit_caps(d.feats(), CAP_COLUMNS).selectExpr("feature", f"{X.rounded('low')} as low", f"{X.rounded('high')} as high")


def fit_caps(df, columns, low=0.01, high=0.99):
    """Cap table: one row per column, from exact quantiles."""
    q = label_quantiles(df, [], columns, [low, high])
    return q.groupBy("feature").agg(
        F.max(F.when(F.col("prob") == low, F.col("value"))).alias("low"),
        F.max(F.when(F.col("prob") == high, F.col("value"))).alias("high"))


_caps = {"interest_coverage": (-5.0, 30.0), "debt_to_equity": (None, 4.0), "current_ratio": (0.0, 10.0)}


@query("winsor_caps", f"""SELECT ticker, fiscal_year, {r('CASE WHEN interest_coverage IS NOT NULL THEN least(30, greatest(-5, interest_coverage)) END')} AS interest_coverage,
 {r('CASE WHEN debt_to_equity IS NOT NULL THEN least(4, debt_to_equity) END')} AS debt_to_equity,
 {r('CASE WHEN current_ratio IS NOT NULL THEN least(10, greatest(0, current_ratio)) END')} AS current_ratio FROM feat""")
def _(d):
    return shape(Fe.winsorize(d.feats(), _caps), [*KEYS, *_caps])


@query("domain_risks_strict", f"SELECT {cols([*KEYS, *C.DOMAINS, 'scorecard_credit_score'])} FROM strict")
def _(d):
    return shape(Fe.engineer(d.panel(), renormalize=False), [*KEYS, *C.DOMAINS, "scorecard_credit_score"])


@query("feature_coverage_pct", f"SELECT ticker, fiscal_year, {r('(' + '+'.join(f'CAST({c} IS NOT NULL AS INTEGER)' for c in C.DOMAINS) + ')/6.0::DOUBLE')} AS feature_coverage_pct FROM feat")
def _(d):
    return shape(X.with_exprs(d.feats(), {"feature_coverage_pct": Fe.feature_coverage()}), [*KEYS, "feature_coverage_pct"])


@query("ebitda_source", "SELECT ticker, fiscal_year, CASE WHEN ebitda IS NOT NULL THEN 'direct' WHEN operating_income IS NOT NULL AND depreciation_amortization IS NOT NULL THEN 'reconstructed' ELSE 'missing' END AS ebitda_source FROM panel")
def _(d):
    return Fe.ebitda_source(X.ensure_columns(d.panel(), ["ebitda"])).select(*KEYS, "ebitda_source")


@query("balance_check", """SELECT financial_flag, count(*) AS rows, count(gap) AS checked, count(*) FILTER (WHERE gap>0.05) AS failed FROM (
 SELECT financial_flag, CASE WHEN assets<>0 THEN abs(assets-liabilities-equity)/abs(assets) END AS gap FROM panel) GROUP BY 1""")
def _(d):
    return Fe.balance_check(d.panel()).groupBy("financial_flag").agg(
        F.count("*").alias("rows"), F.count("balance_gap").alias("checked"),
        F.expr("count(*) filter (where not balance_ok) as failed"))
