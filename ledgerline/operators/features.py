"""Raw statements -> ratios -> bounded risks -> score, as staged projections (no shuffle)."""

from pyspark.sql import DataFrame, functions as F

from .. import constants as C
from ..functions.scalars import (
    clip, count_present, ensure_columns, flag, num, number, risk_when_high, risk_when_low,
    safe_divide, sealed, weighted_mean, weighted_sum, with_exprs,
)


def standardize_names(df: DataFrame, mode: str = "whole_column") -> DataFrame:
    """Take current_assets / current_liabilities where the *_current column is empty.

    "whole_column": only if every row of the column is empty (decided with one
    limited probe of the data; skipped when only one of the two names exists).
    "row": per row, the only choice that works on an unbounded stream.
    """
    for target, source in (("assets_current", "current_assets"), ("liabilities_current", "current_liabilities")):
        if source not in df.columns:
            continue
        if target not in df.columns:
            df = df.withColumn(target, F.col(source))
        elif mode == "row":
            df = df.withColumn(target, F.coalesce(target, source))
        elif df.filter(F.col(target).isNotNull()).isEmpty():
            df = df.withColumn(target, F.col(source))
    return df


def coerce_money(df: DataFrame, fx: float = 1.0, fx_rates: DataFrame | None = None) -> DataFrame:
    """Monetary columns to numbers, times one rate or times a per-currency rate table."""
    df = ensure_columns(df, C.MONETARY)
    rate = num(fx)
    if fx_rates is not None:
        df = df.join(fx_rates.selectExpr("currency", "cast(fx_rate as double) as fx_rate"), "currency", "left")
        rate = "fx_rate"
    return with_exprs(df, {c: number(c) if rate == "1.0D" else f"{number(c)} * {rate}" for c in C.MONETARY})


def derived_values(df: DataFrame) -> DataFrame:
    """Debt, free cash flow, net debt and EBITDA."""
    df = with_exprs(df, {
        "total_debt": "coalesce(long_term_debt + short_term_debt, long_term_debt, short_term_debt)",
        "long_term_debt": "coalesce(long_term_debt, 0D)",
        "short_term_debt": "coalesce(short_term_debt, 0D)",
        "capex": "coalesce(capex, 0D)",
        "fcf": "cfo - abs(coalesce(capex, 0D))",
        "ebitda": "coalesce(ebitda, operating_income + depreciation_amortization)",
    })
    return with_exprs(df, {"debt": "total_debt", "free_cash_flow": "fcf", "net_debt": "total_debt - cash"})


def base_ratios(df: DataFrame, minimum: float | None = C.MIN_DENOMINATOR) -> DataFrame:
    per_assets = {
        "liabilities_to_assets": "liabilities", "equity_to_assets": "equity",
        "cash_to_assets": "cash", "revenue_to_assets": "revenue",
        "net_income_to_assets": "net_income", "cfo_to_assets": "cfo",
        "debt_to_assets": "total_debt",
    }
    quick = safe_divide("(coalesce(cash, 0D) + coalesce(receivables, 0D))", "liabilities_current", minimum)
    return with_exprs(df, {
        "log_assets": f"log1p({clip('assets', low=0.0)})",
        **{name: safe_divide(item, "assets", minimum) for name, item in per_assets.items()},
        "debt_to_equity": safe_divide("total_debt", "equity", minimum),
        "current_ratio": safe_divide("assets_current", "liabilities_current", minimum),
        "quick_ratio": f"case when cash is not null or receivables is not null then {quick} end",
    })


def diagnostic_ratios(df: DataFrame, minimum: float | None = C.MIN_DENOMINATOR) -> DataFrame:
    """Margins and coverage; interest coverage takes any non-zero interest amount."""
    return with_exprs(df, {
        "gross_margin": safe_divide("gross_profit", "revenue", minimum),
        "operating_margin": safe_divide("operating_income", "revenue", minimum),
        "interest_coverage": safe_divide("operating_income", "abs(interest_expense)"),
        "cfo_to_liabilities": safe_divide("cfo", "liabilities", minimum),
        "fcf_to_debt": safe_divide("fcf", "total_debt", minimum),
        "capex_to_revenue": safe_divide("abs(capex)", "revenue", minimum),
    })


def ebitda_metrics(
    df: DataFrame, minimum: float | None = C.MIN_DENOMINATOR, mask_financial: bool = True
) -> DataFrame:
    """EBITDA ratios; leverage needs a positive EBITDA, and financial firms get none of them."""
    if mask_financial and C.SEGMENT_COL in df.columns:
        known = f"coalesce(lower(cast({C.SEGMENT_COL} as string)) not in ('financial', '1', 'true'), true)"
        df = with_exprs(df, {"ebitda": f"case when {known} then ebitda end"})
    return with_exprs(df, {
        "ebitda_margin": safe_divide("ebitda", "revenue", minimum),
        "debt_to_ebitda": f"case when ebitda > 0 then {safe_divide('total_debt', 'ebitda', minimum)} end",
        "net_debt_to_ebitda": f"case when ebitda > 0 then {safe_divide('net_debt', 'ebitda', minimum)} end",
        "ebitda_interest_coverage": safe_divide("ebitda", "abs(interest_expense)"),
    })


def winsorize(df: DataFrame, caps: dict | None) -> DataFrame:
    """Clip the named columns to their (low, high) caps; None leaves a side open."""
    have = set(df.columns)
    return with_exprs(df, {c: clip(c, *b) for c, b in (caps or {}).items() if c in have and b is not None})


def size_flags(df: DataFrame) -> DataFrame:
    """Flags are left-closed, the band is right-closed: at a limit they differ on purpose."""
    small, mid, large = num(C.SMALL_LIMIT), num(C.MID_LIMIT), num(C.LARGE_LIMIT)
    return with_exprs(df, {
        "small_company_flag": flag(f"assets < {small}"),
        "mid_company_flag": flag(f"assets >= {small} and assets < {mid}"),
        "large_company_flag": flag(f"assets >= {mid}"),
        "asset_size_band": (
            f"case when assets <= 0 then null when assets <= {small} then 'small' "
            f"when assets <= {mid} then 'mid' when assets <= {large} then 'large' "
            "when assets is not null then 'mega' end"
        ),
    })


def component_risks(df: DataFrame, rules: dict | None = None) -> DataFrame:
    """One bounded risk per rule; CFO/debt is an inner value, taken after the caps."""
    df = with_exprs(df, {"cfo_to_debt": safe_divide("cfo", "abs(total_debt)")})
    out = {}
    for name, (source, direction, start, end) in (rules or C.COMPONENT_RULES).items():
        build = risk_when_high if direction == "high" else risk_when_low
        out[name] = build(source, start, end)
    out["negative_ebitda_flag"] = "case when ebitda <= 0 then 1D when ebitda > 0 then 0D end"
    return with_exprs(df, out)


def structural_flags(df: DataFrame) -> DataFrame:
    return with_exprs(df, {
        "negative_equity_flag": flag("equity_to_assets < 0"),
        "liabilities_exceed_assets_flag": flag("liabilities_to_assets > 1"),
    })


def structural_distress(df: DataFrame) -> DataFrame:
    """Not renormalised: one missing part makes it missing; flags stand in without the parts."""
    if set(C.STRUCTURAL_COMPONENTS) <= set(df.columns):
        return with_exprs(df, {"structural_distress_risk": weighted_sum(C.STRUCTURAL_COMPONENTS)})
    worst = "cast(greatest(negative_equity_flag, liabilities_exceed_assets_flag) as double)"
    return with_exprs(df, {"structural_distress_risk": worst})


def domain_risks(df: DataFrame, renormalize: bool = True) -> DataFrame:
    """Domain risks over the components present; renormalize=False is the older strict rule."""
    combine = weighted_mean if renormalize else weighted_sum
    parts = {d: combine(w) for d, w in C.DOMAIN_COMPONENTS.items()}
    legacy = combine(C.DEBT_SERVICE_LEGACY)
    return with_exprs(df, {
        **parts,
        "earnings_risk": "profitability_risk",
        "debt_service_risk": f"coalesce({parts['debt_service_risk']}, {legacy})",
        "debt_service_risk_legacy": legacy,
    })


def credit_score(weights: dict | None = None) -> str:
    """0-100, higher is riskier; weights renormalised over the domains a row has."""
    return f"100D * ({weighted_mean(weights or C.SCORE_WEIGHTS)})"


def feature_coverage(features=None) -> str:
    features = list(features or C.DOMAINS)
    return f"{count_present(features)} / {num(len(features))}"


def ebitda_source(df: DataFrame) -> DataFrame:
    """Was EBITDA reported, rebuilt from its parts, or not available?  Use before derived_values."""
    return with_exprs(df, {"ebitda_source": (
        "case when ebitda is not null then 'direct' "
        "when operating_income + depreciation_amortization is not null then 'reconstructed' "
        "else 'missing' end"
    )})


def balance_check(df: DataFrame, tolerance: float = 0.05) -> DataFrame:
    """Does equity equal assets minus liabilities within a share of assets?"""
    df = with_exprs(df, {"balance_gap": safe_divide("abs(assets - liabilities - equity)", "abs(assets)")})
    return with_exprs(df, {"balance_ok": f"balance_gap <= {num(tolerance)}"})


def engineer(
    df: DataFrame,
    *,
    caps: dict | None = None,
    fx: float = 1.0,
    fx_rates: DataFrame | None = None,
    minimum: float | None = C.MIN_DENOMINATOR,
    names: str = "whole_column",
    rules: dict | None = None,
    renormalize: bool = True,
    weights: dict | None = None,
) -> DataFrame:
    """The full chain, in its fixed order.  Column expressions only: one narrow stage, sealed in parts that the JVM compiles."""
    out = (
        df.transform(standardize_names, names)
        .transform(coerce_money, fx, fx_rates)
        .transform(derived_values)
        .transform(sealed)
        .transform(base_ratios, minimum)
        .transform(diagnostic_ratios, minimum)
        .transform(sealed)
        .transform(ebitda_metrics, minimum)
        .transform(winsorize, caps)
        .transform(size_flags)
        .transform(sealed)
        .transform(component_risks, rules)
        .transform(sealed)
        .transform(structural_flags)
        .transform(structural_distress)
        .transform(sealed)
        .transform(domain_risks, renormalize)
        .transform(sealed)
    )
    return sealed(with_exprs(out, {"scorecard_credit_score": credit_score(weights)}))
