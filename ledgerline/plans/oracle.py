"""Reference SQL of the registered queries: the same results, written as plain SQL over the raw tables.

Each named common table is written once; `sql(body)` puts the ones a body needs in front of it.
"""

import re

from .. import constants as C

FIRST_YEAR, LAST_YEAR = 1996, 2000
CENTROIDS = [
    [0.05, 1.00, 1.00, 0.05, 0.05, 1.00],
    [0.45, 0.35, 0.35, 0.45, 0.35, 0.45],
    [0.95, 0.95, 0.95, 0.90, 0.85, 0.95],
    [0.65, 0.60, 0.60, 0.60, 0.55, 0.85],
    [0.20, 0.20, 0.25, 0.30, 0.15, 0.10],
]
RANKS = {0: 3, 1: 2, 2: 5, 3: 4, 4: 1}

MONEY = set(C.MONETARY) | {
    "total_debt", "net_debt", "fcf", "debt", "free_cash_flow", "ppe", "goodwill", "sga", "rd", "value_money",
}
PLAIN = {
    "ticker", "cik", "company_name", "sic", "fiscal_year", "fiscal_period", "canonical_feature", "concept",
    "label", "major_sector", "financial_flag", "asset_size_band", "currency", "cluster", "cluster_key", "segment",
    "small_company_flag", "mid_company_flag", "large_company_flag", "negative_equity_flag", "k", "prob_text",
    "liabilities_exceed_assets_flag", "assigned_cluster", "cluster_label", "risk_rank", "warning_flags",
    "upper_bucket_cluster", "upper_bucket_label", "lower_bucket_cluster", "lower_bucket_label", "outlook_flag",
    "outlook_reason", "scenario", "scope", "issuer_years", "issuers", "row_count", "rows", "n", "metric",
    "relative_position", "ebitda_source", "balance_ok", "feature", "features_present", "rating_style_rank",
    "rating_style_label", "method", "filing_id", "flag", "family", "severity", *C.GUARDRAIL_COLUMNS,
}


def kind(name: str) -> str:
    base = re.sub(r"^(median_|base_|p_)", "", name)
    return "plain" if name in PLAIN else "money" if base in MONEY else "ratio"


def r(expr: str, digits: int = 6) -> str:
    scale = 6 if digits <= 2 else 10
    return f"CAST(round(CAST({expr} AS DECIMAL(38,{scale})), {digits}) AS DOUBLE)"


def cols(names) -> str:
    """Select list with the rounding used on both sides."""
    out = []
    for n in names:
        k = kind(n)
        out.append(n if k == "plain" else f"{r(n, 2 if k == 'money' else 6)} AS {n}")
    return ", ".join(out)


def div(n: str, d: str, low: float | None = C.MIN_DENOMINATOR) -> str:
    guard = f"{d} IS NOT NULL AND {d} <> 0" + ("" if low is None else f" AND abs({d}) >= {low}")
    return f"(CASE WHEN {guard} THEN ({n}) / ({d}) ELSE NULL END)"


def bounded(x: str) -> str:
    return f"(CASE WHEN ({x}) IS NULL THEN NULL ELSE greatest(0.0::DOUBLE, least(1.0::DOUBLE, {x})) END)"


def mean_of(parts: dict) -> str:
    top = " + ".join(f"coalesce({c}, 0)::DOUBLE * {w}::DOUBLE" for c, w in parts.items())
    low = " + ".join(f"(CASE WHEN {c} IS NULL THEN 0 ELSE {w} END)::DOUBLE" for c, w in parts.items())
    return f"(({top}) / nullif({low}, 0))"


def sum_of(parts: dict) -> str:
    return "(" + " + ".join(f"{w}::DOUBLE * {c}" for c, w in parts.items()) + ")"


def lit(s: str) -> str:
    return "'" + s.replace("'", "''") + "'"


CTES: dict = {}

CTES["lines"] = """
SELECT l_orderkey, sum(CAST(round(l_extendedprice*100) AS BIGINT))::DOUBLE AS allc,
  coalesce(sum(CASE WHEN l_returnflag='R' THEN CAST(round(l_extendedprice*100) AS BIGINT) END),0)::DOUBLE AS rc,
  coalesce(sum(CASE WHEN l_linestatus='O' THEN CAST(round(l_extendedprice*100) AS BIGINT) END),0)::DOUBLE AS oc,
  sum(CAST(round(l_discount*100) AS BIGINT))::DOUBLE AS dc, sum(CAST(round(l_tax*100) AS BIGINT))::DOUBLE AS tc,
  sum(l_quantity) AS q, count(*)::DOUBLE AS n FROM lineitem GROUP BY l_orderkey"""

SEGMENTS = "CASE c_mktsegment WHEN 'AUTOMOBILE' THEN '3711' WHEN 'FURNITURE' THEN '5712' WHEN 'MACHINERY' THEN '4911' WHEN 'HOUSEHOLD' THEN '7311' WHEN 'BUILDING' THEN '6022' END"
SIC = f"CASE WHEN c_custkey%50=0 THEN NULL WHEN c_custkey%50=1 THEN 'n/a' ELSE {SEGMENTS} END"

CTES["ord"] = f"""
SELECT 'C'||o_custkey AS ticker, CAST(c_custkey AS VARCHAR) AS cik, c_name AS company_name, {SIC} AS sic,
  CAST(year(o_orderdate) AS INTEGER) AS fiscal_year, CASE WHEN o_orderkey%20=0 THEN 'Q1' WHEN o_orderkey%37=3 THEN 'H1' ELSE 'FY' END AS fiscal_period,
  CAST(o_orderdate AS DATE) AS filing_date, o_orderkey AS filing_id, c_custkey AS k, o_orderstatus AS s, o_orderpriority AS p,
  o_totalprice*20*(1+c_nationkey) AS a, c_acctbal/10000 AS e, rc/allc AS r, oc/allc AS o, dc/(100.0::DOUBLE*n) AS d,
  tc/(100.0::DOUBLE*n) AS t, q
FROM orders JOIN lines ON o_orderkey=l_orderkey JOIN customer ON o_custkey=c_custkey"""

_f = {
    "assets": "a", "equity": "a*e", "liabilities": "a*(1-e)", "assets_current": "a*(0.2::DOUBLE+0.6::DOUBLE*o)",
    "liabilities_current": "a*(1-e)*(0.3::DOUBLE+0.5::DOUBLE*r)", "cash": "CASE WHEN s='P' THEN NULL ELSE a*1.5::DOUBLE*d END",
    "receivables": "CASE WHEN s='F' THEN NULL ELSE a*0.3::DOUBLE*o END",
    "long_term_debt": "CASE WHEN p='4-NOT SPECIFIED' THEN NULL ELSE a*(1-e)*0.5::DOUBLE*(1-r) END",
    "short_term_debt": "CASE WHEN p IN ('4-NOT SPECIFIED','5-LOW') THEN NULL ELSE a*(1-e)*0.1::DOUBLE*o END",
    "revenue": "a*(0.2::DOUBLE+q/200.0::DOUBLE)", "net_income": "a*(2.5::DOUBLE*t-0.08::DOUBLE)",
    "cfo": "a*(0.25::DOUBLE*(1-r)-0.05::DOUBLE)", "operating_income": "a*(3.0::DOUBLE*t-0.06::DOUBLE)",
    "interest_expense": "CASE WHEN p='5-LOW' THEN NULL ELSE a*(1-e)*0.02::DOUBLE END",
    "depreciation_amortization": "CASE WHEN p='1-URGENT' THEN NULL ELSE a*0.04::DOUBLE END", "capex": "a*0.03::DOUBLE*o",
}
_gap = {"net_income": "k%10=2", "equity": "k%10=3", "liabilities": "k%10=3", "cfo": "k%25=4", "long_term_debt": "k%25=4",
        "short_term_debt": "k%25=4", "interest_expense": "k%25=4"}


def _gone(item):
    parts = ([_gap[item]] if item in _gap else []) + ([] if item in ("assets", "revenue", "capex") else ["k%25=5"])
    return " OR ".join(parts)


CTES["stm"] = "SELECT *, " + ", ".join(
    f"CASE WHEN {_gone(i)} THEN NULL ELSE {x} END AS {i}" if _gone(i) else f"{x} AS {i}" for i, x in _f.items()
) + " FROM ord"
_tags = " ".join(
    f"WHEN item='{i}' AND filing_id%2=1 THEN '{(C.CONCEPTS[i] + C.CONCEPTS[i])[1]}' WHEN item='{i}' THEN '{C.CONCEPTS[i][0]}'" for i in _f
)
CTES["facts"] = f"""
SELECT ticker, cik, company_name, sic, CASE {_tags} END AS concept, replace(item,'_',' ') AS label, numeric_value,
  fiscal_year, fiscal_period, filing_date
FROM (SELECT * FROM (UNPIVOT (SELECT ticker,cik,company_name,sic,fiscal_year,fiscal_period,filing_date,filing_id,{','.join(_f)} FROM stm)
  ON {','.join(_f)} INTO NAME item VALUE numeric_value)
 UNION ALL SELECT ticker, cik, company_name, sic, fiscal_year, fiscal_period, filing_date, filing_id, 'cash', NULL FROM stm WHERE filing_id%41=5 AND cash IS NULL)"""
CTES["lookup"] = "SELECT * FROM (VALUES " + ", ".join(
    f"('{i}','{t}',{n})" for i, ts in C.CONCEPTS.items() for n, t in enumerate(ts)) + ") v(canonical_feature, concept, place)"
CTES["iyf"] = f"""
SELECT ticker, cik, TRY_CAST(sic AS INTEGER) AS sic, fiscal_year, canonical_feature, max(company_name) AS company_name,
  median(numeric_value) AS value
FROM facts JOIN lookup USING (concept)
WHERE fiscal_period='FY' AND fiscal_year BETWEEN {FIRST_YEAR} AND {LAST_YEAR} AND numeric_value IS NOT NULL
GROUP BY ALL"""


def sector(code="sic"):
    return f"CASE WHEN {code} IS NULL THEN 'Unknown' " + " ".join(
        f"WHEN {code}>={a} AND {code}<{b} THEN '{n}'" for a, b, n in C.SIC_DIVISIONS) + " ELSE 'Other' END"


def segment(code="sic"):
    return f"CASE WHEN {code} IS NULL THEN 'Unknown' WHEN {code} BETWEEN 6000 AND 6799 THEN 'Financial' ELSE 'Non-financial' END"


CTES["pivoted"] = "SELECT ticker, cik, sic, fiscal_year, max(company_name) AS company_name, " + ", ".join(
    f"max(CASE WHEN canonical_feature='{i}' THEN value END)::DOUBLE AS {i}" for i in C.CONCEPTS
) + " FROM iyf GROUP BY ticker, cik, sic, fiscal_year"
CTES["panel"] = f"SELECT *, {sector()} AS major_sector, {segment()} AS financial_flag, CAST(NULL AS DOUBLE) AS ebitda FROM pivoted"


def feature_ctes(name: str, source: str, rules=None, strict=False, weights=None) -> None:
    """Adds <name>1..<name>6 and <name>: the engineered columns over a source table."""
    rules = rules or C.COMPONENT_RULES
    combine = sum_of if strict else mean_of
    CTES[f"{name}1"] = f"""
SELECT * REPLACE (coalesce(long_term_debt,0)::DOUBLE AS long_term_debt, coalesce(short_term_debt,0)::DOUBLE AS short_term_debt,
    coalesce(capex,0)::DOUBLE AS capex,
    coalesce(ebitda, CASE WHEN operating_income IS NOT NULL AND depreciation_amortization IS NOT NULL
      THEN operating_income+depreciation_amortization END) AS ebitda),
  CASE WHEN long_term_debt IS NULL AND short_term_debt IS NULL THEN NULL
    ELSE coalesce(long_term_debt,0)::DOUBLE+coalesce(short_term_debt,0)::DOUBLE END AS total_debt,
  cfo-abs(coalesce(capex,0)::DOUBLE) AS fcf
FROM {source}"""
    # EBITDA does not apply to financial firms.
    CTES[f"{name}2"] = f"""
SELECT * REPLACE (CASE WHEN lower(CAST(financial_flag AS VARCHAR)) IN ('financial','1','true') THEN NULL ELSE ebitda END AS ebitda),
  total_debt-cash AS net_debt, total_debt AS debt, fcf AS free_cash_flow FROM {name}1"""
    CTES[f"{name}3"] = f"""
SELECT *, ln(1+greatest(assets,0)) AS log_assets, {div('liabilities','assets')} AS liabilities_to_assets,
  {div('equity','assets')} AS equity_to_assets, {div('cash','assets')} AS cash_to_assets, {div('revenue','assets')} AS revenue_to_assets,
  {div('net_income','assets')} AS net_income_to_assets, {div('cfo','assets')} AS cfo_to_assets, {div('total_debt','assets')} AS debt_to_assets,
  {div('total_debt','equity')} AS debt_to_equity, {div('assets_current','liabilities_current')} AS current_ratio,
  CASE WHEN cash IS NULL AND receivables IS NULL THEN NULL ELSE {div('coalesce(cash,0)::DOUBLE+coalesce(receivables,0)::DOUBLE','liabilities_current')} END AS quick_ratio,
  {div('gross_profit','revenue')} AS gross_margin, {div('operating_income','revenue')} AS operating_margin,
  {div('operating_income','abs(interest_expense)',None)} AS interest_coverage, {div('cfo','liabilities')} AS cfo_to_liabilities,
  {div('fcf','total_debt')} AS fcf_to_debt, {div('abs(capex)','revenue')} AS capex_to_revenue, {div('ebitda','revenue')} AS ebitda_margin,
  CASE WHEN ebitda<=0 THEN NULL ELSE {div('total_debt','ebitda')} END AS debt_to_ebitda,
  CASE WHEN ebitda<=0 THEN NULL ELSE {div('net_debt','ebitda')} END AS net_debt_to_ebitda,
  {div('ebitda','abs(interest_expense)',None)} AS ebitda_interest_coverage, {div('cfo','abs(total_debt)',None)} AS cfo_to_debt
FROM {name}2"""
    parts = []
    for risk, (source_ratio, direction, start, end) in rules.items():
        x = f"({source_ratio}-({start!r}::DOUBLE))/({end - start!r}::DOUBLE)" if direction == "high" else f"(({start!r}::DOUBLE)-{source_ratio})/({start - end!r}::DOUBLE)"
        parts.append(f"{bounded(x)} AS {risk}")
    CTES[f"{name}4"] = f"""
SELECT *, CAST(assets IS NOT NULL AND assets<5e6 AS INTEGER) AS small_company_flag,
  CAST(assets IS NOT NULL AND assets>=5e6 AND assets<5e7 AS INTEGER) AS mid_company_flag,
  CAST(assets IS NOT NULL AND assets>=5e7 AS INTEGER) AS large_company_flag,
  CASE WHEN assets IS NULL OR assets<=0 THEN NULL WHEN assets<=5e6 THEN 'small' WHEN assets<=5e7 THEN 'mid' WHEN assets<=1e11 THEN 'large' ELSE 'mega' END AS asset_size_band,
  {', '.join(parts)}, CASE WHEN ebitda IS NULL THEN NULL WHEN ebitda<=0 THEN 1.0::DOUBLE ELSE 0.0::DOUBLE END AS negative_ebitda_flag,
  CAST(coalesce(equity_to_assets<0,false) AS INTEGER) AS negative_equity_flag,
  CAST(coalesce(liabilities_to_assets>1,false) AS INTEGER) AS liabilities_exceed_assets_flag
FROM {name}3"""
    domains = {d: combine(w) for d, w in C.DOMAIN_COMPONENTS.items()}
    legacy = combine(C.DEBT_SERVICE_LEGACY)
    CTES[f"{name}5"] = f"""
SELECT *, {sum_of(C.STRUCTURAL_COMPONENTS)} AS structural_distress_risk, profitability_risk AS earnings_risk,
  {domains['operating_cashflow_risk']} AS operating_cashflow_risk, {domains['liquidity_risk']} AS liquidity_risk,
  {domains['leverage_risk']} AS leverage_risk, coalesce({domains['debt_service_risk']}, {legacy}) AS debt_service_risk,
  {legacy} AS debt_service_risk_legacy FROM {name}4"""
    CTES[name] = f"SELECT *, 100*{mean_of(weights or C.SCORE_WEIGHTS)} AS scorecard_credit_score FROM {name}5"


def score_ctes(name: str, source: str, temperature: float = 1.0) -> None:
    """Adds <name>: scored rows with outlook, over an engineered source and the `med` medians."""
    CTES[f"{name}1"] = f"SELECT *, " + ", ".join(
        f"coalesce({d}, m_{d}) AS x{i}" for i, d in enumerate(C.DOMAINS)) + f" FROM {source}, med"
    dist = [
        "sqrt(" + "+".join(f"(x{i}-{v})*(x{i}-{v})" for i, v in enumerate(c)) + ")" for c in CENTROIDS
    ]
    CTES[f"{name}2"] = "SELECT *, " + ", ".join(f"{d} AS cluster_{i}_distance" for i, d in enumerate(dist)) + f" FROM {name}1"
    ds = [f"cluster_{i}_distance" for i in range(5)]
    total = "(" + "+".join(f"exp(-{d}/{temperature})" for d in ds) + ")"
    best = "least(" + ",".join(ds) + ")"
    CTES[f"{name}3"] = f"""SELECT *, CAST(CASE {' '.join(f'WHEN {d}={best} THEN {i}' for i, d in enumerate(ds))} END AS INTEGER) AS assigned_cluster,
  {best} AS distance_to_assigned_cluster, {', '.join(f'exp(-{d}/{temperature})/{total} AS cluster_{i}_affinity' for i, d in enumerate(ds))} FROM {name}2"""
    warn = ", ".join(f"CASE WHEN {c} {op} {t} THEN '{f}' END" for f, c, op, t in C.WARNINGS)
    rank = "CAST(CASE assigned_cluster " + " ".join(f"WHEN {c} THEN {k}" for c, k in RANKS.items()) + " END AS INTEGER)"
    label = "CASE {} " + " ".join(f"WHEN {c} THEN {lit(C.RANK_LABELS[k])}" for c, k in RANKS.items()) + " END"
    CTES[f"{name}4"] = f"""SELECT *, {rank} AS risk_rank, {label.format('assigned_cluster')} AS cluster_label,
  greatest({','.join(f'cluster_{i}_affinity' for i in range(5))}) AS cluster_affinity, cluster_2_affinity AS near_default_affinity,
  ({'+'.join(f'CAST({d} IS NOT NULL AS INTEGER)' for d in C.DOMAINS)})/6.0::DOUBLE AS feature_coverage_pct,
  coalesce(nullif(concat_ws(', ', {warn}), ''), 'none') AS warning_flags FROM {name}3"""
    inv = {k: c for c, k in RANKS.items()}

    def near(step):
        return "CAST(CASE risk_rank " + " ".join(f"WHEN {k} THEN {inv[k+step]}" for k in RANKS.values() if k + step in inv) + " END AS INTEGER)"

    CTES[f"{name}5"] = f"SELECT *, {near(-1)} AS upper_bucket_cluster, {near(1)} AS lower_bucket_cluster FROM {name}4"
    pick = "CASE {} " + " ".join(f"WHEN {i} THEN cluster_{i}_distance" for i in range(5)) + " END"
    CTES[f"{name}6"] = f"""SELECT *, {label.format('upper_bucket_cluster')} AS upper_bucket_label, {label.format('lower_bucket_cluster')} AS lower_bucket_label,
  {pick.format('upper_bucket_cluster')} AS distance_to_upper_bucket, {pick.format('lower_bucket_cluster')} AS distance_to_lower_bucket FROM {name}5"""
    d, u, l = "distance_to_assigned_cluster", "distance_to_upper_bucket", "distance_to_lower_bucket"
    reason = f"""CASE WHEN {d} IS NULL THEN 'missing' WHEN {u} IS NULL AND {l} IS NULL THEN 'no_neighbours'
 WHEN {u} IS NULL THEN CASE WHEN {l}<={d}*1.35 THEN 'lower_near' ELSE 'lower_far' END
 WHEN {l} IS NULL THEN CASE WHEN {u}<={d}*1.35 THEN 'upper_near' ELSE 'upper_far' END
 WHEN {l}-{u}>{d}*0.15 AND {u}<={d}*1.35 THEN 'positive' WHEN {l}-{u}<-({d}*0.15) AND {l}<={d}*1.35 THEN 'negative' ELSE 'neutral' END"""
    CTES[f"{name}7"] = f"""SELECT *, CASE WHEN {d}>0 THEN {u}/{d} END AS upper_distance_ratio_to_assigned,
  CASE WHEN {d}>0 THEN {l}/{d} END AS lower_distance_ratio_to_assigned, {reason} AS why FROM {name}6"""
    CTES[name] = f"""SELECT *, CASE WHEN why IN ('lower_near','negative') THEN 'Negative' WHEN why IN ('upper_near','positive') THEN 'Positive' ELSE 'Neutral' END AS outlook_flag,
  CASE why {' '.join(f'WHEN {lit(k)} THEN {lit(v)}' for k, v in C.OUTLOOK_TEXT.items())} END AS outlook_reason FROM {name}7"""


def hits(rules=None) -> list:
    """(flag, family, severity, condition) with the contradiction rules."""
    out = [(f, fam, sev, f"coalesce({c} {op} {t}, false)") for f, fam, c, op, t, sev in (rules or C.GUARDRAILS)]
    lev = " OR ".join(c for _, fam, _, c in out if fam in ("leverage", "debt_service"))
    high = " OR ".join(c for _, _, sev, c in out if sev == "High caution")
    f, fam, sev = C.TOP_BUCKET_LEVERAGE
    g, gam, gev = C.TOP_BUCKET_HIGH
    h, ham, hev = C.WORST_BUCKET
    return out + [(f, fam, sev, f"(risk_rank=1 AND ({lev}))"), (g, gam, gev, f"(risk_rank=1 AND ({high}))"), (h, ham, hev, "(risk_rank>=5)")]


def guard_ctes(name: str, source: str, rules=None) -> None:
    found = hits(rules)
    CTES[f"{name}1"] = "SELECT *, " + ", ".join(f"{c} AS h{i}" for i, (*_, c) in enumerate(found)) + f" FROM {source}"

    def any_of(test):
        return "(" + " OR ".join(f"h{i}" for i, (f, fam, sev, _) in enumerate(found) if test(f, fam, sev)) + ")"

    level = "CASE " + " ".join(
        f"WHEN {any_of(lambda f, fam, sev, s=s: sev == s)} THEN '{s}'" for s in reversed(C.SEVERITIES[1:])) + " ELSE 'Clear' END"
    CTES[f"{name}2"] = f"""SELECT *, {level} AS guardrail_level,
  concat_ws(', ', {', '.join(f"CASE WHEN h{i} THEN '{f}' END" for i, (f, *_) in enumerate(found))}) AS guardrail_flags FROM {name}1"""
    t = {k: lit(v) for k, v in C.SUMMARY_TEXT.items()}

    def has(n):
        return any_of(lambda f, fam, sev: f == n)

    caution = t["caution"].replace("{label}", "'||cluster_label||'").replace("{rank}", "'||risk_rank||'")
    pos = "coalesce(nullif(concat_ws(', ', CASE WHEN liquidity_risk<=0.25 THEN 'liquidity' END, CASE WHEN operating_cashflow_risk<=0.25 THEN 'operating cash-flow generation' END, CASE WHEN structural_distress_risk=0 THEN 'absence of structural balance-sheet distress' END),''),'selected financial strengths')"
    neg = "coalesce(nullif(concat_ws(', ', " + ", ".join(
        f"CASE WHEN {any_of(lambda f, fam, sev, x=x: fam == x)} THEN '{C.CONCERN_NAMES[x]}' END" for x in ("leverage", "debt_service", "liquidity")
    ) + "),''),'selected financial diagnostics')"
    some = lit(C.INTERPRETATION_TEXT["some"]).replace("{positives}", f"'||{pos}||'").replace("{concerns}", f"'||{neg}||'")
    CTES[name] = f"""SELECT *, CASE WHEN guardrail_flags='' THEN {t['none']} WHEN {has(C.WORST_BUCKET[0])} THEN {t['distressed']}
  WHEN {has(C.TOP_BUCKET_HIGH[0])} THEN {t['top_high']} WHEN {has(C.TOP_BUCKET_LEVERAGE[0])} THEN {t['top_leverage']}
  WHEN {any_of(lambda f, fam, sev: fam == 'structural')} THEN {t['structural']} WHEN guardrail_level IN ('Caution','High caution') THEN {caution} ELSE {t['monitor']} END AS guardrail_summary,
  CASE WHEN guardrail_flags='' THEN {lit(C.INTERPRETATION_TEXT['none'])} ELSE {some} END AS analyst_interpretation,
  CASE guardrail_level {' '.join(f'WHEN {lit(k)} THEN {lit(v)}' for k, v in C.CONCLUSION_TEXT.items())} END AS commercial_conclusion FROM {name}2"""


feature_ctes("feat", "panel")
CTES["med"] = "SELECT " + ", ".join(f"median({d}) AS m_{d}" for d in C.DOMAINS) + " FROM feat WHERE financial_flag='Non-financial'"
score_ctes("scored", "feat")
guard_ctes("guarded", "scored")
PRESENT = "(" + "+".join(f"CAST({d} IS NOT NULL AS INTEGER)" for d in C.DOMAINS) + ")"
CTES["clustered"] = f"""SELECT *, assigned_cluster AS cluster, financial_flag||'__'||assigned_cluster AS cluster_key FROM scored
WHERE financial_flag='Non-financial' AND ticker IS NOT NULL AND fiscal_year IS NOT NULL AND {PRESENT}>=4"""

SCENARIO_SQL = {
    "base": {},
    "revenue_down_15pct": {"revenue": "revenue*0.85::DOUBLE", "net_income": "net_income*0.7::DOUBLE", "cfo": "cfo*0.75::DOUBLE", "operating_income": "operating_income*0.7::DOUBLE"},
    "debt_up_25pct": {"long_term_debt": "long_term_debt*1.25::DOUBLE", "liabilities": "liabilities+long_term_debt*0.25::DOUBLE",
                      "cash": "CASE WHEN cash-long_term_debt*0.05::DOUBLE>0 THEN cash-long_term_debt*0.05::DOUBLE WHEN cash-long_term_debt*0.05::DOUBLE<=0 THEN 0 END"},
    "cash_burn_case": {"cash": "CASE WHEN cash*0.5::DOUBLE>0 THEN cash*0.5::DOUBLE WHEN cash IS NOT NULL THEN 0 END", "cfo": "-abs(cfo)", "net_income": "-abs(net_income)"},
    "near_default_stress": {"liabilities": "assets*1.1::DOUBLE", "equity": "-assets*0.1::DOUBLE", "long_term_debt": "assets*0.75::DOUBLE", "short_term_debt": "assets*0.15::DOUBLE",
                            "interest_expense": "CASE WHEN interest_expense>1000000 THEN interest_expense WHEN interest_expense IS NOT NULL THEN 1000000 END",
                            "operating_income": "CASE WHEN interest_expense*0.4::DOUBLE>0 THEN interest_expense*0.4::DOUBLE WHEN interest_expense IS NOT NULL THEN 0 END"},
}
CTES["scen"] = " UNION ALL ".join(
    f"SELECT * {'REPLACE (' + ', '.join(f'coalesce({e}, {c})::DOUBLE AS {c}' for c, e in ups.items()) + ')' if ups else ''}, '{name}' AS scenario FROM panel"
    for name, ups in SCENARIO_SQL.items())
feature_ctes("sfeat", "scen")
score_ctes("sscored", "sfeat")
guard_ctes("sguarded", "sscored")
feature_ctes("strict", "panel", strict=True)


def sql(body: str, extra: dict | None = None) -> str:
    """The body with the common tables it needs in front, in dependency order."""
    known = {**CTES, **(extra or {})}
    seen, order = set(), []

    def visit(text):
        for word in re.findall(r"\b[a-z_]+[0-9]?\b", re.sub(r"'(?:[^']|'')*'", "", text)):
            if word in known and word not in seen:
                seen.add(word)
                visit(known[word])
                order.append(word)

    visit(body)
    shared = {"facts", "panel", "feat", "med", "scored", "clustered", "guarded", "sfeat", "sscored", "sguarded", "srank", "pts", "prof"}
    head = ",\n".join(
        f"{n} AS {'MATERIALIZED ' if n in shared else ''}({known[n].strip()})" for n in order)
    return (f"WITH {head}\n" if head else "") + body
