"""Fixed values of the credit model: weights, thresholds, labels and column lists.

Everything in this file is a fixed value.  The numbers and names have to stay as
they are for results to be comparable between installations, so they are stated
once here, as plain tables, and every operator reads them from here.
"""

# The six domain risks that feed the clustering, in model order.
DOMAINS = [
    "structural_distress_risk",
    "earnings_risk",
    "operating_cashflow_risk",
    "liquidity_risk",
    "leverage_risk",
    "debt_service_risk",
]

# Weight of each domain risk in the 0-100 score.
SCORE_WEIGHTS = {
    "leverage_risk": 0.25,
    "liquidity_risk": 0.10,
    "earnings_risk": 0.15,
    "operating_cashflow_risk": 0.20,
    "debt_service_risk": 0.25,
    "structural_distress_risk": 0.05,
}

# Alternative weight sets of the weight-sensitivity job.
WEIGHT_SETS = {
    "baseline": SCORE_WEIGHTS,
    "equal": {d: 1.0 / 6.0 for d in DOMAINS},
    "conservative_lender": {
        "leverage_risk": 0.30,
        "liquidity_risk": 0.20,
        "earnings_risk": 0.10,
        "operating_cashflow_risk": 0.20,
        "debt_service_risk": 0.15,
        "structural_distress_risk": 0.05,
    },
    "sme_working_capital": {
        "leverage_risk": 0.20,
        "liquidity_risk": 0.25,
        "earnings_risk": 0.15,
        "operating_cashflow_risk": 0.25,
        "debt_service_risk": 0.10,
        "structural_distress_risk": 0.05,
    },
}

# Component -> domain weights (domain risks are renormalised over
# the components a row has; structural distress is a plain sum).
DOMAIN_COMPONENTS = {
    "leverage_risk": {
        "liabilities_risk": 0.30,
        "debt_load_risk": 0.25,
        "equity_buffer_risk": 0.20,
        "net_debt_to_ebitda_risk": 0.25,
    },
    "liquidity_risk": {
        "current_liquidity_risk": 0.35,
        "quick_liquidity_risk": 0.30,
        "debt_repayment_risk": 0.20,
        "cash_buffer_risk": 0.15,
    },
    "operating_cashflow_risk": {
        "cashflow_risk": 0.50,
        "cfo_to_debt_risk": 0.50,
    },
    "debt_service_risk": {
        "coverage_risk": 0.35,
        "fcf_risk": 0.25,
        "debt_to_ebitda_risk": 0.25,
        "ebitda_coverage_risk": 0.15,
    },
}
DEBT_SERVICE_LEGACY = {"coverage_risk": 0.60, "fcf_risk": 0.40}
STRUCTURAL_COMPONENTS = {"equity_buffer_risk": 0.60, "liabilities_risk": 0.40}

# Component risk -> (source ratio, direction, start, end).
# "high": 0 at or below start, 1 at or above end; "low": 0 at or above start,
# 1 at or below end.
COMPONENT_RULES = {
    "liabilities_risk": ("liabilities_to_assets", "high", 0.30, 0.95),
    "debt_load_risk": ("debt_to_assets", "high", 0.10, 0.75),
    "equity_buffer_risk": ("equity_to_assets", "low", 0.65, 0.00),
    "cash_buffer_risk": ("cash_to_assets", "low", 0.15, 0.005),
    "current_liquidity_risk": ("current_ratio", "low", 2.50, 0.50),
    "quick_liquidity_risk": ("quick_ratio", "low", 1.50, 0.25),
    "profitability_risk": ("net_income_to_assets", "low", 0.10, -0.05),
    "cashflow_risk": ("cfo_to_assets", "low", 0.20, -0.05),
    "cfo_to_debt_risk": ("cfo_to_debt", "low", 0.60, 0.02),
    "coverage_risk": ("interest_coverage", "low", 12.0, 0.80),
    "fcf_risk": ("fcf_to_debt", "low", 0.40, -0.10),
    "debt_repayment_risk": ("fcf_to_debt", "low", 0.40, -0.08),
    "ebitda_margin_risk": ("ebitda_margin", "low", 0.35, -0.05),
    "debt_to_ebitda_risk": ("debt_to_ebitda", "high", 1.0, 6.0),
    "net_debt_to_ebitda_risk": ("net_debt_to_ebitda", "high", 1.0, 5.0),
    "ebitda_coverage_risk": ("ebitda_interest_coverage", "low", 20.0, 1.00),
}

# Ratio guardrails, in evaluation order:
# (flag, family, column, operator, threshold, severity).
GUARDRAILS = [
    ("elevated_debt_to_assets", "leverage", "debt_to_assets", ">", 0.45, "Caution"),
    ("high_debt_to_assets", "leverage", "debt_to_assets", ">", 0.60, "High caution"),
    ("elevated_debt_to_ebitda", "leverage", "debt_to_ebitda", ">", 3.5, "Caution"),
    ("high_debt_to_ebitda", "leverage", "debt_to_ebitda", ">", 5.0, "High caution"),
    ("elevated_net_debt_to_ebitda", "leverage", "net_debt_to_ebitda", ">", 3.0, "Caution"),
    ("high_net_debt_to_ebitda", "leverage", "net_debt_to_ebitda", ">", 4.5, "High caution"),
    ("weak_interest_coverage", "debt_service", "interest_coverage", "<", 2.0, "Caution"),
    ("critical_interest_coverage", "debt_service", "interest_coverage", "<", 1.0, "High caution"),
    ("weak_ebitda_interest_coverage", "debt_service", "ebitda_interest_coverage", "<", 3.0, "Caution"),
    ("weak_fcf_to_debt", "debt_service", "fcf_to_debt", "<", 0.10, "Caution"),
    ("current_ratio_below_1", "liquidity", "current_ratio", "<", 1.0, "Caution"),
    ("quick_ratio_below_0_5", "liquidity", "quick_ratio", "<", 0.5, "High caution"),
    ("low_cash_to_assets", "liquidity", "cash_to_assets", "<", 0.03, "Monitor"),
    ("negative_equity", "structural", "equity_to_assets", "<", 0.0, "Override required"),
    ("liabilities_exceed_assets", "structural", "liabilities_to_assets", ">", 1.0, "Override required"),
]
# Guardrails that compare the model bucket with the ratios.
TOP_BUCKET_LEVERAGE = ("top_bucket_with_leverage_caveat", "contradiction", "Caution")
TOP_BUCKET_HIGH = ("top_bucket_with_high_caution_caveat", "contradiction", "High caution")
WORST_BUCKET = ("distressed_cluster_requires_manual_review", "contradiction", "Override required")
EXTERNAL_RATING = ("external_rating_speculative_grade", "external_rating", "Caution")

# Severities, mildest first.
SEVERITIES = ["Clear", "Monitor", "Caution", "High caution", "Override required"]

# First letters of a rating token; the first match in text order decides.
INVESTMENT_MARKERS = ["AAA", "AA", "A", "BAA", "BBB"]
SPECULATIVE_MARKERS = ["BA", "BB", "B", "CAA", "CCC", "CC", "C", "D"]

# Warning flags of a scored row, in order: (flag, column, operator, threshold).
WARNINGS = [
    ("invalid_assets", "assets", "<=", 0.0),
    ("assets_below_model_threshold", "assets", "<", 1_000_000.0),
    ("liabilities_exceed_assets", "liabilities_to_assets", ">", 1.0),
    ("negative_equity", "equity_to_assets", "<", 0.0),
    ("high_debt_to_assets", "debt_to_assets", ">", 0.75),
    ("current_ratio_below_1", "current_ratio", "<", 1.0),
    ("quick_ratio_below_0_5", "quick_ratio", "<", 0.5),
    ("interest_coverage_below_1", "interest_coverage", "<", 1.0),
    ("ebitda_interest_coverage_below_1_5", "ebitda_interest_coverage", "<", 1.5),
    ("debt_to_ebitda_above_6", "debt_to_ebitda", ">", 6.0),
    ("net_debt_to_ebitda_above_5", "net_debt_to_ebitda", ">", 5.0),
    ("negative_or_zero_ebitda", "ebitda", "<=", 0.0),
    ("negative_cfo_to_assets", "cfo_to_assets", "<", 0.0),
]

# Denominators, size limits and model defaults.
MIN_DENOMINATOR = 1_000.0
MIN_TRAINING_ASSETS = 1_000_000.0
SMALL_LIMIT = 5_000_000.0
MID_LIMIT = 50_000_000.0
LARGE_LIMIT = 100_000_000_000.0
SEGMENT_COL = "financial_flag"
TARGET_SEGMENT = "Non-financial"
K_CLUSTERS = 5
N_INIT = 500
SEED = 42
MAX_ITER = 300
TOL = 1e-4
MIN_SEGMENT_ROWS = 500
MIN_FEATURES = 4
ROW_COVERAGE = 0.60
HEAVY_ROWS = 25_000
K_RANGE = [2, 3, 4, 5, 6, 7, 8]
WARD_K = [3, 4, 5, 6, 7, 8]
DBSCAN_EPS = [0.25, 0.35, 0.50, 0.75, 1.00, 1.25, 1.50]
DBSCAN_MIN_SAMPLES = [10, 25, 50, 100]
NEUTRAL_BAND = 0.15
BOUNDARY = 1.35
TEMPERATURES = [0.3, 0.5, 1.0, 2.0, 3.0]
STABILITY_SEEDS = [1, 7, 21, 42, 100]
MODEL_VERSION = "v4_scorecard_ebitda"
FACTS_PER_FILE = 250_000

# Rank -> label of the five-level ladder (1 is the least risky).
RANK_LABELS = {
    1: "1 - Strong relative credit profile",
    2: "2 - Good credit profile",
    3: "3 - Loss-making / cash-flow weak profile",
    4: "4 - Leveraged / weak operating credit profile",
    5: "5 - Distressed / near-default proxy",
}
UNRANKED = "Unranked"

EXTREME_QUANTILES = [0.001, 0.01, 0.05, 0.50, 0.95, 0.99, 0.999]

# Monetary input columns.
MONETARY = [
    "assets", "liabilities", "equity", "cash", "net_income", "cfo", "revenue",
    "long_term_debt", "short_term_debt", "assets_current", "current_assets",
    "liabilities_current", "current_liabilities", "receivables", "inventory",
    "capex", "operating_income", "gross_profit", "interest_expense",
    "depreciation_amortization", "ebitda",
]

# Canonical item -> accounting concepts, preferred first.
CONCEPTS = {
    "assets": ["us-gaap:Assets"],
    "assets_current": ["us-gaap:AssetsCurrent"],
    "liabilities": ["us-gaap:Liabilities"],
    "liabilities_current": ["us-gaap:LiabilitiesCurrent"],
    "cash": [
        "us-gaap:CashAndCashEquivalentsAtCarryingValue",
        "us-gaap:CashCashEquivalentsRestrictedCashAndRestrictedCashEquivalents",
        "us-gaap:CashAndDueFromBanks",
    ],
    "receivables": ["us-gaap:AccountsReceivableNetCurrent"],
    "inventory": ["us-gaap:InventoryNet"],
    "ppe": ["us-gaap:PropertyPlantAndEquipmentNet"],
    "goodwill": ["us-gaap:Goodwill"],
    "equity": [
        "us-gaap:StockholdersEquity",
        "us-gaap:StockholdersEquityIncludingPortionAttributableToNoncontrollingInterest",
    ],
    "long_term_debt": ["us-gaap:LongTermDebt", "us-gaap:LongTermDebtNoncurrent"],
    "short_term_debt": [
        "us-gaap:ShortTermBorrowings",
        "us-gaap:LongTermDebtCurrent",
        "us-gaap:CurrentPortionOfLongTermDebt",
    ],
    "revenue": [
        "us-gaap:Revenues",
        "us-gaap:SalesRevenueNet",
        "us-gaap:RevenueFromContractWithCustomerExcludingAssessedTax",
    ],
    "depreciation_amortization": [
        "us-gaap:DepreciationDepletionAndAmortization",
        "us-gaap:DepreciationDepletionAndAmortizationExpense",
        "us-gaap:DepreciationAndAmortization",
        "us-gaap:Depreciation",
        "us-gaap:AmortizationOfIntangibleAssets",
    ],
    "gross_profit": ["us-gaap:GrossProfit"],
    "operating_income": ["us-gaap:OperatingIncomeLoss"],
    "net_income": ["us-gaap:NetIncomeLoss", "us-gaap:ProfitLoss"],
    "interest_expense": ["us-gaap:InterestExpense", "us-gaap:InterestExpenseNonOperating"],
    "sga": ["us-gaap:SellingGeneralAndAdministrativeExpense"],
    "rd": ["us-gaap:ResearchAndDevelopmentExpense"],
    "cfo": ["us-gaap:NetCashProvidedByUsedInOperatingActivities"],
    "capex": ["us-gaap:PaymentsToAcquirePropertyPlantAndEquipment"],
}

# Concepts whose coverage is inspected before modelling.
TARGET_CONCEPTS = [
    "us-gaap:Assets", "us-gaap:AssetsCurrent", "us-gaap:Liabilities",
    "us-gaap:LiabilitiesCurrent", "us-gaap:CashAndCashEquivalentsAtCarryingValue",
    "us-gaap:AccountsReceivableNetCurrent", "us-gaap:InventoryNet",
    "us-gaap:PropertyPlantAndEquipmentNet", "us-gaap:Goodwill", "us-gaap:LongTermDebt",
    "us-gaap:LongTermDebtCurrent", "us-gaap:StockholdersEquity",
    "us-gaap:RetainedEarningsAccumulatedDeficit", "us-gaap:Revenues", "us-gaap:GrossProfit",
    "us-gaap:OperatingIncomeLoss", "us-gaap:NetIncomeLoss", "us-gaap:InterestExpense",
    "us-gaap:SellingGeneralAndAdministrativeExpense", "us-gaap:ResearchAndDevelopmentExpense",
    "us-gaap:NetCashProvidedByUsedInOperatingActivities",
    "us-gaap:PaymentsToAcquirePropertyPlantAndEquipment",
]

# Industry code ranges [first, end) of the major divisions.
SIC_DIVISIONS = [
    (100, 1000, "Agriculture"),
    (1000, 1500, "Mining / Energy"),
    (1500, 1800, "Construction"),
    (2000, 4000, "Manufacturing / Industrials"),
    (4000, 5000, "Transportation / Utilities"),
    (5000, 6000, "Wholesale / Retail"),
    (6000, 6800, "Finance / Insurance / Real Estate"),
    (7000, 9000, "Services"),
    (9100, 9730, "Public Administration"),
]
FINANCIAL_RANGE = (6000, 6800)
FINANCE_SECTOR = "Finance / Insurance / Real Estate"

# Report column lists.
RATIOS = [
    "log_assets", "liabilities_to_assets", "debt_to_assets", "debt_to_equity",
    "equity_to_assets", "cash_to_assets", "net_income_to_assets", "cfo_to_assets",
    "revenue_to_assets", "current_ratio", "quick_ratio", "interest_coverage",
    "fcf_to_debt", "operating_margin", "gross_margin", "cfo_to_liabilities",
    "capex_to_revenue", "total_debt", "net_debt", "ebitda", "ebitda_margin",
    "debt_to_ebitda", "net_debt_to_ebitda", "ebitda_interest_coverage",
    "leverage_risk", "liquidity_risk", "earnings_risk", "operating_cashflow_risk",
    "debt_service_risk", "debt_service_risk_legacy", "structural_distress_risk",
    "scorecard_credit_score",
]
PROFILE_FEATURES = [
    "log_assets", "liabilities_to_assets", "debt_to_assets", "debt_to_equity",
    "equity_to_assets", "cash_to_assets", "net_income_to_assets", "cfo_to_assets",
    "revenue_to_assets", "current_ratio", "quick_ratio", "interest_coverage",
    "fcf_to_debt", "operating_margin", "gross_margin", "ebitda_margin",
    "debt_to_ebitda", "net_debt_to_ebitda", "ebitda_interest_coverage",
    "leverage_risk", "liquidity_risk", "earnings_risk", "operating_cashflow_risk",
    "debt_service_risk", "structural_distress_risk", "scorecard_credit_score",
]
COMPONENTS = [
    "liabilities_risk", "debt_load_risk", "equity_buffer_risk", "cash_buffer_risk",
    "current_liquidity_risk", "quick_liquidity_risk", "profitability_risk",
    "cashflow_risk", "cfo_to_debt_risk", "coverage_risk", "fcf_risk",
    "debt_repayment_risk", "ebitda_margin_risk", "debt_to_ebitda_risk",
    "net_debt_to_ebitda_risk", "ebitda_coverage_risk", "negative_ebitda_flag",
    "negative_equity_flag", "liabilities_exceed_assets_flag",
]
SIZE_FLAGS = ["small_company_flag", "mid_company_flag", "large_company_flag"]
MODEL_PROFILE = list(dict.fromkeys(
    ["scorecard_credit_score", *DOMAINS, *COMPONENTS, "log_assets", *SIZE_FLAGS,
     "total_debt", "net_debt", "ebitda", *RATIOS]
))
COMPARE_METRICS = [
    "log_assets", "liabilities_to_assets", "debt_to_assets", "equity_to_assets",
    "current_ratio", "quick_ratio", "cash_to_assets", "net_income_to_assets",
    "cfo_to_assets", "revenue_to_assets", "interest_coverage", "fcf_to_debt",
    "operating_margin", "gross_margin", "ebitda_margin", "debt_to_ebitda",
    "net_debt_to_ebitda", "ebitda_interest_coverage",
]
GUARDRAIL_COLUMNS = [
    "guardrail_level", "guardrail_flags", "guardrail_summary",
    "analyst_interpretation", "commercial_conclusion",
]
SCORE_COLUMNS = [
    "assigned_cluster", "cluster_label", "risk_rank", "cluster_affinity",
    "near_default_affinity", "distance_to_assigned_cluster", "upper_bucket_cluster",
    "upper_bucket_label", "distance_to_upper_bucket", "lower_bucket_cluster",
    "lower_bucket_label", "distance_to_lower_bucket", "outlook_flag", "outlook_reason",
    "scorecard_credit_score", "feature_coverage_pct", "warning_flags", *GUARDRAIL_COLUMNS,
]
SUMMARY_COLUMNS = ["company_name", "fiscal_year", *SCORE_COLUMNS]
SCENARIO_SUMMARY_COLUMNS = ["scenario", *SCORE_COLUMNS]
SCENARIO_INPUTS = [
    "scenario", "assets", "liabilities", "equity", "cash", "revenue", "net_income",
    "cfo", "long_term_debt", "short_term_debt", "interest_expense", "operating_income",
    "depreciation_amortization", "ebitda",
]
SCENARIO_DIAGNOSTICS = [
    "liabilities_to_assets", "debt_to_assets", "debt_to_equity", "equity_to_assets",
    "cfo_to_assets", "current_ratio", "quick_ratio", "interest_coverage", "fcf_to_debt",
    "ebitda", "ebitda_margin", "debt_to_ebitda", "net_debt_to_ebitda",
    "ebitda_interest_coverage", "debt_service_risk",
]
GUARDRAIL_CONTEXT = [
    "scope", "scenario", "company_name", "fiscal_year", "assigned_cluster", "cluster_label",
    "risk_rank", "scorecard_credit_score", "outlook_flag", "warning_flags",
]
SCENARIOS = ["base", "revenue_down_15pct", "debt_up_25pct", "cash_burn_case", "near_default_stress"]
DIMENSION_NAMES = [
    ("Leverage risk", "leverage_risk"),
    ("Liquidity risk", "liquidity_risk"),
    ("Earnings risk", "earnings_risk"),
    ("Operating cash-flow risk", "operating_cashflow_risk"),
    ("Debt-service risk", "debt_service_risk"),
    ("Structural distress risk", "structural_distress_risk"),
]
SCALE_NAMES = [
    ("Assets", "assets"), ("Revenue", "revenue"), ("Equity", "equity"),
    ("Total debt", "total_debt"), ("Net debt", "net_debt"), ("EBITDA", "ebitda"),
    ("Operating income", "operating_income"), ("CFO", "cfo"), ("Free cash flow", "fcf"),
]
KEY_RATIO_NAMES = [
    ("Liabilities / assets", "liabilities_to_assets"),
    ("Debt / assets", "debt_to_assets"),
    ("Debt / equity", "debt_to_equity"),
    ("Current ratio", "current_ratio"),
    ("Quick ratio", "quick_ratio"),
    ("Interest coverage", "interest_coverage"),
    ("EBITDA interest coverage", "ebitda_interest_coverage"),
    ("Debt / EBITDA", "debt_to_ebitda"),
    ("Net debt / EBITDA", "net_debt_to_ebitda"),
    ("FCF / debt", "fcf_to_debt"),
    ("EBITDA margin", "ebitda_margin"),
]

# Report sentences (guardrail summary, interpretation, conclusion, outlook).
SUMMARY_TEXT = {
    "none": "No material guardrail issues were identified based on the configured ratio, structural, and model-consistency checks.",
    "distressed": "The company is assigned to the weakest model-relative bucket. The result requires manual analyst review before being used in a client-facing conclusion.",
    "top_high": "The model assigns the company to the strongest relative credit-risk bucket, but high-caution leverage or debt-service indicators materially constrain the interpretation.",
    "top_leverage": "The model assigns the company to the strongest relative credit-risk bucket, but leverage and/or debt-service metrics require explicit qualification.",
    "structural": "Structural balance-sheet distress indicators were triggered. The model output should not be used without manual analyst review.",
    "caution": "The company is assigned to {label} with risk rank {rank}, but selected financial diagnostics require a qualified interpretation.",
    "monitor": "Selected monitoring guardrails were triggered, but they do not materially contradict the assigned model bucket.",
}
INTERPRETATION_TEXT = {
    "none": "The model output and key financial diagnostics are broadly consistent. The assigned cluster may be interpreted as a relative credit-risk grouping, subject to the methodology limitations of the scorecard.",
    "some": "The cluster assignment appears primarily supported by {positives}. However, {concerns} constrain the interpretation. The result should therefore be read as a relative model indication rather than an unqualified credit-strength conclusion.",
    "no_positives": "selected financial strengths",
    "no_concerns": "selected financial diagnostics",
}
POSITIVE_NAMES = {
    "liquidity_risk": "liquidity",
    "operating_cashflow_risk": "operating cash-flow generation",
    "structural_distress_risk": "absence of structural balance-sheet distress",
}
CONCERN_NAMES = {
    "leverage": "leverage",
    "debt_service": "debt-service capacity",
    "liquidity": "liquidity",
    "external_rating": "external speculative-grade rating indicators",
}
CONCLUSION_TEXT = {
    "Clear": "The model output can be presented as a relative financial-risk diagnostic, subject to normal review of input quality, business context, and model limitations.",
    "Monitor": "The result remains usable as a relative risk diagnostic, but the flagged items should be monitored and explained in any client-facing discussion.",
    "Caution": "The result should be presented with explicit caveats. Further review of debt maturity, covenants, refinancing risk, working-capital dynamics, and cash-flow sustainability is recommended before relying on the output for a commercial decision.",
    "High caution": "The model output may be directionally useful, but the flagged weaknesses are material. The conclusion should be manually reviewed and should not be framed as a clean low-risk or investment-grade-like result.",
    "Override required": "Manual analyst override is required. The model output should not be used as a standalone conclusion without detailed review of the financial statements, debt structure, liquidity, and business context.",
}
OUTLOOK_TEXT = {
    "missing": "Assigned-cluster distance is missing; outlook cannot be reliably assessed.",
    "no_neighbours": "No adjacent risk buckets available.",
    "lower_near": "Company is near the weaker adjacent bucket and has no stronger adjacent bucket available.",
    "lower_far": "Only the weaker adjacent bucket is available, but the company remains materially closer to its assigned bucket.",
    "upper_near": "Company is near the stronger adjacent bucket and has no weaker adjacent bucket available.",
    "upper_far": "Only the stronger adjacent bucket is available, but the company remains materially closer to its assigned bucket.",
    "positive": "Company is closer to the stronger adjacent bucket and close enough to that bucket to indicate positive cluster-position outlook.",
    "negative": "Company is closer to the weaker adjacent bucket and close enough to that bucket to indicate negative cluster-position outlook.",
    "neutral": "Company remains materially closer to its assigned bucket than to adjacent buckets; no strong upgrade or downgrade signal.",
}
NARRATIVE_TEXT = (
    "{company} is classified as '{label}' under the stable 1-to-5 risk-label scale shown above. "
    "The scorecard credit score is {score}. The scorecard evaluates relative credit risk across "
    "leverage, liquidity, earnings quality, operating cash-flow generation, debt-service capacity, "
    "and structural balance-sheet indicators. The current classification outlook is {outlook}."
)
METHOD_TEXT = {
    "KMeans": ("KMeans selected v3", "Production model", "Selected for stable five-level credit-risk ladder and reporting compatibility."),
    "Agglomerative": ("Agglomerative best candidate", "Robustness check", "Useful hierarchy check; not selected because KMeans supports centroid-based scoring."),
    "DBSCAN": ("DBSCAN practical candidate", "Density/outlier diagnostic", "Useful outlier check; not ideal for ordered credit-risk labels."),
}
