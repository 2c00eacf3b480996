"""Stress scenarios: each company becomes five rows in one scan."""

from pyspark.sql import DataFrame, Window as W, functions as F

from .. import constants as C
from ..functions.scalars import text, with_exprs
from .guardrails import apply_guardrails
from .outlook import with_outlook
from .scoring import Model, score_companies


def make_scenarios(df: DataFrame) -> DataFrame:
    """base, revenue -15%, debt +25%, cash burn, near default.

    A change that cannot be computed (missing input) leaves the old value, and
    items the input does not have are not added.
    """
    have = set(df.columns)

    def item(name, default="cast(null as double)"):
        return name if name in have else default

    ltd, cash, assets = item("long_term_debt", "0D"), item("cash", "0D"), item("assets")
    interest = item("interest_expense", "1000000D")

    def floor_zero(e):
        return f"case when {e} is not null then greatest({e}, 0D) end"

    revenue_down, debt_up, burn, distress = C.SCENARIOS[1:]
    changes = {
        "revenue": {revenue_down: "revenue * 0.85D"},
        "net_income": {revenue_down: "net_income * 0.70D", burn: "-abs(net_income)"},
        "cfo": {revenue_down: "cfo * 0.75D", burn: "-abs(cfo)"},
        "operating_income": {
            revenue_down: "operating_income * 0.70D",
            distress: floor_zero(f"{interest} * 0.4D"),
        },
        "long_term_debt": {debt_up: f"{ltd} * 1.25D", distress: f"{assets} * 0.75D"},
        "short_term_debt": {distress: f"{assets} * 0.15D"},
        "liabilities": {debt_up: f"liabilities + {ltd} * 0.25D", distress: f"{assets} * 1.10D"},
        "equity": {distress: f"-{assets} * 0.10D"},
        "cash": {
            debt_up: floor_zero(f"({cash} - {ltd} * 0.05D)"),
            burn: floor_zero(f"({cash} * 0.50D)"),
        },
        "interest_expense": {
            distress: "case when interest_expense is not null then greatest(interest_expense, 1000000D) end"
        },
    }
    listed = ", ".join(text(s) for s in C.SCENARIOS)
    out = df.withColumn("scenario", F.expr(f"explode(array({listed}))"))
    exprs = {}
    for name, cases in changes.items():
        if name in have:
            hits = " ".join(f"when {text(s)} then {e}" for s, e in cases.items())
            exprs[name] = f"coalesce(case scenario {hits} end, {name})"
    return with_exprs(out, exprs)


def score_scenarios(df: DataFrame, model: Model, external_rating: str | None = None, **options) -> DataFrame:
    scored = score_companies(make_scenarios(df), model, **options)
    return apply_guardrails(with_outlook(scored, model), external_rating)


def scenario_migration(scored: DataFrame, keys: list) -> DataFrame:
    """Every scenario next to the base case of its company (five rows per window group)."""
    w = W.partitionBy(*keys)

    def base(c):
        return F.max(F.when(F.col("scenario") == "base", F.col(c))).over(w)

    level = "array_position(array({}), {{}})".format(", ".join(text(s) for s in C.SEVERITIES))
    out = scored.withColumns({
        "base_rank": base("risk_rank"),
        "base_score": base("scorecard_credit_score"),
        "base_outlook": base("outlook_flag"),
        "base_level": base("guardrail_level"),
    })
    return with_exprs(out, {
        "rank_change": "risk_rank - base_rank",
        "score_change": "scorecard_credit_score - base_score",
        "outlook_changed": "not (outlook_flag <=> base_outlook)",
        "level_change": f"cast({level.format('guardrail_level')} - {level.format('base_level')} as int)",
    })
