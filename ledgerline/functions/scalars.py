"""Null-safe column builders: a missing value stays missing, never becomes a zero risk.

The builders return Spark SQL expression text, to be used with `with_exprs`,
`F.expr` or `selectExpr`.  One parsed expression per column keeps the planning
cost of a table with ninety derived columns low.
"""

import uuid

from pyspark.sql import DataFrame, functions as F


def num(value) -> str:
    """A double literal."""
    return f"({float(value)!r}D)" if float(value) < 0 else f"{float(value)!r}D"


def text(value: str | None) -> str:
    """A string literal."""
    if value is None:
        return "cast(null as string)"
    return "'" + value.replace("\\", "\\\\").replace("'", "\\'") + "'"


def sealed(df: DataFrame) -> DataFrame:
    """Keep later filters above this point, and count the rows that pass it.

    A filter on a column at the end of a long chain would otherwise be pushed
    below the chain with the whole chain copied into the condition.  The code
    that Spark generates ends here too: a long chain without such points becomes
    one method that the JVM finds too large to compile (over 8,000 bytes).
    """
    return df.observe(f"rows_{uuid.uuid4().hex}", F.count(F.lit(1)).alias("rows"))


def with_exprs(df: DataFrame, exprs: dict) -> DataFrame:
    """Add or replace columns from expression texts; all of them see the input columns."""
    return df.withColumns({name: F.expr(body) for name, body in exprs.items()}) if exprs else df


def number(c: str) -> str:
    """Text or number to double; text that is no number, and NaN, become null."""
    return f"nanvl(try_cast({c} as double), null)"


def count_present(cols) -> str:
    return "(" + " + ".join(f"if({c} is not null, 1, 0)" for c in cols) + ")"


def safe_divide(n: str, d: str, minimum: float | None = None) -> str:
    """n / d; null where d is null, zero or, with a minimum, smaller than it in size."""
    if minimum is not None and minimum >= 1:
        return f"case when abs({d}) >= {num(minimum)} then {n} / {d} end"
    guard = f"{d} <> 0" + ("" if minimum is None else f" and abs({d}) >= {num(minimum)}")
    # A tiny denominator can overflow; infinities count as missing.
    return f"nullif(nullif(case when {guard} then {n} / {d} end, double('infinity')), double('-infinity'))"


def clip(c: str, low=None, high=None) -> str:
    """Limit to [low, high].  greatest/least skip nulls, hence the guard."""
    out = c if low is None else f"greatest({num(low)}, {c})"
    out = out if high is None else f"least({num(high)}, {out})"
    return f"case when {c} is not null then {out} end"


def clip01(c: str) -> str:
    return clip(c, 0.0, 1.0)


def risk_when_high(c: str, low: float, high: float) -> str:
    return (
        f"case when {c} <= {num(low)} then 0D when {c} >= {num(high)} then 1D "
        f"else ({c} - {num(low)}) / {num(high - low)} end"
    )


def risk_when_low(c: str, good: float, bad: float) -> str:
    return (
        f"case when {c} >= {num(good)} then 0D when {c} <= {num(bad)} then 1D "
        f"else ({num(good)} - {c}) / {num(good - bad)} end"
    )


def weighted_mean(weights: dict) -> str:
    """Weighted mean over the columns a row has; null only when it has none of them."""
    total = " + ".join(f"coalesce({c}, 0D) * {num(w)}" for c, w in weights.items())
    weight = " + ".join(f"if({c} is not null, {num(w)}, 0D)" for c, w in weights.items())
    return f"({total}) / nullif({weight}, 0D)"


def weighted_sum(weights: dict) -> str:
    """Plain weighted sum: one missing column makes the sum missing."""
    return "(" + " + ".join(f"{num(w)} * {c}" for c, w in weights.items()) + ")"


def flag(condition: str) -> str:
    return f"if(coalesce({condition}, false), 1, 0)"


OPERATORS = (">", ">=", "<", "<=", "==")


def rule_holds(c: str, operator: str, threshold) -> str:
    """Rule check that is false for null, NaN, infinite and non-numeric values."""
    if operator not in OPERATORS:
        raise ValueError(f"Unsupported operator {operator!r}; use one of {OPERATORS}")
    limit = threshold if isinstance(threshold, str) else num(threshold)
    finite = f"nullif(nullif({number(c)}, double('infinity')), double('-infinity'))"
    return f"coalesce({finite} {operator} {limit}, false)"


def rounded(c: str, digits: int = 6) -> str:
    """Round half up after dropping floating-point noise, so that ties round alike everywhere."""
    return f"round(round({c}, {10 if digits > 2 else 6}), {digits})"


def case_map(c: str, mapping: dict, default: str | None = None) -> str:
    """Small fixed map as a CASE expression; values are texts or numbers."""
    def lit(v):
        return text(v) if v is None or isinstance(v, str) else str(v)

    if not mapping:
        return lit(default)
    hits = " ".join(f"when {lit(k)} then {lit(v)}" for k, v in mapping.items())
    tail = "" if default is None else f" else {lit(default)}"
    return f"case {c} {hits}{tail} end"


def existing(df: DataFrame, names) -> list[str]:
    """Requested columns that the frame has, in request order, each once."""
    have = set(df.columns)
    return [n for n in dict.fromkeys(names) if n in have]


def numeric(df: DataFrame, names) -> list[str]:
    types = dict(df.dtypes)
    plain = ("int", "bigint", "double", "float", "smallint", "tinyint")
    return [n for n in existing(df, names) if types[n] in plain or types[n].startswith("decimal")]


def ensure_columns(df: DataFrame, names, dtype: str = "double") -> DataFrame:
    """Add the requested columns that the frame lacks, as nulls."""
    have = set(df.columns)
    return with_exprs(df, {n: f"cast(null as {dtype})" for n in names if n not in have})


def require_columns(df: DataFrame, names, what: str) -> DataFrame:
    missing = sorted(set(names) - set(df.columns))
    if missing:
        raise ValueError(f"{what} is missing required columns: {missing}")
    return df


def unpivot(df: DataFrame, keys, names, name_col="metric", value_col="value") -> DataFrame:
    """Wide numeric columns to one row per (keys, name)."""
    long = df.selectExpr(*keys, *[f"cast({n} as double) as {n}" for n in names])
    return long.unpivot(list(keys), list(names), name_col, value_col)
