"""Rule table over scored rows: flags, severity level and report sentences."""

from pyspark.sql import DataFrame, functions as F

from .. import constants as C
from ..functions.scalars import case_map, existing, rule_holds, sealed, text, with_exprs

#: Rules of one part of the generated code.
RULES = 8


def speculative_rating(c: str) -> str:
    """The first word that starts with a rating marker decides; investment markers win within a word."""
    known = "|".join(C.INVESTMENT_MARKERS + C.SPECULATIVE_MARKERS)
    good = "|".join(C.INVESTMENT_MARKERS)
    words = f"translate(upper({c}), '-+/', '   ')"
    first = f"regexp_extract({words}, '(?:^|\\\\s)((?:{known})\\\\S*)', 1)"
    return f"coalesce({first} <> '' and not {first} rlike '^(?:{good})', false)"


def guardrail_rules(df: DataFrame, rules=None, external_rating: str | None = None) -> list:
    """(flag, family, severity, condition text) in evaluation order; contradictions build on the ratio rules."""
    have = set(df.columns)
    rules = list(rules or C.GUARDRAILS)
    out = [
        (flag, family, severity, rule_holds(c, op, limit) if c in have else "false")
        for flag, family, c, op, limit, severity in rules
    ]

    def any_of(test):
        hits = [cond for flag, family, severity, cond in out if test(family, severity)]
        return "(" + (" or ".join(hits) or "false") + ")"

    leveraged = any_of(lambda family, severity: family in ("leverage", "debt_service"))
    high = any_of(lambda family, severity: severity == "High caution")
    if "risk_rank" in have:
        top, worst = "coalesce(risk_rank = 1, false)", "coalesce(risk_rank >= 5, false)"
        out += [
            (*_order(C.TOP_BUCKET_LEVERAGE), f"{top} and {leveraged}"),
            (*_order(C.TOP_BUCKET_HIGH), f"{top} and {high}"),
            (*_order(C.WORST_BUCKET), worst),
        ]
    if external_rating is not None:
        source = external_rating if external_rating in have else text(external_rating)
        out.append((*_order(C.EXTERNAL_RATING), speculative_rating(source)))
    return out


def _order(rule):
    flag, family, severity = rule
    return flag, family, severity


def apply_guardrails(df: DataFrame, external_rating: str | None = None, rules=None, texts: bool = True) -> DataFrame:
    """Guardrail columns.  external_rating is a column name or one text for all rows."""
    found = guardrail_rules(df, rules, external_rating)
    marks = {flag: f"hit_{i}" for i, (flag, *_ ) in enumerate(found)}
    df = sealed(df)
    for at in range(0, len(found), RULES):
        df = sealed(with_exprs(df, {marks[flag]: cond for flag, _, _, cond in found[at:at + RULES]}))

    def any_of(test):
        return "(" + (" or ".join(marks[f] for f, fam, sev, _ in found if test(f, fam, sev)) or "false") + ")"

    levels = " ".join(
        f"when {any_of(lambda f, fam, sev, level=level: sev == level)} then {text(level)}"
        for level in reversed(C.SEVERITIES[1:])
    )
    flags = ", ".join(f"if({marks[f]}, {text(f)}, null)" for f, *_ in found)
    df = with_exprs(df, {
        "guardrail_level": f"case {levels} else 'Clear' end",
        "guardrail_flags": f"concat_ws(', ', {flags})",
    })
    if texts:
        df = with_exprs(df, _texts(df, any_of))
    return df.drop(*marks.values())


def guardrail_levels(df: DataFrame, variants: dict, keys=()) -> DataFrame:
    """keys, variant, guardrail_level: the level of every row under each rule table, from one scan."""
    def level(rules):
        found = guardrail_rules(df, rules)
        hits = {sev: " or ".join(cond for _, _, s, cond in found if s == sev) for sev in reversed(C.SEVERITIES[1:])}
        return "case " + " ".join(f"when {cond} then {text(sev)}" for sev, cond in hits.items() if cond) + " else 'Clear' end"

    rows = ", ".join(f"named_struct('variant', {text(name)}, 'guardrail_level', {level(rules)})" for name, rules in variants.items())
    return df.selectExpr(*keys, f"inline(array({rows}))")


def _texts(df: DataFrame, any_of) -> dict:
    have = set(df.columns)

    def flag_is(name):
        return any_of(lambda f, fam, sev: f == name)

    def family_is(name):
        return any_of(lambda f, fam, sev: fam == name)

    label = "coalesce(cluster_label, 'the assigned model bucket')" if "cluster_label" in have else "'the assigned model bucket'"
    rank = "coalesce(cast(risk_rank as string), 'None')" if "risk_rank" in have else "'None'"
    caution = text(C.SUMMARY_TEXT["caution"]).replace("{label}", f"', {label}, '").replace("{rank}", f"', {rank}, '")
    t = {k: text(v) for k, v in C.SUMMARY_TEXT.items()}
    summary = (
        f"case when guardrail_flags = '' then {t['none']} "
        f"when {flag_is(C.WORST_BUCKET[0])} then {t['distressed']} "
        f"when {flag_is(C.TOP_BUCKET_HIGH[0])} then {t['top_high']} "
        f"when {flag_is(C.TOP_BUCKET_LEVERAGE[0])} then {t['top_leverage']} "
        f"when {family_is('structural')} then {t['structural']} "
        f"when guardrail_level in ('Caution', 'High caution') then concat({caution}) "
        f"else {t['monitor']} end"
    )
    good = []
    for c, name in C.POSITIVE_NAMES.items():
        if c in have:
            test = f"{c} = 0" if c == "structural_distress_risk" else f"{c} <= 0.25D"
            good.append(f"if(coalesce({test}, false), {text(name)}, null)")
    bad = [f"if({family_is(family)}, {text(name)}, null)" for family, name in C.CONCERN_NAMES.items()]

    def joined(parts, default):
        return f"coalesce(nullif(concat_ws(', ', {', '.join(parts) or 'null'}), ''), {text(default)})"

    i = C.INTERPRETATION_TEXT
    some = (
        text(i["some"])
        .replace("{positives}", f"', {joined(good, i['no_positives'])}, '")
        .replace("{concerns}", f"', {joined(bad, i['no_concerns'])}, '")
    )
    return {
        "guardrail_summary": summary,
        "analyst_interpretation": f"case when guardrail_flags = '' then {text(i['none'])} else concat({some}) end",
        "commercial_conclusion": case_map("guardrail_level", C.CONCLUSION_TEXT),
    }


def guardrail_hits(df: DataFrame, keys, external_rating: str | None = None, rules=None) -> DataFrame:
    """One row per company and triggered flag: the auditable long form."""
    parts = ", ".join(
        f"if({cond}, named_struct('flag', {text(flag)}, 'family', {text(family)}, 'severity', {text(severity)}), null)"
        for flag, family, severity, cond in guardrail_rules(df, rules, external_rating)
    )
    return df.selectExpr(*keys, f"explode(array_compact(array({parts}))) as hit").select(*keys, "hit.*")


def family_rates(df: DataFrame, keys, **options) -> DataFrame:
    """Share of companies hit by each rule family; one pass, families are a fixed list."""
    found = guardrail_rules(df, options.get("rules"), options.get("external_rating"))
    families = list(dict.fromkeys(family for _, family, _, _ in found))
    parts = ", ".join(
        f"named_struct('family', {text(f)}, 'hit', cast(" + " or ".join(c for _, fam, _, c in found if fam == f) + " as int))"
        for f in families
    )
    return (
        df.selectExpr(f"inline(array({parts}))")
        .groupBy("family")
        .agg(F.sum("hit").alias("companies_hit"), F.count("*").alias("companies"))
        .withColumn("hit_rate", F.expr("companies_hit / companies"))
    )
