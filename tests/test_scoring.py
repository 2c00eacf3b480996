"""Worked examples, thresholds and null handling of the score chain."""

import itertools

import pytest
from pyspark.sql import functions as F

from ledgerline import constants as C
from ledgerline.functions import scalars as X
from ledgerline.operators import features as Fe, guardrails as Gu, outlook as Ou, panel as P, reports as Re, scenarios as Sn, scoring as Sc
from ledgerline.plans.oracle import CENTROIDS, RANKS
from ledgerline.sources import model_store as Ms, tables as T

# Published worked example and the second input without a supplied EBITDA.
HEADER = (
    "company_name,fiscal_year,currency,major_sector,financial_flag,revenue,assets,current_assets,cash,receivables,inventory,"
    "equity,current_liabilities,liabilities,long_term_debt,short_term_debt,net_income,cfo,capex,operating_income,"
    "interest_expense,depreciation_amortization,ebitda"
)
ROWS = [
    "EEEC,2025,BGN,Transportation / Utilities,Non-financial,2572207000,2127723000,1024267000,224558000,465950000,42958000,457686000,541002000,1670037000,988887000,14753000,36799000,265267000,212690000,54961000,102302000,119519000,259574000",
    "Manual,2025,USD,Manufacturing / Industrials,Non-financial,48585294.12,29721275.23,10037745.82,34804.65,2208235.29,7794705.88,9082352.94,12722352.94,20638823.53,7910588.24,1478235.29,949411.76,3558235.29,588235.29,1664705.88,597647.06,2713000,",
]
GOLDEN = {
    ("EEEC", "base"): 59.8438, ("EEEC", "revenue_down_15pct"): 63.8499, ("EEEC", "debt_up_25pct"): 67.1684,
    ("EEEC", "cash_burn_case"): 78.6781, ("EEEC", "near_default_stress"): 75.9542,
    ("Manual", "base"): 47.7030, ("Manual", "revenue_down_15pct"): 54.6641, ("Manual", "debt_up_25pct"): 52.6525,
    ("Manual", "cash_burn_case"): 73.9318, ("Manual", "near_default_stress"): 78.7433,
}


def fixed_model():
    return Sc.Model(
        segment=C.TARGET_SEGMENT, features=list(C.DOMAINS), centroids=CENTROIDS, medians=dict.fromkeys(C.DOMAINS, 0.4),
        labels={c: C.RANK_LABELS[r] for c, r in RANKS.items()}, ranks=dict(RANKS))


@pytest.fixture(scope="module")
def companies(spark, tmp_path_factory):
    path = tmp_path_factory.mktemp("input") / "companies.csv"
    path.write_text("\n".join([HEADER, *ROWS]) + "\n")
    return T.read_company_input(spark, str(path))


def test_worked_examples_and_scenarios(companies):
    scored = Sn.score_scenarios(companies, fixed_model(), external_rating="Ba2 / BB")
    rows = {(r["company_name"], r["scenario"]): r for r in scored.collect()}
    assert len(rows) == 10
    for key, score in GOLDEN.items():
        assert rows[key]["scorecard_credit_score"] == pytest.approx(score, abs=1e-4)
    base = rows["EEEC", "base"]
    assert [round(base[d], 4) for d in C.DOMAINS] == [0.6998, 0.5514, 0.44, 0.3507, 0.6257, 0.805]
    assert base["liabilities_to_assets"] == pytest.approx(0.785, abs=1e-3)
    assert base["warning_flags"] == "interest_coverage_below_1"
    assert base["guardrail_level"] == "High caution"
    assert base["guardrail_flags"].endswith("external_rating_speculative_grade")
    affinity = sum(base[f"cluster_{i}_affinity"] for i in range(5))
    assert affinity == pytest.approx(1.0)
    assert base["near_default_affinity"] <= base["cluster_affinity"]
    assert rows["Manual", "base"]["ebitda"] == pytest.approx(1664705.88 + 2713000)


def test_scenario_keeps_old_value_where_the_change_is_unknown(spark):
    df = spark.createDataFrame([("a", None, 5.0, 7.0, None)], "company_name string, assets double, liabilities double, cash double, interest_expense double")
    rows = {r["scenario"]: r for r in Sn.make_scenarios(df).collect()}
    assert rows["near_default_stress"]["liabilities"] == 5.0
    assert rows["near_default_stress"]["interest_expense"] is None
    assert rows["cash_burn_case"]["cash"] == 3.5
    assert "operating_income" not in rows["base"].asDict()


def test_every_subset_of_missing_components(spark):
    """A domain is missing only when all its components are, and equals the plain sum when none is."""
    for domain, weights in C.DOMAIN_COMPONENTS.items():
        names = list(weights)
        rows = [tuple(v if keep else None for v, keep in zip((0.2, 0.5, 0.9, 1.0), mask)) for mask in itertools.product([0, 1], repeat=len(names))]
        df = spark.createDataFrame(rows, ", ".join(f"{n} double" for n in names))
        out = df.selectExpr("*", f"{X.weighted_mean(weights)} as mean", f"{X.weighted_sum(weights)} as plain").collect()
        for r in out:
            have = [n for n in names if r[n] is not None]
            if not have:
                assert r["mean"] is None
            else:
                want = sum(r[n] * weights[n] for n in have) / sum(weights[n] for n in have)
                assert r["mean"] == pytest.approx(want)
            if len(have) == len(names):
                assert r["plain"] == pytest.approx(r["mean"])
            else:
                assert r["plain"] is None


def test_thresholds_and_missing_values(spark):
    values = [None, float("nan"), -1.0, 0.0, 999.0, 1000.0, 5e6, 5e7, 1e11, 1e11 + 1]
    df = spark.createDataFrame([(v,) for v in values], "assets double").selectExpr("assets", "1000D as liabilities")
    rows = Fe.engineer(df).orderBy(F.col("assets").asc_nulls_first()).collect()
    by = {r["assets"]: r for r in rows if r["assets"] is not None}
    assert len([r for r in rows if r["assets"] is None]) == 2, "NaN counts as missing"
    assert by[999.0]["liabilities_to_assets"] is None and by[1000.0]["liabilities_to_assets"] == 1.0
    assert (by[5e6]["small_company_flag"], by[5e6]["mid_company_flag"], by[5e6]["asset_size_band"]) == (0, 1, "small")
    assert by[5e7]["asset_size_band"] == "mid" and by[5e7]["large_company_flag"] == 1
    assert by[1e11]["asset_size_band"] == "large" and by[1e11 + 1]["asset_size_band"] == "mega"
    assert by[0.0]["asset_size_band"] is None and by[-1.0]["log_assets"] == 0.0
    for name, (source, direction, start, end) in C.COMPONENT_RULES.items():
        build = X.risk_when_high if direction == "high" else X.risk_when_low
        probe = spark.createDataFrame([(start,), (end,), ((start + end) / 2,), (None,)], "v double")
        got = [r[0] for r in probe.selectExpr(build("v", start, end)).collect()]
        assert got[0] == 0.0 and got[1] == 1.0 and got[2] == pytest.approx(0.5) and got[3] is None


def test_text_amounts_and_financial_mask(spark):
    df = spark.createDataFrame(
        [("12000", "x", "Financial"), ("12000", "9000", "TRUE"), ("12000", "9000", "Non-financial"), ("12000", "9000", None)],
        "assets string, ebitda string, financial_flag string")
    got = [r["ebitda"] for r in Fe.engineer(df).select("ebitda").collect()]
    assert got == [None, None, 9000.0, 9000.0]


def test_current_names_whole_column_and_row(spark):
    df = spark.createDataFrame([(1, None, 5.0), (2, 4.0, 6.0)], "i int, assets_current double, current_assets double")
    whole = {r["i"]: r["assets_current"] for r in Fe.standardize_names(df).collect()}
    row = {r["i"]: r["assets_current"] for r in Fe.standardize_names(df, "row").collect()}
    assert whole == {1: None, 2: 4.0} and row == {1: 5.0, 2: 4.0}


def test_sic_ranges(spark):
    cases = {"": "Unknown", "n/a": "Unknown", "99": "Other", "100": "Agriculture", "1799": "Construction", "1800": "Other",
             "5999.0": "Wholesale / Retail", "6000": C.FINANCE_SECTOR, "6799": C.FINANCE_SECTOR, "6800": "Other",
             "9729": "Public Administration", "9730": "Other", None: "Unknown"}
    df = spark.createDataFrame([(k,) for k in cases], "sic string")
    got = {r["sic"]: (r["s"], r["f"]) for r in df.selectExpr("sic", f"{P.sic_division()} as s", f"{P.financial_flag()} as f").collect()}
    assert {k: v[0] for k, v in got.items()} == cases
    assert got["6799"][1] == "Financial" and got["6800"][1] == "Non-financial" and got[None][1] == "Unknown"


def test_rating_words(spark):
    cases = {"Ba2 / BB": True, "BBB-": False, "B+": True, "stable": False, "": False, None: False, "Debt BBB": True, "CCC": True, "AA": False}
    df = spark.createDataFrame([(k,) for k in cases], "t string")
    got = {r["t"]: r["s"] for r in df.selectExpr("t", f"{Gu.speculative_rating('t')} as s").collect()}
    assert got == cases


def test_outlook_branches(spark):
    cases = [
        (1, 0.2, None, 0.25, "Negative"), (1, 0.2, None, 0.5, "Neutral"), (5, 0.2, 0.25, None, "Positive"),
        (5, 0.2, 0.5, None, "Neutral"), (3, 0.2, 0.22, 0.4, "Positive"), (3, 0.2, 0.4, 0.22, "Negative"),
        (3, 0.2, 0.4, 0.41, "Neutral"), (3, None, 0.1, 0.1, "Neutral"), (3, 0.2, None, None, "Neutral"), (None, 0.2, 0.1, 0.1, None),
    ]
    df = spark.createDataFrame(cases, "risk_rank int, distance_to_assigned_cluster double, distance_to_upper_bucket double, distance_to_lower_bucket double, want string")
    for r in Ou.outlook(df).collect():
        assert r["outlook_flag"] == r["want"], r


def test_guardrails_clear_and_contradiction(spark):
    df = spark.createDataFrame(
        [(1, "L1", 0.1, 3.0, 0.1), (1, "L1", 0.65, 3.0, 0.5), (5, "L5", 0.1, 3.0, 0.5), (2, "L2", 0.1, 0.9, None)],
        "risk_rank int, cluster_label string, debt_to_assets double, current_ratio double, liquidity_risk double")
    rows = Gu.apply_guardrails(df).collect()
    assert rows[0]["guardrail_level"] == "Clear" and rows[0]["guardrail_flags"] == ""
    assert rows[1]["guardrail_flags"].split(", ")[-2:] == ["top_bucket_with_leverage_caveat", "top_bucket_with_high_caution_caveat"]
    assert rows[2]["guardrail_level"] == "Override required"
    assert rows[3]["guardrail_summary"].startswith("The company is assigned to L2 with risk rank 2")
    assert "selected financial strengths" in rows[3]["analyst_interpretation"]
    with pytest.raises(ValueError):
        X.rule_holds("a", "!=", 1)


def test_model_store_round_trip(spark, tmp_path, companies):
    model = fixed_model()
    model.caps = {"interest_coverage": (-5.0, None)}
    folder = Ms.save(spark, {model.segment: model}, str(tmp_path / "model"))
    loaded = Sc.resolve_model(Ms.load(spark, folder), C.TARGET_SEGMENT)
    assert (loaded.centroids, loaded.medians, loaded.labels, loaded.ranks, loaded.caps) == (
        model.centroids, model.medians, model.labels, model.ranks, model.caps)
    assert Ms.summary(spark, folder).first()["near_default_cluster"] == 2
    with pytest.raises(KeyError):
        Sc.resolve_model({"a": model}, "b")
    model.centroids = [[0.1]]
    with pytest.raises(ValueError):
        Ms.validate(model)


def test_load_table_names_missing_columns(spark, tmp_path):
    spark.range(3).write.parquet(str(tmp_path / "t"))
    with pytest.raises(ValueError, match="ticker"):
        T.load_table(spark, str(tmp_path / "t"), ["id", "ticker"], "panel")


def test_report_tables(companies):
    model = fixed_model()
    scored = Gu.apply_guardrails(Ou.with_outlook(Sc.score_companies(companies, model), model))
    assert Re.score_summary(scored).columns == [c for c in C.SUMMARY_COLUMNS]
    file = Re.scored_file(scored).columns
    assert len(file) == len(set(file))
    assert Re.dimension_table(scored, ["company_name"]).count() == 12
    table = Re.guardrails_table(scored, Sn.score_scenarios(companies, model))
    assert table.count() == 12 and table.columns[:2] == ["scope", "scenario"]


def test_scoring_chain_is_generated_in_parts_the_jvm_compiles(spark):
    model = Sc.Model(segment=C.TARGET_SEGMENT, features=list(C.DOMAINS), centroids=CENTROIDS, medians=dict.fromkeys(C.DOMAINS, 0.3),
                     labels={c: C.RANK_LABELS[k] for c, k in RANKS.items()}, ranks=dict(RANKS))
    rows = spark.createDataFrame([("C1", 2024, 3711)], "ticker string, fiscal_year int, sic int").selectExpr(
        "*", *[f"cast({i + 1} * 1e6 as double) as {c}" for i, c in enumerate(C.CONCEPTS)])
    out = Sn.score_scenarios(P.complete_panel(rows), model).select("ticker", "fiscal_year", *C.SCENARIO_SUMMARY_COLUMNS)
    parts = out._jdf.queryExecution().debug().codegenToSeq()
    sizes = [parts.apply(i)._3().maxMethodCodeSize() for i in range(parts.size())]
    assert sizes and max(sizes) < 8000, sizes
    assert {r["scenario"] for r in out.collect()} == set(C.SCENARIOS)
