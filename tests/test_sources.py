"""Files by column name, safe resume, shared folders, model store and the manifest stream."""

import os
import random
import shutil

import pytest
from pyspark.sql import functions as F

from ledgerline import session as Se
from ledgerline.operators.scoring import Model
from ledgerline.sources import model_store as Ms, tables as T
from ledgerline.streaming import jobs as J

FACT = ("A", "1", "A Inc", "3711", "Assets", "assets", 5.5, 2024, "FY", "2024-12-31")
NAMES = [c.split()[0] for c in T.FACT_SCHEMA.split(", ")]


def csv(folder, columns, rows):
    os.makedirs(folder)
    with open(f"{folder}/a.csv", "w") as file:
        file.write("\n".join([",".join(columns), *[",".join(str(v) for v in r) for r in rows]]) + "\n")
    return str(folder)


def test_csv_columns_are_taken_by_name(spark, tmp_path):
    turned = csv(tmp_path / "turned", NAMES[::-1], [FACT[::-1], (*FACT[::-1][:3], "not a number", *FACT[::-1][4:])])
    rows = T.read_csv(spark, turned, T.FACT_SCHEMA).collect()
    assert [r["numeric_value"] for r in rows] == [5.5, None] and rows[0]["ticker"] == "A" and str(rows[0]["filing_date"]) == "2024-12-31"
    short = csv(tmp_path / "short", NAMES[1:], [FACT[1:]])
    with pytest.raises(ValueError, match="ticker"):
        T.read_csv(spark, short, T.FACT_SCHEMA)
    company = [f.name for f in T.COMPANY_SCHEMA if f.name != "ebitda"]
    got = T.read_company_input(spark, csv(tmp_path / "company", company[::-1], [[1] * len(company)])).first()
    assert got["ebitda"] is None and got["company_name"] == "1" and got["revenue"] == 1.0


def test_resume_appends_once_and_does_not_hide_a_failing_read(spark, tmp_path):
    facts = spark.createDataFrame([FACT[:9], ("B", *FACT[1:9])], ", ".join(T.FACT_SCHEMA.split(", ")[:9]))
    out = str(tmp_path / "store")
    assert T.ingest_remaining(spark, facts.filter("ticker = 'A'"), out).count() == 1
    assert T.ingest_remaining(spark, facts, out).count() == 2 and T.ingest_remaining(spark, facts, out).count() == 2
    broken = tmp_path / "broken"
    os.makedirs(broken)
    (broken / "part-0.parquet").write_bytes(b"not parquet")
    with pytest.raises(Exception):
        T.ingest_remaining(spark, facts, str(broken))
    assert os.listdir(broken) == ["part-0.parquet"]


def test_footprint_counts_files_and_bytes(spark, tmp_path):
    out = f"{tmp_path}/table"
    spark.range(1000).selectExpr("id", "id % 3 as part").repartition(3, "part").write.partitionBy("part").parquet(out)
    sizes = [os.path.getsize(f"{folder}/{f}") for folder, _, names in os.walk(out) for f in names if f.endswith(".parquet")]
    got = T.footprint(spark, out).first()
    assert (got["files"], got["bytes"]) == (3, sum(sizes)) and len(sizes) == 3 and got["gigabytes"] == pytest.approx(sum(sizes) / 1e9)


def test_dropped_folders_are_deleted(spark, monkeypatch):
    monkeypatch.setattr(Se, "_made", {})
    path = Se.stored(spark.range(3)).inputFiles()[0]
    assert os.path.exists(path.removeprefix("file:").removeprefix("//"))
    assert Se.drop_folders(spark) == 1 and not os.path.exists(path.removeprefix("file:").removeprefix("//"))


def test_a_cluster_without_a_shared_folder_is_an_error():
    class Context:
        master = "spark://somewhere:7077"

        def getCheckpointDir(self):
            return None

    class Session:
        sparkContext = Context()
        conf = type("Conf", (), {"get": staticmethod(lambda key, default: default)})

    with pytest.raises(ValueError, match="checkpoint"):
        Se.checkpoint_folder(Session())


def test_model_store_keeps_profile_sizes_and_metrics(spark, tmp_path):
    profile = spark.createDataFrame([("Non-financial", 0, 2), ("Non-financial", 1, 1)], "financial_flag string, cluster int, rating_style_rank int")
    model = Model("Non-financial", ["a"], [[0.1], [0.9]], {"a": 0.5}, {}, {}, profile=profile, meta={
        "status": "clustered", "rows": 7, "inertia": 1.5, "silhouette_squared": 0.4, "calinski_harabasz": 3.0, "davies_bouldin": 1.0, "sizes": {0: 3, 1: 4}})
    loaded = Ms.load(spark, Ms.save(spark, {"Non-financial": model}, str(tmp_path / "m")))["Non-financial"]
    assert loaded.meta == model.meta and loaded.profile.count() == 2
    assert loaded.ranks == {} and loaded.near_default == 0  # from the stored profile


def test_a_stopped_load_loses_nothing(spark, tmp_path):
    """Stopped after one of its years was written: its rows do not show, and the same load makes up for it."""
    facts = spark.createDataFrame([(t, *FACT[1:7], y, "FY") for t in "ABCD" for y in (2001, 2002, 2003)], ", ".join(T.FACT_SCHEMA.split(", ")[:9]))
    out, old, new = str(tmp_path / "store"), facts.filter("ticker = 'A'"), facts.filter("ticker <> 'A'")
    T.ingest_remaining(spark, old, out)
    T.ingest_remaining(spark, new, out)
    (batch,) = [f for f in os.listdir(out) if f.startswith("batch_id=") and T.batch_name(new) in f]
    for year in (2002, 2003):  # what a driver that died leaves: one year of the load, and no name in the list
        shutil.rmtree(f"{out}/{batch}/fiscal_year={year}")
    spark.createDataFrame([(T.batch_name(old),)], "batch_id string").coalesce(1).write.mode("overwrite").parquet(f"{out}/_batches")
    assert {r.ticker for r in T.stored_facts(spark, out).collect()} == {"A"}
    for _ in range(2):
        rows = T.ingest_remaining(spark, new, out).collect()
        assert sorted((r.ticker, r.fiscal_year) for r in rows) == [(t, y) for t in "ABCD" for y in (2001, 2002, 2003)]


def test_manifest_rewrites_touched_buckets_only(spark, tmp_path):
    names = "ticker string, cik string, company_name string, sic string, min_fiscal_year int, max_fiscal_year int, row_count long"
    out, r, want = f"{tmp_path}/out", random.Random(4), {}
    files = lambda: sorted(f for _, _, names in os.walk(out) for f in names if f.endswith(".parquet"))
    most = []
    for n in range(20):
        rows = [(f"T{i}", str(i), None, None, 2000, 2000 + n, n + 1) for i in r.sample(range(30), 6)]
        for _ in range(1 + n % 2):  # every second batch is replayed
            J.merge_manifest(spark.createDataFrame(rows, names), n, out, buckets=4)
        want |= {x[0]: x for x in rows}
        most.append(len(files()))
        if n == 10:
            before = files()
            J.merge_manifest(spark.createDataFrame(rows[:0], names), n + 100, out, buckets=4)
            assert files() == before
    assert {tuple(x) for x in J.latest_manifest(spark, out).collect()} == set(want.values()) and max(most) <= 8


def test_aliases_of_a_stream_row_are_decided_by_row(spark):
    """A batch fills an alias only where the whole column is missing; a stream cannot know that and decides by row."""
    from ledgerline.operators import features as Fe

    df = spark.createDataFrame([(1.0, None, 5.0), (2.0, 3.0, 6.0)], "assets double, assets_current double, current_assets double")
    batch = Fe.standardize_names(df).select(F.col("assets_current")).collect()
    row = Fe.standardize_names(df, mode="row").select(F.col("assets_current")).collect()
    assert [r[0] for r in batch] == [None, 3.0] and [r[0] for r in row] == [5.0, 3.0]


def test_lines_are_dealt_to_bounded_tasks(spark, monkeypatch):
    from ledgerline.sources import filings as S

    folder = "/root/testdata/sf0.001"
    whole = sorted(map(str, S.statements(spark, folder).collect()))
    least = int(spark.conf.get("spark.sql.shuffle.partitions"))
    slots = spark.sparkContext.defaultParallelism
    assert S.tasks_for(spark, S.TASK_LINES * slots) is None
    assert S.tasks_for(spark, 216_000_000) == max(least, S.FEW) and S.tasks_for(spark, 900_000_000) == max(least, 600)
    monkeypatch.setattr(S, "TASK_LINES", 20)
    monkeypatch.setattr(S, "MOST_LINES", 20)
    lines = spark.read.parquet(f"{folder}/lineitem.parquet").count()
    tasks = -(-lines // 20)
    assert S.tasks_for(spark, lines) == tasks > least
    dealt = S.statements(spark, folder)
    assert sorted(map(str, dealt.collect())) == whole
    plan = dealt._jdf.queryExecution().executedPlan().toString()
    assert f"{tasks}), REPARTITION_BY_NUM" in plan  # lines are neither merged nor gathered in fewer tasks


@pytest.mark.parametrize("slots", [64, 1 << 24])
def test_rows_by_keys_equal_the_plain_join(spark, monkeypatch, slots):
    """Null and repeated keys on both sides; with few slots most rows are settled by the join, with many by the slots."""
    monkeypatch.setattr(T, "SLOTS", slots)
    df = spark.createDataFrame([(None if i % 9 == 0 else f"C{i % 200}", i) for i in range(1000)], "ticker string, v int")
    keys = spark.createDataFrame([(None if i == 0 else f"C{i % 120}",) for i in range(300)], "ticker string")
    for how in ("left_semi", "left_anti"):
        got = sorted((r.ticker or "", r.v) for r in T.rows_by_keys(df, keys, "ticker", how).collect())
        want = sorted((r.ticker or "", r.v) for r in df.join(keys, "ticker", how).collect())
        assert got == want and want
    only = T.rows_by_keys(df, keys.limit(0), "ticker", "left_anti")
    assert only.count() == 1000 and T.rows_by_keys(df.limit(0), keys, "ticker", "left_semi").count() == 0
