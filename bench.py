"""Headline queries, each from the raw tables; prints one JSON line."""

import json
import os
import sys
import time

sys.path.insert(0, os.path.dirname(os.path.abspath(__file__)))

HEADLINES = [
    "issuer_year_facts", "issuer_year_pivot", "engineer_credit_features", "sector_year_scores", "cluster_profile",
    "representatives", "score_companies", "apply_guardrails", "scenario_rescoring", "compare_to_cluster_profile",
    "threshold_sensitivity", "silhouette_squared", "silhouette", "kmeans_fit", "ward_hierarchy", "dbscan_grid",
]


def main() -> None:
    from ledgerline.plans import catalog
    from ledgerline.plans.registry import Data
    from ledgerline.session import build_session

    folder = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    cpus = os.environ.get("BENCH_CPUS", "8")
    spark = build_session(
        f"local[{cpus}]", "ledgerline-bench",
        **{"spark.sql.shuffle.partitions": cpus, "spark.driver.memory": "16g", "spark.ui.enabled": "false",
           "spark.ui.showConsoleProgress": "false"})
    spark.sparkContext.setLogLevel("ERROR")
    queries = catalog.queries()
    wanted = os.environ.get("BENCH_QUERIES", "").split(",") if os.environ.get("BENCH_QUERIES") else HEADLINES
    queries["facts_summary"](spark, folder).collect()  # JVM warm-up
    times = {}
    for name in wanted:
        # No stored panel of an earlier query is reused: every time starts at the raw tables.
        Data.forget(spark)
        start = time.time()
        queries[name](spark, folder).write.format("noop").mode("overwrite").save()
        times[name] = round(time.time() - start, 3)
        print(f"{name}: {times[name]} s", file=sys.stderr)
    print(json.dumps({
        "metric": "total_wall_time", "value": round(sum(times.values()), 3), "unit": "sec", "queries": times,
        "sf": os.path.basename(folder.rstrip("/")).removeprefix("sf"),
    }))
    spark.stop()


if __name__ == "__main__":
    main()
