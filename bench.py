"""Time headline queries: warm, median of the repeats, results written to the no-op sink.

Prints one JSON line. BENCH_SF_DIR, BENCH_CPUS and BENCH_REPEATS set data, cores and repeats.
"""

from __future__ import annotations

import json
import os
import statistics
import sys
import time

HEADLINE = (
    "panel_minimum_slice", "pit1_as_of", "pit2_asof_join", "pit3_asof_strict", "pit12_entry_exit", "pit14_issue_table",
    "ag2_nested_mean", "ag4_strict_nested_mean", "ag9_window_measures", "ag20_release_features",
    "wn1_rolling_days", "wn3_rolling_longest_run", "wn5_prior_year_z", "wn17_deseasonalise", "wn21_curve", "wn22_within_contract",
    "src1_nested_series", "src4_month_slots", "src8_report", "src10_message_index", "src12_coalesce_ranges", "src13_extract_links",
    "ver2_rowset_fingerprint", "ver5_latest", "ver7_archive_status", "fn1_fold", "fn15_busdays",
    "jn1_checked_join", "jn3_point_in_polygon", "jn8_select_contract", "ev2_decluster", "ev4_event_windows", "ev7_placebo",
    "tk1_top_n", "tk3_no_overlap", "tk5_size_pairs", "st4_ols", "st5_horse_race", "wf5_fit_ridge", "wf13_expanding_predictions",
    "wf18_fold_residuals", "tr1_execution_outcomes", "val1_strategy_metrics", "un1_block_bootstrap", "un4_circular_null", "au1_audit_panel",
)


def main() -> None:
    sys.path.insert(0, os.path.dirname(os.path.abspath(__file__)))
    from tidemark.plans import load
    from tidemark.session import local_session

    sf_dir = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    cpus = os.environ.get("BENCH_CPUS", "8")
    repeats = int(os.environ.get("BENCH_REPEATS", "1"))
    names = sys.argv[1:] or HEADLINE
    spark = local_session(cpus, "tidemark-bench")
    spark.sparkContext.setLogLevel("ERROR")
    registry = load()

    def once(name: str) -> float:
        t0 = time.perf_counter()
        registry[name].run(spark, sf_dir).write.format("noop").mode("overwrite").save()
        return time.perf_counter() - t0

    once("fn15_busdays")  # start the JVM's code paths before timing
    times = {}
    for name in names:
        once(name)
        times[name] = round(statistics.median(once(name) for _ in range(repeats)), 3)
    sf = os.path.basename(sf_dir.rstrip("/")).replace("sf", "")
    print(json.dumps({"metric": "headline_total", "value": round(sum(times.values()), 3), "unit": "sec", "queries": times, "sf": float(sf)}))
    spark.stop()


if __name__ == "__main__":
    main()
