"""Times the headline queries on one machine and prints one JSON line.

BENCH_SF_DIR names the tables (default /root/testdata/sf0.1), BENCH_CPUS the cores.
"""

import json
import os
import re
import sys
import time

sys.path.insert(0, os.path.dirname(os.path.abspath(__file__)))

HEADLINE = [
    "chunk_counts_by_language", "w1_token_windows", "a1_chunk_summary", "j6_vector_topk", "k2_rerank", "a2_hit_rates",
    "a7_grade_summary", "a25_multiset_coverage", "w2_fill_gaps", "w3_resolve_overlaps", "w4_merge_close_segments",
    "w6_merge_same_role", "w25_frames_from_turns", "w26_rechunk_words", "w5_label_runs", "w7_forecast_labels",
    "w11_greedy_cooldown", "a14_forecast_metrics", "a15_endpoint_metrics", "j12_window_hits", "a9_latency_distribution",
    "a11_stage_latencies", "a30_phase_timestamps", "j7_nearest_in_time", "j8_asof_backward", "j9_fifo_match",
    "u7_build_edges", "j4_fuzzy_link", "j15_negative_sample", "k3_quota_sample", "s13_extract_links", "s14_extract_sections",
    "t1_pause_ema_batch", "t3_speculation_batch", "t8_turn_sessions", "t1_pause_ema", "t3_speculation_lifecycle", "t5_rechunk_stream",
]


def main() -> None:
    path = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1").rstrip("/")
    cpus = int(os.environ.get("BENCH_CPUS", os.cpu_count() or 8))
    from convlake import workloads
    from convlake.session import local_session

    spark = local_session(cpus, partitions=cpus, app="bench")
    names = sys.argv[1:] or HEADLINE
    # one query warms up the session (class loading, Python workers)
    workloads.QUERIES["p12_cap_samples"](spark, path).write.format("noop").mode("overwrite").save()
    times = {}
    for name in names:
        start = time.perf_counter()
        workloads.QUERIES[name](spark, path).write.format("noop").mode("overwrite").save()
        times[name] = round(time.perf_counter() - start, 3)
        print(name, times[name], file=sys.stderr, flush=True)
    sf = re.search(r"sf([\d.]+)$", path)
    print(json.dumps({"metric": "headline_total", "value": round(sum(times.values()), 3), "unit": "sec", "queries": times, "sf": float(sf.group(1)) if sf else None}))
    spark.stop()


if __name__ == "__main__":
    main()
