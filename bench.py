"""Times the headline queries and prints one JSON line.

BENCH_SF_DIR names the tables, BENCH_CPUS the local cores.  Every query runs once on the smallest tables
to warm up, where there are any, and is then timed to a sink that reads all rows.
"""

import json
import os
import sys
import time

sys.path.insert(0, os.path.dirname(os.path.abspath(__file__)))

HEADLINE = [
    "graph_node_kinds", "graph_edge_counts", "matched_rules", "tainted_paths", "neighbourhood_depths",
    "sequential_edges", "latest_definition", "node_index", "indexed_edges", "truncated_graphs", "two_hop_edges",
    "pooled_vectors", "neighbour_mix", "important_nodes", "top_scored_pairs", "nodes_at_positions",
    "recorded_flow_edges", "normalised_taint_records", "tainted_sink_calls", "pr_auc", "auroc", "localisation",
    "batch_ranking_loss", "graph_size_statistics", "rule_coverage", "split_by_position", "balanced_samples",
    "exact_duplicates", "commit_identifiers", "document_type_counts", "masked_texts", "masked_identifiers",
    "payload_findings", "issue_actions", "dashboard", "daily_trend", "project_stats", "scan_page",
]


def main() -> None:
    from codeloom.plans.registry import load_all
    from codeloom.session import local_session

    sf = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    cpus = os.environ.get("BENCH_CPUS", "8")
    spark = local_session(cpus, "bench")
    queries = load_all()
    names = sys.argv[1:] or HEADLINE
    times = {}
    small = os.path.join(os.path.dirname(sf.rstrip("/")), "sf0.001")
    for name in names:
        for tables in ([small] if os.path.isdir(small) else []) + [sf]:
            start = time.time()
            queries[name].plan(spark, tables).write.format("noop").mode("overwrite").save()
            times[name] = round(time.time() - start, 3)
    files = spark.read.parquet(f"{sf}/events.parquet").count()
    rate = round(files / times["graph_edge_counts"]) if "graph_edge_counts" in times else None
    print(
        json.dumps(
            {
                "metric": "headline_queries_total", "value": round(sum(times.values()), 3), "unit": "sec",
                "queries": times, "sf": os.path.basename(sf.rstrip("/")), "source_files_per_sec": rate,
            }
        ),
        flush=True,
    )
    spark.stop()


if __name__ == "__main__":
    main()
