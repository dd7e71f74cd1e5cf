"""Headline queries on the given tables; prints one JSON line."""

from __future__ import annotations

import json
import os
import sys
import time

sys.path.insert(0, os.path.dirname(os.path.abspath(__file__)))

from timberline.plans import registry, reports, views  # noqa: E402
from timberline.session import local_session  # noqa: E402
from timberline.streaming import monitor  # noqa: E402

HEADLINE = [
    "analyse", "analyse_lines", "merge_multiline", "parse_entries", "mine_templates", "rule_engine", "zscore_outliers",
    "evaluate_anomalies", "evaluate_anomalies_forest", "severity_scores", "explanations", "timeline",
    "detect_patterns", "root_causes", "enriched_root_causes", "relationship_groups", "incidents", "search_logs",
    "summary_metrics", "category_heatmap", "request_metrics", "cluster_logs", "component_stats", "chunk_logs",
    "alert_cooldown",
]


def main() -> None:
    sf_dir = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    cores = os.environ.get("BENCH_CPUS", "8")
    spark = local_session(cores, int(cores) if cores.isdigit() else 8)
    only = sys.argv[1].split(",") if len(sys.argv) > 1 else HEADLINE
    # the rendered log tables are test data; they are written before the clock starts
    n_lines = views.log_lines(spark, sf_dir).count()
    views.entries(spark, sf_dir).count()
    views.doc_lines(spark, sf_dir).count()
    reports.reports(spark, sf_dir).count()
    # the whole chain from lines to explained reports, with the forest
    runs_on = registry.QUERIES | {"analyse": lambda s, d: monitor.analyse(views.log_lines(s, d), deep=False)}
    took = {}
    for name in only:
        runs = []
        for _ in range(2):
            start = time.time()
            runs_on[name](spark, sf_dir).write.format("noop").mode("overwrite").save()
            runs.append(time.time() - start)
        took[name] = round(min(runs), 3)
        print(name, [round(r, 2) for r in runs], file=sys.stderr, flush=True)
    out = {
        "metric": "headline_queries_total", "value": round(sum(took.values()), 3), "unit": "sec",
        "queries": took, "sf": sf_dir.rstrip("/").rsplit("/", 1)[-1], "log_lines": n_lines,
    }
    if "analyse" in took:
        out["lines_per_sec_end_to_end"] = round(n_lines / took["analyse"])
    print(json.dumps(out))


if __name__ == "__main__":
    main()
