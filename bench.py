"""Times the headline queries on one machine and prints a single JSON line.

``BENCH_SF_DIR`` names the folder of tables, ``BENCH_CPUS`` the number of threads,
``BENCH_QUERIES`` a comma-separated choice instead of the headline ones ("all" for every one),
``BENCH_RUNS`` how often each is run; the best time counts.
"""

from __future__ import annotations

import json
import os
import time

from fleetlens.catalogue import QUERIES
from fleetlens.session import build_session

HEADLINE = [
    "queue_usage", "queue_tree", "queue_quota", "leaf_queues", "apps_snapshot", "apps_filtered", "app_facets", "apps_page",
    "apps_sorted_page", "apps_by_queue", "latest_app_state", "stream_latest_apps", "fmt_timestamp", "fmt_bytes",
    "datanode_usage", "listing_sorted", "path_parts", "workflow_tasks", "task_app_link", "workflow_drilldown",
    "instances_last_3d", "log_lines", "paged_projects_whole", "audit_verdict_counts", "split_statements",
    "audit_table_refs", "csv_lines", "guarded_append", "sql_inner_join", "sql_group_having", "sql_guarded",
]


def main() -> None:
    folder = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    cpus = os.environ.get("BENCH_CPUS", "8")
    chosen = os.environ.get("BENCH_QUERIES", "")
    names = list(QUERIES) if chosen == "all" else chosen.split(",") if chosen else HEADLINE
    spark = build_session(
        f"local[{cpus}]",
        **{
            "spark.ui.enabled": "false",
            "spark.sql.shuffle.partitions": cpus,
            "spark.driver.memory": "16g",
            "spark.ui.showConsoleProgress": "false",
        },
    )
    spark.sparkContext.setLogLevel("ERROR")
    QUERIES["apps_by_state"](spark, folder).write.format("noop").mode("overwrite").save()
    runs = int(os.environ.get("BENCH_RUNS", "2"))
    took = {}
    for name in names:
        times = []
        for _ in range(runs):
            began = time.perf_counter()
            QUERIES[name](spark, folder).write.format("noop").mode("overwrite").save()
            times.append(time.perf_counter() - began)
        took[name] = round(min(times), 3)
    line = {
        "metric": f"total query time, best of {runs}",
        "value": round(sum(took.values()), 3),
        "unit": "sec",
        "queries": took,
        "sf": os.path.basename(folder.rstrip("/")),
    }
    print(json.dumps(line))
    spark.stop()


if __name__ == "__main__":
    main()
