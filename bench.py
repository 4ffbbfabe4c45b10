"""Times the headline queries at $BENCH_SF_DIR on local[$BENCH_CPUS] and prints one line of JSON."""

from __future__ import annotations

import json
import os
import time

from tallyspark import queries
from tallyspark.session import session

HEADLINE = ("performance_summary", "asof_join_time", "last_by_key", "rolling_performance", "round_trips", "journal_by_symbol", "group_sum_mean_count", "flow_adjusted_returns", "relative_metrics", "pivot_metrics",
    "natural_join_dedupe_right", "first_by_dedupe", "derive_funcs", "quote_snapshot", "connection_health")


def main() -> None:
    folder = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    cpus = os.environ.get("BENCH_CPUS", "8")
    spark = session("bench", **{"spark.master": f"local[{cpus}]", "spark.sql.shuffle.partitions": cpus, "spark.driver.memory": "8g", "spark.ui.enabled": "false", "spark.ui.showConsoleProgress": "false"})
    spark.sparkContext.setLogLevel("ERROR")
    queries.QUERIES["group_last"](spark, folder).write.format("noop").mode("overwrite").save()  # code is loaded, the disk cache is warm
    taken = {}
    for name in HEADLINE:
        best = float("inf")
        for _ in range(2):
            began = time.perf_counter()
            queries.QUERIES[name](spark, folder).write.format("noop").mode("overwrite").save()
            best = min(best, time.perf_counter() - began)
        taken[name] = round(best, 3)
    print(json.dumps({"metric": "headline_queries_total", "value": round(sum(taken.values()), 3), "unit": "sec", "queries": taken, "sf": os.path.basename(folder.rstrip("/")).removeprefix("sf")}))
    spark.stop()


if __name__ == "__main__":
    main()
