"""Time the headline queries, each as the least of ``RUNS`` runs. Prints one JSON line.

BENCH_SF_DIR (default /root/testdata/sf0.1) and BENCH_CPUS (default 8) set data and cores.
"""

from __future__ import annotations

import json
import os
import sys
import time
from pathlib import Path

sys.path.insert(0, str(Path(__file__).resolve().parent))

from pitlab.registry import all_queries  # noqa: E402
from pitlab.session import build_session  # noqa: E402
from pitlab.standins.frames import Standins  # noqa: E402

RUNS = 2

HEADLINE = (
    "daily_bars",
    "deduplicated_bars",
    "bar_quality",
    "import_summary",
    "momentum_features",
    "momentum_signals",
    "momentum_ranks",
    "rebalance_diagnostics",
    "universe_as_of",
    "universe_changes",
    "asof_join",
    "resolved_bars",
    "identity_clip",
    "pit_coverage",
    "order_deltas",
    "affordable_orders",
    "ledger",
    "period_returns",
    "universe_audit",
    "occupancy_map",
    "series_cover",
    "quality_gates",
    "latest_signals",
    "performance_metrics",
)


def main() -> None:
    folder = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1").rstrip("/")
    cores = os.environ.get("BENCH_CPUS", "8")
    spark = build_session(cores, shuffle_partitions=int(cores) if cores.isdigit() else 8, app="pitlab-bench")
    registered = all_queries()
    names = sys.argv[1:] or HEADLINE
    spark.read.parquet(f"{folder}/region.parquet").count()
    times: dict[str, float] = {}
    # The derived research tables are written once an application; their cost is a line of its own.
    started = time.perf_counter()
    tables = Standins(spark, folder)
    for table in (tables.bars, tables.calendar, tables.rebalances, tables.memberships, tables.orders, tables.fund_trades):
        table.count()
    times["tables"] = round(time.perf_counter() - started, 3)
    for name in names:
        # The least of several runs, as the spread between runs is as large as most changes.
        runs = []
        for _ in range(RUNS):
            started = time.perf_counter()
            # The noop sink runs the whole plan and keeps every column.
            registered[name].build(Standins(spark, folder)).write.format("noop").mode("overwrite").save()
            runs.append(time.perf_counter() - started)
        times[name] = round(min(runs), 3)
        print(f"{name}: {times[name]}", file=sys.stderr, flush=True)
    total = round(sum(times.values()), 3)
    print(json.dumps({"metric": "headline_queries_total", "value": total, "unit": "sec", "queries": times, "sf": Path(folder).name.removeprefix("sf")}))
    spark.stop()


if __name__ == "__main__":
    main()
