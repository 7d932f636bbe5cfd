"""Benchmark: times every catalogue query and prints one JSON line.

BENCH_SF_DIR names the data folder, BENCH_CPUS the number of local cores,
BENCH_QUERIES (optional) a comma-separated choice of queries. Each query starts
from the raw tables, and every time is the median of BENCH_RUNS runs after one
warm-up. The load job and the queries over the loaded, partitioned tables are
timed as well, under the prefix `lake_`.
"""

from __future__ import annotations

import json
import os
import statistics
import sys
import tempfile
import time
from pathlib import Path

sys.path.insert(0, str(Path(__file__).resolve().parent))

from daytally.operators import loading  # noqa: E402
from daytally.plans import catalogue  # noqa: E402
from daytally.schemas import Layout  # noqa: E402
from daytally.session import local_session  # noqa: E402
from daytally.sources.lake import Lake  # noqa: E402
from daytally.sources.transactions import Transactions  # noqa: E402

# entries that write stored tables, or copy them, while they are built; the load is timed as lake_load
LOADS = {
    "load_and_count", "load_increment_and_count", "load_rejects_counted", "load_delta", "landed_item_days",
    "merged_store_days", "mixed_store_days", "mixed_item_days", "late_lines_store_days", "late_lines_item_days",
}
# entries over the raw tables only, and the facts themselves
NOT_ON_LAKE = LOADS | {"duplicate_line_keys"}


def timed(run, runs: int) -> float:
    run()
    seconds = []
    for _ in range(runs):
        start = time.perf_counter()
        run()
        seconds.append(time.perf_counter() - start)
    return round(statistics.median(seconds), 3)


def consume(df) -> None:
    """Compute every row and column without moving them to the driver."""
    df.write.format("noop").mode("overwrite").save()


def main() -> None:
    folder = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    cpus = os.environ.get("BENCH_CPUS", "8")
    runs = int(os.environ.get("BENCH_RUNS", "1"))
    chosen = os.environ.get("BENCH_QUERIES")
    names = chosen.split(",") if chosen else [n for n in catalogue.ENTRIES if n not in LOADS]
    spark = local_session(cpus, 8, os.environ.get("BENCH_MEMORY", "8g"))
    raw = Transactions(spark, folder)
    seconds = {}
    for name in names:
        seconds[name] = timed(lambda: consume(catalogue.comparable_types(catalogue.ENTRIES[name](raw))), runs)
    if not chosen:
        root = tempfile.mkdtemp(prefix="daytally-bench-")
        layouts = {
            "da_stores_date": Layout("da_stores_date", "year", 1996, 2010),
            "da_items_stores_date": Layout("da_items_stores_date", "month", 1996, 2010),
        }
        start = time.perf_counter()
        loading.load(raw, root, layouts, mode="replace")
        seconds["lake_load"] = round(time.perf_counter() - start, 3)
        lake = Lake(spark, root)
        for name in [n for n in catalogue.ENTRIES if n not in NOT_ON_LAKE]:
            seconds[f"lake_{name}"] = timed(lambda: consume(catalogue.ENTRIES[name](lake)), runs)
    print(
        json.dumps(
            {
                "metric": "total_query_seconds",
                "value": round(sum(seconds.values()), 3),
                "unit": "sec",
                "queries": seconds,
                "sf": Path(folder).name.removeprefix("sf"),
            }
        )
    )
    spark.stop()


if __name__ == "__main__":
    main()
