"""Times the headline queries and prints one JSON line."""

from __future__ import annotations

import json
import os
import statistics
import sys
import time
from pathlib import Path

sys.path.insert(0, str(Path(__file__).resolve().parent))

from tessel.queries import QUERIES
from tessel.session import session

HEADLINE = [f"tpch_q{n:02d}" for n in range(1, 23)] + ["a18_final_merge", "c22_q6_by_masks", "j27_asof_join", "w10_running_sum"]
RUNS = 3


def main() -> None:
    folder = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    cpus = os.environ.get("BENCH_CPUS", "8")
    settings = {"spark.sql.shuffle.partitions": cpus, "spark.ui.enabled": "false", "spark.ui.showConsoleProgress": "false", "spark.driver.memory": "8g"}
    spark = session(f"local[{cpus}]", "bench", **settings)
    spark.sparkContext.setLogLevel("ERROR")

    def once(name: str) -> float:
        began = time.perf_counter()
        QUERIES[name](spark, folder).write.format("noop").mode("overwrite").save()
        return time.perf_counter() - began

    # the first run of each is cold: it plans, compiles and reads; the median of the next ones counts
    cold = {n: round(once(n), 4) for n in HEADLINE}
    hot = {n: round(statistics.median(once(n) for _ in range(RUNS)), 4) for n in HEADLINE}
    print(json.dumps({"metric": "headline_hot_total", "value": round(sum(hot.values()), 4), "unit": "sec", "queries": hot, "cold": cold, "sf": Path(folder).name.removeprefix("sf"), "runs": RUNS, "cpus": cpus}))


if __name__ == "__main__":
    main()
