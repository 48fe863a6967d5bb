"""Times every query on local cores and prints one JSON line.

Each query runs once unmeasured and then ``BENCH_RUNS`` times (default 1); the smallest time
counts. The sink takes every row and column of the result.
"""

from __future__ import annotations

import json
import os
import sys
import time
from pathlib import Path

sys.path.insert(0, str(Path(__file__).resolve().parent))


def main() -> None:
    from verdigris.plans.queries import QUERIES
    from verdigris.session import local_session

    sf_dir = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    cores = os.environ.get("BENCH_CPUS", "8")
    runs = int(os.environ.get("BENCH_RUNS", "1"))
    wanted = [q for q in os.environ.get("BENCH_QUERIES", "").split(",") if q]
    spark = local_session(cores, memory="16g", partitions=int(cores) if cores.isdigit() else 8)
    times: dict[str, float] = {}
    for name, job in QUERIES.items():
        if wanted and name not in wanted:
            continue
        measured = []
        for attempt in range(runs + 1):
            start = time.perf_counter()
            job(spark, sf_dir).write.format("noop").mode("overwrite").save()
            measured.append(time.perf_counter() - start)
        times[name] = round(min(measured[1:]), 3)
        print(f"{name} first {measured[0]:.2f} then {times[name]:.2f}", file=sys.stderr)
    print(
        json.dumps(
            {
                "metric": "total_query_time",
                "value": round(sum(times.values()), 3),
                "unit": "sec",
                "queries": times,
                "sf": Path(sf_dir).name.removeprefix("sf"),
                "cpus": cores,
            }
        )
    )


if __name__ == "__main__":
    main()
