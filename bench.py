"""Headline queries at one scale: prints one JSON line with seconds by query (best of a few warm runs, noop sink)."""

from __future__ import annotations

import json
import os
import sys
import time
from datetime import timedelta

SF_DIR = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
CPUS = os.environ.get("BENCH_CPUS", "8")
RUNS = int(os.environ.get("BENCH_RUNS", "3"))
HEADLINE = ("split_by_observation_gap", "split_by_stops", "filter_stale_pings", "filter_impossible_speeds", "filter_traffic_stops", "split_trips", "pipeline_trips", "partition_points", "stop_summary", "path_quality", "way_counts", "resample_grid")


def main() -> None:
    from waymark.operators import segments, trajectory
    from waymark.queries import QUERIES
    from waymark.session import session
    from waymark.sources.fixture import gps_points

    spark = session("bench", spark__master=f"local[{CPUS}]", spark__sql__shuffle__partitions=CPUS, spark__driver__memory="8g", spark__ui__enabled="false", spark__ui__showConsoleProgress="false")
    spark.sparkContext.setLogLevel("ERROR")

    def timed(make) -> float:
        best = float("inf")
        for _ in range(RUNS + 1):  # the first run compiles
            began = time.perf_counter()
            make().write.format("noop").mode("overwrite").save()
            best = min(best, time.perf_counter() - began)
        return round(best, 3)

    found = {name: timed(lambda n=name: QUERIES[n](spark, SF_DIR)) for name in HEADLINE}
    pings = gps_points(spark, SF_DIR)
    rows = pings.count()
    tiled = segments.tile_dataset(pings, 10, 40 * 86_400)
    found["split_by_stops_x10"] = timed(lambda: trajectory.split_by_stops(tiled, 250.0, timedelta(seconds=300)))
    found["split_by_stops_300s"] = timed(lambda: trajectory.split_by_stops(pings, 250.0, timedelta(seconds=300)))
    rate = {"rows": rows, "split_by_stops_300s_rows_per_s": round(rows / found["split_by_stops_300s"]), "split_by_stops_x10_rows_per_s": round(10 * rows / found["split_by_stops_x10"])}
    print(json.dumps({"metric": "total_query_seconds", "value": round(sum(found.values()), 3), "unit": "sec", "queries": found, "sf": os.path.basename(SF_DIR.rstrip("/")), "cpus": CPUS, **rate}))
    sys.stdout.flush()
    spark.stop()


if __name__ == "__main__":
    main()
