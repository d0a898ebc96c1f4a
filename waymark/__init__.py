"""GPS trajectories on Spark. The names below are loaded from their modules when they are first used."""

from __future__ import annotations

from importlib import import_module
from typing import Any

_FROM = {
    "sources.readers": ("read_parquet", "read_dataset", "process", "traces_to_csv", "traces_to_parquet", "ChunkIndex", "scan_raw_truck", "scan_partitioned_truck", "scan_partitioned_trip", "scan_matched_truck", "scan_matched_trip"),
    "sources.file_variants": ("process_file", "filter_impossible_speeds_file", "filter_stale_pings_file", "filter_traffic_stops_file", "split_by_observation_gap_file", "split_by_stops_file"),
    "operators.trajectory": ("filter_impossible_speeds", "filter_stale_pings", "filter_traffic_stops", "split_by_observation_gap", "split_by_stops"),
    "operators.partition": ("assign_partitions", "partition_points", "trip_metadata"),
    "generate": ("ErrorConfig", "RouteSegment", "TracePoint", "TripConfig", "default_error_profile", "generate_trace", "generate_traces"),
    "plans.layout": ("partition_existing_parquet", "write_partitions", "write_trips_partitioned", "compact_partitions", "rebalance_partitions"),
    "plans.trips": ("run_pipeline", "split_trips", "trips"),
    "plans.matching": ("run_map_matching", "match_trips", "match_segments", "evaluate_quality"),
}
_WHERE = {name: module for module, names in _FROM.items() for name in names}

__all__ = sorted(_WHERE)


def __getattr__(name: str) -> Any:
    if name not in _WHERE:
        raise AttributeError(f"module {__name__!r} has no attribute {name!r}")
    return getattr(import_module(f"{__name__}.{_WHERE[name]}"), name)
