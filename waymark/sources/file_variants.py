"""Operators from file to file: each reads Parquet, writes Parquet and returns the rows written."""

from __future__ import annotations

from waymark.operators import trajectory
from waymark.sources.readers import file_operator, process

process_file = file_operator(process)
split_by_observation_gap_file = file_operator(trajectory.split_by_observation_gap)
split_by_stops_file = file_operator(trajectory.split_by_stops)
filter_stale_pings_file = file_operator(trajectory.filter_stale_pings)
filter_impossible_speeds_file = file_operator(trajectory.filter_impossible_speeds)
filter_traffic_stops_file = file_operator(trajectory.filter_traffic_stops)
