"""Cleaning and splitting of trajectories."""

from __future__ import annotations

from datetime import timedelta

import numpy as np
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from waymark.functions.geo import KMH_TO_MPS
from waymark.operators import walk
from waymark.schema import micros, require, require_doubles, require_time, span_micros

GAP_SEGMENT = T.StructField("gap_segment_id", T.IntegerType())
SEGMENT, STOP = T.StructField("segment_id", T.IntegerType()), T.StructField("is_stop", T.BooleanType())


def split_by_observation_gap(df: DataFrame, gap: timedelta, id_col: str = "id", time_col: str = "time", min_length: int = 0) -> DataFrame:
    """df with segment_id, which grows after each silence longer than `gap`.

    Null times neither start a segment nor count; segments of fewer than min_length times are
    dropped without renumbering, and with min_length > 0 so are rows without id.
    """
    require(df, id_col)
    require_time(df, time_col)
    w = Window.partitionBy(id_col).orderBy(time_col)
    us = micros(time_col)
    late = F.coalesce(us - F.lag(us).over(w) > span_micros(gap), F.lit(False))
    out = df.withColumn("_late", late.cast("int"))
    out = out.withColumn("segment_id", F.sum("_late").over(w.rowsBetween(Window.unboundedPreceding, 0)).cast("int")).drop("_late")
    if min_length <= 0:
        return out
    times = F.count(time_col).over(Window.partitionBy(id_col, "segment_id"))
    return out.withColumn("_n", times).filter((F.col("_n") >= min_length) & F.col(id_col).isNotNull()).drop("_n")


def _split(tracks: walk.Tracks, lat: str, lon: str, diameter: float, duration: int, least: int, angle: float | None = None, distance: float = 0.0) -> walk.Marked:
    """Stops and movements of tracks; movements of fewer than `least` times are dropped; then, with an angle, the traffic filter."""
    stop = walk.stop_flags(tracks, walk.US, lat, lon, diameter, duration)
    number = walk.numbers(tracks, walk.changes(stop))
    stay = stop | (walk.times_in(tracks, walk.US, number) >= least)
    number, stop = number[stay], stop[stay]
    if angle is not None:
        left = tracks.take(stay)
        stop = walk.traffic_flags(left, stop, lat, lon, angle, distance)
        number = walk.numbers(left, walk.changes(stop))
    return stay, {"segment_id": number, "is_stop": stop}


def split_by_stops(df: DataFrame, max_diameter: float, min_duration: timedelta, id_col: str = "id", time_col: str = "time", lat_col: str = "lat", lon_col: str = "lon", min_length: int = 0) -> DataFrame:
    """df with segment_id and is_stop; movements of fewer than min_length times are dropped, stops stay."""
    require(df, id_col)
    require_time(df, time_col)
    require_doubles(df, lat_col, lon_col)
    duration = span_micros(min_duration)
    base = walk.prepared(df.drop("segment_id", "is_stop"), id_col, time_col)
    return walk.walk_marks(base, id_col, [walk.US, lat_col, lon_col], lambda tracks: _split(tracks, lat_col, lon_col, max_diameter, duration, min_length), [SEGMENT, STOP])


def filter_traffic_stops(df: DataFrame, max_angle_change: float = 30.0, min_distance: float = 10.0, id_col: str = "id", time_col: str = "time", lat_col: str = "lat", lon_col: str = "lon") -> DataFrame:
    """df (with is_stop) without the stops that go on in the direction they were entered; segments are numbered anew."""
    require(df, id_col, "is_stop")
    require_time(df, time_col)
    require_doubles(df, lat_col, lon_col)

    def marks(tracks: walk.Tracks) -> walk.Marked:
        stop = walk.traffic_flags(tracks, tracks.value["is_stop"].astype(bool), lat_col, lon_col, max_angle_change, min_distance)
        return np.ones(tracks.n, bool), {"segment_id": walk.numbers(tracks, walk.changes(stop)), "is_stop": stop}

    return walk.walk_marks(walk.prepared(df, id_col, time_col), id_col, [lat_col, lon_col, "is_stop"], marks, [SEGMENT, STOP])


def filter_stale_pings(df: DataFrame, window: int = 5, id_col: str = "id", time_col: str = "time", lat_col: str = "lat", lon_col: str = "lon", speed_col: str = "speed", heading_col: str = "heading") -> DataFrame:
    """df without verbatim repeats of one of the last `window` kept moving pings of a vehicle (window 0: df as it is)."""
    require(df, id_col)
    require_time(df, time_col)
    require_doubles(df, lat_col, lon_col, speed_col, heading_col)
    if window <= 0:
        return df
    own = [lat_col, lon_col, speed_col, heading_col]
    return walk.walk_filter(walk.prepared(df, id_col, time_col), id_col, own, [lambda tracks: walk.fresh(tracks, own, speed_col, window)])


def filter_impossible_speeds(df: DataFrame, max_speed_kmh: float = 200.0, id_col: str = "id", time_col: str = "time", lat_col: str = "lat", lon_col: str = "lon") -> DataFrame:
    """df without pings that the last kept ping of the vehicle could only reach faster than max_speed_kmh."""
    require(df, id_col)
    require_time(df, time_col)
    require_doubles(df, lat_col, lon_col)
    own = [walk.US, lat_col, lon_col]
    return walk.walk_filter(walk.prepared(df, id_col, time_col), id_col, own, [lambda tracks: walk.possible(tracks, *own, max_speed_kmh * KMH_TO_MPS)])


#: Columns that cleaning looks at.
CLEANED = ["lat", "lon", "speed", "heading"]


def _cleaning(stale_window: int | None, max_speed_kmh: float | None) -> list[walk.Step]:
    steps: list[walk.Step] = []
    if stale_window:
        steps.append(lambda tracks: walk.fresh(tracks, CLEANED, "speed", stale_window))
    if max_speed_kmh is not None:
        steps.append(lambda tracks: walk.possible(tracks, walk.US, "lat", "lon", max_speed_kmh * KMH_TO_MPS))
    return steps


def clean(df: DataFrame, stale_window: int | None = 5, max_speed_kmh: float | None = 200.0, id_col: str = "id", time_col: str = "time") -> DataFrame:
    """Stale pings and impossible speeds dropped in one walk over one exchange; None leaves a filter out."""
    require(df, id_col)
    require_time(df, time_col)
    require_doubles(df, *CLEANED)
    steps = _cleaning(stale_window, max_speed_kmh)
    return walk.walk_filter(walk.prepared(df, id_col, time_col), id_col, [*CLEANED, walk.US], steps) if steps else df


def split_stops_and_traffic(df: DataFrame, max_diameter: float, min_duration: timedelta, max_angle_change: float | None, min_distance: float, min_length: int, id_col: str = "id", time_col: str = "time") -> DataFrame:
    """split_by_stops, its min_length and filter_traffic_stops in one walk over one exchange."""
    duration = span_micros(min_duration)
    base = walk.prepared(df.drop("segment_id", "is_stop"), id_col, time_col)
    return walk.walk_marks(base, id_col, [walk.US, "lat", "lon"], lambda tracks: _split(tracks, "lat", "lon", max_diameter, duration, min_length, max_angle_change, min_distance), [SEGMENT, STOP])


def clean_and_split(df: DataFrame, gap: timedelta, max_diameter: float, min_duration: timedelta, max_angle_change: float | None, min_distance: float, min_length: int, stale_window: int | None, max_speed_kmh: float | None, id_col: str = "id", time_col: str = "time") -> DataFrame:
    """clean, split_by_observation_gap, split_by_stops (both with min_length) and filter_traffic_stops in one walk over one exchange.

    df with gap_segment_id, segment_id and is_stop.
    """
    require(df, id_col)
    require_time(df, time_col)
    require_doubles(df, *CLEANED)
    silence, duration, cleaning = span_micros(gap), span_micros(min_duration), _cleaning(stale_window, max_speed_kmh)

    def marks(tracks: walk.Tracks) -> walk.Marked:
        at = np.arange(tracks.n)
        for step in cleaning:
            stay, _ = step(tracks)
            at, tracks = at[stay], tracks.take(stay)
        number = walk.numbers(tracks, walk.late(tracks, walk.US, silence))
        if min_length > 0:
            stay = (walk.times_in(tracks, walk.US, number) >= min_length) & tracks.named
            at, number, tracks = at[stay], number[stay], tracks.take(stay)
        stay, found = _split(tracks, "lat", "lon", max_diameter, duration, min_length, max_angle_change, min_distance)
        return at[stay], found | {"gap_segment_id": number[stay]}

    base = walk.prepared(df.drop("gap_segment_id", "segment_id", "is_stop"), id_col, time_col)
    return walk.walk_marks(base, id_col, [walk.US, *CLEANED], marks, [GAP_SEGMENT, SEGMENT, STOP])
