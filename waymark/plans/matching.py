"""Map matching behind a protocol: any engine that turns a trace into ways and shapes can be plugged in.

The engine runs once per worker and trip. What surrounds it is here: requests, gaps bridged by
routes, seams without repeats, quality, and resumable runs by partition.
"""

from __future__ import annotations

import math
import time
from collections.abc import Callable, Iterator
from dataclasses import dataclass, field
from typing import Protocol

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from waymark.operators import quality
from waymark.operators.segments import MAX_DIST_M, MIN_DIST_M, TIME_S
from waymark.operators.walk import bearing_of
from waymark.operators.walk import metres as haversine
from waymark.schema import require
from waymark.sources.files import Files

Point = tuple[float, float]
#: Settings of a matching request that a caller may override.
REQUEST = {"costing": "truck", "shape_match": "map_snap", "search_radius": 50, "gps_accuracy": 10, "breakage_cap_m": 20_000.0}


@dataclass
class Match:
    """What an engine found: one shape per unbroken stretch, ways in order of travel, and matched points."""

    shapes: list[list[Point]]
    ways: list[int] = field(default_factory=list)
    points: list[tuple[float, float, float] | None] = field(default_factory=list)  # lat, lon, distance


class Matcher(Protocol):
    def match(self, points: list[Point], times: list[float], request: dict) -> Match: ...

    def route(self, start: Point, end: Point) -> list[Point]: ...


class StraightLine:
    """The matcher without a road graph: every ping is its own match, and a way is a cell of a grid."""

    def __init__(self, degrees: float = 0.01):
        self.degrees = degrees

    def match(self, points: list[Point], times: list[float], request: dict) -> Match:
        cell = lambda p: math.floor((p[0] + 90) / self.degrees) * 100_000 + math.floor((p[1] + 180) / self.degrees)
        return Match([list(points)], without_repeats([cell(p) for p in points]), [(a, b, 0.0) for a, b in points])

    def route(self, start: Point, end: Point) -> list[Point]:
        return [start, end]


def without_repeats(ways: list[int | None]) -> list[int]:
    """Ways without nulls and without immediate repeats."""
    out: list[int] = []
    for w in ways:
        if w is not None and (not out or out[-1] != w):
            out.append(w)
    return out


def request_for(points: list[Point], **overrides) -> dict:
    """Settings of one request; the breakage distance follows the largest step of the trace."""
    own = REQUEST | overrides
    step = max((haversine(*a, *b) for a, b in zip(points, points[1:])), default=0.0)
    return {k: v for k, v in own.items() if k != "breakage_cap_m"} | {"breakage_distance": max(3000.0, min(own["breakage_cap_m"], 1.5 * step))}


def find_gaps(points: list[Point], times: list[float], max_dist_m: float = MAX_DIST_M, time_s: float = TIME_S, min_dist_m: float = MIN_DIST_M) -> list[int]:
    """Rows after which a trace is cut and bridged."""
    cuts = []
    for i in range(len(points) - 1):
        d, dt = haversine(*points[i], *points[i + 1]), times[i + 1] - times[i]
        if d > max_dist_m or dt > time_s and d > min_dist_m:
            cuts.append(i)
    return cuts


def split_at(rows: list, cuts: list[int]) -> list[list]:
    """Slices of rows, each cut after the given row; a cut after the last row leaves an empty slice behind it."""
    edges = [0, *(c + 1 for c in cuts), len(rows)]
    return [rows[a:b] for a, b in zip(edges, edges[1:])]


@dataclass
class Bridged:
    match: Match
    n_bridges: int = 0
    max_detour_ratio: float | None = None
    total_bridge_m: float = 0.0
    any_bridge_failed: bool = False


def length_m(shape: list[Point]) -> float:
    return sum(haversine(*a, *b) for a, b in zip(shape, shape[1:]))


def match_with_bridges(engine: Matcher, points: list[Point], times: list[float], **overrides) -> Bridged:
    """Match each stretch between gaps and route across the gaps; if any part fails, match the trace as a whole."""
    cuts = find_gaps(points, times)
    if not cuts:
        return Bridged(engine.match(points, times, request_for(points, **overrides)))
    try:
        shapes, ways, found, out = [], [], [], Bridged(Match([]))
        parts = list(zip(split_at(points, cuts), split_at(times, cuts)))
        for k, (own, at) in enumerate(parts):
            if len(own) < 2:
                found += [None] * len(own)
            else:
                m = engine.match(own, at, request_for(own, **overrides))
                shapes += m.shapes
                ways += m.ways
                found += m.points
            if k + 1 < len(parts) and own and parts[k + 1][0]:
                a, b = own[-1], parts[k + 1][0][0]
                route = engine.route(a, b)
                metres, straight = length_m(route), haversine(*a, *b)
                out.n_bridges += 1
                out.total_bridge_m += metres
                if straight > 0:
                    out.max_detour_ratio = max(out.max_detour_ratio or 0.0, metres / straight)
                shapes.append(route)
        out.match = Match(shapes, without_repeats(ways), found)
        return out
    except Exception:
        return Bridged(engine.match(points, times, request_for(points, **overrides)), any_bridge_failed=True)


def reversals(shape: list[Point]) -> int:
    n, before = 0, None
    for a, b in zip(shape, shape[1:]):
        if haversine(*a, *b) < quality.MIN_LEG_M:
            continue
        now = bearing_of(*a, *b)
        if before is not None and abs((now - before + 540.0) % 360.0 - 180.0) > quality.REVERSAL_DEG:
            n += 1
        before = now
    return n


QUALITY = "ok boolean, error string, n_points bigint, n_polylines bigint, path_length_ratio double, heading_reversals bigint, n_bridges bigint, max_detour_ratio double, total_bridge_m double, any_bridge_failed boolean, has_issues boolean"
MATCHED = f"id string, date date, ways array<bigint>, elapsed_s double, {QUALITY}"
#: What is asked of the engine and reported: shapes with their breaks; points, ways and shapes; ways alone; or stretches with bridges between them.
MODES = ("route", "attributes", "ways", "bridges")


def evaluate(engine: Matcher, points: list[Point], times: list[float], mode: str = "route", **overrides) -> tuple[dict, Match]:
    """Quality of one trip's match, and the match; an engine's exception becomes the error text.

    Breaks between shapes count in mode "route" only; mode "ways" has neither length nor reversals.
    """
    if mode not in MODES:
        raise ValueError(f"mode must be one of {', '.join(MODES)}")
    row = {"ok": False, "error": None, "n_points": len(points), "n_polylines": 0, "path_length_ratio": None, "heading_reversals": 0, "n_bridges": 0, "max_detour_ratio": None, "total_bridge_m": 0.0, "any_bridge_failed": False}
    found = Match([])
    if len(points) < 2:
        row["error"] = "insufficient points (<2)"
    else:
        try:
            if mode == "bridges":
                b = match_with_bridges(engine, points, times, **overrides)
                found = b.match
                row |= {"n_bridges": b.n_bridges, "max_detour_ratio": b.max_detour_ratio, "total_bridge_m": b.total_bridge_m, "any_bridge_failed": b.any_bridge_failed}
            elif mode == "ways" and hasattr(engine, "ways"):
                found = Match([], engine.ways(points, request_for(points, **overrides)))
            else:
                found = engine.match(points, times, request_for(points, **overrides))
                found = Match([], found.ways) if mode == "ways" else found
        except Exception as e:
            row["error"] = f"{type(e).__name__}: {e}"
    if found.shapes:
        walked = length_m(points)
        row |= {"n_polylines": len(found.shapes) if mode == "route" else 0, "heading_reversals": sum(map(reversals, found.shapes)), "path_length_ratio": sum(map(length_m, found.shapes)) / walked if walked else None}
    ratio = row["path_length_ratio"]
    row["has_issues"] = bool(row["error"] is not None or row["n_polylines"] > 1 or (ratio is not None and not quality.RATIO[0] <= ratio <= quality.RATIO[1]) or row["heading_reversals"] > quality.MAX_REVERSALS or row["any_bridge_failed"])
    return row | {"ok": not row["has_issues"]}, found


def match_trip(engine: Matcher, trip: pd.DataFrame, mode: str = "bridges", **overrides) -> dict:
    """Ways and quality of one trip (time, lat, lon, in order)."""
    began = time.perf_counter()
    when = pd.to_datetime(trip["time"])
    row, found = evaluate(engine, list(zip(trip["lat"].tolist(), trip["lon"].tolist())), [t.timestamp() for t in when], mode, **overrides)
    return row | {"date": when.min().date() if len(when) else None, "ways": found.ways, "elapsed_s": time.perf_counter() - began}


_engines: dict[Callable[[], Matcher], Matcher] = {}


def engine_of(make_engine: Callable[[], Matcher]) -> Matcher:
    """One engine per worker."""
    if make_engine not in _engines:
        _engines[make_engine] = make_engine()
    return _engines[make_engine]


def match_trips(points: DataFrame, make_engine: Callable[[], Matcher], mode: str = "bridges", **overrides) -> DataFrame:
    """One row per trip of points (id, time, lat, lon and maybe is_stop, whose stops are left out): ways and quality."""
    require(points, "id", "time", "lat", "lon")

    def run(key: tuple, trip: pd.DataFrame) -> pd.DataFrame:
        found = match_trip(engine_of(make_engine), trip.sort_values("time"), mode, **overrides)
        return pd.DataFrame([{"id": key[0], **found}])

    return moving(points).select("id", "time", "lat", "lon").groupBy("id").applyInPandas(run, MATCHED)


def moving(points: DataFrame, skip_stops: bool = True) -> DataFrame:
    return points.filter(~F.coalesce("is_stop", F.lit(False))) if skip_stops and "is_stop" in points.columns else points


def ways_of(matched: DataFrame) -> DataFrame:
    """(id, date, way_id): a row per way; a trip without ways has one row without way_id."""
    return matched.select("id", "date", F.explode_outer("ways").alias("way_id"))


def quality_of(matched: DataFrame) -> DataFrame:
    """The quality columns with the verdict has_issues, worked out from them."""
    bad = quality.has_issues(F.col("error"), F.col("n_polylines"), F.col("path_length_ratio"), F.col("heading_reversals"), F.col("any_bridge_failed"))
    return matched.drop("ways").withColumn("has_issues", bad)


LINE = "array<struct<lat:double,lon:double>>"
SEGMENT_MATCH = f"segment_id bigint, error string, way_ids array<bigint>, shapes array<{LINE}>, points array<struct<time:timestamp,lat:double,lon:double,matched_lat:double,matched_lon:double,distance_from_trace:double>>"
INSPECT_QUALITY = "segment_id bigint, n_points bigint, ok boolean, error string, path_length_ratio double, heading_reversals bigint, has_issues boolean"


def match_segments(split: DataFrame, make_engine: Callable[[], Matcher], skip_stops: bool = True, min_points: int = 2, **overrides) -> DataFrame:
    """One row per segment_id of split pings with at least min_points: matched points, ways and shapes, or the engine's error."""
    require(split, "segment_id", "time", "lat", "lon")

    def run(key: tuple, segment: pd.DataFrame) -> pd.DataFrame:
        segment = segment.sort_values("time")
        when = pd.to_datetime(segment["time"])
        at = list(zip(segment["lat"].tolist(), segment["lon"].tolist()))
        if len(at) < min_points:
            return pd.DataFrame(columns=["segment_id", "error", "way_ids", "shapes", "points"])
        row, found = evaluate(engine_of(make_engine), at, [t.timestamp() for t in when], "attributes", **overrides)
        near = found.points if row["error"] is None and found.points else [None] * len(at)
        points = [{"time": t, "lat": a, "lon": b, "matched_lat": m and m[0], "matched_lon": m and m[1], "distance_from_trace": m and m[2]} for t, (a, b), m in zip(when, at, near)]
        lines = [[{"lat": a, "lon": b} for a, b in line] for line in found.shapes]
        return pd.DataFrame([{"segment_id": key[0], "error": row["error"], "way_ids": found.ways, "shapes": lines, "points": points}])

    rows = moving(split, skip_stops).select(F.col("segment_id").cast("long").alias("segment_id"), F.col("time").cast("timestamp").alias("time"), "lat", "lon")
    return rows.groupBy("segment_id").applyInPandas(run, SEGMENT_MATCH)


def evaluate_quality(split: DataFrame, matched: DataFrame | None = None, make_engine: Callable[[], Matcher] | None = None, skip_stops: bool = True, min_points: int = 2, **overrides) -> DataFrame:
    """A quality row per segment: from match_segments' rows, in DataFrame expressions, or (without them) from the engine.

    Breaks between shapes are not known on the first way.
    """
    rows = moving(split, skip_stops).select(F.col("segment_id").cast("long").alias("segment_id"), "time", "lat", "lon")
    if matched is not None:
        lines = matched.select("segment_id", F.posexplode("shapes").alias("polyline", "line")).select("segment_id", "polyline", F.posexplode("line").alias("seq", "at")).select("segment_id", "polyline", "seq", "at.*")
        found = quality.path_quality(rows, lines, "segment_id").filter(F.col("n_points") >= min_points).join(matched.select("segment_id", "error"), "segment_id")
        ratio = F.when(F.col("error").isNull(), F.col("path_length_ratio"))
        turns = F.when(F.col("error").isNull(), F.col("heading_reversals")).otherwise(F.lit(0))
        bad = quality.has_issues(F.col("error"), F.lit(0), ratio, turns)
        return found.select("segment_id", "n_points", (~bad).alias("ok"), "error", ratio.alias("path_length_ratio"), turns.cast("long").alias("heading_reversals"), bad.alias("has_issues"))
    if make_engine is None:
        raise ValueError("give either matched rows or an engine")

    def run(key: tuple, segment: pd.DataFrame) -> pd.DataFrame:
        segment = segment.sort_values("time")
        if len(segment) < min_points:
            return pd.DataFrame(columns=["segment_id", "n_points", "ok", "error", "path_length_ratio", "heading_reversals", "has_issues"])
        row, _ = evaluate(engine_of(make_engine), list(zip(segment["lat"].tolist(), segment["lon"].tolist())), [t.timestamp() for t in pd.to_datetime(segment["time"])], "route", **overrides)
        return pd.DataFrame([{"segment_id": key[0]} | {k: row[k] for k in ("n_points", "ok", "error", "path_length_ratio", "heading_reversals", "has_issues")}])

    return rows.groupBy("segment_id").applyInPandas(run, INSPECT_QUALITY)


def matched_points(points: DataFrame, make_engine: Callable[[], Matcher], bridges: bool = True, **overrides) -> DataFrame:
    """points with matched_lat, matched_lon and distance_from_trace (null where a stretch, or with bridges a part between gaps, has one ping)."""
    kinds = ", ".join(f"`{c}` {t}" for c, t in points.dtypes)

    def run(key: tuple, trip: pd.DataFrame) -> pd.DataFrame:
        trip = trip.sort_values("time")
        at = list(zip(trip["lat"].tolist(), trip["lon"].tolist()))
        engine, when = engine_of(make_engine), [t.timestamp() for t in pd.to_datetime(trip["time"])]
        if len(at) < 2:
            found = [None] * len(at)
        elif bridges:
            found = match_with_bridges(engine, at, when, **overrides).match.points
        else:
            found = engine.match(at, when, request_for(at, **overrides)).points
        cells = [p or (None, None, None) for p in found]
        return trip.assign(**{c: [p[i] for p in cells] for i, c in enumerate(("matched_lat", "matched_lon", "distance_from_trace"))})

    return points.groupBy("id").applyInPandas(run, f"{kinds}, matched_lat double, matched_lon double, distance_from_trace double")


def run_map_matching(points: DataFrame, out_dir: str, make_engine: Callable[[], Matcher], **overrides) -> None:
    """Match a partitioned dataset (tier, partition_id) into out_dir, out_dir/_quality and out_dir/_timing.

    Each trip is matched once, into a staging table; the outputs are then written from it, each
    replacing whole partitions, and the timing rows last. A run that broke off goes on with the
    partitions that have no timing row yet, and what it had written of these is replaced. Larger
    partitions come first.
    """
    spark = points.sparkSession
    keys, staging = ["tier", "partition_id"], f"{out_dir}/_matched.new"
    files = Files(spark, out_dir)
    points = points.withColumns({k: F.col(k).cast("string") for k in keys})
    if files.exists(f"{out_dir}/_timing"):
        done = spark.read.parquet(f"{out_dir}/_timing").select(*[F.col(k).cast("string").alias(k) for k in keys]).distinct()
        points = points.join(done, keys, "left_anti")
    where = points.groupBy("id").agg(*[F.first(k).alias(k) for k in keys], F.count(F.lit(1)).alias("_n"))
    match_trips(points, make_engine, **overrides).join(where, "id").orderBy(F.desc("_n")).drop("_n").write.mode("overwrite").parquet(staging)
    matched = spark.read.parquet(staging)
    replace = lambda df: df.repartition(*keys).write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy(*keys)
    replace(matched.select("id", "date", F.explode_outer("ways").alias("way_id"), *keys)).parquet(out_dir)
    replace(matched.drop("ways")).parquet(f"{out_dir}/_quality")
    timing = matched.groupBy(*keys).agg(F.lit(False).alias("skipped"), F.count(F.lit(1)).alias("trips"), F.sum(F.greatest(F.size("ways"), F.lit(1))).alias("rows_out"), F.sum("elapsed_s").alias("elapsed_s"))
    timing.orderBy(F.desc("elapsed_s")).write.mode("append").parquet(f"{out_dir}/_timing")
    files.remove(staging)
