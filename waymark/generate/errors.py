"""Injected errors: faults of the receiver, and what drivers and fleets do.

An injector takes (points, rng, settings) and returns points. Traces too short for an effect come back as they are.
"""

from __future__ import annotations

import math
from collections.abc import Callable
from random import Random

from waymark.functions.geo import METERS_PER_DEGREE
from waymark.generate.models import STEP_S, ErrorConfig, TracePoint
from waymark.operators.walk import bearing_of
from waymark.operators.walk import metres as haversine

Points = list[TracePoint]
GPS: dict[str, Callable] = {}
OPERATIONAL: dict[str, Callable] = {}


def injector(registry: dict[str, Callable], least: int = 0) -> Callable:
    def register(f: Callable) -> Callable:
        def guarded(points: Points, rng: Random, **params) -> Points:
            return f(list(points), rng, **params) if len(points) >= least else list(points)

        registry[f.__name__] = guarded
        return guarded

    return register


def moved(p: TracePoint, north_m: float, east_m: float) -> TracePoint:
    return p.at(lat=p.lat + north_m / METERS_PER_DEGREE, lon=p.lon + east_m / (METERS_PER_DEGREE * math.cos(math.radians(p.lat))))


def around(p: TracePoint, rng: Random, metres: float) -> TracePoint:
    angle = rng.uniform(0, 2 * math.pi)
    return moved(p, metres * math.cos(angle), metres * math.sin(angle))


def block(points: Points, rng: Random, seconds: float, lo: float = 0.2, hi: float = 0.8) -> tuple[int, int]:
    """A run of rows of about `seconds`, within the given share of the trace."""
    n, length = len(points), max(1, int(seconds / STEP_S))
    first = rng.randint(int(n * lo), max(int(n * lo), int(n * hi) - length))
    return first, min(n - 1, first + length)


def dwell(p: TracePoint, rng: Random, seconds: float, jitter_m: float = 5.0, heading: float | None = None) -> Points:
    """Pings of a standing vehicle, the first one a step after p."""
    at = p.heading if heading is None else heading
    return [around(p, rng, rng.uniform(0, jitter_m)).later(STEP_S * i).at(speed=0.0, heading=at) for i in range(1, int(seconds / STEP_S) + 1)]


def inserted(points: Points, i: int, extra: Points) -> Points:
    """extra behind row i; what follows is as much later as extra lasts."""
    shift = (extra[-1].time - points[i].time).total_seconds() if extra else 0.0
    return points[: i + 1] + extra + [p.later(shift) for p in points[i + 1 :]]


@injector(GPS, 10)
def signal_dropout(points: Points, rng: Random, duration_s: float = 300) -> Points:
    a, b = block(points, rng, duration_s)
    return points[:a] + points[b:]


@injector(GPS, 2)
def cold_start_drift(points: Points, rng: Random, n_points: int = 3, drift_m: float = 50) -> Points:
    starts = [0] + [i for i in range(1, len(points)) if (points[i].time - points[i - 1].time).total_seconds() > 120]
    for s in starts:
        for k in range(min(n_points, len(points) - s)):
            points[s + k] = around(points[s + k], rng, drift_m * (1 - k / n_points))
    return points


@injector(GPS, 5)
def multipath(points: Points, rng: Random, count: int = 3, min_m: float = 50, max_m: float = 200) -> Points:
    for i in rng.sample(range(1, len(points) - 1), min(count, len(points) - 2)):
        points[i] = around(points[i], rng, rng.uniform(min_m, max_m)).at(speed=rng.uniform(60, 120))
    return points


@injector(GPS, 10)
def frozen_fix(points: Points, rng: Random, duration_s: float = 300) -> Points:
    a, b = block(points, rng, duration_s)
    for i in range(a, b):
        points[i] = points[i].at(lat=points[a].lat, lon=points[a].lon, speed=0.0)
    return points


@injector(GPS, 5)
def timestamp_glitch(points: Points, rng: Random, count: int = 2) -> Points:
    for i in rng.sample(range(1, len(points) - 1), min(count, len(points) - 2)):
        what = rng.choice(("same", "ahead", "behind"))
        points[i] = points[i].at(time=points[i - 1].time) if what == "same" else points[i].later(3600 * (rng.uniform(1, 12) if what == "ahead" else -rng.uniform(1, 6)))
    return points


@injector(GPS, 5)
def coordinate_corruption(points: Points, rng: Random, count: int = 2) -> Points:
    for i in rng.sample(range(1, len(points) - 1), min(count, len(points) - 2)):
        p, what = points[i], rng.choice(("short", "lat", "lon", "swap"))
        points[i] = {"short": p.at(lat=math.trunc(p.lat * 100) / 100, lon=math.trunc(p.lon * 100) / 100), "lat": p.at(lat=-p.lat), "lon": p.at(lon=-p.lon), "swap": p.at(lat=p.lon, lon=p.lat)}[what]
    return points


@injector(GPS, 10)
def speed_heading_desync(points: Points, rng: Random, duration_s: float = 300) -> Points:
    a, b = block(points, rng, duration_s)
    lag = rng.randint(2, 5)
    headings = [p.heading for p in points]
    for i in range(a, b):
        points[i] = points[i].at(speed=0.0, heading=headings[max(0, i - lag)])
    return points


@injector(GPS)
def jitter_at_rest(points: Points, rng: Random, radius_m: float = 10) -> Points:
    north = east = 0.0
    for i, p in enumerate(points):
        if p.speed < 1:
            north, east = north + rng.gauss(0, radius_m / 3), east + rng.gauss(0, radius_m / 3)
            far = math.hypot(north, east)
            if far > radius_m:
                north, east = north * radius_m / far, east * radius_m / far
            points[i] = moved(p, north, east)
        else:
            north = east = 0.0
    return points


@injector(GPS, 10)
def stale_reemission(points: Points, rng: Random, count: int = 2, max_lag: int = 4) -> Points:
    """A moving ping once more, 1 to max_lag rows later, with a time of its own between its neighbours."""
    moving = [i for i in range(len(points) - max_lag - 1) if points[i].speed > 0]
    for i in sorted(rng.sample(moving, min(count, len(moving))), reverse=True):
        j = i + rng.randint(1, max_lag)
        middle = (points[j + 1].time - points[j].time).total_seconds() / 2
        points.insert(j + 1, points[i].at(time=points[j].later(middle).time))
    return points


@injector(OPERATIONAL, 20)
def privacy_shutoff(points: Points, rng: Random, duration_s: float = 36_000) -> Points:
    a = int(len(points) * rng.uniform(0.70, 0.85))
    return points[:a] + [p.later(duration_s) for p in points[a:]]


@injector(OPERATIONAL, 10)
def relay_driving(points: Points, rng: Random, speed_mph: float = 2, min_points: int = 3) -> Points:
    """Another driver takes over: long stops are cut out and the rest goes on without a break."""
    out: Points = []
    i = 0
    while i < len(points):
        j = i
        while j < len(points) and points[j].speed < speed_mph:
            j += 1
        if j - i >= min_points:
            out.append(points[i])
        else:
            out += points[i:j]
        if j < len(points):
            out.append(points[j])
        i = j + 1
    return [p.at(time=out[0].later(STEP_S * k).time) for k, p in enumerate(out)]


@injector(OPERATIONAL, 1)
def yard_dwell(points: Points, rng: Random, duration_s: float = 14_400, where: str = "start") -> Points:
    if where == "start":
        stay = dwell(points[0], rng, duration_s)
        return [points[0].at(speed=0.0), *stay, *(p.later(duration_s) for p in points[1:])]
    return points + dwell(points[-1], rng, duration_s)


@injector(OPERATIONAL, 1)
def loading_dwell(points: Points, rng: Random, duration_s: float = 5_400, where: str = "end") -> Points:
    return yard_dwell(points, rng, duration_s=duration_s, where=where)


@injector(OPERATIONAL, 10)
def fuel_rest_stop(points: Points, rng: Random, duration_s: float = 2_700) -> Points:
    i = int(len(points) * rng.uniform(0.4, 0.6))
    return inserted(points, i, dwell(points[i], rng, duration_s))


@injector(OPERATIONAL, 10)
def weigh_station_stop(points: Points, rng: Random, duration_s: float = 300, approach: int = 3) -> Points:
    i = rng.randint(approach, len(points) - 2)
    for k in range(i - approach, i):
        points[k] = points[k].at(speed=points[k].speed * 0.3)
    return inserted(points, i, dwell(points[i], rng, duration_s))


@injector(OPERATIONAL, 10)
def bobtail_segment(points: Points, rng: Random, share: float = 0.3, factor: float = 1.15) -> Points:
    n = int(len(points) * share)
    a = rng.randint(0, len(points) - n)
    return [p.at(speed=p.speed * factor) if a <= i < a + n and p.speed > 5 else p for i, p in enumerate(points)]


@injector(OPERATIONAL, 20)
def off_route_detour(points: Points, rng: Random, offset_m: float = 500, n_points: int = 10) -> Points:
    a, side = rng.randint(1, len(points) - n_points - 1), rng.choice((-1, 1))
    for k in range(n_points):
        across = math.radians(points[a + k].heading + 90 * side)
        far = offset_m * math.sin(math.pi * (k + 1) / (n_points + 1))
        points[a + k] = moved(points[a + k], far * math.cos(across), far * math.sin(across))
    return points


@injector(OPERATIONAL, 10)
def device_power_cycle(points: Points, rng: Random, gap_s: float = 180, drift_m: float = 40, n_points: int = 2) -> Points:
    a, b = block(points, rng, gap_s)
    rest = points[b:]
    for k in range(min(n_points, len(rest))):
        rest[k] = around(rest[k], rng, drift_m * (1 - k / n_points))
    return points[:a] + rest


@injector(OPERATIONAL, 20)
def traffic_jam(points: Points, rng: Random, duration_s: float = 7_200, speed_mph: float = 3, stopped: float = 0.4) -> Points:
    """The vehicle crawls between two pings for `duration_s`, standing for a share of the time, headed where it goes."""
    i = rng.randint(len(points) // 4, 3 * len(points) // 4)
    a, b = points[i], points[i + 1]
    n = int(duration_s / STEP_S)
    head = bearing_of(a.lat, a.lon, b.lat, b.lon) if (a.lat, a.lon) != (b.lat, b.lon) else a.heading
    crawl, share = [], 0.0
    for k in range(1, n + 1):
        stands = rng.random() < stopped
        share += 0 if stands else (1 - share) / (n - k + 2)
        crawl.append(a.at(lat=a.lat + share * (b.lat - a.lat), lon=a.lon + share * (b.lon - a.lon), speed=0.0 if stands else speed_mph, heading=head).later(STEP_S * k))
    return inserted(points, i, crawl)


@injector(OPERATIONAL)
def geofence_gap(points: Points, rng: Random, center: tuple[float, float] = (0.0, 0.0), radius_m: float = 1_000) -> Points:
    return [p for p in points if haversine(p.lat, p.lon, *center) > radius_m]


def apply_errors(points: Points, errors: list[ErrorConfig], rng: Random) -> Points:
    """Operational patterns first, then faults of the receiver, each with its probability."""
    for e in errors:
        if e.kind not in GPS and e.kind not in OPERATIONAL:
            raise ValueError(f"unknown error type: {e.kind}")
    for registry in (OPERATIONAL, GPS):
        for e in errors:
            if e.kind in registry and rng.random() < e.probability:
                points = registry[e.kind](points, rng, **e.params)
    return points
