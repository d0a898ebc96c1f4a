"""Trips from a route: speeds, pings every minute, manoeuvres at both ends, noise and errors."""

from __future__ import annotations

import math
from collections.abc import Callable, Iterator
from dataclasses import replace
from datetime import datetime, timedelta
from random import Random

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from waymark.functions.geo import MPS_TO_MPH
from waymark.generate.errors import apply_errors, moved
from waymark.generate.models import PROFILE, STEP_S, RouteSegment, TracePoint, TripConfig, certain_error, default_error_profile
from waymark.operators.walk import bearing_of
from waymark.operators.walk import metres as haversine
from waymark.schema import PING

Route = Callable[[tuple[float, float], tuple[float, float]], list[RouteSegment]]
#: Acceleration and braking (m/s2), chance of a halt on an urban stretch.
ACCELERATION, BRAKING, TRAFFIC_STOP = 0.5, 0.8, 0.12
#: Each manoeuvre as (metres ahead, metres to the right, seconds) legs in the frame of the arriving vehicle.
MANOEUVRES = {
    "straight_back": ((30, 0, 20), (0, 0, 30), (-25, 0, 60)),
    "alley_dock": ((35, 8, 25), (45, -4, 15), (0, 0, 20), (-20, 14, 70), (-8, 6, 30)),
    "blind_side": ((25, -6, 25), (32, 3, 15), (0, 0, 40), (-14, -10, 90), (0, 0, 30), (-6, -4, 40)),
    "pull_through": ((20, 0, 20), (30, 3, 30), (25, 0, 30)),
    "angle_back": ((25, 5, 25), (0, 0, 20), (-20, 8, 60)),
}


def straight_route(a: tuple[float, float], b: tuple[float, float]) -> list[RouteSegment]:
    """The route where no engine is at hand: a straight line, slow at both ends."""
    total = haversine(*a, *b)
    at = lambda s: (a[0] + s * (b[0] - a[0]), a[1] + s * (b[1] - a[1]))
    edge = min(0.1, 3000.0 / total) if total else 0.0
    cuts = [0.0, edge, 1 - edge, 1.0] if edge else [0.0, 1.0]
    return [RouteSegment((at(s), at(e)), total * (e - s), 13.0 if i != 1 else 27.0, i != 1) for i, (s, e) in enumerate(zip(cuts, cuts[1:])) if e > s]


def truck_cap(v: float) -> float:
    return min(v, 29.0) if v > 22 else min(v, 15.6) if v > 11 else min(v, 11.2)


def smooth_speeds(route: list[RouteSegment]) -> list[tuple[float, float]]:
    """(entry, cruise) speed of each stretch (m/s): no change faster than the vehicle accelerates and brakes, from rest to rest."""
    cruise = [truck_cap(s.speed_mps) for s in route]
    entry = [0.0, *cruise[1:], 0.0]
    for i, s in enumerate(route):
        entry[i + 1] = min(entry[i + 1], math.sqrt(entry[i] ** 2 + 2 * ACCELERATION * s.length_m))
    for i in range(len(route) - 1, -1, -1):
        entry[i] = min(entry[i], math.sqrt(entry[i + 1] ** 2 + 2 * BRAKING * route[i].length_m))
    return list(zip(entry, cruise))


def drive(route: list[RouteSegment], start: datetime, rng: Random) -> list[TracePoint]:
    """Pings every minute along the route, and one where it ends."""
    legs: list[tuple[float, float, tuple, tuple, float]] = []  # start s, end s, points, speed
    clock = 0.0
    speeds = smooth_speeds(route)
    for i, s in enumerate(route):
        v = max(1.0, (speeds[i][0] + speeds[i][1]) / 2 if i in (0, len(route) - 1) else speeds[i][1])
        if s.urban and rng.random() < TRAFFIC_STOP:
            halt = rng.uniform(20, 90)
            legs.append((clock, clock + halt, s.line[0], s.line[0], 0.0))
            clock += halt
        parts = list(zip(s.line, s.line[1:]))
        whole = sum(haversine(*a, *b) for a, b in parts) or 1.0
        for a, b in parts:
            took = s.length_m * haversine(*a, *b) / whole / v
            legs.append((clock, clock + took, a, b, v))
            clock += took
    out, k, t, heading = [], 0, 0.0, 0.0
    while legs and t <= clock:
        while k + 1 < len(legs) and legs[k][1] < t:
            k += 1
        begin, end, a, b, v = legs[k]
        share = (t - begin) / (end - begin) if end > begin else 0.0
        heading = bearing_of(*a, *b) if a != b else heading
        out.append(TracePoint(start + timedelta(seconds=t), a[0] + share * (b[0] - a[0]), a[1] + share * (b[1] - a[1]), v * MPS_TO_MPH, heading))
        t += STEP_S
    if legs and out[-1].time < start + timedelta(seconds=clock):
        out.append(out[-1].at(time=start + timedelta(seconds=clock), lat=legs[-1][3][0], lon=legs[-1][3][1], speed=0.0))
    return out


def manoeuvre(kind: str, at: TracePoint, rng: Random, scale: float = 1.0) -> list[TracePoint]:
    """Pings of parking at the end of a trip."""
    if kind not in MANOEUVRES:
        raise ValueError(f"unknown manoeuvre: {kind}")
    out, p = [], at
    ahead = math.radians(at.heading)
    for forward, right, seconds in MANOEUVRES[kind]:
        forward, right = forward * scale, right * scale
        north = forward * math.cos(ahead) - right * math.sin(ahead)
        east = forward * math.sin(ahead) + right * math.cos(ahead)
        q = moved(p, north, east).later(seconds)
        metres = math.hypot(forward, right)
        heading = bearing_of(p.lat, p.lon, q.lat, q.lon) if metres else p.heading
        p = q.at(speed=metres / seconds * MPS_TO_MPH, heading=heading)
        out.append(p)
    return [*out, p.later(rng.uniform(20, 60)).at(speed=0.0)]


def departure(kind: str, at: TracePoint, rng: Random) -> list[TracePoint]:
    """Pings of leaving a parking place: the manoeuvre backwards, ending where and when the drive begins, in four steps of speed."""
    path = manoeuvre(kind, at.at(heading=(at.heading + 180) % 360), rng)[::-1]
    total = (path[0].time - at.time).total_seconds()
    out = []
    for i, p in enumerate(path):
        back = (p.time - at.time).total_seconds()
        out.append(p.at(time=at.time - timedelta(seconds=back), speed=(0.0, 2.0, 4.0, 6.0)[min(3, 4 * i // len(path))], heading=(p.heading + 180) % 360))
    assert total >= 0
    return out


def generate_trace(trip: TripConfig, route: Route = straight_route) -> list[TracePoint]:
    """All pings of one trip; the same configuration gives the same pings anywhere."""
    rng = Random(f"{trip.trip_id}/{trip.seed}")
    points = drive(route(trip.origin, trip.destination), trip.departure, rng)
    if points and trip.departure_manoeuvre:
        points = departure(trip.departure_manoeuvre, points[0], rng) + points
    if points and trip.arrival_manoeuvre:
        points = points + manoeuvre(trip.arrival_manoeuvre, points[-1], rng)
    points = apply_errors(points, trip.errors, rng)
    if trip.noise_m:
        points = [moved(p, rng.gauss(0, trip.noise_m), rng.gauss(0, trip.noise_m)) if p.speed else p for p in points]
    return points


def generate_traces(spark: SparkSession, trips: list[TripConfig], route: Route = straight_route) -> DataFrame:
    """Pings of all trips, one task per some of them."""
    rows = spark.range(len(trips)).repartition(max(1, min(len(trips), spark.sparkContext.defaultParallelism)))

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            out = [(trips[i].trip_id, p.time, p.lat, p.lon, p.speed, p.heading) for i in frame["id"] for p in generate_trace(trips[i], route)]
            yield pd.DataFrame(out, columns=["id", "time", "lat", "lon", "speed", "heading"])

    return rows.mapInPandas(run, PING)


#: Places of random trips with their weights.
ZONES = ((43.65, -79.38, 5), (45.50, -73.57, 4), (41.88, -87.63, 5), (42.33, -83.05, 3), (40.71, -74.01, 5), (39.95, -75.17, 3), (33.75, -84.39, 4), (32.78, -96.80, 4), (29.76, -95.37, 3), (34.05, -118.24, 5), (37.77, -122.42, 3), (47.61, -122.33, 3), (49.28, -123.12, 2), (51.05, -114.07, 2), (39.74, -104.99, 2), (39.10, -94.58, 2))


def random_trip(trip_id: str, day: datetime, rng: Random) -> TripConfig:
    """A trip between two weighted places, with manoeuvres at both ends."""
    (a, b, _), (c, d, _) = rng.choices(ZONES, [z[2] for z in ZONES], k=2)
    near = lambda x: x + rng.uniform(-0.2, 0.2)
    kinds = sorted(MANOEUVRES)
    return TripConfig(trip_id, (near(a), near(b)), (near(c), near(d)), day + timedelta(minutes=rng.randint(0, 1439)), rng.randint(0, 2**31), rng.choice(kinds), rng.choice(kinds), errors=default_error_profile())


def generate_database(spark: SparkSession, out_dir: str, trucks: int, trips_each: int, first_day: datetime, seed: int = 0) -> None:
    """Raw pings of many trucks under year=YYYY/chunk_id=XX; every kind of error occurs in some trip, if there are as many trips as kinds.

    The first trips of all trucks, then their second ones, and so on, get one kind each for sure.
    """
    kinds = sorted(PROFILE)

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            for truck in frame["id"]:
                rng = Random(f"{seed}/{truck}")
                name = f"{rng.getrandbits(64):016x}"
                for k in range(trips_each):
                    trip = random_trip(f"{name}/{k}", first_day + timedelta(days=k), rng)
                    if (slot := k * trucks + int(truck)) < len(kinds):
                        trip = replace(trip, errors=certain_error(kinds[slot]))
                    points = generate_trace(trip)
                    yield pd.DataFrame([(name, p.time, p.lat, p.lon, p.speed, p.heading) for p in points], columns=["id", "time", "lat", "lon", "speed", "heading"])

    pings = spark.range(trucks).mapInPandas(run, PING)
    keyed = pings.withColumn("year", F.year("time").cast("string")).withColumn("chunk_id", F.right("id", F.lit(2)))
    keyed.repartition("chunk_id").sortWithinPartitions("id", "time").write.mode("overwrite").partitionBy("year", "chunk_id").parquet(out_dir)


