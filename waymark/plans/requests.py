"""Requests to a routing engine as JSON, what its answers say, and an engine behind HTTP."""

from __future__ import annotations

import json
import os
import urllib.request
from pathlib import Path
from typing import Any, NamedTuple

from waymark.functions.shape import decode_polyline, join_legs
from waymark.operators.walk import metres

Point = tuple[float, float]
#: Options of a trace request that a caller may override, and the bounds of the adaptive breakage distance.
TRACE_OPTIONS = {"search_radius": 50, "gps_accuracy": 25, "breakage_distance": 3000, "interpolation_distance": 20, "max_route_distance_factor": 10, "max_route_time_factor": 10, "beta": 5, "turn_penalty_factor": 500}
BREAKAGE_M, BREAKAGE_CAP_M = 3000.0, 20_000.0
#: Speed (m/s) of a route without a duration.
NO_SPEED = 25.0


class Route(NamedTuple):
    """A route: its line, and speed and length of each step of it."""

    coords: list[Point]
    speeds_mps: list[float]
    distances_m: list[float]
    total_distance_m: float
    total_duration_s: float


def breakage(points: list[Point], cap: float = BREAKAGE_CAP_M) -> float:
    """1.5 times the largest step of a trace, within the bounds."""
    step = max((metres(*a, *b) for a, b in zip(points, points[1:])), default=0.0)
    return max(BREAKAGE_M, min(cap, 1.5 * step))


def trace_request(points: list[Point], costing: str = "auto", costing_options: dict | None = None, only: list[str] | None = None, cap: float = BREAKAGE_CAP_M, **options) -> dict[str, Any]:
    """The body of a trace request; `only` names the attributes to return."""
    body: dict[str, Any] = {
        "shape": [{"lat": a, "lon": b} for a, b in points],
        "costing": costing,
        "shape_match": "map_snap",
        "trace_options": TRACE_OPTIONS | {"breakage_distance": breakage(points, cap)} | options,
    }
    if costing_options is not None:
        body["costing_options"] = {costing: costing_options}
    if only is not None:
        body["filters"] = {"attributes": only, "action": "include"}
    return body


def route_request(start: Point, end: Point, costing: str = "auto") -> dict[str, Any]:
    return {"locations": [{"lat": a, "lon": b} for a, b in (start, end)], "costing": costing, "units": "kilometers"}


def encode(body: dict[str, Any]) -> str:
    return json.dumps(body, separators=(",", ":"))


def decode(answer: str | bytes) -> dict[str, Any]:
    return json.loads(answer)


def matched_points(answer: dict[str, Any], points: list[Point]) -> list[tuple[float, float, float]]:
    """(lat, lon, distance) of each point; what an answer leaves out is the point itself."""
    found = answer.get("matched_points", [])
    return [(m.get("lat", p[0]), m.get("lon", p[1]), m.get("distance_from_trace_point", 0.0)) for m, p in zip(found, points)]


def way_ids(answer: dict[str, Any]) -> list[int]:
    """Ways of an answer's edges, in order, without nulls and immediate repeats."""
    ways = [e["way_id"] for e in answer.get("edges", []) if e.get("way_id") is not None]
    return [w for w, before in zip(ways, [None, *ways]) if w != before]


def shapes(answer: dict[str, Any]) -> list[list[Point]]:
    """A line for the trip and for each of its alternates: what a matcher that broke the trace returns."""
    trips = [answer, *answer.get("alternates", [])]
    lines = [join_legs([decode_polyline(leg.get("shape", "")) for leg in t.get("trip", {}).get("legs", [])]) for t in trips]
    return [line for line in lines if line]


def route(answer: dict[str, Any]) -> Route:
    """The route of an answer; a manoeuvre's speed holds for the steps it covers, the mean one for the others."""
    trip = answer["trip"]
    legs = [decode_polyline(leg.get("shape", "")) for leg in trip["legs"]]
    coords = join_legs(legs)
    total, seconds = trip["summary"]["length"] * 1000, trip["summary"]["time"]
    lengths = [metres(*a, *b) for a, b in zip(coords, coords[1:])]
    speeds = [total / seconds if seconds > 0 else NO_SPEED] * len(lengths)
    first = 0
    for leg, line in zip(trip["legs"], legs):
        for m in leg["maneuvers"]:
            if m["time"] > 0:
                for i in range(first + m["begin_shape_index"], min(first + m["end_shape_index"], len(speeds))):
                    speeds[i] = m["length"] * 1000 / m["time"]
        first += max(len(line) - 1, 0)
    return Route(coords, speeds, lengths, total, seconds)


def find_config(given: str | None = None, name: str = "valhalla.json") -> Path:
    """The engine's configuration: the given file, else that of $VALHALLA_CONFIG, else the first one in this folder or above."""
    if given or (given := os.environ.get("VALHALLA_CONFIG")):
        if not Path(given).is_file():
            raise FileNotFoundError(given)
        return Path(given)
    for folder in (Path.cwd(), *Path.cwd().parents):
        if (folder / name).is_file():
            return folder / name
    raise FileNotFoundError(name)


class HttpEngine:
    """A matcher (see matching.Matcher) that asks a routing service by HTTP."""

    def __init__(self, url: str, timeout_s: float = 30.0, costing: str = "truck"):
        self.url, self.timeout_s, self.costing = url.rstrip("/"), timeout_s, costing

    def ask(self, action: str, body: dict[str, Any]) -> dict[str, Any]:
        sent = urllib.request.Request(f"{self.url}/{action}", encode(body).encode(), {"Content-Type": "application/json"})
        with urllib.request.urlopen(sent, timeout=self.timeout_s) as answer:
            return decode(answer.read())

    def match(self, points: list[Point], times: list[float], request: dict):
        from waymark.plans.matching import Match

        body = trace_request(points, self.costing, **{k: v for k, v in request.items() if k in TRACE_OPTIONS})
        attributes = self.ask("trace_attributes", body)
        return Match(shapes(self.ask("trace_route", body)), way_ids(attributes), list(matched_points(attributes, points)))

    def ways(self, points: list[Point], request: dict) -> list[int]:
        return way_ids(self.ask("trace_attributes", trace_request(points, self.costing, only=["edge.way_id"], **{k: v for k, v in request.items() if k in TRACE_OPTIONS})))

    def route(self, start: Point, end: Point) -> list[Point]:
        return self.fetch_route(start, end).coords

    def fetch_route(self, start: Point, end: Point) -> Route:
        return route(self.ask("route", route_request(start, end, self.costing)))
