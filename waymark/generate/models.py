"""What a synthetic trip is made from."""

from __future__ import annotations

from dataclasses import dataclass, field, replace
from datetime import datetime, timedelta
from typing import Any

STEP_S = 60


@dataclass(frozen=True)
class TracePoint:
    time: datetime
    lat: float
    lon: float
    speed: float  # mph
    heading: float

    def at(self, **changes: Any) -> TracePoint:
        return replace(self, **changes)

    def later(self, seconds: float) -> TracePoint:
        return replace(self, time=self.time + timedelta(seconds=seconds))


@dataclass(frozen=True)
class RouteSegment:
    """A stretch of road: its line, length and how fast cars drive there (m/s)."""

    line: tuple[tuple[float, float], ...]
    length_m: float
    speed_mps: float
    urban: bool = False


@dataclass(frozen=True)
class ErrorConfig:
    kind: str
    probability: float = 1.0
    params: dict[str, Any] = field(default_factory=dict)


@dataclass(frozen=True)
class TripConfig:
    trip_id: str
    origin: tuple[float, float]
    destination: tuple[float, float]
    departure: datetime
    seed: int = 0
    arrival_manoeuvre: str | None = None
    departure_manoeuvre: str | None = None
    noise_m: float = 3.0
    errors: list[ErrorConfig] = field(default_factory=list)


#: The default profile, each kind with its probability, and parameters of some kinds.
PROFILE = {
    "jitter_at_rest": 0.25, "signal_dropout": 0.08, "cold_start_drift": 0.10, "device_power_cycle": 0.07, "multipath": 0.05, "speed_heading_desync": 0.05,
    "frozen_fix": 0.03, "timestamp_glitch": 0.01, "coordinate_corruption": 0.01, "stale_reemission": 0.04,
    "fuel_rest_stop": 0.20, "loading_dwell": 0.15, "weigh_station_stop": 0.10, "bobtail_segment": 0.08, "yard_dwell": 0.05, "traffic_jam": 0.06,
    "off_route_detour": 0.04, "privacy_shutoff": 0.03, "geofence_gap": 0.02, "relay_driving": 0.01,
}
PARAMS = {"multipath": {"count": 2}, "timestamp_glitch": {"count": 1}, "coordinate_corruption": {"count": 1}, "stale_reemission": {"count": 2}, "geofence_gap": {"center": (44.25, -76.5), "radius_m": 2000.0}}


def default_error_profile() -> list[ErrorConfig]:
    return [ErrorConfig(kind, p, PARAMS.get(kind, {})) for kind, p in PROFILE.items()]


def certain_error(kind: str) -> list[ErrorConfig]:
    """A profile that has one kind of error for sure."""
    return [ErrorConfig(kind, 1.0, PARAMS.get(kind, {}))]
