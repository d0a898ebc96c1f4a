"""Synthetic traces with injectable errors."""

from waymark.generate.errors import GPS, OPERATIONAL, apply_errors
from waymark.generate.models import ErrorConfig, RouteSegment, TracePoint, TripConfig, default_error_profile
from waymark.generate.trips import generate_database, generate_trace, generate_traces, random_trip, straight_route

__all__ = ["GPS", "OPERATIONAL", "ErrorConfig", "RouteSegment", "TracePoint", "TripConfig", "apply_errors", "default_error_profile", "generate_database", "generate_trace", "generate_traces", "random_trip", "straight_route"]
