"""Composite trip ids and storage keys."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def trip_id(truck="id", gap="gap_segment_id", segment="segment_id") -> Column:
    """`{truck}_gap{N}_trip{M}`"""
    return F.concat(F.col(truck), F.lit("_gap"), F.col(gap).cast("string"), F.lit("_trip"), F.col(segment).cast("string"))


def truck_of(trip="id") -> Column:
    """What stands before the first `_gap`."""
    return F.substring_index(F.col(trip), "_gap", 1)


def raw_chunk(truck="id") -> Column:
    """Chunk key of raw data: the last two characters of a truck's id."""
    return F.right(F.col(truck), F.lit(2))


def trip_chunk(trip="id") -> Column:
    """Chunk key of the index of trips: the last three characters of the truck's id."""
    return F.right(truck_of(trip), F.lit(3))


def truck_id_from_trip(trip: str) -> str:
    return trip.split("_gap")[0]
