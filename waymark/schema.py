"""Schemas of pings and results, and checks made when a plan is built."""

from __future__ import annotations

from datetime import timedelta

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

PING = "id string, time timestamp_ntz, lat double, lon double, speed double, heading double"
WAYS = "id string, date date, way_id bigint"
QUALITY = "id string, date date, ok boolean, error string, n_points bigint, n_polylines bigint, path_length_ratio double, heading_reversals bigint, elapsed_s double, n_bridges bigint, max_detour_ratio double, total_bridge_m double, any_bridge_failed boolean"
TIMING = "tier string, partition_id bigint, skipped boolean, trips bigint, rows_out bigint, elapsed_s double"


def require(df: DataFrame, *columns: str) -> None:
    missing = [c for c in columns if c not in df.columns]
    if missing:
        raise ValueError(f"missing columns: {', '.join(missing)}")


def require_time(df: DataFrame, column: str) -> None:
    require(df, column)
    if not isinstance(df.schema[column].dataType, (T.TimestampType, T.TimestampNTZType)):
        raise ValueError(f"{column} must be a timestamp, not {df.schema[column].dataType.simpleString()}")


def require_doubles(df: DataFrame, *columns: str) -> None:
    require(df, *columns)
    for c in columns:
        if not isinstance(df.schema[c].dataType, T.DoubleType):
            raise ValueError(f"{c} must be double, not {df.schema[c].dataType.simpleString()}")


def micros(column: str | Column) -> Column:
    """Microseconds of a time, naive or not (the session's zone is UTC)."""
    return F.unix_micros((F.col(column) if isinstance(column, str) else column).cast("timestamp"))


def span_micros(span: timedelta | float | int) -> int:
    """Whole microseconds of a timedelta, or of seconds."""
    return int((span.total_seconds() if isinstance(span, timedelta) else float(span)) * 1_000_000)
