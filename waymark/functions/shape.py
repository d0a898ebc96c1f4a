"""Polylines and geometries: decoding of encoded shapes and of WKB lines."""

from __future__ import annotations

import struct

import pandas as pd
from pyspark.sql import functions as F
from pyspark.sql import types as T

POINTS = T.ArrayType(T.StructType([T.StructField("lat", T.DoubleType()), T.StructField("lon", T.DoubleType())]))
MEASURES = ("bbox_xmin", "bbox_ymin", "bbox_xmax", "bbox_ymax", "centroid_x", "centroid_y")


def decode_polyline(text: str, precision: int = 6) -> list[tuple[float, float]]:
    """(lat, lon) points of a polyline: zigzag deltas in groups of five bits."""
    values, value, shift = [], 0, 0
    for ch in text:
        bits = ord(ch) - 63
        value |= (bits & 0x1F) << shift
        shift += 5
        if bits < 0x20:
            values.append(~(value >> 1) if value & 1 else value >> 1)
            value, shift = 0, 0
    out, lat, lon, unit = [], 0, 0, 10**precision
    for dy, dx in zip(values[::2], values[1::2]):
        lat, lon = lat + dy, lon + dx
        out.append((lat / unit, lon / unit))
    return out


def join_legs(legs: list[list[tuple[float, float]]]) -> list[tuple[float, float]]:
    """Legs end to end; a leg's first point is left out if the line already ends there."""
    line: list[tuple[float, float]] = []
    for leg in legs:
        line += leg[1:] if line and leg and leg[0] == line[-1] else leg
    return line


@F.pandas_udf(POINTS)
def polyline6(shape: pd.Series) -> pd.Series:
    return shape.map(lambda s: None if s is None else [{"lat": a, "lon": b} for a, b in decode_polyline(s)])


def wkb_line(raw: bytes) -> list[tuple[float, float]]:
    """(x, y) points of a WKB LineString or of the parts of a MultiLineString."""
    order = "<" if raw[0] else ">"
    kind, n = struct.unpack_from(order + "II", raw, 1)
    if kind == 2:
        flat = struct.unpack_from(f"{order}{2 * n}d", raw, 9)
        return list(zip(flat[::2], flat[1::2]))
    if kind == 5:
        out, at = [], 9
        for _ in range(n):
            part = wkb_line(raw[at:])
            out += part
            at += 9 + 16 * len(part)
        return out
    raise ValueError(f"WKB type {kind} is not a line")


def line_measures(points: list[tuple[float, float]]) -> dict[str, float]:
    """Bounding box and length-weighted centroid."""
    xs, ys = zip(*points)
    lengths = [((b[0] - a[0]) ** 2 + (b[1] - a[1]) ** 2) ** 0.5 for a, b in zip(points, points[1:])]
    total = sum(lengths)
    if total:
        cx = sum((a[0] + b[0]) / 2 * d for a, b, d in zip(points, points[1:], lengths)) / total
        cy = sum((a[1] + b[1]) / 2 * d for a, b, d in zip(points, points[1:], lengths)) / total
    else:
        cx, cy = sum(xs) / len(xs), sum(ys) / len(ys)
    return {"bbox_xmin": min(xs), "bbox_ymin": min(ys), "bbox_xmax": max(xs), "bbox_ymax": max(ys), "centroid_x": cx, "centroid_y": cy}


@F.pandas_udf(T.StructType([T.StructField(c, T.DoubleType()) for c in MEASURES]))
def wkb_measures(geometry: pd.Series) -> pd.DataFrame:
    rows = [line_measures(wkb_line(g)) if g is not None else dict.fromkeys(MEASURES) for g in geometry]
    return pd.DataFrame(rows, columns=list(MEASURES), dtype="float64")
