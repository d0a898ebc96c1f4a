"""Quality of matched paths: length ratio, heading reversals, breaks, and a verdict."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from waymark.functions import geo

#: Shortest leg with a heading (m), reversal (degrees), and the limits of a sound match.
MIN_LEG_M, REVERSAL_DEG = 10.0, 150.0
RATIO, MAX_REVERSALS = (0.7, 1.5), 5


def legs(points: DataFrame, by: list[str], order_col: str) -> DataFrame:
    """points with leg_m and leg_bearing from the point before, by group."""
    w = Window.partitionBy(*by).orderBy(order_col)
    lat, lon = F.lag("lat").over(w), F.lag("lon").over(w)
    return points.withColumn("leg_m", geo.haversine_atan2_m(lat, lon, "lat", "lon")).withColumn("leg_bearing", geo.bearing(lat, lon, "lat", "lon"))


def lengths_and_reversals(points: DataFrame, by: list[str], order_col: str) -> DataFrame:
    """Per group: length_m, and heading_reversals between consecutive legs that are long enough to have a heading."""
    w = Window.partitionBy(*by).orderBy(order_col)
    heading = legs(points, by, order_col).withColumn("_b", F.when(F.col("leg_m") >= MIN_LEG_M, F.col("leg_bearing")))
    before = F.last("_b", ignorenulls=True).over(w.rowsBetween(Window.unboundedPreceding, -1))
    flip = F.abs(geo.shortest_arc("_before", "_b")) > REVERSAL_DEG
    marked = heading.withColumn("_before", before).withColumn("_flip", F.coalesce(flip.cast("int"), F.lit(0)))
    return marked.groupBy(*by).agg(F.coalesce(F.sum("leg_m"), F.lit(0.0)).alias("length_m"), F.sum("_flip").cast("long").alias("heading_reversals"))


def path_quality(points: DataFrame, shapes: DataFrame, id_col: str = "id", time_col: str = "time") -> DataFrame:
    """id, n_points, path_length_ratio (matched to input length; null without one) and heading_reversals.

    points: id, time, lat, lon. shapes: id, polyline (number), seq, lat, lon.
    """
    walked = legs(points, [id_col], time_col).groupBy(id_col).agg(F.count(F.lit(1)).alias("n_points"), F.coalesce(F.sum("leg_m"), F.lit(0.0)).alias("_in"))
    each = lengths_and_reversals(shapes, [id_col, "polyline"], "seq")
    matched = each.groupBy(id_col).agg(F.sum("length_m").alias("_out"), F.sum("heading_reversals").cast("long").alias("heading_reversals"), F.count(F.lit(1)).alias("n_polylines"))
    both = walked.join(matched, id_col, "left")
    ratio = F.when(F.col("_in") > 0, F.coalesce("_out", F.lit(0.0)) / F.col("_in"))
    return both.select(id_col, "n_points", F.coalesce("n_polylines", F.lit(0)).alias("n_polylines"), ratio.alias("path_length_ratio"), F.coalesce("heading_reversals", F.lit(0)).alias("heading_reversals"))


def polyline_breaks(shapes: DataFrame, id_col: str = "id") -> DataFrame:
    """Jumps from the end of each polyline to the start of the next: id, polyline, gap_m."""
    ends = shapes.groupBy(id_col, "polyline").agg(F.min_by(F.struct("lat", "lon"), "seq").alias("a"), F.max_by(F.struct("lat", "lon"), "seq").alias("b"))
    w = Window.partitionBy(id_col).orderBy("polyline")
    last = F.lag("b").over(w)
    return ends.select(id_col, "polyline", geo.haversine_atan2_m(last["lat"], last["lon"], F.col("a.lat"), F.col("a.lon")).alias("gap_m")).filter("gap_m is not null")


def bridge_summary(bridges: DataFrame, id_col: str = "id") -> DataFrame:
    """Per trip: n_bridges, max_detour_ratio, total_bridge_m, any_bridge_failed (bridges: id, detour_ratio, bridge_m, ok)."""
    return bridges.groupBy(id_col).agg(F.count(F.lit(1)).alias("n_bridges"), F.max("detour_ratio").alias("max_detour_ratio"), F.sum("bridge_m").alias("total_bridge_m"), F.max(~F.col("ok")).alias("any_bridge_failed"))


def has_issues(error: Column, n_polylines: Column, ratio: Column, reversals: Column, bridge_failed: Column | None = None) -> Column:
    """Whether a match needs a look: an error, breaks, a length out of proportion, too many reversals, or a failed bridge."""
    bad = error.isNotNull() | (n_polylines > 1) | F.coalesce((ratio < RATIO[0]) | (ratio > RATIO[1]), F.lit(False)) | (reversals > MAX_REVERSALS)
    return bad | F.coalesce(bridge_failed, F.lit(False)) if bridge_failed is not None else bad
