"""Road usage: counts of ways, their geometries, and reports by area."""

from __future__ import annotations

import math

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from waymark.functions.shape import wkb_measures
from waymark.schema import require


def collapse_repeats(df: DataFrame, id_col: str = "id", order_col: str = "time", way_col: str = "way_id") -> DataFrame:
    """Rows whose way differs from the vehicle's way before (rows without a way are left out first)."""
    w = Window.partitionBy(id_col).orderBy(order_col)
    known = df.filter(F.col(way_col).isNotNull()).withColumn("_before", F.lag(way_col).over(w))
    return known.filter(F.col("_before").isNull() | (F.col("_before") != F.col(way_col))).drop("_before")


def way_counts(ways: DataFrame) -> DataFrame:
    """Visits (rows) and different trips of each way; a way that a trip comes back to counts as two visits."""
    require(ways, "id", "way_id")
    return ways.filter("way_id is not null").groupBy("way_id").agg(F.count(F.lit(1)).alias("trip_count"), F.countDistinct("id").alias("n_trips"))


def way_geometry(counts: DataFrame, roads: DataFrame) -> DataFrame:
    """counts with the geometry of roads (feature_id `way/<id>`, geometry); ways unknown to roads keep a null one."""
    wanted = counts.select(F.concat(F.lit("way/"), F.col("way_id").cast("string")).alias("feature_id"))
    found = roads.join(wanted, "feature_id", "left_semi").select(F.substring("feature_id", 5, 30).cast("long").alias("way_id"), "geometry")
    return counts.join(found, "way_id", "left")


def way_index(joined: DataFrame) -> DataFrame:
    """joined with bounding box and centroid of each geometry."""
    return joined.withColumn("_m", wkb_measures("geometry")).select(*joined.columns, "_m.*")


#: Radius of the web map's sphere (m).
MERCATOR_M = 6_378_137.0


def to_degrees(bbox: tuple[float, float, float, float], crs: str) -> tuple[float, float, float, float]:
    """A box of web-map metres (EPSG:3857) in degrees; one of EPSG:4326 as it is. Other systems raise ValueError."""
    if crs == "EPSG:4326":
        return bbox
    if crs != "EPSG:3857":
        raise ValueError(f"unknown coordinate system: {crs}")
    lon = lambda x: math.degrees(x / MERCATOR_M)
    lat = lambda y: math.degrees(2 * math.atan(math.exp(y / MERCATOR_M)) - math.pi / 2)
    return lon(bbox[0]), lat(bbox[1]), lon(bbox[2]), lat(bbox[3])


def in_metres(index: DataFrame) -> DataFrame:
    """index with its boxes and centroids in web-map metres (EPSG:3857); geometries stay as they are."""
    x = lambda c: (F.radians(c) * MERCATOR_M).alias(c)
    y = lambda c: (F.log(F.tan(F.radians(c) / 2 + math.pi / 4)) * MERCATOR_M).alias(c)
    kind = {"bbox_xmin": x, "bbox_xmax": x, "centroid_x": x, "bbox_ymin": y, "bbox_ymax": y, "centroid_y": y}
    return index.select(*[kind[c](c) if c in kind else c for c in index.columns])


def load_area(index: DataFrame, bbox: tuple[float, float, float, float] | None = None, bbox_pad: float = 0.25, min_trip_count: int | None = None, top_n: int | None = None, bbox_crs: str = "EPSG:4326", to_crs: str = "EPSG:4326") -> DataFrame:
    """Ways whose box meets bbox (xmin, ymin, xmax, ymax in bbox_crs) widened by bbox_pad, most used first, in to_crs."""
    out = index
    if bbox is not None:
        dx, dy = (bbox[2] - bbox[0]) * bbox_pad, (bbox[3] - bbox[1]) * bbox_pad
        xmin, ymin, xmax, ymax = to_degrees((bbox[0] - dx, bbox[1] - dy, bbox[2] + dx, bbox[3] + dy), bbox_crs)
        out = out.filter((F.col("bbox_xmax") >= xmin) & (F.col("bbox_xmin") <= xmax) & (F.col("bbox_ymax") >= ymin) & (F.col("bbox_ymin") <= ymax))
    if min_trip_count is not None:
        out = out.filter(F.col("trip_count") >= min_trip_count)
    if to_crs not in ("EPSG:4326", "EPSG:3857"):
        raise ValueError(f"unknown coordinate system: {to_crs}")
    out = (out if to_crs == "EPSG:4326" else in_metres(out)).orderBy(F.desc("trip_count"), "way_id")
    return out.limit(top_n) if top_n is not None else out
