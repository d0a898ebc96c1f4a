"""Trip metadata and spatial keys."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from waymark.functions import geo
from waymark.schema import require


def _boxed(points: DataFrame, id_col: str, order: Sequence[Column | str]) -> DataFrame:
    """points with their trip's centroid_lat, centroid_lon, bbox_diag_km and, as _nth, their number in the trip.

    Sums of doubles depend on their order in the last bit, and a centroid on the border of a tile or
    Hilbert cell falls to either side by it. So positions are added up in a fixed order, not in that
    in which an exchange happens to deal rows: by `order`, and where it leaves ties, by lat and lon.
    """
    w = Window.partitionBy(id_col).orderBy(*order, "lat", "lon")
    whole = w.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    sides = [f(c).over(whole).alias(f"_{n}_{c}") for c in ("lat", "lon") for n, f in (("min", F.min), ("max", F.max))]
    boxed = points.select("*", F.avg("lat").over(whole).alias("centroid_lat"), F.avg("lon").over(whole).alias("centroid_lon"), *sides, F.row_number().over(w).alias("_nth"))
    return boxed.withColumn("bbox_diag_km", geo.haversine_km("_min_lat", "_min_lon", "_max_lat", "_max_lon"))


def trip_metadata(points: DataFrame, id_col: str = "id", order: Sequence[Column | str] = ()) -> DataFrame:
    """One row per trip: id, centroid_lat, centroid_lon, bbox_diag_km; positions are added up by `order`, then lat, lon.

    The same rows give the same doubles however they are dealt, and those that partition_points uses.
    """
    require(points, id_col, "lat", "lon")
    return _boxed(points, id_col, order).filter(F.col("_nth") == 1).select(id_col, "centroid_lat", "centroid_lon", "bbox_diag_km")


def assign_partitions(meta: DataFrame) -> DataFrame:
    """meta (centroid_lat, centroid_lon, bbox_diag_km) with tier, partition_id and hilbert_idx."""
    require(meta, "centroid_lat", "centroid_lon", "bbox_diag_km")
    return meta.withColumns({
        "tier": geo.tier("bbox_diag_km"),
        "partition_id": geo.partition_id("centroid_lat", "centroid_lon", "bbox_diag_km"),
        "hilbert_idx": geo.hilbert_index("centroid_lat", "centroid_lon"),
    })


def partition_points(points: DataFrame, id_col: str = "id", order: Sequence[Column | str] = ()) -> DataFrame:
    """points with their trip's tier, partition_id and hilbert_idx; window aggregates share one exchange by trip.

    Points are worked out once: an aggregate joined back would run all that comes before it (such as
    a whole trip pipeline) twice. Keys equal those of trip_metadata with the same `order`.
    """
    require(points, id_col, "lat", "lon")
    return assign_partitions(_boxed(points, id_col, order)).select(*points.columns, "tier", "partition_id", "hilbert_idx")


def partition_summary(keyed: DataFrame) -> DataFrame:
    """Distinct partitions of each tier."""
    return keyed.groupBy("tier").agg(F.countDistinct("partition_id").alias("n_partitions"))


def top_partitions(keyed: DataFrame, n: int) -> DataFrame:
    """The n largest partitions of each tier, by rows."""
    counts = keyed.groupBy("tier", "partition_id").agg(F.count(F.lit(1)).alias("n_rows"))
    w = Window.partitionBy("tier").orderBy(F.desc("n_rows"), "partition_id")
    return counts.withColumn("rank", F.row_number().over(w)).filter(F.col("rank") <= n)


def timing_stats(timing: DataFrame) -> DataFrame:
    """Per tier and partition: trips, seconds (sum, median, 95th percentile), share of failures, ms a point.

    timing has tier, partition_id, ok, n_points, elapsed_s.
    """
    return timing.groupBy("tier", "partition_id").agg(
        F.count(F.lit(1)).alias("trips"), F.sum("elapsed_s").alias("sum_s"), F.median("elapsed_s").alias("median_s"), F.percentile("elapsed_s", 0.95).alias("p95_s"),
        F.avg(F.when(F.col("ok"), 0.0).otherwise(1.0)).alias("fail_rate"), (F.sum("elapsed_s") * 1000 / F.sum("n_points")).alias("ms_per_point"),
    )
