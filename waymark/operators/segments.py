"""Operators on segments of trajectories: gaps to bridge, grids, thinning, endpoints and stops."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from waymark.functions import geo
from waymark.schema import micros, require

#: Distances (m) and time (s) at which the route between two pings is bridged.
MAX_DIST_M, TIME_S, MIN_DIST_M = 5000.0, 240.0, 1000.0


def bridge_gaps(df: DataFrame, id_col: str = "id", time_col: str = "time", max_dist_m: float = MAX_DIST_M, time_s: float = TIME_S, min_dist_m: float = MIN_DIST_M) -> DataFrame:
    """df with dist_m and dt_s to the vehicle's next ping, cut_after, and bridge_segment (from 0, one more behind each cut)."""
    require(df, id_col, time_col, "lat", "lon")
    w = Window.partitionBy(id_col).orderBy(time_col)
    dist = geo.haversine_atan2_m("lat", "lon", F.lead("lat").over(w), F.lead("lon").over(w))
    us = micros(time_col)
    out = df.withColumn("dist_m", dist).withColumn("dt_s", (F.lead(us).over(w) - us) / 1e6)
    cut = (F.col("dist_m") > max_dist_m) | ((F.col("dt_s") > time_s) & (F.col("dist_m") > min_dist_m))
    out = out.withColumn("cut_after", F.coalesce(cut, F.lit(False)))
    before = F.coalesce(F.lag(F.col("cut_after").cast("int")).over(w), F.lit(0))
    return out.withColumn("_cut", before).withColumn("bridge_segment", F.sum("_cut").over(w.rowsBetween(Window.unboundedPreceding, 0)).cast("int")).drop("_cut")


def resample(df: DataFrame, step_s: int = 60, id_col: str = "id", time_col: str = "time") -> DataFrame:
    """(id, time, lat, lon, speed, heading) on a grid of step_s from each vehicle's first time to its last.

    Positions and speeds are linear between pings, headings turn the shorter way. Pings without
    time are left out; of pings at one time the last in order of position counts.
    """
    step = step_s * 1_000_000
    known = df.select(F.col(id_col).alias("id"), micros(time_col).alias("_t"), "lat", "lon", "speed", "heading").filter("_t is not null")
    w = Window.partitionBy("id").orderBy("_t", "lat", "lon")
    nxt = {c: F.lead(c).over(w) for c in ("_t", "lat", "lon", "speed", "heading")}
    spans = known.withColumn("_first", F.min("_t").over(Window.partitionBy("id"))).select("*", *[x.alias(f"{c}_b") for c, x in nxt.items()])
    # grid times in [this ping, next ping); the last ping has its own time alone
    low = F.col("_first") + F.ceil((F.col("_t") - F.col("_first")) / step).cast("long") * step
    high = F.when(F.col("_t_b").isNull(), F.col("_t")).otherwise(F.col("_t_b") - 1)
    grid = spans.withColumn("_at", F.explode(F.when(low <= high, F.sequence(low, high, F.lit(step).cast("long")))))
    share = F.when(F.col("_t_b").isNull(), 0.0).otherwise((F.col("_at") - F.col("_t")) / (F.col("_t_b") - F.col("_t")))
    between = lambda c: (F.col(c) + F.coalesce(F.col("_f") * (F.col(f"{c}_b") - F.col(c)), F.lit(0.0))).alias(c)
    turn = F.pmod(F.col("heading") + F.coalesce(F.col("_f") * geo.shortest_arc("heading", "heading_b"), F.lit(0.0)), F.lit(360.0))
    return grid.withColumn("_f", share).select("id", F.timestamp_micros("_at").cast("timestamp_ntz").alias("time"), between("lat"), between("lon"), between("speed"), turn.alias("heading"))


def downsample(df: DataFrame, max_points: int, id_col: str = "id", time_col: str = "time", segment_col: str = "segment_id") -> DataFrame:
    """Each vehicle's pings thinned to about max_points, with the first and last of every segment."""
    seg = Window.partitionBy(id_col, segment_col)
    counted = df.withColumn("_all", F.count(F.lit(1)).over(Window.partitionBy(id_col))).withColumn("_n", F.count(F.lit(1)).over(seg)).withColumn("_i", F.row_number().over(seg.orderBy(time_col)) - 1)
    budget = F.greatest(F.lit(2), F.floor(F.lit(max_points) * F.col("_n") / F.col("_all")).cast("int"))
    step = F.greatest(F.lit(1), F.floor(F.col("_n") / budget).cast("int"))
    keep = (F.col("_all") <= max_points) | (F.col("_n") <= 2) | (F.col("_i") % step == 0) | (F.col("_i") == F.col("_n") - 1)
    return counted.filter(keep).drop("_all", "_n", "_i")


def segment_endpoints(df: DataFrame, id_col: str = "id", time_col: str = "time") -> DataFrame:
    """First and last position, is_stop and number of pings of each segment."""
    point = F.struct("lat", "lon")
    found = df.groupBy(id_col, "segment_id").agg(F.min_by(point, time_col).alias("a"), F.max_by(point, time_col).alias("b"), F.min_by("is_stop", time_col).alias("is_stop"), F.count(F.lit(1)).alias("n_points"))
    return found.select(id_col, "segment_id", F.col("a.lat").alias("first_lat"), F.col("a.lon").alias("first_lon"), F.col("b.lat").alias("last_lat"), F.col("b.lon").alias("last_lon"), "is_stop", "n_points")


def stop_summary(df: DataFrame, id_col: str = "id", time_col: str = "time") -> DataFrame:
    """Each stop: centroid, pings, start, end, duration, and the ends of the movements on either side."""
    ends = segment_endpoints(df, id_col, time_col)
    w = Window.partitionBy(id_col).orderBy("segment_id")

    def beside(shift: int, lat: str, lon: str) -> list[Column]:
        moving = (~F.lag("is_stop", shift).over(w)) & (F.lag("segment_id", shift).over(w) == F.col("segment_id") - shift)
        return [F.when(moving, F.lag(c, shift).over(w)) for c in (lat, lon)]

    (from_lat, from_lon), (to_lat, to_lon) = beside(1, "last_lat", "last_lon"), beside(-1, "first_lat", "first_lon")
    joints = ends.select(id_col, "segment_id", "is_stop", from_lat.alias("from_lat"), from_lon.alias("from_lon"), to_lat.alias("to_lat"), to_lon.alias("to_lon")).filter("is_stop").drop("is_stop")
    us = micros(time_col)
    stops = df.filter("is_stop").groupBy(id_col, "segment_id").agg(F.avg("lat").alias("centroid_lat"), F.avg("lon").alias("centroid_lon"), F.count(F.lit(1)).alias("n_points"), F.min(time_col).alias("start"), F.max(time_col).alias("end"), ((F.max(us) - F.min(us)) / 1e6).alias("duration_s"))
    return stops.join(joints, [id_col, "segment_id"])


def bounds(df: DataFrame) -> DataFrame:
    """Smallest, largest and mean position of all rows."""
    return df.agg(*[f(c).alias(f"{n}_{c}") for c in ("lat", "lon") for n, f in (("min", F.min), ("max", F.max), ("mean", F.avg))])


def trip_recovery(df: DataFrame, id_col: str = "id", segment_col: str = "segment_id", truth_col: str = "trip") -> DataFrame:
    """Per found segment: how many true trips it mixes, which, and its rows."""
    return df.groupBy(id_col, segment_col).agg(F.countDistinct(truth_col).alias("n_trips"), F.sort_array(F.collect_set(truth_col)).alias("trips"), F.count(F.lit(1)).alias("n_rows"))


def compare_stops(a: DataFrame, b: DataFrame, id_col: str = "id", time_col: str = "time") -> DataFrame:
    """Stop pings of two splits by vehicle and day, side by side; what only one of them has is null in the other."""
    daily = lambda df, name: df.filter("is_stop").groupBy(id_col, F.to_date(time_col).alias("day")).agg(F.count(F.lit(1)).alias(name))
    return daily(a, "n_a").join(daily(b, "n_b"), [id_col, "day"], "full_outer")


def tile_dataset(df: DataFrame, copies: int, shift_s: int, id_col: str = "id", time_col: str = "time") -> DataFrame:
    """`copies` of df with ids and times of their own, for runs at a larger scale."""
    k = F.explode(F.sequence(F.lit(0), F.lit(copies - 1)))
    out = df.withColumn("_k", k)
    moved = (micros(time_col) + F.col("_k").cast("long") * (shift_s * 1_000_000))
    kind = df.schema[time_col].dataType
    return out.withColumn(id_col, F.concat(F.col(id_col), F.lit("#"), F.col("_k").cast("string"))).withColumn(time_col, F.timestamp_micros(moved).cast(kind)).drop("_k")
