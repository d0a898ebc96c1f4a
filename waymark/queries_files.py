"""More queries of the registry: layouts that are written and read back, lookups, shapes, matching, and a rougher fixture."""

from __future__ import annotations

import struct
import tempfile
import uuid
from collections.abc import Iterator
from datetime import timedelta

import pandas as pd
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from waymark.functions import geo, ids, shape
from waymark.operators import quality, segments, trajectory, ways
from waymark.plans import layout, matching
from waymark.queries import ALL, GAP, KEYS, _keyed, brg, gap_cte, hav, query, sql, steps_cte, stops_cte
from waymark.sources import readers


def scratch(spark: SparkSession, name: str) -> str:
    """A new folder's path where driver and executors both write: under spark.checkpoint.dir, or (unset, as in tests) a temporary one."""
    root = spark.conf.get("spark.checkpoint.dir", None) or tempfile.gettempdir()
    return f"{root.rstrip('/')}/waymark-queries/{spark.sparkContext.applicationId}/{name}-{uuid.uuid4().hex}"


# --- Scalars -----------------------------------------------------------------------------------


@query(sql("SELECT id, time, CASE WHEN d > 180 THEN 360 - d ELSE d END AS turn FROM (SELECT id, time, (heading - lag(heading) OVER (PARTITION BY id ORDER BY time) + 360.0::DOUBLE) % 360.0::DOUBLE AS d FROM gps)"))
def heading_change(p: DataFrame) -> DataFrame:
    before = F.lag("heading").over(Window.partitionBy("id").orderBy("time"))
    return p.withColumn("b", before).select("id", "time", geo.angular_difference("heading", "b").alias("turn"))


@query(sql("SELECT id, time, round(lat + speed / 111320.0::DOUBLE, 9) AS lat, round(lon + heading / (111320.0::DOUBLE * cos(radians(lat))), 9) AS lon FROM gps"))
def metre_offset(p: DataFrame) -> DataFrame:
    lat, lon = geo.offset("lat", "lon", "speed", "heading")
    return p.select("id", "time", F.round(lat, 9).alias("lat"), F.round(lon, 9).alias("lon"))


@query(sql("SELECT id, time, speed * 2.23694::DOUBLE AS mph, speed * 0.44704::DOUBLE AS mps, CASE WHEN speed > 22 THEN least(speed, 29.0::DOUBLE) WHEN speed > 11 THEN least(speed, 15.6::DOUBLE) ELSE least(speed, 11.2::DOUBLE) END AS cap FROM gps"))
def truck_speeds(p: DataFrame) -> DataFrame:
    return p.select("id", "time", geo.mps_to_mph("speed").alias("mph"), geo.mph_to_mps("speed").alias("mps"), geo.truck_speed_cap("speed").alias("cap"))


@query(sql(f"SELECT id, round(greatest(3000.0::DOUBLE, least(20000.0::DOUBLE, 1.5::DOUBLE * max({hav('lat', 'lon', 'lat2', 'lon2')}))), 3) AS breakage_m FROM steps GROUP BY id", steps_cte("gps")))
def breakage_distance(p: DataFrame) -> DataFrame:
    w = Window.partitionBy("id").orderBy("time")
    step = p.withColumn("m", geo.haversine_m("lat", "lon", F.lead("lat").over(w), F.lead("lon").over(w)))
    return step.groupBy("id").agg(F.round(geo.breakage_distance(F.max("m"), 20_000.0), 3).alias("breakage_m"))


#: Published example of the encoding, at five decimals, and the same numbers at six.
@query("SELECT * FROM (VALUES (0, 3.85::DOUBLE, -12.02::DOUBLE), (1, 4.07::DOUBLE, -12.095::DOUBLE), (2, 4.3252::DOUBLE, -12.6453::DOUBLE)) t(seq, lat, lon)")
def polyline_decode(p: DataFrame) -> DataFrame:
    coded = p.limit(1).select(shape.polyline6(F.lit("_p~iF~ps|U_ulLnnqC_mqNvxq`@")).alias("line"))
    return coded.select(F.posexplode("line").alias("seq", "at")).select("seq", F.round("at.lat", 9).alias("lat"), F.round("at.lon", 9).alias("lon"))


# --- Stops near the threshold, with nulls -------------------------------------------------------


def _rough(p: DataFrame) -> DataFrame:
    """Positions within some 450 m of each other, every thirteenth unknown, so that boxes are often just too large."""
    n = F.unix_micros(F.col("time").cast("timestamp")) / 1_000_000
    s = F.floor(n).cast("long")
    lat = F.lit(43.0) + ((s * 7919) % 11).cast("double") * 0.0004
    lon = F.lit(-79.0) + ((s * 104729) % 13).cast("double") * 0.0004
    return p.withColumns({"lat": F.when(s % 13 != 5, lat), "lon": F.when(s % 17 != 3, lon)})


ROUGH = """rough AS MATERIALIZED (SELECT id, time, CASE WHEN s % 13 <> 5 THEN 43.0::DOUBLE + ((s * 7919) % 11)::DOUBLE * 0.0004::DOUBLE END AS lat,
  CASE WHEN s % 17 <> 3 THEN -79.0::DOUBLE + ((s * 104729) % 13)::DOUBLE * 0.0004::DOUBLE END AS lon, speed, heading
  FROM (SELECT *, CAST(floor(epoch_us(time)::DOUBLE / 1000000) AS BIGINT) AS s FROM gps))"""


@query(sql(f"SELECT {ALL}, segment_id, is_stop FROM stopped", ROUGH, stops_cte("rough", 400, 3600)))
def split_by_stops_rough(p: DataFrame) -> DataFrame:
    return trajectory.split_by_stops(_rough(p), 400.0, timedelta(hours=1))


# --- Layouts, written and read back -------------------------------------------------------------


def _written(p: DataFrame, times: int = 1) -> str:
    """A partitioned dataset of the pings' trips in `times` appended parts."""
    out = scratch(p.sparkSession, "trips")
    keyed = _keyed(p).withColumn("_part", F.pmod(F.xxhash64("id"), F.lit(times)))
    for k in range(times):
        layout.write_partitions(keyed.filter(F.col("_part") == k).drop("_part"), out)
    return out


def _numbered(df: DataFrame) -> DataFrame:
    """Partition numbers as numbers, also where a session reads folder names as text."""
    return df.withColumn("partition_id", F.col("partition_id").cast("long"))


PLACED = f"placed AS (SELECT {ALL}, tier, partition_id, hilbert_idx FROM both_ b JOIN (SELECT id, tier, partition_id, hilbert_idx FROM keyed) USING (id))"


@query(sql(f"SELECT {ALL}, tier, partition_id, hilbert_idx FROM placed", *KEYS, PLACED))
def written_partitions(p: DataFrame) -> DataFrame:
    """The layout read back, in the SQL's order of columns: Spark puts those of folder names last."""
    return _numbered(readers.read_parquet(p.sparkSession, _written(p))).select(*p.columns, *layout.KEYS, "hilbert_idx")


@query(sql("SELECT tier, partition_id, count(*) AS n_rows, 1::BIGINT AS n_files FROM placed GROUP BY ALL", *KEYS, PLACED))
def compacted_partitions(p: DataFrame) -> DataFrame:
    spark, out = p.sparkSession, _written(p, 2)
    layout.compact_partitions(spark, out)
    back = _numbered(spark.read.parquet(out).withColumn("file", F.col("_metadata.file_path")))
    return back.groupBy("tier", "partition_id").agg(F.count(F.lit(1)).alias("n_rows"), F.countDistinct("file").alias("n_files"))


@query(sql("SELECT tier, count(*) AS n_rows, count(DISTINCT id) AS n_trips, CAST(sum(hilbert_idx) AS BIGINT) AS hilbert_sum, true AS none_too_large FROM placed GROUP BY tier", *KEYS, PLACED))
def rebalanced_partitions(p: DataFrame) -> DataFrame:
    """Rows by tier after rebalancing; a partition has no more rows than 1.5 targets, or than rows share its largest number."""
    spark, out, target = p.sparkSession, _written(p), 500
    layout.rebalance_partitions(spark, out, target)
    back = spark.read.parquet(out)
    ties = back.groupBy("tier", "hilbert_idx").count().groupBy("tier").agg(F.max("count").alias("most"))
    small = back.groupBy("tier", "partition_id").count().join(ties, "tier").groupBy("tier").agg(F.max(F.col("count") <= F.lit(1.5 * target) + 2 * F.col("most")).alias("none_too_large"))
    return back.groupBy("tier").agg(F.count(F.lit(1)).alias("n_rows"), F.countDistinct("id").alias("n_trips"), F.sum("hilbert_idx").alias("hilbert_sum")).join(small, "tier")


@query(sql("SELECT right(id, 3) AS chunk_id, count(DISTINCT id) AS n_trips FROM both_ WHERE id NOT LIKE '%\\_2%' ESCAPE '\\' GROUP BY 1", *KEYS))
def chunk_index(p: DataFrame) -> DataFrame:
    """Trips of each chunk, found through the index of files alone."""
    spark, out = p.sparkSession, _written(p)
    index = readers.chunk_files(spark.read.parquet(out)).select("chunk_id", F.explode("paths").alias("path"))
    rows = spark.read.parquet(out).select("id", F.col("_metadata.file_path").alias("path")).distinct()
    found = rows.join(index, "path").filter((ids.trip_chunk("id") == F.col("chunk_id")) & ~F.col("id").like(r"%\_2%"))
    return found.groupBy("chunk_id").agg(F.countDistinct("id").alias("n_trips"))


@query(sql(f"SELECT {ALL}, tier, partition_id, hilbert_idx FROM placed WHERE id = 'truck_000004'", *KEYS, PLACED))
def indexed_trip(p: DataFrame) -> DataFrame:
    spark, out = p.sparkSession, _written(p)
    readers.ChunkIndex.build(spark, out).save()
    return _numbered(readers.ChunkIndex.load(out).scan_trip(spark, "truck_000004"))


@query(sql(f"SELECT {ALL}, tier, partition_id, hilbert_idx FROM placed WHERE id IN ('truck_000003', 'truck_000005')", *KEYS, PLACED))
def scanned_trips(p: DataFrame) -> DataFrame:
    spark, out = p.sparkSession, _written(p)
    return _numbered(readers.union_relaxed([readers.scan_partitioned_trip(spark, out, "truck_000003"), readers.scan_trips(spark, out, ["truck_000005"])]))


@query(sql(f"SELECT {ALL}, CAST(year(time) AS VARCHAR) AS year, right(id, 2) AS chunk_id FROM gps WHERE id = 'truck_000003'"))
def scan_raw_truck(p: DataFrame) -> DataFrame:
    out = scratch(p.sparkSession, "raw")
    raw = p.withColumn("year", F.year("time").cast("string")).withColumn("chunk_id", ids.raw_chunk("id"))
    raw.repartition("year", "chunk_id").write.partitionBy("year", "chunk_id").parquet(out)
    return readers.scan_raw_truck(p.sparkSession, out, "truck_000003")


@query(sql("SELECT id, strftime(time, '%Y-%m-%dT%H:%M:%SZ') AS time, printf('%.6f', lat) AS lat, printf('%.6f', lon) AS lon, printf('%.1f', speed) AS speed, printf('%.1f', heading) AS heading FROM gps"))
def traces_as_csv(p: DataFrame) -> DataFrame:
    out = scratch(p.sparkSession, "csv")
    readers.traces_to_csv(p, out)
    return p.sparkSession.read.option("header", True).csv(out)


@query(sql("SELECT count(*) AS returned, count(*) AS in_footers FROM gps"))
def processed_file(p: DataFrame) -> DataFrame:
    """Rows that the file variant of an operator says it wrote, and those in the footers of its files."""
    spark, src, out = p.sparkSession, scratch(p.sparkSession, "in"), scratch(p.sparkSession, "out")
    p.write.parquet(src)
    n = readers.file_operator(readers.process)(spark, src, out)
    return spark.createDataFrame([(n, layout.parquet_rows(spark, out))], "returned long, in_footers long")


# --- Shapes and roads ---------------------------------------------------------------------------


def _lines(p: DataFrame) -> DataFrame:
    """Each vehicle's way as a WKB line."""

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            raw = [struct.pack(f"<BII{2 * len(line)}d", 1, 2, len(line), *(x for q in line for x in (q["lon"], q["lat"]))) for line in frame["line"]]
            yield pd.DataFrame({"id": frame["id"], "geometry": raw})

    lines = p.groupBy("id").agg(F.array_sort(F.collect_list(F.struct("time", "lon", "lat"))).alias("line"))
    return lines.select("id", F.transform("line", lambda q: F.struct(q["lon"].alias("lon"), q["lat"].alias("lat"))).alias("line")).mapInPandas(run, "id string, geometry binary")


@query(
    sql(
        "SELECT id, min(lon) AS bbox_xmin, min(lat) AS bbox_ymin, max(lon) AS bbox_xmax, max(lat) AS bbox_ymax, round(sum((lon + lon2) / 2 * m) / sum(m), 6) AS centroid_x, round(sum((lat + lat2) / 2 * m) / sum(m), 6) AS centroid_y FROM l GROUP BY id",
        steps_cte("gps"),
        "l AS (SELECT *, sqrt(pow(lat2 - lat, 2) + pow(lon2 - lon, 2)) AS m FROM steps)",
    )
)
def way_index(p: DataFrame) -> DataFrame:
    found = ways.way_index(_lines(p)).drop("geometry")
    return found.withColumns({c: F.round(c, 6) for c in ("centroid_x", "centroid_y")})


@query(
    sql(
        f"SELECT id, segment_id AS polyline, round({hav('plat', 'plon', 'alat', 'alon')}, 3) AS gap_m FROM (SELECT *, lag(zlat) OVER w AS plat, lag(zlon) OVER w AS plon FROM e WINDOW w AS (PARTITION BY id ORDER BY segment_id)) WHERE plat IS NOT NULL",
        gap_cte("gps", 43200),
        "e AS (SELECT id, segment_id, arg_min(lat, time) AS alat, arg_min(lon, time) AS alon, arg_max(lat, time) AS zlat, arg_max(lon, time) AS zlon FROM gapped GROUP BY ALL)",
    )
)
def polyline_breaks(p: DataFrame) -> DataFrame:
    cut = trajectory.split_by_observation_gap(p, GAP)
    lines = cut.select("id", F.col("segment_id").alias("polyline"), F.col("time").alias("seq"), "lat", "lon")
    return quality.polyline_breaks(lines).withColumn("gap_m", F.round("gap_m", 3))


@query(
    sql(
        "SELECT id, count(*) AS n_bridges, round(max(d / 1000), 6) AS max_detour_ratio, round(sum(d), 2) AS total_bridge_m, bool_or(d > 2000000) AS any_bridge_failed FROM b WHERE d > 5000 OR (t > 240 AND d > 1000) GROUP BY id",
        steps_cte("gps"),
        f"b AS (SELECT *, {hav('lat', 'lon', 'lat2', 'lon2')} AS d, (epoch_us(lead(time) OVER (PARTITION BY id ORDER BY time)) - epoch_us(time)) / 1e6 AS t FROM steps)",
    )
)
def bridge_summary(p: DataFrame) -> DataFrame:
    cut = segments.bridge_gaps(p).filter("cut_after")
    s = quality.bridge_summary(cut.select("id", (F.col("dist_m") / 1000).alias("detour_ratio"), F.col("dist_m").alias("bridge_m"), (F.col("dist_m") <= 2_000_000).alias("ok")))
    return s.select("id", "n_bridges", F.round("max_detour_ratio", 6).alias("max_detour_ratio"), F.round("total_bridge_m", 2).alias("total_bridge_m"), "any_bridge_failed")


# --- Matching -----------------------------------------------------------------------------------

CELL = "CAST(floor((lat + 90.0::DOUBLE) / 0.01::DOUBLE) AS BIGINT) * 100000 + CAST(floor((lon + 180.0::DOUBLE) / 0.01::DOUBLE) AS BIGINT)"


@query(sql(f"SELECT id, (SELECT strftime(min(g.time), '%Y-%m-%d') FROM gps g WHERE g.id = c.id) AS date, way_id FROM (SELECT id, way_id, lag(way_id) OVER (PARTITION BY id ORDER BY time) AS b FROM (SELECT id, time, {CELL} AS way_id FROM gps)) c WHERE b IS DISTINCT FROM way_id"))
def matched_ways(p: DataFrame) -> DataFrame:
    return matching.ways_of(matching.match_trips(p, matching.StraightLine, mode="ways")).withColumn("date", F.col("date").cast("string"))


@query(sql("SELECT id, time, lat, lon, speed, heading, lat AS matched_lat, lon AS matched_lon, 0.0::DOUBLE AS distance_from_trace FROM gps"))
def matched_points(p: DataFrame) -> DataFrame:
    """With a matcher whose places are the pings, and without bridges."""
    return matching.matched_points(p, matching.StraightLine, bridges=False)


@query(
    sql(
        "SELECT s.segment_id, s.n_points, CASE WHEN s.m > 0 THEN 1.0::DOUBLE END AS path_length_ratio, r.n AS heading_reversals, r.n > 5 AS has_issues FROM s JOIN r USING (segment_id) WHERE s.n_points >= 2",
        "one AS (SELECT *, dense_rank() OVER (ORDER BY id) AS segment_id FROM gps)",
        f"l AS MATERIALIZED (SELECT *, {hav('la', 'lo', 'lat', 'lon')} AS m, {brg('la', 'lo', 'lat', 'lon')} AS b FROM (SELECT *, lag(lat) OVER (PARTITION BY segment_id ORDER BY time) AS la, lag(lon) OVER (PARTITION BY segment_id ORDER BY time) AS lo FROM one))",
        "s AS (SELECT segment_id, count(*) AS n_points, coalesce(sum(m), 0) AS m FROM l GROUP BY segment_id)",
        "v AS (SELECT *, lag(b) OVER (PARTITION BY segment_id ORDER BY time) AS pb FROM l WHERE m >= 10)",
        "r AS (SELECT l.segment_id, count(*) FILTER (v.pb IS NOT NULL AND abs((v.b - v.pb + 540.0::DOUBLE) % 360.0::DOUBLE - 180.0::DOUBLE) > 150) AS n FROM l LEFT JOIN v ON v.segment_id = l.segment_id AND v.time = l.time GROUP BY l.segment_id)",
    )
)
def inspected_quality(p: DataFrame) -> DataFrame:
    numbered = p.join(p.select("id").distinct().withColumn("segment_id", F.row_number().over(Window.orderBy("id"))), "id")  # a row a vehicle
    found = matching.evaluate_quality(numbered, matching.match_segments(numbered, matching.StraightLine))
    return found.select("segment_id", "n_points", F.round("path_length_ratio", 6).alias("path_length_ratio"), "heading_reversals", "has_issues")
