"""Registry of the trajectory queries: name -> callable(spark, sf_dir), and the SQL that gives the same rows.

All run over the pings that sources.fixture makes of the events table.
"""

from __future__ import annotations

from collections.abc import Callable
from datetime import date, timedelta

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from waymark.functions import geo, ids
from waymark.operators import partition, quality, segments, trajectory, ways
from waymark.plans import layout, trips
from waymark.sources import readers
from waymark.sources.fixture import GPS_SQL, gps_points

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}

GAP, DIAMETER, DURATION = timedelta(hours=12), 250.0, timedelta(minutes=30)
R2 = "12742000.0::DOUBLE"


def query(sql: str | None = None) -> Callable:
    def register(f: Callable[[DataFrame], DataFrame]) -> Callable:
        QUERIES[f.__name__] = lambda spark, sf_dir: f(gps_points(spark, sf_dir))
        if sql:
            ORACLES[f.__name__] = sql
        return f

    return register


# --- SQL for the oracles -----------------------------------------------------------------------


def hav(a: str, b: str, c: str, d: str) -> str:
    """Metres between (a, b) and (c, d)."""
    return f"{R2} * asin(sqrt(pow(sin(radians({c} - {a}) / 2), 2) + cos(radians({a})) * cos(radians({c})) * pow(sin(radians({d} - {b}) / 2), 2)))"


def brg(a: str, b: str, c: str, d: str) -> str:
    raw = f"degrees(atan2(sin(radians({d} - {b})) * cos(radians({c})), cos(radians({a})) * sin(radians({c})) - sin(radians({a})) * cos(radians({c})) * cos(radians({d} - {b}))))"
    return f"(({raw}) + 360.0::DOUBLE) % 360.0::DOUBLE"


def tile(lat: str, lon: str, deg: int) -> str:
    cols, rows = 360 // deg, 180 // deg
    if 180 % deg:
        rows += 1
    return f"(greatest(least(CAST(floor(({lat} + 90.0::DOUBLE) / {deg}::DOUBLE) AS BIGINT), {rows - 1}), 0) * {cols} + greatest(least(CAST(floor(({lon} + 180.0::DOUBLE) / {deg}::DOUBLE) AS BIGINT), {cols - 1}), 0))"


def hilbert(source: str, keys: str) -> str:
    """CTEs that number (lat, lon) of `source` on the Hilbert curve: the result is h(keys, hilbert_idx)."""
    n = 4095
    first = f"h0 AS (SELECT {keys}, CAST(trunc(least(greatest((lon + 141.0::DOUBLE) / 89.0::DOUBLE * {n}.0::DOUBLE, 0), {n})) AS BIGINT) AS x, CAST(trunc(least(greatest((lat - 24.0::DOUBLE) / 60.0::DOUBLE * {n}.0::DOUBLE, 0), {n})) AS BIGINT) AS y, 0::BIGINT AS d FROM {source})"
    steps = [first]
    for i in range(12):
        s = 1 << (11 - i)
        rx, ry = f"(CASE WHEN x & {s} > 0 THEN 1 ELSE 0 END)", f"(CASE WHEN y & {s} > 0 THEN 1 ELSE 0 END)"
        fx, fy = f"(CASE WHEN {ry} = 0 AND {rx} = 1 THEN {n} - x ELSE x END)", f"(CASE WHEN {ry} = 0 AND {rx} = 1 THEN {n} - y ELSE y END)"
        steps.append(f"h{i + 1} AS (SELECT {keys}, CASE WHEN {ry} = 0 THEN {fy} ELSE {fx} END AS x, CASE WHEN {ry} = 0 THEN {fx} ELSE {fy} END AS y, d + {s}::BIGINT * {s} * xor(3 * {rx}, {ry}) AS d FROM h{i})")
    return ", ".join(steps) + f", h AS (SELECT {keys}, d AS hilbert_idx FROM h12)"


ALL = "id, time, lat, lon, speed, heading"


def gap_cte(source: str, seconds: float, out: str = "gapped") -> str:
    return f"""{out} AS (SELECT *, CAST(sum(late) OVER (PARTITION BY id ORDER BY time ROWS UNBOUNDED PRECEDING) AS INTEGER) AS segment_id
      FROM (SELECT *, CASE WHEN epoch_us(time) - lag(epoch_us(time)) OVER (PARTITION BY id ORDER BY time) > {int(seconds * 1e6)} THEN 1 ELSE 0 END AS late FROM {source}))"""


def stale_cte(source: str, window: int, out: str = "fresh") -> str:
    """Rows of source that the stale filter keeps."""
    key = "concat_ws('|', lat, lon, speed, heading)"
    return f"""{out}_r AS MATERIALIZED (SELECT *, row_number() OVER (PARTITION BY id ORDER BY time) AS rn, {key} AS k FROM {source}),
    {out}_w(id, rn, keep, ring) AS (
      SELECT id, rn, true, CASE WHEN speed = 0 THEN []::VARCHAR[] ELSE [k] END FROM {out}_r WHERE rn = 1
      UNION ALL
      SELECT r.id, r.rn, r.speed = 0 OR NOT list_contains(w.ring, r.k),
        CASE WHEN r.speed = 0 OR list_contains(w.ring, r.k) THEN w.ring ELSE list_append(w.ring, r.k)[-{window}:] END
      FROM {out}_w w JOIN {out}_r r ON r.id = w.id AND r.rn = w.rn + 1),
    {out} AS MATERIALIZED (SELECT r.* EXCLUDE (rn, k) FROM {out}_r r JOIN {out}_w w USING (id, rn) WHERE w.keep)"""


def speed_cte(source: str, kmh: float, out: str = "possible") -> str:
    dt = "(epoch_us(r.time) - epoch_us(w.since)) / 1e6::DOUBLE"
    far = f"({dt} > 0 AND {hav('w.alat', 'w.alon', 'r.lat', 'r.lon')} / ({dt}) > {kmh}::DOUBLE * (1000.0::DOUBLE / 3600.0::DOUBLE))"
    hold = f"({far} OR {dt} <= 0)"
    return f"""{out}_r AS MATERIALIZED (SELECT *, row_number() OVER (PARTITION BY id ORDER BY time) AS rn FROM {source}),
    {out}_w(id, rn, keep, alat, alon, since) AS (
      SELECT id, rn, true, lat, lon, time FROM {out}_r WHERE rn = 1
      UNION ALL
      SELECT r.id, r.rn, NOT {far}, CASE WHEN {hold} THEN w.alat ELSE r.lat END, CASE WHEN {hold} THEN w.alon ELSE r.lon END, CASE WHEN {hold} THEN w.since ELSE r.time END
      FROM {out}_w w JOIN {out}_r r ON r.id = w.id AND r.rn = w.rn + 1),
    {out} AS MATERIALIZED (SELECT r.* EXCLUDE (rn) FROM {out}_r r JOIN {out}_w w USING (id, rn) WHERE w.keep)"""


def stops_cte(source: str, diameter: float, seconds: float, out: str = "stopped") -> str:
    """source with is_stop and segment_id: boxes grown from every row, then the greedy chain over them."""
    deg = f"({diameter}::DOUBLE / 111000.0::DOUBLE)"
    s, n, w, e = "least(b.s, r.lat)", "greatest(b.n, r.lat)", "least(b.w, r.lon)", "greatest(b.e, r.lon)"
    return f"""{out}_r AS MATERIALIZED (SELECT *, row_number() OVER (PARTITION BY id ORDER BY time) AS rn FROM {source}),
    {out}_b(id, a, z, t, s, n, w, e, far) AS (
      SELECT id, rn, rn, epoch_us(time), lat, lat, lon, lon, 0::BIGINT FROM {out}_r WHERE lat IS NOT NULL AND lon IS NOT NULL
      UNION ALL
      SELECT b.id, b.a, r.rn, b.t, {s}, {n}, {w}, {e}, epoch_us(r.time) - b.t
      FROM {out}_b b JOIN {out}_r r ON r.id = b.id AND r.rn = b.z + 1
      WHERE r.lat IS NOT NULL AND r.lon IS NOT NULL AND {n} - {s} <= {deg} AND {e} - {w} <= {deg} AND {hav(s, w, n, e)} <= {diameter}::DOUBLE),
    {out}_e AS MATERIALIZED (SELECT r.id, r.rn AS a, max(b.z) FILTER (b.far >= {int(seconds * 1e6)}) AS z FROM {out}_r r LEFT JOIN {out}_b b ON b.id = r.id AND b.a = r.rn GROUP BY r.id, r.rn),
    {out}_c(id, a, z) AS (
      SELECT id, a, z FROM {out}_e WHERE a = 1
      UNION ALL
      SELECT e.id, e.a, e.z FROM {out}_c c JOIN {out}_e e ON e.id = c.id AND e.a = coalesce(c.z, c.a) + 1),
    {out}_f AS MATERIALIZED (SELECT r.*, c.id IS NOT NULL AS is_stop FROM {out}_r r LEFT JOIN {out}_c c ON c.id = r.id AND c.z IS NOT NULL AND r.rn BETWEEN c.a AND c.z),
    {segment_cte(f"{out}_f", out)}"""


def segment_cte(flagged: str, out: str) -> str:
    return f"""{out} AS MATERIALIZED (SELECT * EXCLUDE (turn), CAST(sum(turn) OVER (PARTITION BY id ORDER BY rn ROWS UNBOUNDED PRECEDING) AS INTEGER) AS segment_id
      FROM (SELECT *, CASE WHEN is_stop IS DISTINCT FROM lag(is_stop, 1, is_stop) OVER (PARTITION BY id ORDER BY rn) THEN 1 ELSE 0 END AS turn FROM {flagged}))"""


def short_cte(source: str, least: int, out: str) -> str:
    return f"""{out} AS MATERIALIZED (SELECT * EXCLUDE (n) FROM (SELECT *, count(time) OVER (PARTITION BY id, segment_id) AS n FROM {source}) WHERE is_stop OR n >= {least})"""


def traffic_cte(source: str, angle: float, metres: float, out: str = "true_stops") -> str:
    """source (with rn, is_stop, segment_id) with is_stop and segment_id after the traffic filter; rn is numbered anew."""
    return f"""{out}_r AS MATERIALIZED (SELECT * EXCLUDE (rn, segment_id), segment_id AS run, row_number() OVER (PARTITION BY id ORDER BY time) AS rn FROM {source}),
    {out}_s AS MATERIALIZED (SELECT id, g, min(rn) AS a, max(rn) AS z FROM (SELECT *, rn - row_number() OVER (PARTITION BY id ORDER BY rn) AS g FROM {out}_r WHERE is_stop) GROUP BY id, g),
    {out}_i AS MATERIALIZED (SELECT s.id, s.a, arg_max({{'lat': f.lat, 'lon': f.lon}}, f.rn) AS f, any_value({{'lat': p.lat, 'lon': p.lon}}) AS p
      FROM {out}_s s JOIN {out}_r p ON p.id = s.id AND p.rn = s.a - 1 JOIN {out}_r f ON f.id = s.id AND f.rn < p.rn
      WHERE {hav('f.lat', 'f.lon', 'p.lat', 'p.lon')} >= {metres}::DOUBLE GROUP BY s.id, s.a),
    {out}_o AS MATERIALIZED (SELECT s.id, s.a, arg_min({{'lat': f.lat, 'lon': f.lon}}, f.rn) AS f, any_value({{'lat': p.lat, 'lon': p.lon}}) AS p
      FROM {out}_s s JOIN {out}_r p ON p.id = s.id AND p.rn = s.z + 1 JOIN {out}_r f ON f.id = s.id AND f.rn > p.rn
      WHERE {hav('p.lat', 'p.lon', 'f.lat', 'f.lon')} >= {metres}::DOUBLE GROUP BY s.id, s.a),
    {out}_d AS MATERIALIZED (SELECT s.id, s.a, s.z, ({brg('i.f.lat', 'i.f.lon', 'i.p.lat', 'i.p.lon')} - {brg('o.p.lat', 'o.p.lon', 'o.f.lat', 'o.f.lon')} + 360.0::DOUBLE) % 360.0::DOUBLE AS d
      FROM {out}_s s JOIN {out}_i i USING (id, a) JOIN {out}_o o USING (id, a)),
    {out}_f AS MATERIALIZED (SELECT r.* EXCLUDE (is_stop, run), r.is_stop AND x.id IS NULL AS is_stop FROM {out}_r r
      LEFT JOIN {out}_d x ON x.id = r.id AND r.rn BETWEEN x.a AND x.z AND least(x.d, 360.0::DOUBLE - x.d) < {angle}::DOUBLE),
    {segment_cte(f"{out}_f", out)}"""


def sql(select: str, *ctes: str) -> str:
    return "WITH RECURSIVE " + ", ".join([GPS_SQL, *ctes]) + " " + select


def steps_cte(f: str) -> str:
    return f"steps AS (SELECT *, lead(lat) OVER w AS lat2, lead(lon) OVER w AS lon2 FROM {f} WINDOW w AS (PARTITION BY id ORDER BY time))"


# --- Scalar functions --------------------------------------------------------------------------


@query(sql("SELECT id, time, speed * (1000.0::DOUBLE / 3600.0::DOUBLE) AS speed_mps FROM gps"))
def speed_mps(p: DataFrame) -> DataFrame:
    return p.select("id", "time", geo.speed_mps("speed").alias("speed_mps"))


def _steps(p: DataFrame) -> DataFrame:
    w = Window.partitionBy("id").orderBy("time")
    return p.select("*", F.lead("lat").over(w).alias("lat2"), F.lead("lon").over(w).alias("lon2"))


@query(sql(f"SELECT id, time, round({hav('lat', 'lon', 'lat2', 'lon2')}, 3) AS metres FROM steps", steps_cte("gps")))
def haversine_steps(p: DataFrame) -> DataFrame:
    return _steps(p).select("id", "time", F.round(geo.haversine_m("lat", "lon", "lat2", "lon2"), 3).alias("metres"))


@query(sql(f"SELECT id, time, round({brg('lat', 'lon', 'lat2', 'lon2')}, 3) % 360.0::DOUBLE AS bearing FROM steps", steps_cte("gps")))
def bearing_steps(p: DataFrame) -> DataFrame:
    return _steps(p).select("id", "time", (F.round(geo.bearing("lat", "lon", "lat2", "lon2"), 3) % 360.0).alias("bearing"))


@query(sql(f"SELECT id, time, {tile('lat', 'lon', 1)} AS tile_1, {tile('lat', 'lon', 4)} AS tile_4, {tile('lat', 'lon', 8)} AS tile_8 FROM gps"))
def tile_ids(p: DataFrame) -> DataFrame:
    return p.select("id", "time", *[geo.tile_id("lat", "lon", d).alias(f"tile_{d}") for d in (1, 4, 8)])


TIER_SQL = "CASE WHEN {d} < 100 THEN 'local' WHEN {d} < 800 THEN 'regional' ELSE 'longhaul' END"


def key_sql(lat: str, lon: str, d: str) -> str:
    return f"CASE WHEN {d} < 100 THEN {tile(lat, lon, 1)} WHEN {d} < 800 THEN (1::BIGINT << 60) | {tile(lat, lon, 4)} ELSE (2::BIGINT << 60) | {tile(lat, lon, 8)} END"


@query(sql(f"SELECT id, time, {TIER_SQL.format(d='(speed * 20)')} AS tier, {key_sql('lat', 'lon', '(speed * 20)')} AS partition_id FROM gps"))
def tier_keys(p: DataFrame) -> DataFrame:
    d = F.col("speed") * 20
    return p.select("id", "time", geo.tier(d).alias("tier"), geo.partition_id("lat", "lon", d).alias("partition_id"))


@query(sql("SELECT * FROM h", hilbert("gps", "id, time")))
def hilbert_index(p: DataFrame) -> DataFrame:
    return p.select("id", "time", geo.hilbert_index("lat", "lon").alias("hilbert_idx"))


@query(sql("SELECT id, time, id || '_gap' || CAST(heading AS BIGINT) || '_trip' || CAST(speed AS BIGINT) AS trip, id AS truck, right(id, 2) AS raw_chunk, right(id, 3) AS trip_chunk FROM gps"))
def composite_ids(p: DataFrame) -> DataFrame:
    t = p.select("id", "time", F.col("heading").cast("long").alias("gap_segment_id"), F.col("speed").cast("long").alias("segment_id"))
    t = t.withColumn("trip", ids.trip_id())
    return t.select("id", "time", "trip", ids.truck_of("trip").alias("truck"), ids.raw_chunk("id").alias("raw_chunk"), ids.trip_chunk("trip").alias("trip_chunk"))


# --- Cleaning and splitting --------------------------------------------------------------------


@query(sql(f"SELECT {ALL}, segment_id FROM gapped", gap_cte("gps", 43200)))
def split_by_observation_gap(p: DataFrame) -> DataFrame:
    return trajectory.split_by_observation_gap(p, GAP)


@query(sql(f"SELECT {ALL}, segment_id FROM (SELECT *, count(time) OVER (PARTITION BY id, segment_id) AS n FROM gapped) WHERE n >= 3", gap_cte("gps", 43200)))
def split_by_observation_gap_min_length(p: DataFrame) -> DataFrame:
    return trajectory.split_by_observation_gap(p, GAP, min_length=3)


@query(sql(f"SELECT {ALL}, segment_id, is_stop FROM stopped", stops_cte("gps", 250, 1800)))
def split_by_stops(p: DataFrame) -> DataFrame:
    return trajectory.split_by_stops(p, DIAMETER, DURATION)


@query(sql(f"SELECT {ALL}, segment_id, is_stop FROM long_enough", stops_cte("gps", 250, 1800), short_cte("stopped", 2, "long_enough")))
def split_by_stops_min_length(p: DataFrame) -> DataFrame:
    return trajectory.split_by_stops(p, DIAMETER, DURATION, min_length=2)


@query(sql(f"SELECT {ALL} FROM fresh", stale_cte("gps", 5)))
def filter_stale_pings(p: DataFrame) -> DataFrame:
    return trajectory.filter_stale_pings(p, 5)


@query(sql(f"SELECT {ALL} FROM possible", speed_cte("gps", 200)))
def filter_impossible_speeds(p: DataFrame) -> DataFrame:
    return trajectory.filter_impossible_speeds(p, 200.0)


@query(sql(f"SELECT {ALL}, segment_id, is_stop FROM true_stops", stops_cte("gps", 250, 1800), traffic_cte("stopped", 30, 10)))
def filter_traffic_stops(p: DataFrame) -> DataFrame:
    return trajectory.filter_traffic_stops(trajectory.split_by_stops(p, DIAMETER, DURATION), 30.0, 10.0)


def chain_sql(source: str, least: int) -> tuple[str, ...]:
    """Gap segments of at least `least` times, then stops, movements of at least as many times, and the traffic filter."""
    gaps = "(SELECT * EXCLUDE (segment_id, late, n), segment_id AS gap_segment_id FROM (SELECT *, count(time) OVER (PARTITION BY id, segment_id) AS n FROM gapped) WHERE n >= {least} AND id IS NOT NULL)"
    return gap_cte(source, 43200), stops_cte(gaps.format(least=least), 250, 1800), short_cte("stopped", least, "long_enough"), traffic_cte("long_enough", 30, 10)


@query(sql(f"SELECT {ALL}, gap_segment_id, is_stop, CAST(dense_rank() OVER (ORDER BY gap_segment_id * 1000000 + segment_id) AS INTEGER) AS segment_id FROM true_stops", stale_cte("gps", 5), *chain_sql("fresh", 3)))
def split_trips(p: DataFrame) -> DataFrame:
    return trips.split_trips(p, GAP, DIAMETER, DURATION)


TRIP_SQL = "id || '_gap' || gap_segment_id || '_trip' || segment_id"
TRIPS = (stale_cte("gps", 5), speed_cte("fresh", 200), *chain_sql("possible", 2))


def _trips(p: DataFrame) -> DataFrame:
    return trips.trips(p, GAP, DIAMETER, DURATION)


@query(sql(f"SELECT {TRIP_SQL} AS id, time, lat, lon, speed, heading, gap_segment_id, segment_id, is_stop FROM true_stops", *TRIPS))
def pipeline_trips(p: DataFrame) -> DataFrame:
    return _trips(p)


# --- Spatial partitions ------------------------------------------------------------------------
# Vehicles as a whole are long-haul, their days below 60 degrees local: both groupings together have all tiers.


def _in_rows(p: DataFrame) -> DataFrame:
    """p with _row, a ping's place in the table: the order in which SQL adds up on one thread."""
    return p.select("*", F.struct("_metadata.file_name", "_metadata.row_index").alias("_row"))


def _both(p: DataFrame) -> DataFrame:
    days = p.filter("lat < 60").withColumn("id", F.concat("id", F.lit("_"), F.date_format("time", "yyyyMMdd")))
    return p.unionByName(days)


def _keyed(p: DataFrame) -> DataFrame:
    return partition.partition_points(_both(_in_rows(p)), order=["_row"]).drop("_row")


BOTH = "both_ AS (SELECT * FROM gps UNION ALL SELECT id || '_' || strftime(time, '%Y%m%d') AS id, time, lat, lon, speed, heading FROM gps WHERE lat < 60)"
META = f"meta AS MATERIALIZED (SELECT id, avg(lat) AS lat, avg(lon) AS lon, {hav('min(lat)', 'min(lon)', 'max(lat)', 'max(lon)')} / 1000.0::DOUBLE AS diag, count(*) AS n FROM both_ GROUP BY id)"
KEYED = f"keyed AS MATERIALIZED (SELECT meta.*, hilbert_idx, {TIER_SQL.format(d='diag')} AS tier, {key_sql('lat', 'lon', 'diag')} AS partition_id FROM meta JOIN h USING (id))"
KEYS = (BOTH, META, hilbert("meta", "id"), KEYED)


@query(sql("SELECT id, round(lat, 6) AS centroid_lat, round(lon, 6) AS centroid_lon, round(diag, 6) AS bbox_diag_km FROM meta", BOTH, META))
def trip_metadata(p: DataFrame) -> DataFrame:
    m = partition.trip_metadata(_both(_in_rows(p)), order=["_row"])
    return m.select("id", *[F.round(c, 6).alias(c) for c in ("centroid_lat", "centroid_lon", "bbox_diag_km")])


@query(sql("SELECT id, tier, partition_id, hilbert_idx FROM keyed", *KEYS))
def assign_partitions(p: DataFrame) -> DataFrame:
    return partition.assign_partitions(partition.trip_metadata(_both(_in_rows(p)), order=["_row"])).select("id", "tier", "partition_id", "hilbert_idx")


@query(sql(f"SELECT {ALL}, tier, partition_id, hilbert_idx FROM both_ b JOIN (SELECT id, tier, partition_id, hilbert_idx FROM keyed) USING (id)", *KEYS))
def partition_points(p: DataFrame) -> DataFrame:
    return _keyed(p)


@query(sql("SELECT tier, count(DISTINCT partition_id) AS n_partitions FROM keyed GROUP BY tier", *KEYS))
def partition_summary(p: DataFrame) -> DataFrame:
    return partition.partition_summary(_keyed(p))


@query(sql("SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY tier ORDER BY n_rows DESC, partition_id) AS rank FROM (SELECT tier, partition_id, CAST(sum(n) AS BIGINT) AS n_rows FROM keyed GROUP BY tier, partition_id)) WHERE rank <= 5", *KEYS))
def top_partitions_per_tier(p: DataFrame) -> DataFrame:
    return partition.top_partitions(_keyed(p), 5).withColumn("rank", F.col("rank").cast("long"))


@query(
    sql(
        "SELECT id, time, tier, hilbert_idx, CAST((SELECT count(*) FROM cuts c WHERE c.tier = r.tier AND c.cut <= r.hilbert_idx) AS INTEGER) AS slice FROM r",
        *KEYS,
        "r AS MATERIALIZED (SELECT b.id, time, tier, hilbert_idx, row_number() OVER (PARTITION BY tier ORDER BY hilbert_idx) - 1 AS i, count(*) OVER (PARTITION BY tier) AS n FROM both_ b JOIN keyed k ON k.id = b.id)",
        "cuts AS MATERIALIZED (SELECT tier, hilbert_idx AS cut FROM r JOIN range(1, 4) s(s) ON i = least(s * ((n + 3) // 4), n - 1))",
    )
)
def plan_slices(p: DataFrame) -> DataFrame:
    return layout.plan_slices(_keyed(p), 4, ["tier"]).select("id", "time", "tier", "hilbert_idx", "slice")


# --- Segments ----------------------------------------------------------------------------------


@query(
    sql(
        "SELECT id, time, round(d, 3) AS dist_m, cut AS cut_after, CAST(coalesce(sum(CASE WHEN cut THEN 1 ELSE 0 END) OVER (PARTITION BY id ORDER BY time ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS INTEGER) AS bridge_segment FROM b",
        steps_cte("gps"),
        f"b AS MATERIALIZED (SELECT *, coalesce(d > 5000 OR (t > 240 AND d > 1000), false) AS cut FROM (SELECT *, {hav('lat', 'lon', 'lat2', 'lon2')} AS d, (epoch_us(lead(time) OVER (PARTITION BY id ORDER BY time)) - epoch_us(time)) / 1e6 AS t FROM steps))",
    )
)
def bridge_gaps(p: DataFrame) -> DataFrame:
    return segments.bridge_gaps(p).select("id", "time", F.round("dist_m", 3).alias("dist_m"), "cut_after", "bridge_segment")


GRID = """WITH RECURSIVE {gps}, n AS MATERIALIZED (SELECT *, epoch_us(time) AS t, lead(epoch_us(time)) OVER w AS t2, lead(lat) OVER w AS lat2, lead(lon) OVER w AS lon2, lead(speed) OVER w AS sp2, lead(heading) OVER w AS h2, min(epoch_us(time)) OVER (PARTITION BY id) AS t0
    FROM gps WINDOW w AS (PARTITION BY id ORDER BY time)),
  g AS (SELECT *, unnest(generate_series(t0 + CAST(ceil((t - t0)::DOUBLE / 21600000000::DOUBLE) AS BIGINT) * 21600000000, coalesce(t2 - 1, t), 21600000000)) AS tick FROM n),
  f AS (SELECT *, CASE WHEN t2 IS NULL THEN 0.0::DOUBLE ELSE (tick - t)::DOUBLE / (t2 - t)::DOUBLE END AS f FROM g)
  SELECT id, make_timestamp(tick) AS time, round(lat + coalesce(f * (lat2 - lat), 0), 6) AS lat, round(lon + coalesce(f * (lon2 - lon), 0), 6) AS lon, round(speed + coalesce(f * (sp2 - speed), 0), 6) AS speed,
    round((heading + coalesce(f * ((h2 - heading + 540.0::DOUBLE) % 360.0::DOUBLE - 180.0::DOUBLE), 0) + 360.0::DOUBLE) % 360.0::DOUBLE, 4) AS heading FROM f"""


@query(GRID.format(gps=GPS_SQL))
def resample_grid(p: DataFrame) -> DataFrame:
    r = segments.resample(p, 21600)
    return r.select("id", "time", *[F.round(c, 6).alias(c) for c in ("lat", "lon", "speed")], F.round("heading", 4).alias("heading"))


@query(
    sql(
        f"SELECT {ALL}, segment_id FROM (SELECT *, greatest(1, n // greatest(2, CAST(floor(20.0::DOUBLE * n / a) AS BIGINT))) AS step FROM c) WHERE a <= 20 OR n <= 2 OR i % step = 0 OR i = n - 1",
        gap_cte("gps", 43200),
        "c AS (SELECT *, count(*) OVER (PARTITION BY id) AS a, count(*) OVER (PARTITION BY id, segment_id) AS n, row_number() OVER (PARTITION BY id, segment_id ORDER BY time) - 1 AS i FROM gapped)",
    )
)
def downsample(p: DataFrame) -> DataFrame:
    return segments.downsample(trajectory.split_by_observation_gap(p, GAP), 20)


ENDS = "SELECT id, segment_id, arg_min(lat, time) AS first_lat, arg_min(lon, time) AS first_lon, arg_max(lat, time) AS last_lat, arg_max(lon, time) AS last_lon, arg_min(is_stop, time) AS is_stop, count(*) AS n_points FROM stopped GROUP BY id, segment_id"


@query(sql(ENDS, stops_cte("gps", 250, 1800)))
def segment_endpoints(p: DataFrame) -> DataFrame:
    return segments.segment_endpoints(trajectory.split_by_stops(p, DIAMETER, DURATION))


@query(
    sql(
        'SELECT s.id, s.segment_id, round(avg(s.lat), 6) AS centroid_lat, round(avg(s.lon), 6) AS centroid_lon, count(*) AS n_points, min(s.time) AS start, max(s.time) AS "end", (max(epoch_us(s.time)) - min(epoch_us(s.time))) / 1e6::DOUBLE AS duration_s,'
        " any_value(CASE WHEN NOT a.is_stop THEN a.last_lat END) AS from_lat, any_value(CASE WHEN NOT b.is_stop THEN b.first_lat END) AS to_lat"
        " FROM stopped s LEFT JOIN ends a ON a.id = s.id AND a.segment_id = s.segment_id - 1 LEFT JOIN ends b ON b.id = s.id AND b.segment_id = s.segment_id + 1 WHERE s.is_stop GROUP BY s.id, s.segment_id",
        stops_cte("gps", 250, 1800),
        f"ends AS ({ENDS})",
    )
)
def stop_summary(p: DataFrame) -> DataFrame:
    s = segments.stop_summary(trajectory.split_by_stops(p, DIAMETER, DURATION))
    return s.select("id", "segment_id", F.round("centroid_lat", 6).alias("centroid_lat"), F.round("centroid_lon", 6).alias("centroid_lon"), "n_points", "start", "end", "duration_s", "from_lat", "to_lat")


@query(sql("SELECT min(lat) AS min_lat, max(lat) AS max_lat, round(avg(lat), 6) AS mean_lat, min(lon) AS min_lon, max(lon) AS max_lon, round(avg(lon), 6) AS mean_lon FROM gps"))
def layer_bounds(p: DataFrame) -> DataFrame:
    b = segments.bounds(p)
    return b.select(*[F.round(c, 6).alias(c) if c.startswith("mean") else c for c in b.columns])


@query(sql("SELECT id, segment_id, count(DISTINCT CAST(time AS DATE)) AS n_trips, list_sort(list(DISTINCT strftime(time, '%Y-%m-%d')))[1] AS first_trip, count(*) AS n_rows FROM gapped GROUP BY id, segment_id", gap_cte("gps", 43200)))
def trip_recovery(p: DataFrame) -> DataFrame:
    t = trajectory.split_by_observation_gap(p, GAP).withColumn("trip", F.date_format("time", "yyyy-MM-dd"))
    return segments.trip_recovery(t).select("id", "segment_id", "n_trips", F.get("trips", F.lit(0)).alias("first_trip"), "n_rows")


# --- Roads: a ping's one-degree tile stands for its way, missing where it is fast ---------------


def _ways(p: DataFrame) -> DataFrame:
    return p.select("id", "time", "lat", "lon", F.when(F.col("speed") < 90, geo.tile_id("lat", "lon", 1)).alias("way_id"))


WAYS = f"ways AS (SELECT id, time, lat, lon, CASE WHEN speed < 90 THEN {tile('lat', 'lon', 1)} END AS way_id FROM gps)"
DEDUP = "dedup AS (SELECT id, time, way_id FROM (SELECT *, lag(way_id) OVER (PARTITION BY id ORDER BY time) AS b FROM ways WHERE way_id IS NOT NULL) WHERE b IS DISTINCT FROM way_id)"
COUNTS = "counts AS (SELECT way_id, count(*) AS trip_count, count(DISTINCT id) AS n_trips FROM dedup GROUP BY way_id)"


@query(sql("SELECT * FROM dedup", WAYS, DEDUP))
def ways_dedup(p: DataFrame) -> DataFrame:
    return ways.collapse_repeats(_ways(p)).select("id", "time", "way_id")


def _counts(p: DataFrame) -> DataFrame:
    return ways.way_counts(ways.collapse_repeats(_ways(p)))


@query(sql("SELECT * FROM counts", WAYS, DEDUP, COUNTS))
def way_counts(p: DataFrame) -> DataFrame:
    return _counts(p)


def _roads(p: DataFrame) -> DataFrame:
    roads = p.filter("speed < 60").select(geo.tile_id("lat", "lon", 1).alias("w"), "lon", "lat").groupBy("w").agg(F.min("lon").alias("x"), F.min("lat").alias("y"), F.max("lon").alias("x2"), F.max("lat").alias("y2"))
    text = F.concat_ws(" ", F.col("x").cast("string"), F.col("y").cast("string"))
    return roads.select(F.concat(F.lit("way/"), F.col("w").cast("string")).alias("feature_id"), text.cast("binary").alias("geometry"), "x", "y", "x2", "y2")


ROADS = f"roads AS (SELECT {tile('lat', 'lon', 1)} AS way_id, min(lon) AS x, min(lat) AS y, max(lon) AS x2, max(lat) AS y2 FROM gps WHERE speed < 60 GROUP BY 1)"


@query(sql("SELECT way_id, trip_count, n_trips, x IS NOT NULL AS has_geometry FROM counts LEFT JOIN roads USING (way_id)", WAYS, DEDUP, COUNTS, ROADS))
def way_geometry_join(p: DataFrame) -> DataFrame:
    return ways.way_geometry(_counts(p), _roads(p)).select("way_id", "trip_count", "n_trips", F.col("geometry").isNotNull().alias("has_geometry"))


@query(sql("SELECT way_id, trip_count, x AS bbox_xmin FROM counts JOIN roads USING (way_id) WHERE x2 >= -79.25 AND x <= -78.75 AND y2 >= 42.5 AND y <= 46.5 AND trip_count >= 2 ORDER BY trip_count DESC, way_id LIMIT 3", WAYS, DEDUP, COUNTS, ROADS))
def way_bbox_topn(p: DataFrame) -> DataFrame:
    index = _counts(p).join(_roads(p).select(F.substring("feature_id", 5, 30).cast("long").alias("way_id"), F.col("x").alias("bbox_xmin"), F.col("y").alias("bbox_ymin"), F.col("x2").alias("bbox_xmax"), F.col("y2").alias("bbox_ymax")), "way_id")
    return ways.load_area(index, (-79.15, 43.3, -78.85, 45.7), bbox_pad=1 / 3, min_trip_count=2, top_n=3).select("way_id", "trip_count", "bbox_xmin")


# --- Quality: a vehicle's moving pings stand for its matched shape ------------------------------


def _shapes(p: DataFrame) -> DataFrame:
    return p.filter("speed > 0").select("id", F.lit(0).alias("polyline"), F.col("time").alias("seq"), "lat", "lon")


def leg_cte(source: str, out: str) -> str:
    w = "OVER (PARTITION BY id ORDER BY time)"
    return f"{out} AS MATERIALIZED (SELECT *, {hav('la', 'lo', 'lat', 'lon')} AS m, {brg('la', 'lo', 'lat', 'lon')} AS b FROM (SELECT *, lag(lat) {w} AS la, lag(lon) {w} AS lo FROM {source}))"


@query(
    sql(
        "SELECT i.id, i.n_points, round(o.m / i.m, 6) AS path_length_ratio, r.n AS heading_reversals, coalesce(o.m / i.m < 0.7 OR o.m / i.m > 1.5, false) OR r.n > 5 AS has_issues"
        " FROM (SELECT id, count(*) AS n_points, sum(m) AS m FROM l GROUP BY id) i JOIN (SELECT id, sum(m) AS m FROM s GROUP BY id) o USING (id) JOIN r USING (id)",
        leg_cte("gps", "l"),
        leg_cte("(SELECT * FROM gps WHERE speed > 0)", "s"),
        "v AS (SELECT *, lag(b) OVER (PARTITION BY id ORDER BY time) AS pb FROM s WHERE m >= 10)",
        "r AS (SELECT s.id, count(*) FILTER (v.pb IS NOT NULL AND abs((v.b - v.pb + 540.0::DOUBLE) % 360.0::DOUBLE - 180.0::DOUBLE) > 150) AS n FROM s LEFT JOIN v ON v.id = s.id AND v.time = s.time GROUP BY s.id)",
    )
)
def path_quality(p: DataFrame) -> DataFrame:
    q = quality.path_quality(p, _shapes(p))
    bad = quality.has_issues(F.lit(None).cast("string"), F.col("n_polylines"), F.col("path_length_ratio"), F.col("heading_reversals"))
    return q.select("id", "n_points", F.round("path_length_ratio", 6).alias("path_length_ratio"), "heading_reversals", bad.alias("has_issues"))


@query(sql("SELECT segment AS tier, trips, round(s, 6) AS sum_s, round(m, 6) AS median_s, round(q, 6) AS p95_s, round(f, 6) AS fail_rate, round(k, 6) AS ms_per_point FROM (SELECT CAST(heading AS VARCHAR) AS segment, count(*) AS trips, sum(speed) AS s, median(speed) AS m, quantile_cont(speed, 0.95) AS q, avg(CASE WHEN lat < 60 THEN 0.0::DOUBLE ELSE 1.0::DOUBLE END) AS f, sum(speed) * 1000 / count(*) AS k FROM gps GROUP BY heading)"))
def partition_timing_stats(p: DataFrame) -> DataFrame:
    t = p.select(F.col("heading").cast("string").alias("tier"), F.lit(0).alias("partition_id"), (F.col("lat") < 60).alias("ok"), F.lit(1).alias("n_points"), F.col("speed").alias("elapsed_s"))
    s = partition.timing_stats(t)
    return s.select("tier", "trips", *[F.round(c, 6).alias(c) for c in ("sum_s", "median_s", "p95_s", "fail_rate", "ms_per_point")])


# --- Lookups -----------------------------------------------------------------------------------


@query(sql(f"SELECT {ALL} FROM gps WHERE starts_with(id, 'truck_00000')"))
def scan_partitioned_truck(p: DataFrame) -> DataFrame:
    return readers.of_truck(p, "truck_00000")


@query(sql(f"SELECT {ALL} FROM gps WHERE id = 'truck_000004' AND time >= TIMESTAMP '2024-01-05' AND time < TIMESTAMP '2024-01-12 06:00:00'"))
def trace_time_range(p: DataFrame) -> DataFrame:
    return readers.time_range(p.filter("id = 'truck_000004'"), "2024-01-05", "2024-01-12T06:00:00")


@query(sql(f"SELECT {ALL} FROM gps WHERE CAST(time AS DATE) BETWEEN DATE '2024-01-05' AND DATE '2024-01-07'"))
def trace_date_range(p: DataFrame) -> DataFrame:
    return readers.date_range(p, date(2024, 1, 5), date(2024, 1, 7))


@query(
    sql(
        "SELECT coalesce(a.id, b.id) AS id, strftime(coalesce(a.day, b.day), '%Y-%m-%d') AS day, coalesce(a.n, 0) AS n_a, coalesce(b.n, 0) AS n_b FROM (SELECT id, CAST(time AS DATE) AS day, count(*) AS n FROM s1 WHERE is_stop GROUP BY ALL) a"
        " FULL JOIN (SELECT id, CAST(time AS DATE) AS day, count(*) AS n FROM s2 WHERE is_stop GROUP BY ALL) b ON a.id = b.id AND a.day = b.day",
        stops_cte("gps", 250, 1800, "s1"),
        stops_cte("gps", 5, 1800, "s2"),
    )
)
def compare_stop_settings(p: DataFrame) -> DataFrame:
    found = segments.compare_stops(trajectory.split_by_stops(p, DIAMETER, DURATION), trajectory.split_by_stops(p, 5.0, DURATION))
    return found.select("id", F.date_format("day", "yyyy-MM-dd").alias("day"), *[F.coalesce(c, F.lit(0)).alias(c) for c in ("n_a", "n_b")])


def flagship(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Segments between silences of 12 hours, with their pings, start and end."""
    cut = trajectory.split_by_observation_gap(gps_points(spark, sf_dir), GAP)
    return cut.groupBy("id", "segment_id").agg(F.count(F.lit(1)).alias("n_points"), F.min("time").alias("start"), F.max("time").alias("end"))
