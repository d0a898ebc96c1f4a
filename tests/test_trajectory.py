from datetime import datetime, timedelta

import pytest

from waymark.operators import segments, trajectory, walk
from waymark.plans import trips

T0 = datetime(2024, 6, 10, 8)
PING = "id string, time timestamp_ntz, lat double, lon double, speed double, heading double"


def pings(spark, rows, schema=PING):
    return spark.createDataFrame(rows, schema)


def track(name, steps, start=T0, lat=40.7, lon=-74.0):
    """steps: (seconds since the ping before, degrees north)"""
    out, t = [], start
    for s, d in steps:
        t, lat = t + timedelta(seconds=s), lat + d
        out.append((name, t, lat, lon, 30.0, 0.0))
    return out


def fixture(spark):
    moving = lambda n, s=30: [(s, 0.002)] * n
    a = track("truck_A", moving(15) + [(600, 0.002)] + moving(14))
    b = track("truck_B", moving(10) + [(33, 0.00001)] * 9 + moving(11))
    c = track("truck_C", moving(7) + [(300, 0.002)] + moving(5) + [(30, 0.00001)] * 6 + moving(4))
    return pings(spark, a + b + c)


def per_id(df, expr="count(distinct segment_id) as n"):
    return {r["id"]: r["n"] for r in df.groupBy("id").agg(__import__("pyspark").sql.functions.expr(expr.split(" as ")[0]).alias("n")).collect()}


def test_gap(spark):
    df = fixture(spark)
    two = timedelta(minutes=2)
    assert per_id(trajectory.split_by_observation_gap(df, two)) == {"truck_A": 2, "truck_B": 1, "truck_C": 2}
    assert per_id(trajectory.split_by_observation_gap(df, timedelta(hours=1)))["truck_A"] == 1
    assert per_id(trajectory.split_by_observation_gap(df, timedelta(seconds=1)))["truck_A"] == 30
    assert per_id(trajectory.split_by_observation_gap(df, two, min_length=20)) == {"truck_B": 1}
    assert trajectory.split_by_observation_gap(df, two).count() == 83


def test_gap_is_strict_and_nulls_do_not_start_segments(spark):
    rows = [("a", T0, 0.0, 0.0, 1.0, 1.0), ("a", T0 + timedelta(seconds=60), 0.0, 0.0, 1.0, 1.0), ("a", T0 + timedelta(seconds=121), 0.0, 0.0, 1.0, 1.0), ("a", None, 0.0, 0.0, 1.0, 1.0), (None, T0, 0.0, 0.0, 1.0, 1.0)]
    found = trajectory.split_by_observation_gap(pings(spark, rows), timedelta(seconds=60)).collect()
    assert {(r["id"], r["time"], r["segment_id"]) for r in found} == {("a", None, 0), ("a", rows[0][1], 0), ("a", rows[1][1], 0), ("a", rows[2][1], 1), (None, T0, 0)}
    assert trajectory.split_by_observation_gap(pings(spark, rows), timedelta(seconds=60), min_length=1).filter("id is null").count() == 0


def test_wrong_types(spark):
    with pytest.raises(ValueError):
        trajectory.split_by_observation_gap(spark.createDataFrame([("a", "x")], "id string, time string"), timedelta(1))
    with pytest.raises(ValueError):
        trajectory.split_by_stops(spark.createDataFrame([("a", T0, 1, 2)], "id string, time timestamp, lat int, lon int"), 1, timedelta(1))


def test_stops(spark):
    df = fixture(spark)
    out = trajectory.split_by_stops(df, 50.0, timedelta(minutes=2))
    assert out.count() == 83 and per_id(out) == {"truck_A": 1, "truck_B": 3, "truck_C": 3}
    short = trajectory.split_by_stops(df, 50.0, timedelta(minutes=2), min_length=15).filter("id = 'truck_B'")
    assert short.count() > 0 and short.filter("not is_stop").count() == 0
    assert trajectory.split_by_stops(df, 100_000.0, timedelta(hours=24)).filter("is_stop").count() == 0


def test_stop_ranges():
    sec = 1_000_000
    assert walk.find_stops([], [], [], 10, 0) == []
    assert walk.find_stops([1.0], [1.0], [0], 10, 0) == [(0, 0)]
    still = [43.0] * 5, [-79.0] * 5
    assert walk.find_stops(*still, [i * sec for i in range(5)], 10, 3 * sec) == [(0, 4)]
    assert walk.find_stops(*still, [i * sec for i in range(5)], 10, 9 * sec) == []
    assert walk.find_stops([None, 43.0, 43.0, 43.0, None], [None, -79.0, -79.0, -79.0, None], [i * sec for i in range(5)], 10, 2 * sec) == [(1, 3)]
    assert walk.find_stops([43.0, 43.0, 43.0, 43.1, 43.2], [-79.0] * 5, [i * sec for i in range(5)], 10, 2 * sec) == [(0, 2)]


def traffic(spark, points, stops):
    rows = [("a", T0 + timedelta(seconds=i), lat, lon, s, 0) for i, ((lat, lon), s) in enumerate(zip(points, stops))]
    df = spark.createDataFrame(rows, "id string, time timestamp_ntz, lat double, lon double, is_stop boolean, segment_id int")
    return trajectory.filter_traffic_stops(df).orderBy("time").collect()


def test_traffic(spark):
    straight = traffic(spark, [(40.0 + i * 0.001, -74.0) for i in range(6)], [False, False, True, True, False, False])
    assert [r["is_stop"] for r in straight] == [False] * 6 and {r["segment_id"] for r in straight} == {0}
    turn = traffic(spark, [(40.0, -74.0), (40.001, -74.0), (40.002, -74.0), (40.002, -74.0), (40.002, -73.999), (40.002, -73.998)], [False, False, True, True, False, False])
    assert [r["is_stop"] for r in turn] == [False, False, True, True, False, False] and [r["segment_id"] for r in turn] == [0, 0, 1, 1, 2, 2]


def test_stale(spark):
    rows = [("a", T0 + timedelta(seconds=i), 40.0 + k, -74.0, v, 10.0) for i, (k, v) in enumerate([(0, 5.0), (1, 5.0), (0, 5.0), (2, 0.0), (2, 0.0), (3, 5.0), (4, 5.0), (5, 5.0), (1, 5.0)])]
    rows += [("b", T0, 40.0, -74.0, 5.0, 10.0)]
    kept = lambda w: sorted(r["time"].second for r in trajectory.filter_stale_pings(pings(spark, rows), w).filter("id = 'a'").collect())
    assert kept(5) == [0, 1, 3, 4, 5, 6, 7]
    assert kept(3) == [0, 1, 3, 4, 5, 6, 7, 8]
    assert kept(0) == list(range(9))
    signed = [("a", T0, 0.0, 1.0, 5.0, 1.0), ("a", T0 + timedelta(seconds=1), -0.0, 1.0, 5.0, 1.0)]
    assert trajectory.filter_stale_pings(pings(spark, signed), 5).count() == 2


def test_impossible_speed(spark):
    def kept(values, limit=200.0):
        rows = [("a", None if s is None else T0 + timedelta(seconds=s), lat, -74.0, 1.0, float(i)) for i, (s, lat) in enumerate(values)]
        return sorted(int(r["heading"]) for r in trajectory.filter_impossible_speeds(pings(spark, rows), limit).collect())

    assert kept([(0, 40.0), (60, 40.01), (120, 60.0), (180, 40.02)]) == [0, 1, 3]
    assert kept([(0, 40.0), (60, 60.0), (120, 60.0), (180, 40.01)]) == [0, 3]
    assert kept([(0, 40.0), (60, None), (120, 40.01)]) == [0, 1, 2]
    assert kept([(0, 40.0), (0, 60.0), (60, 40.01)]) == [0, 1, 2]
    assert kept([(0, 40.0), (60, 40.01)], 1.0) == [0]


def test_fused_walks_equal_the_single_ones(spark):
    from waymark.sources.fixture import gps_points

    p = gps_points(spark, "/root/testdata/sf0.001")
    a = trajectory.filter_impossible_speeds(trajectory.filter_stale_pings(p, 5), 200.0)
    assert sorted(map(tuple, a.collect())) == sorted(map(tuple, trajectory.clean(p).collect()))
    d, t = 250.0, timedelta(minutes=30)
    b = trajectory.filter_traffic_stops(trajectory.split_by_stops(p, d, t, min_length=2), 30.0, 10.0)
    c = trajectory.split_stops_and_traffic(p, d, t, 30.0, 10.0, 2)
    cols = ["id", "time", "segment_id", "is_stop"]
    assert sorted(map(tuple, b.select(cols).collect())) == sorted(map(tuple, c.select(cols).collect()))


def test_filters_are_idempotent(spark):
    from waymark.sources.fixture import gps_points

    once = trajectory.clean(gps_points(spark, "/root/testdata/sf0.001"))
    assert once.count() == trajectory.clean(once).count()


def test_trips_have_unique_ids_per_unit(spark):
    df = fixture(spark)
    found = trips.trips(df, gap=timedelta(minutes=2), stop_max_diameter=50.0, stop_min_duration=timedelta(minutes=2))
    assert found.filter("id like 'truck_A_gap1%'").count() > 0
    again = trips.trips(df.withColumn("file", df["id"]), gap=timedelta(minutes=2), stop_max_diameter=50.0, stop_min_duration=timedelta(minutes=2), unit_col="file")
    assert again.select("id").distinct().count() == found.select("id").distinct().count()


def test_gap_is_kept_without_stops(spark):
    rows = track("a", [(60, 0.01)] * 4 + [(13_500, 0.01)] + [(60, 0.01)] * 3)
    assert trips.split_trips(pings(spark, rows)).select("segment_id").distinct().count() == 2


@pytest.mark.parametrize("steps, cuts", [([(20, 0.0001)] * 4, 0), ([(20, 0.0), (20, 0.135)], 1), ([(20, 0.0), (600, 0.0001)], 0), ([(20, 0.0), (360, 0.011)], 1)])
def test_bridge_gaps(spark, steps, cuts):
    out = segments.bridge_gaps(pings(spark, track("a", steps)))
    assert out.filter("cut_after").count() == cuts and out.agg({"bridge_segment": "max"}).collect()[0][0] == cuts


def test_resample_turns_the_short_way(spark):
    rows = [("a", T0, 0.0, 0.0, 10.0, 350.0), ("a", T0 + timedelta(seconds=120), 1.0, 2.0, 20.0, 10.0)]
    out = [tuple(r) for r in segments.resample(pings(spark, rows), 60).orderBy("time").collect()]
    assert [(r[2], r[3], r[4], r[5] % 360) for r in out] == [(0.0, 0.0, 10.0, 350.0), (0.5, 1.0, 15.0, 0.0), (1.0, 2.0, 20.0, 10.0)]


def test_tile_dataset(spark):
    df = fixture(spark)
    big = segments.tile_dataset(df, 3, 86_400)
    assert big.count() == 249 and big.select("id").distinct().count() == 9 and big.schema == df.schema
