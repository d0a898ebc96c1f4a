import pytest
from pyspark.sql import functions as F

from waymark.functions import geo, ids


def one(spark, *cols):
    return spark.range(1).select(*cols).collect()[0]


def test_distances_and_bearings(spark):
    r = one(spark, geo.haversine_m(0.0, 0.0, 0.0, 1.0), geo.haversine_km(40.6413, -73.7781, 51.47, -0.4543), geo.haversine_atan2_m(0.0, 0.0, 1.0, 0.0), geo.bearing(0.0, 0.0, 0.0, 1.0), geo.bearing(0.0, 0.0, -1.0, 0.0))
    assert abs(r[0] - 111_195) < 100 and abs(r[1] - 5555) < 20 and abs(r[2] - 111_195) < 100
    assert r[3] == pytest.approx(90) and r[4] == pytest.approx(180)


def test_angles(spark):
    r = one(spark, geo.angular_difference(5.0, 5.0), geo.angular_difference(0.0, 180.0), geo.angular_difference(10.0, 350.0), geo.shortest_arc(350.0, 10.0), geo.shortest_arc(10.0, 350.0))
    assert list(r) == [0, 180, 20, 20, -20]


def test_tiles_and_tiers(spark):
    r = one(spark, geo.tile_id(0.0, 0.0, 1.0), geo.tile_id(-90.0, -180.0, 1.0), geo.tile_id(95.0, 200.0, 1.0))
    assert list(r) == [32580, 0, 180 * 360 - 1]
    with pytest.raises(ValueError):
        geo.tile_id(0.0, 0.0, 0)
    for d, name, n in ((10.0, "local", 0), (100.0, "regional", 1), (300.0, "regional", 1), (800.0, "longhaul", 2), (2000.0, "longhaul", 2)):
        r = one(spark, geo.tier(d), geo.partition_id(43.0, -79.0, d))
        assert r[0] == name and r[1] >> 60 == n


def test_hilbert(spark):
    r = one(spark, *[geo.hilbert_index(a, b) for a, b in ((43.6, -79.3), (45.5, -73.5), (0.0, -200.0), (24.0, -141.0))], geo.hilbert_index(F.lit(None).cast("double"), 0.0))
    assert r[0] > 0 and r[1] > 0 and r[0] != r[1] and r[2] == r[3] == 0 and r[4] is None


def test_hilbert_is_a_curve():
    """Neighbours on the curve are neighbours on the grid (the inverse, on a small order)."""

    def xy2d(n, x, y):
        d, s = 0, n // 2
        while s:
            rx, ry = int(x & s > 0), int(y & s > 0)
            d += s * s * ((3 * rx) ^ ry)
            if ry == 0:
                if rx == 1:
                    x, y = n - 1 - x, n - 1 - y
                x, y = y, x
            s //= 2
        return d

    where = {xy2d(16, x, y): (x, y) for x in range(16) for y in range(16)}
    assert sorted(where) == list(range(256))
    assert all(abs(where[i][0] - where[i + 1][0]) + abs(where[i][1] - where[i + 1][1]) == 1 for i in range(255))


def test_speeds_and_ids(spark):
    r = one(spark, geo.speed_mps(36.0), geo.truck_speed_cap(30.0), geo.truck_speed_cap(20.0), geo.truck_speed_cap(5.0), geo.breakage_distance(100.0, 20_000), geo.breakage_distance(4000.0, 5000))
    assert r[0] == pytest.approx(10) and list(r)[1:] == [29.0, 15.6, 5.0, 3000.0, 5000.0]
    t = spark.createDataFrame([("abcdef", 0, 3)], "id string, gap_segment_id int, segment_id int").select(ids.trip_id().alias("id"), ids.raw_chunk("id").alias("c"))
    assert t.collect()[0]["id"] == "abcdef_gap0_trip3" and t.collect()[0]["c"] == "ef"
    assert t.select(ids.truck_of(), ids.trip_chunk()).collect()[0][:] == ("abcdef", "def")
