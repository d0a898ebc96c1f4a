import struct
from datetime import datetime, timedelta
from random import Random

import pytest
from pyspark.sql import functions as F

from waymark import viz
from waymark.functions import shape
from waymark.generate import ErrorConfig, TripConfig, apply_errors, default_error_profile, generate_trace, generate_traces
from waymark.generate.errors import GPS, OPERATIONAL
from waymark.operators import quality, trajectory, ways
from waymark.plans import matching

T0 = datetime(2024, 6, 10, 8)


def trip(**k):
    return TripConfig("t", (43.6, -79.4), (44.6, -78.4), T0, 7, **k)


def test_trace_is_the_same_everywhere(spark):
    full = trip(errors=default_error_profile(), arrival_manoeuvre="alley_dock", departure_manoeuvre="pull_through")
    points = generate_trace(full)
    got = generate_traces(spark, [full, trip()]).filter("id = 't'")
    assert got.count() == len(points) + len(generate_trace(trip()))
    assert points == generate_trace(full)


def test_every_injector_runs():
    base = generate_trace(trip(noise_m=0))
    for kind in [*GPS, *OPERATIONAL]:
        assert isinstance(apply_errors(base, [ErrorConfig(kind)], Random(1)), list)
        assert apply_errors([], [], Random(1)) == []
    with pytest.raises(ValueError):
        apply_errors(base, [ErrorConfig("nothing")], Random(1))


def test_injected_repeats_are_filtered(spark):
    base = [p.at(speed=30.0 + i) for i, p in enumerate(generate_trace(trip(noise_m=0))[:30])]
    more = GPS["stale_reemission"](base, Random(3), count=3)
    assert len(more) == 33
    df = spark.createDataFrame([("a", p.time, p.lat, p.lon, p.speed, p.heading) for p in more], "id string, time timestamp_ntz, lat double, lon double, speed double, heading double")
    assert trajectory.filter_stale_pings(df, 8).count() == 30


def test_polyline_and_wkb(spark):
    assert shape.decode_polyline("_p~iF~ps|U_ulLnnqC_mqNvxq`@", 5) == [(38.5, -120.2), (40.7, -120.95), (43.252, -126.453)]
    assert shape.join_legs([[(0, 0), (1, 1)], [(1, 1), (2, 2)], [(3, 3)]]) == [(0, 0), (1, 1), (2, 2), (3, 3)]
    raw = struct.pack("<BII4d", 1, 2, 2, 0.0, 0.0, 2.0, 4.0)
    counts = spark.createDataFrame([(1, 3, 2), (2, 1, 1)], "way_id long, trip_count long, n_trips long")
    roads = spark.createDataFrame([("way/1", bytearray(raw)), ("way/9", bytearray(raw))], "feature_id string, geometry binary")
    index = ways.way_index(ways.way_geometry(counts, roads))
    rows = {r["way_id"]: r for r in index.collect()}
    assert rows[1]["bbox_xmax"] == 2.0 and rows[1]["centroid_y"] == 2.0 and rows[2]["geometry"] is None
    assert [r["way_id"] for r in ways.load_area(index, (1, 1, 3, 3), top_n=5).collect()] == [1]
    metres = ways.load_area(index, (111_000, 111_000, 334_000, 334_000), bbox_crs="EPSG:3857", to_crs="EPSG:3857").collect()
    assert [r["way_id"] for r in metres] == [1] and metres[0]["bbox_xmax"] == pytest.approx(222_638.98) and metres[0]["bbox_ymax"] == pytest.approx(445_640.11)


def test_way_usage_stages(spark, tmp_path):
    from waymark.plans.way_usage import run_way_usage

    raw = struct.pack("<BII4d", 1, 2, 2, 0.0, 0.0, 2.0, 4.0)
    spark.createDataFrame([("a", 1), ("b", 1), ("a", 2), ("a", None)], "id string, way_id long").write.parquet(str(tmp_path / "matched"))
    spark.createDataFrame([("way/1", bytearray(raw))], "feature_id string, geometry binary").write.parquet(str(tmp_path / "roads"))
    run = lambda **k: [(r["way_id"], r["trip_count"], r["bbox_ymax"]) for r in run_way_usage(spark, str(tmp_path / "matched"), str(tmp_path / "roads"), str(tmp_path / "out"), **k).collect()]
    assert run() == [(1, 2, 4.0), (2, 1, None)]
    spark.createDataFrame([("c", 2), ("d", 2)], "id string, way_id long").write.mode("append").parquet(str(tmp_path / "matched"))
    assert run() == run(force_stage=2) == [(1, 2, 4.0), (2, 1, None)]  # counts are kept
    assert run(force_stage=1) == [(2, 3, None), (1, 2, 4.0)]


def test_public_names(spark, tmp_path):
    import waymark

    assert all(getattr(waymark, n) is not None for n in waymark.__all__)
    spark.createDataFrame([("a", T0, 43.0, -79.0, 36.0, 1.0)], "id string, time timestamp_ntz, lat double, lon double, speed double, heading double").write.parquet(str(tmp_path / "in"))
    assert waymark.split_by_observation_gap_file(spark, str(tmp_path / "in"), str(tmp_path / "gap"), timedelta(minutes=2)) == 1
    assert waymark.filter_stale_pings_file(spark, str(tmp_path / "in"), str(tmp_path / "fresh")) == 1
    with pytest.raises(AttributeError):
        waymark.nothing


def shapes(spark, points):
    return spark.createDataFrame([("a", 0, i, a, b) for i, (a, b) in enumerate(points)], "id string, polyline int, seq int, lat double, lon double")


def test_quality_of_a_doubled_path(spark):
    line = [(43.0 + i * 0.001, -79.0) for i in range(10)]
    points = spark.createDataFrame([("a", T0 + timedelta(seconds=i), *p) for i, p in enumerate(line)], "id string, time timestamp_ntz, lat double, lon double")
    q = quality.path_quality(points, shapes(spark, line + line[::-1])).collect()[0]
    assert q["path_length_ratio"] == pytest.approx(2.0, rel=1e-3) and q["heading_reversals"] == 1
    verdict = spark.range(1).select(quality.has_issues(F.lit(None).cast("string"), F.lit(1), F.lit(2.0), F.lit(1)), quality.has_issues(F.lit(None).cast("string"), F.lit(1), F.lit(1.0), F.lit(0))).collect()[0]
    assert list(verdict) == [True, False]


def test_matching(spark, tmp_path):
    line = [(43.0 + i * 0.001, -79.0) for i in range(5)] + [(43.5 + i * 0.001, -79.0) for i in range(5)]
    rows = [("a_gap0_trip0", T0 + timedelta(seconds=30 * i), *p, "local", 1, False) for i, p in enumerate(line)] + [("b_gap0_trip0", T0, 43.0, -79.0, "local", 2, False)]
    df = spark.createDataFrame(rows, "id string, time timestamp_ntz, lat double, lon double, tier string, partition_id long, is_stop boolean")
    found = {r["id"]: r for r in matching.match_trips(df, matching.StraightLine).collect()}
    a, b = found["a_gap0_trip0"], found["b_gap0_trip0"]
    assert a["ok"] and a["n_bridges"] == 1 and a["max_detour_ratio"] == pytest.approx(1.0) and a["path_length_ratio"] == pytest.approx(1.0)
    assert not b["ok"] and b["error"] == "insufficient points (<2)"
    out = str(tmp_path / "out")
    matching.run_map_matching(df, out, matching.StraightLine)
    n = spark.read.parquet(out).count()
    matching.run_map_matching(df, out, matching.StraightLine)
    assert spark.read.parquet(out).count() == n and spark.read.parquet(f"{out}/_quality").count() == 2


def test_bridges_and_splits():
    assert matching.split_at([1, 2, 3], [0, 2]) == [[1], [2, 3], []]
    assert matching.without_repeats([1, 1, None, 1, 2, 2, 1]) == [1, 2, 1]
    assert matching.find_gaps([(43.0, -79.0)], [0.0]) == []

    class Broken(matching.StraightLine):
        def route(self, a, b):
            raise RuntimeError("no road")

    b = matching.match_with_bridges(Broken(), [(43.0, -79.0), (43.001, -79.0), (44.0, -79.0), (44.001, -79.0)], [0, 30, 60, 90])
    assert b.any_bridge_failed and len(b.match.shapes) == 1


def test_maps(spark, tmp_path):
    rows = [("a", T0 + timedelta(minutes=i), 43.0 + max(0, i - 10) * 0.01, -79.0, 1.0, 1.0) for i in range(20)]
    df = spark.createDataFrame(rows, "id string, time timestamp_ntz, lat double, lon double, speed double, heading double")
    stops = trajectory.split_by_stops(df, 250.0, timedelta(minutes=5))
    found = viz.geojson(stops)
    assert {f["geometry"]["type"] for f in found["features"]} == {"LineString", "Point"} and viz.mode_of(stops) == "stop" and viz.mode_of(df) == "raw"
    viz.save_map(df, str(tmp_path / "m.html"))
    assert "<polyline" in (tmp_path / "m.html").read_text()


def test_layers_and_server(spark):
    import threading
    import urllib.request

    rows = [("a", T0 + timedelta(minutes=i), 43.0 + max(0, i - 10) * 0.01, -79.0, 1.0, 1.0) for i in range(20)]
    df = spark.createDataFrame(rows, "id string, time timestamp_ntz, lat double, lon double, speed double, heading double")
    split = trajectory.split_by_stops(df, 250.0, timedelta(minutes=5))
    matched = matching.match_segments(split, matching.StraightLine)
    found = viz.plot_inspection(df, split, matched)
    assert {f["properties"]["layer"] for f in found["features"]} == {"raw", "segments", "matched", "shape"}
    server = viz.serve_map(found, port=0, forever=False)
    threading.Thread(target=server.handle_request, daemon=True).start()
    with urllib.request.urlopen(f"http://127.0.0.1:{server.server_port}/", timeout=10) as page:
        assert b"<polyline" in page.read()
    server.server_close()
    with pytest.raises(ValueError):
        viz.stage_trips(spark, "x", truck="a", trip="b")


def test_grid_roads_and_quality():
    from waymark.plans.grid import GridRoads

    engine = GridRoads(0.01)
    along = [(43.0 + 0.0004 * (i % 2), -78.999 + i * 0.002) for i in range(9)]  # beside the road along 43.0
    row, found = matching.evaluate(engine, along, [60.0 * i for i in range(9)], "route")
    assert row["ok"] and found.ways == [2 * 4300] and all(abs(p[0] - 43.0) < 1e-9 for p in found.points)
    corner = [*along, *[(43.001 + i * 0.002, -78.98) for i in range(4)]]
    assert matching.evaluate(engine, corner, [60.0 * i for i in range(len(corner))], "attributes")[1].ways == [2 * 4300, 2 * -7898 + 1]
    apart = [(43.0, -79.0), (43.0, -78.998), (43.5, -79.0), (43.5, -78.998)]  # far apart: two shapes
    row, found = matching.evaluate(engine, apart, [0, 60, 120, 180], "route", breakage_cap_m=3000.0)
    assert row["n_polylines"] == 2 and row["has_issues"] and not row["ok"]
    assert not matching.evaluate(engine, apart, [0, 60, 120, 180], "ways")[0]["has_issues"]
    nowhere = matching.evaluate(engine, [(43.005, -79.005)] * 2, [0, 60], "route")[0]
    assert nowhere["error"].startswith("RuntimeError") and nowhere["has_issues"]


def test_requests():
    from waymark.plans import requests

    body = requests.decode(requests.encode(requests.trace_request([(43.0, -79.0), (43.1, -79.0)], "truck", {"height": 4}, only=["edge.way_id"], beta=7)))
    assert body["trace_options"]["beta"] == 7 and body["costing_options"] == {"truck": {"height": 4}} and body["filters"]["action"] == "include"
    assert 16_000 < body["trace_options"]["breakage_distance"] < 17_000
    legs = [{"shape": "_p~iF~ps|U_ulLnnqC_mqNvxq`@", "maneuvers": [{"length": 1.0, "time": 100, "begin_shape_index": 0, "end_shape_index": 1}]}]
    answer = {"trip": {"legs": legs, "summary": {"length": 2.0, "time": 100}}, "alternates": [{"trip": {"legs": legs}}], "edges": [{"way_id": 1}, {"way_id": 1}, {}, {"way_id": 2}], "matched_points": [{"lat": 1.0, "lon": 2.0}]}
    assert len(requests.shapes(answer)) == 2 and requests.way_ids(answer) == [1, 2] and requests.matched_points(answer, [(0.0, 0.0)]) == [(1.0, 2.0, 0.0)]
    assert requests.route(answer).speeds_mps == [10.0, 20.0]
    with pytest.raises(FileNotFoundError):
        requests.find_config("/nowhere/x.json")


def test_database_has_every_error(spark, tmp_path, monkeypatch):
    from waymark.generate import models, trips

    monkeypatch.setattr(trips, "random_trip", lambda name, day, rng: TripConfig(name, (43.6, -79.4), (43.7, -79.3), day, 1))
    assert [e.kind for k in sorted(models.PROFILE) for e in models.certain_error(k)] == sorted({*GPS, *OPERATIONAL})
    trips.generate_database(spark, str(tmp_path / "db"), 2, 1, T0)
    assert spark.read.parquet(str(tmp_path / "db")).select("id").distinct().count() == 2


def test_stream(spark, tmp_path):
    from waymark.streaming import trips

    rows = [("a", T0 + timedelta(minutes=m), 43.0 + (20.0 if m == 2 else 0.0), -79.0, 10.0, float(m)) for m in (0, 1, 2, 3, 60, 61, 200)]
    schema = "id string, time timestamp_ntz, lat double, lon double, speed double, heading double"
    spark.createDataFrame(rows, schema).coalesce(1).write.parquet(str(tmp_path / "in"))
    stream = spark.readStream.schema(schema).parquet(str(tmp_path / "in"))
    for name, df in (("cleaned", trips.clean(stream)), ("sessions", trips.gap_segments(stream, timedelta(minutes=10), timedelta(minutes=1)))):
        q = df.writeStream.format("memory").queryName(name).outputMode("append").option("checkpointLocation", str(tmp_path / name)).start()
        q.processAllAvailable()
        q.stop()
    assert spark.table("cleaned").count() == 6
    assert sorted(r["n_points"] for r in spark.table("sessions").collect())[:2] == [2, 4]


def test_cli(spark, tmp_path, capsys):
    from waymark import cli

    assert cli.main(["generate", "--origin", "43.6,-79.4", "--destination", "43.9,-79.0", "--format", "parquet", "-o", str(tmp_path / "t")]) == 0
    assert cli.main(["split-gap", str(tmp_path / "t"), "--gap", "600", "-o", str(tmp_path / "g")]) == 0
    assert cli.main(["process", str(tmp_path / "t")]) == 0
    assert "speed_mps" in capsys.readouterr().out
    assert cli.main(["partition", str(tmp_path / "t"), str(tmp_path / "p")]) == 0
