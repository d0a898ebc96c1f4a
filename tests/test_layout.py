import json
from datetime import datetime

import pytest

from waymark.plans import layout
from waymark.sources import readers
from waymark.sources.files import Files


def write(spark, root, tier, pid, n, files=1, base=0):
    for k in range(files):
        rows = [(f"t{pid}", base + i * files + k) for i in range(n // files)]
        spark.createDataFrame(rows, "id string, hilbert_idx long").coalesce(1).write.mode("append").parquet(f"{root}/tier={tier}/partition_id={pid}")


def sizes(spark, root, tier):
    return {p.rsplit("/", 1)[1]: spark.read.parquet(p).count() for p in layout.partition_dirs(Files(spark, root), root) if f"/tier={tier}/" in p}


def test_planner():
    assert [(len(i), s) for i, s in layout.plan_buckets([(i, 100) for i in range(10)], 500)] == [(5, None), (5, None)]
    assert [s for _, s in layout.plan_buckets([(0, 200), (1, 2500), (2, 200)], 500)] == [None, 5, None]
    assert [s for _, s in layout.plan_buckets([(0, 200), (1, 2000)], 500)] == [None, 4]


def test_rebalance(spark, tmp_path):
    root = str(tmp_path)
    for i in range(4):
        write(spark, root, "local", i, 100)
    write(spark, root, "regional", 7, 100)
    write(spark, root, "regional", 8, 1000)
    (tmp_path / "_rebalance.new").mkdir()
    layout.rebalance_partitions(spark, root, 250)
    assert list(sizes(spark, root, "local").values()) == [200, 200]
    assert list(sizes(spark, root, "regional").values()) == [100, 250, 250, 250, 250]
    assert not (tmp_path / "_rebalance.new").exists() and not (tmp_path / "_rebalance.old").exists()
    (tmp_path / "_rebalance.old").mkdir()
    with pytest.raises(RuntimeError, match="crashed mid-swap"):
        layout.rebalance_partitions(spark, root, 250)


def test_compact_keeps_everything(spark, tmp_path):
    root = str(tmp_path)
    write(spark, root, "local", 1, 90, files=3)
    folder = tmp_path / "tier=local" / "partition_id=1"
    first = sorted(folder.glob("part-*.parquet"))[0]
    first.rename(folder / "data.parquet")
    for crc in folder.glob(".*.crc"):
        crc.unlink()
    assert layout.compact_partitions(spark, root) == 1
    assert [p.name for p in folder.glob("*.parquet")] == ["data.parquet"]
    got = [r[0] for r in spark.read.parquet(str(folder / "data.parquet")).select("hilbert_idx").collect()]
    assert got == list(range(90))
    assert layout.compact_partitions(spark, root) == 0


def test_compaction_that_broke_off(spark, tmp_path):
    root = str(tmp_path)
    write(spark, root, "local", 1, 90, files=3)
    folder = tmp_path / "tier=local" / "partition_id=1"
    old = folder / "_compact.old"
    old.mkdir()
    for p in sorted(folder.glob("part-*.parquet"))[:2]:  # broke off while originals were moved aside
        p.rename(old / f"{p.name}.old")
    assert layout.compact_partitions(spark, root) == 1
    got = [r[0] for r in spark.read.parquet(str(folder)).select("hilbert_idx").collect()]
    assert got == list(range(90)) and [p.name for p in folder.rglob("*.parquet*") if not p.name.startswith(".")] == ["data.parquet"]
    assert layout.parquet_rows(spark, str(folder)) == 90


def test_write_trips(spark, tmp_path):
    at = lambda i: {"time": datetime(2024, 1, 1, 0, i), "lat": 43.0 + i * 0.01, "lon": -79.0, "speed": 1.26, "heading": 90.04}
    assert layout.write_trips_partitioned([{"id": "a", "points": [at(0), at(1)]}, {"id": "b", "points": [at(2)]}], str(tmp_path / "out"), spark) == {"local": 1}
    got = spark.read.parquet(str(tmp_path / "out")).orderBy("time").collect()
    assert [(r["id"], r["speed"], r["heading"]) for r in got] == [("a", 1.3, 90.0), ("a", 1.3, 90.0), ("b", 1.3, 90.0)]


def test_union_relaxed(spark):
    a, b = spark.createDataFrame([(1, 2)], "x int, y int"), spark.createDataFrame([(3.5,)], "x double")
    assert sorted(map(tuple, readers.union_relaxed([a, b]).collect()), key=str) == [(1.0, 2), (3.5, None)]


def test_partition_round_trip(spark, tmp_path):
    rows = [(t, datetime(2024, 1, 1, 0, i), 43.0 + i * 0.01, -79.0, 1.0, 1.0) for t in ("a", "b") for i in range(5)]
    df = spark.createDataFrame(rows, "id string, time timestamp_ntz, lat double, lon double, speed double, heading double")
    df.write.parquet(str(tmp_path / "in"))
    assert layout.partition_existing_parquet(spark, str(tmp_path / "in"), str(tmp_path / "out")) == {"local": 1}
    assert spark.read.parquet(str(tmp_path / "out")).count() == 10
    df.drop("lat").write.parquet(str(tmp_path / "bad"))
    with pytest.raises(ValueError):
        layout.partition_existing_parquet(spark, str(tmp_path / "bad"), str(tmp_path / "out2"))


def test_index(spark, tmp_path):
    root = str(tmp_path)
    rows = [("truck_abc_gap0_trip0", 1), ("truck_xbc_gap0_trip0", 2)]
    for i, r in enumerate(rows):
        spark.createDataFrame([r], "id string, v int").write.parquet(f"{root}/tier=local/partition_id={i}")
    index = readers.ChunkIndex.build(spark, root)
    assert index.chunk_ids() == ["abc", "xbc"] and len(index) == 2
    index.save()
    again = readers.ChunkIndex.load(root)
    assert again.scan_truck(spark, "truck_abc").count() == 1 and again.scan_trip(spark, "truck_xbc_gap0_trip0").collect()[0]["v"] == 2
    with pytest.raises(FileNotFoundError):
        again.scan_truck(spark, "truck_zzz")
    path = tmp_path / readers.INDEX_FILE
    path.write_text(json.dumps({"version": 2, "chunk_id_len": 2, "index": {}}))
    with pytest.raises(ValueError):
        readers.ChunkIndex.load(root)
    path.write_text(json.dumps({"abc": []}))
    with pytest.raises(ValueError):
        readers.ChunkIndex.load(root)


def test_raw_traces(spark, tmp_path):
    root = str(tmp_path / "raw")
    rows = [("truck_01", datetime(2026, 1, 1, h), 1.0, 1.0, "2026", "01") for h in (9, 10, 10, 11)]
    spark.createDataFrame(rows, "id string, time timestamp, lat double, lon double, year string, chunk_id string").write.partitionBy("year", "chunk_id").parquet(root)
    df = readers.load_truck_trace(spark, "truck_01", "2026-01-01T10:00:00", "2026-01-01T11:00:00", data_dir=root)
    assert df.count() == 2 and df.first()["chunk_id"] == "01"
    with pytest.raises(ValueError, match="no rows"):
        readers.load_truck_trace(spark, "truck_01", "2027-01-01", None, data_dir=root)
    with pytest.raises(ValueError):
        readers.load_truck_trace(spark, "truck_01")
    assert readers.file_operator(readers.process)(spark, root, f"{root}_out", "lat") == 4
