"""Partitioned layouts: writing, compaction and rebalancing of hive-style directories on any file system of Spark's."""

from __future__ import annotations

import re
from bisect import bisect_right
from itertools import accumulate

from pyspark.sql import DataFrame, Observation, SparkSession, Window
from pyspark.sql import functions as F

from waymark.functions.geo import TIERS
from waymark.operators.partition import partition_points
from waymark.schema import PING, require
from waymark.sources.files import Files

KEYS = ("tier", "partition_id")


def write_partitions(keyed: DataFrame, out_dir: str, mode: str = "append") -> dict[str, int]:
    """Write points with tier, partition_id and hilbert_idx, sorted by hilbert_idx; returns partitions by tier.

    The rebalancing hint lets adaptive execution give a large partition to several tasks, which then
    write a sorted file each. Partitions are counted while they are written.
    """
    require(keyed, *KEYS, "hilbert_idx")
    seen = Observation()
    named = [F.collect_set(F.when(F.col("tier") == t, F.col("partition_id").cast("string"))).alias(t) for t, _, _ in TIERS]
    keyed.observe(seen, *named).hint("rebalance", *KEYS).sortWithinPartitions(*KEYS, "hilbert_idx").write.mode(mode).partitionBy(*KEYS).parquet(out_dir)
    return {t: len(found) for t, _, _ in TIERS if (found := seen.get[t])}


def write_with_metadata(meta: DataFrame, points: DataFrame, out_dir: str) -> dict[str, int]:
    """As write_partitions, keys taken from meta (id, tier, partition_id, hilbert_idx)."""
    require(meta, "id", *KEYS, "hilbert_idx")
    return write_partitions(points.join(meta.select("id", *KEYS, "hilbert_idx"), "id"), out_dir)


def partition_existing_parquet(spark: SparkSession, src: str, out_dir: str) -> dict[str, int]:
    points = spark.read.parquet(src)
    require(points, "id", "lat", "lon")
    return write_partitions(partition_points(points), out_dir)


def partition_dirs(files: Files, root: str) -> list[str]:
    """tier=T/partition_id=P folders in order of tier and number."""
    found = [p.path for t in files.list(root) if t.is_dir and t.name.startswith("tier=") for p in files.list(t.path) if p.is_dir and p.name.startswith("partition_id=")]
    return sorted(found, key=partition_sort_key)


def _recover(files: Files, folder: str) -> None:
    """Finish or undo a compaction of a folder that broke off: originals come back unless the merged file has its name."""
    old, new = f"{folder}/_compact.old", f"{folder}/_compact.new"
    if files.exists(old):
        if not files.exists(f"{folder}/data.parquet"):
            for e in files.list(old):
                files.rename(e.path, f"{folder}/{e.name.removesuffix('.old')}")
        files.remove(old)
    files.remove(new)


def compact_partitions(spark: SparkSession, root: str, max_partition_bytes: int = 1_000_000_000) -> int:
    """Merge the files of each partition into data.parquet sorted by hilbert_idx; returns partitions merged.

    Partitions of one file, or of more than max_partition_bytes, stay as they are. Merged files are
    written beside the others, by one job for all partitions. A partition's originals are moved aside,
    then the merged file gets its name, then the originals go; a run that breaks off in between is
    finished or undone by the next one. Readers of Spark do not see what begins with an underscore.
    """
    files, merged = Files(spark, root), []
    for folder in partition_dirs(files, root):
        _recover(files, folder)
        own = [e for e in files.list(folder) if e.name.endswith(".parquet") and not e.is_dir]
        if len(own) > 1 and sum(e.size for e in own) <= max_partition_bytes:
            merged.append((folder, own))
    if not merged:
        return 0
    staging = f"{root}/_compact.new"
    files.remove(staging)
    df = spark.read.option("basePath", root).parquet(*[e.path for _, own in merged for e in own])
    df.repartition(len(merged), *KEYS).sortWithinPartitions(*KEYS, "hilbert_idx").write.partitionBy(*KEYS).parquet(staging)
    for folder, own in merged:
        whole = [e for e in files.list(staging + folder[len(root.rstrip("/")) :]) if e.name.startswith("part-")]
        files.make(f"{folder}/_compact.old")
        for e in own:
            files.rename(e.path, f"{folder}/_compact.old/{e.name}.old")
        files.rename(whole[0].path, f"{folder}/data.parquet")
        files.remove(f"{folder}/_compact.old")
    files.remove(staging)
    return len(merged)


def plan_buckets(sizes: list[tuple[int, int]], target_rows: int, split_threshold: float = 1.5) -> list[tuple[list[int], int | None]]:
    """Neighbouring partitions (id, rows) packed to about target_rows: (ids, None), or ([id], slices) of one that is too large.

    `ends` holds the running total of rows; a bucket that begins at row `begin` takes all partitions
    up to the last one whose end is within target_rows of it, and at least one.
    """
    ends = list(accumulate(rows for _, rows in sizes))
    plan: list[tuple[list[int], int | None]] = []
    i = 0
    while i < len(sizes):
        pid, rows = sizes[i]
        if rows > target_rows * split_threshold:
            plan.append(([pid], max(2, -(-rows // target_rows))))
            i += 1
            continue
        within = bisect_right(ends, ends[i] - rows + target_rows, i)
        large = next((k for k in range(i, within) if sizes[k][1] > target_rows * split_threshold), within)
        upto = max(i + 1, min(within, large))
        plan.append(([p for p, _ in sizes[i:upto]], None))
        i = upto
    return plan


def slice_cuts(df: DataFrame, slices: int, by: list[str] | None = None) -> DataFrame:
    """Hilbert numbers at which each group of df is cut into `slices` slices of equal rows: (by..., slice, cut)."""
    by = by or []
    w = Window.partitionBy(*by).orderBy("hilbert_idx")
    n = F.count(F.lit(1)).over(Window.partitionBy(*by))
    placed = df.select(*by, "hilbert_idx", (F.row_number().over(w) - 1).alias("_i"), n.alias("_n"))
    size = F.floor((F.col("_n") + slices - 1) / slices)
    wanted = placed.select("*", F.explode(F.sequence(F.lit(1), F.lit(slices - 1))).alias("slice"))
    return wanted.filter(F.col("_i") == F.least(F.col("slice") * size, F.col("_n") - 1)).select(*by, "slice", F.col("hilbert_idx").alias("cut"))


def plan_slices(df: DataFrame, slices: int, by: list[str] | None = None) -> DataFrame:
    """df with `slice`: the number of cuts at or below a row's hilbert_idx, so equal numbers stay together."""
    by = by or []
    cuts = slice_cuts(df, slices, by).groupBy(*by).agg(F.sort_array(F.collect_list("cut")).alias("_cuts"))
    joined = df.join(cuts, by) if by else df.crossJoin(F.broadcast(cuts))  # one row of slices - 1 numbers
    return joined.withColumn("slice", F.size(F.filter("_cuts", lambda c: c <= F.col("hilbert_idx")))).drop("_cuts")


def rebalance_partitions(spark: SparkSession, root: str, target_rows: int = 1_000_000, split_threshold: float = 1.5) -> int:
    """Pack and split the partitions of each tier to about target_rows rows under new consecutive numbers; returns how many.

    Two jobs a tier: rows and, for the partitions that are too large, quantiles of hilbert_idx (all of
    them in one grouped aggregation); then the rewrite, with a slice of equal hilbert_idx in one task.
    The new layout is written to `_rebalance.new`, then swapped in through `_rebalance.old`, tier by
    tier. A stale staging folder is removed; a leftover `_rebalance.old` means a crash during a swap
    and raises.
    """
    files = Files(spark, root)
    new, old = f"{root}/_rebalance.new", f"{root}/_rebalance.old"
    if files.exists(old):
        raise RuntimeError(f"{old} exists: an earlier run crashed mid-swap; restore or remove it first")
    files.remove(new)
    tiers = [e for e in files.list(root) if e.is_dir and e.name.startswith("tier=")]
    total = 0
    for tier in tiers:
        df = spark.read.option("basePath", tier.path).parquet(tier.path).withColumn("_pid", F.col("partition_id").cast("long")).drop("partition_id")
        sizes = sorted((r["_pid"], r["count"]) for r in df.groupBy("_pid").count().collect())  # one row per partition
        buckets = plan_buckets(sizes, target_rows, split_threshold)
        large = {ids[0]: slices for ids, slices in buckets if slices}
        cuts = hilbert_cuts(df.filter(F.col("_pid").isin(list(large))), large) if large else {}
        start, where = 0, []
        for ids, slices in buckets:
            where += [(i, start, cuts.get(i, [])) for i in ids]
            start += slices or 1
        plan = spark.createDataFrame(where, "_pid long, _start int, _cuts array<long>")
        moved = df.join(F.broadcast(plan), "_pid")  # one row per partition
        pid = F.col("_start") + F.size(F.filter("_cuts", lambda c: c <= F.col("hilbert_idx")))
        out = moved.withColumn("partition_id", F.format_string("%06d", pid)).drop("_pid", "_start", "_cuts")
        out.repartition("partition_id").sortWithinPartitions("partition_id", "hilbert_idx").write.partitionBy("partition_id").parquet(f"{new}/{tier.name}")
        total += start
    files.make(old)
    for tier in tiers:
        files.rename(tier.path, f"{old}/{tier.name}")
        files.rename(f"{new}/{tier.name}", tier.path)
    files.remove(new)
    files.remove(old)
    return total


def hilbert_cuts(df: DataFrame, slices: dict[int, int]) -> dict[int, list[int]]:
    """Hilbert numbers that cut each partition (_pid) into its slices of equal rows.

    Rows are counted by number first, so that running totals are taken over different numbers and
    not over rows; the cuts are then exact, and there are slices - 1 of them a partition.
    """
    counted = df.groupBy("_pid", "hilbert_idx").count()
    w = Window.partitionBy("_pid").orderBy("hilbert_idx")
    n = F.sum("count").over(Window.partitionBy("_pid"))
    k = F.create_map(*[F.lit(x) for item in slices.items() for x in item])[F.col("_pid")]
    behind = F.sum("count").over(w)
    placed = counted.select("_pid", "hilbert_idx", (behind - F.col("count")).alias("a"), behind.alias("z"), n.alias("n"), k.alias("k"))
    wanted = placed.select("_pid", "hilbert_idx", "a", "z", "n", F.explode(F.sequence(F.lit(1), F.col("k") - 1)).alias("i"), F.floor((F.col("n") + F.col("k") - 1) / F.col("k")).alias("size"))
    at = F.least(F.col("i") * F.col("size"), F.col("n") - 1)
    rows = wanted.filter((at >= F.col("a")) & (at < F.col("z"))).select("_pid", "i", "hilbert_idx").collect()  # a row a cut
    out: dict[int, list[int]] = {}
    for r in sorted(rows, key=lambda r: (r["_pid"], r["i"])):
        out.setdefault(r["_pid"], []).append(r["hilbert_idx"])
    return out


def partition_sort_key(path: str) -> tuple[str, int]:
    """(tier, partition number) of a path."""
    tier = re.search(r"tier=([^/]+)", path)
    pid = re.search(r"partition_id=(\d+)", path)
    return (tier[1] if tier else "", int(pid[1]) if pid else -1)


def parquet_rows(spark: SparkSession, folder: str) -> int:
    """Rows of the Parquet files of one folder, from their footers."""
    return sum(Files(spark, folder).rows_in_footers(folder).values())


def write_trips_partitioned(trips: list, out_dir: str, spark: SparkSession) -> dict[str, int]:
    """Write trips (lists of pings as dicts, or generated ones with `id` and `points`) by tier and partition.

    Speed and heading are rounded to one decimal.
    """
    rows = [(t["id"], p["time"], float(p["lat"]), float(p["lon"]), round(float(p["speed"]), 1), round(float(p["heading"]), 1)) for t in trips for p in t["points"]]
    return write_partitions(partition_points(spark.createDataFrame(rows, PING)), out_dir)
