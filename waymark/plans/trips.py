"""Whole plans: raw pings to trips, and trips to a partitioned dataset."""

from __future__ import annotations

from datetime import timedelta

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from waymark.functions import ids
from waymark.operators.partition import partition_points
from waymark.operators.trajectory import clean_and_split
from waymark.plans.layout import compact_partitions, rebalance_partitions, write_partitions

#: Defaults of the pipeline.
GAP, DIAMETER_M, DURATION, ANGLE, SPEED_KMH, MIN_LENGTH = timedelta(minutes=30), 250.0, timedelta(minutes=5), 30.0, 200.0, 2


def split_trips(df: DataFrame, gap: timedelta = GAP, stop_max_diameter: float = DIAMETER_M, stop_min_duration: timedelta = DURATION, traffic_max_angle_change: float | None = ANGLE, traffic_min_distance: float = 10.0, min_length: int = 3, stale_window: int | None = 5) -> DataFrame:
    """Pings with gap_segment_id, is_stop and a segment_id that numbers (gap, stop) pairs densely, from 1, over the whole frame.

    Stale pings go first, impossible speeds stay; min_length holds for the segments between gaps
    and for movements. Numbers are given to the distinct pairs and joined back, so that no window
    runs over all pings.
    """
    found = clean_and_split(df, gap, stop_max_diameter, stop_min_duration, traffic_max_angle_change, traffic_min_distance, min_length, stale_window, None).withColumnRenamed("segment_id", "_stop")
    pairs = found.select("gap_segment_id", "_stop").distinct()
    number = F.row_number().over(Window.orderBy("gap_segment_id", "_stop")).alias("segment_id")  # of pairs, as many as a vehicle has at most
    # one row a pair: joined by broadcast where that is small, else with the frequent pairs split by adaptive execution
    return found.join(pairs.select("gap_segment_id", "_stop", number), ["gap_segment_id", "_stop"]).select(*[c for c in found.columns if c != "_stop"], "segment_id")


def trips(df: DataFrame, gap: timedelta = GAP, stop_max_diameter: float = DIAMETER_M, stop_min_duration: timedelta = DURATION, traffic_max_angle_change: float | None = ANGLE, traffic_min_distance: float = 10.0, min_length: int = MIN_LENGTH, stale_window: int | None = 5, max_speed_kmh: float | None = SPEED_KMH, unit_col: str | None = None) -> DataFrame:
    """Cleaned pings with gap_segment_id, segment_id, is_stop and a composite id; min_length holds for the segments between gaps and for movements.

    unit_col (such as a column of file names) makes a vehicle start anew in every unit, as when
    files are processed one by one; ids can then repeat.
    """
    if unit_col is not None:
        df = df.withColumn("_truck", F.col("id")).withColumn("id", F.concat_ws("\u0000", "id", unit_col))
    found = clean_and_split(df, gap, stop_max_diameter, stop_min_duration, traffic_max_angle_change, traffic_min_distance, min_length, stale_window, max_speed_kmh)
    if unit_col is not None:
        found = found.withColumn("id", F.col("_truck")).drop("_truck")
    return found.withColumn("id", ids.trip_id())


def run_pipeline(spark: SparkSession, input_dir: str, output_dir: str, rebalance_rows: int | None = None, compact: bool = False, **options) -> dict[str, int]:
    """Split all pings under input_dir into trips and write them by tier and partition; returns partitions by tier."""
    pings = spark.read.option("recursiveFileLookup", "true").parquet(input_dir)
    summary = write_partitions(partition_points(trips(pings, **options)), output_dir, mode="overwrite")
    if rebalance_rows:
        rebalance_partitions(spark, output_dir, rebalance_rows)
    elif compact:
        compact_partitions(spark, output_dir)
    return summary
