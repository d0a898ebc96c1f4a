"""Road usage in three stages (counts, geometries, index), each kept as a table and skipped where it is there already."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from waymark.operators import ways
from waymark.sources.files import Files

STAGES = ("counts", "geometries", "index")


def run_way_usage(spark: SparkSession, matched_dir: str, roads_path: str, out_dir: str, force: bool = False, force_stage: int | None = None) -> DataFrame:
    """The index of ways (way_id, trip_count, n_trips, geometry, boxes, centroids) under out_dir, most used first.

    A stage runs if its table is missing, if `force` is set, or from stage number `force_stage`
    (1 to 3) on; a table counts as there once its job has ended (`_SUCCESS`).
    """
    files = Files(spark, out_dir)

    def stage(number: int, make) -> DataFrame:
        at = f"{out_dir}/{STAGES[number - 1]}"
        if force or (force_stage is not None and number >= force_stage) or not files.exists(f"{at}/_SUCCESS"):
            make().write.mode("overwrite").parquet(at)
        return spark.read.parquet(at)

    counts = stage(1, lambda: ways.way_counts(spark.read.parquet(matched_dir).select("id", "way_id")))
    joined = stage(2, lambda: ways.way_geometry(counts, spark.read.parquet(roads_path).select("feature_id", "geometry")))
    return stage(3, lambda: ways.way_index(joined).orderBy(F.desc("trip_count"), "way_id"))
