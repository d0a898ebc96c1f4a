"""The events table seen as GPS pings: deterministic positions, the same doubles in Spark and in SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def gps_points(spark: SparkSession, sf_dir: str) -> DataFrame:
    """id, time, lat, lon, speed, heading of each event."""
    e = spark.read.parquet(f"{sf_dir}/events.parquet")
    k = F.get_json_object("props", "$.k").cast("long")
    d = F.datediff(F.to_date("ts"), F.lit("2024-01-01").cast("date")).cast("double")
    base = e.select(F.concat(F.lit("truck_"), F.lpad(F.col("user_id").cast("string"), 6, "0")).alias("id"), F.col("ts").alias("time"), "event_type", "value", k.alias("k"), d.alias("d"))
    jump = F.when((F.col("event_type") == "error") & (F.col("k") % 5 == 0), 20.0).otherwise(0.0)
    return base.select(
        "id", "time",
        (F.lit(43.0) + F.col("d") * 0.05 + (F.col("k") % 2).cast("double") * 0.0001 + jump).alias("lat"),
        (F.lit(-79.0) - (F.col("d") % 7) * 0.05).alias("lon"),
        (F.floor(F.col("value") / 25.0).cast("double") * 10.0).alias("speed"),
        ((F.col("k") % 4).cast("double") * 90.0).alias("heading"),
    )


#: The same in DuckDB.
GPS_SQL = """gps AS (
  SELECT 'truck_' || lpad(CAST(user_id AS VARCHAR), 6, '0') AS id, ts AS time,
    43.0::DOUBLE + d * 0.05::DOUBLE + (k % 2)::DOUBLE * 0.0001::DOUBLE
      + CASE WHEN event_type = 'error' AND k % 5 = 0 THEN 20.0::DOUBLE ELSE 0.0::DOUBLE END AS lat,
    -79.0::DOUBLE - (d % 7) * 0.05::DOUBLE AS lon,
    floor(value / 25.0::DOUBLE) * 10.0::DOUBLE AS speed,
    (k % 4)::DOUBLE * 90.0::DOUBLE AS heading
  FROM (SELECT *, CAST(json_extract_string(props, '$.k') AS BIGINT) AS k,
          date_diff('day', TIMESTAMP '2024-01-01', ts)::DOUBLE AS d FROM events)
)"""
