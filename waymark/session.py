"""Spark session with the settings that the library relies on."""

from __future__ import annotations

from pyspark.sql import SparkSession

#: UTC, so that naive times keep their distances; partition values of paths stay strings ("01" is not 1).
REQUIRED = {
    "spark.sql.session.timeZone": "UTC",
    "spark.sql.sources.partitionColumnTypeInference.enabled": "false",
    "spark.sql.adaptive.enabled": "true",
}


def session(name: str = "waymark", **conf: str) -> SparkSession:
    """A session with REQUIRED and further settings (a dot in a name is written as two underscores)."""
    builder = SparkSession.builder.appName(name)
    for key, value in (REQUIRED | {k.replace("__", "."): v for k, v in conf.items()}).items():
        builder = builder.config(key, value)
    return builder.getOrCreate()
