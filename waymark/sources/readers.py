"""Reading pings and trips: whole files, hive layouts, lookups by truck or trip, and an index of files."""

from __future__ import annotations

import json
import re
from datetime import date, datetime, timedelta, timezone

from pyspark.sql import Column, DataFrame, Observation, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from waymark.functions import geo, ids
from waymark.schema import require
from waymark.sources.files import Files

INDEX_FILE, INDEX_VERSION, KEY_LENGTH = ".chunk_index.json", 2, 3


def read_parquet(spark: SparkSession, path: str, schema: str | None = None) -> DataFrame:
    reader = spark.read.schema(schema) if schema else spark.read
    return reader.parquet(path)


def read_dataset(df: DataFrame) -> DataFrame:
    """A frame that is read already, as it is."""
    return df


def process(df: DataFrame, speed_col: str = "speed") -> DataFrame:
    """df with speed_mps, from a speed in km/h."""
    require(df, speed_col)
    return df.withColumn("speed_mps", geo.speed_mps(speed_col))


def to_file(df: DataFrame, out: str) -> int:
    """Write df and return its rows, counted while they are written."""
    seen = Observation()
    df.observe(seen, F.count(F.lit(1)).alias("rows")).write.mode("overwrite").parquet(out)
    return int(seen.get["rows"])


def file_operator(operator):
    """The variant of an operator that reads a file, writes a file and returns the rows written."""

    def run(spark: SparkSession, src: str, out: str, *args, **kwargs) -> int:
        return to_file(operator(spark.read.parquet(src), *args, **kwargs), out)

    run.__doc__ = operator.__doc__
    return run


def scan_raw(spark: SparkSession, root: str) -> DataFrame:
    """Raw pings under year=YYYY/chunk_id=XX; both stay strings, so that chunk 01 is not 1."""
    sample = spark.read.parquet(root)
    fields = [T.StructField(f.name, T.StringType()) if f.name in ("year", "chunk_id") else f for f in sample.schema.fields]
    return spark.read.schema(T.StructType(fields)).parquet(root)


def raw_truck(df: DataFrame, truck: str) -> DataFrame:
    """Pings of one truck; its chunk prunes the partitions."""
    return df.filter((F.col("chunk_id") == truck[-2:]) & (F.col("id") == truck))


def scan_raw_truck(spark: SparkSession, root: str, truck: str) -> DataFrame:
    return raw_truck(scan_raw(spark, root), truck)


def of_truck(df: DataFrame, truck: str) -> DataFrame:
    """Trips whose id starts with the truck's (a truck id that another one begins with matches both)."""
    return df.filter(F.col("id").startswith(truck))


def scan_partitioned_truck(spark: SparkSession, root: str, truck: str) -> DataFrame:
    return of_truck(spark.read.parquet(root), truck)


def scan_partitioned_trip(spark: SparkSession, root: str, trip: str) -> DataFrame:
    return spark.read.parquet(root).filter(F.col("id") == trip)


#: Matched trips have the same layout; Spark leaves out what starts with an underscore beside them.
scan_matched_truck, scan_matched_trip = scan_partitioned_truck, scan_partitioned_trip


def scan_trips(spark: SparkSession, root: str, trips: list[str]) -> DataFrame:
    return spark.read.parquet(root).filter(F.col("id").isin(trips))


def _bound(value: str | datetime, aware: bool) -> datetime:
    at = datetime.fromisoformat(value) if isinstance(value, str) else value
    if aware and at.tzinfo is None:
        return at.replace(tzinfo=timezone.utc)
    return at.astimezone(timezone.utc).replace(tzinfo=None) if not aware and at.tzinfo else at


def time_range(df: DataFrame, start: str | datetime | None, end: str | datetime | None, time_col: str = "time") -> DataFrame:
    """Rows of [start, end); ISO strings count, and bounds without zone are UTC if the column has one."""
    aware = isinstance(df.schema[time_col].dataType, T.TimestampType)
    kind = "timestamp" if aware else "timestamp_ntz"
    lit = lambda v: F.lit(_bound(v, aware).isoformat()).cast(kind)
    if start is not None:
        df = df.filter(F.col(time_col) >= lit(start))
    if end is not None:
        df = df.filter(F.col(time_col) < lit(end))
    return df


def date_range(df: DataFrame, first: date, last: date, time_col: str = "time") -> DataFrame:
    """Rows of the days first to last, both included, as a range of times that reaches the scan."""
    return time_range(df, datetime.combine(first, datetime.min.time()), datetime.combine(last, datetime.min.time()) + timedelta(days=1), time_col)


def load_truck_trace(spark: SparkSession, truck: str, start=None, end=None, data_dir: str | None = None, index: ChunkIndex | None = None) -> DataFrame:
    """A truck's pings in [start, end) by time, from raw data or from an index; none raises ValueError."""
    if (data_dir is None) == (index is None):
        raise ValueError("give either data_dir or index")
    df = scan_raw_truck(spark, data_dir, truck) if data_dir is not None else index.scan_truck(spark, truck)
    out = time_range(df, start, end).orderBy("time")
    if out.isEmpty():
        raise ValueError(f"no rows for {truck}")
    return out


def chunk_files(df: DataFrame) -> DataFrame:
    """(chunk_id, paths) of trips read from files; only ids are read."""
    pairs = df.select(ids.trip_chunk("id").alias("chunk_id"), F.col("_metadata.file_path").alias("path")).distinct()
    return pairs.groupBy("chunk_id").agg(F.sort_array(F.collect_set("path")).alias("paths"))


class ChunkIndex:
    """Files that hold the trips of trucks whose ids end alike."""

    def __init__(self, root: str, index: dict[str, list[str]]):
        self.root, self.index = root, index

    @classmethod
    def build(cls, spark: SparkSession, root: str) -> ChunkIndex:
        plain = lambda p: re.sub("^file:/+", "/", p)
        base = plain(Files(spark, root).qualified(root)).rstrip("/") + "/"
        rows = chunk_files(spark.read.parquet(root)).collect()  # a row per key, as many as three characters allow
        return cls(root, {r["chunk_id"]: sorted(plain(p).removeprefix(base) for p in r["paths"]) for r in rows})

    def save(self) -> str:
        path = f"{self.root}/{INDEX_FILE}"
        Files(SparkSession.active(), self.root).write_text(path, json.dumps({"version": INDEX_VERSION, "chunk_id_len": KEY_LENGTH, "index": self.index}))
        return path

    @classmethod
    def load(cls, root: str) -> ChunkIndex:
        data = json.loads(Files(SparkSession.active(), root).read_text(f"{root}/{INDEX_FILE}"))
        if not isinstance(data, dict) or "version" not in data:
            raise ValueError("an index of an old form; build it again")
        if data.get("chunk_id_len") != KEY_LENGTH:
            raise ValueError(f"an index with keys of {data.get('chunk_id_len')} characters, not {KEY_LENGTH}")
        return cls(root, data["index"])

    def _files(self, truck: str) -> list[str]:
        key = truck[-KEY_LENGTH:]
        if key not in self.index:
            raise FileNotFoundError(f"no files for chunk {key}")
        return [f"{self.root}/{p}" for p in self.index[key]]

    def scan_truck(self, spark: SparkSession, truck: str) -> DataFrame:
        return of_truck(spark.read.option("basePath", self.root).parquet(*self._files(truck)), truck)

    def scan_trip(self, spark: SparkSession, trip: str) -> DataFrame:
        return spark.read.option("basePath", self.root).parquet(*self._files(ids.truck_id_from_trip(trip))).filter(F.col("id") == trip)

    def chunk_ids(self) -> list[str]:
        return sorted(self.index)

    def __len__(self) -> int:
        return len(self.index)

    def __repr__(self) -> str:
        return f"ChunkIndex({self.root!r}, {len(self)} chunks)"


def csv_columns(df: DataFrame) -> DataFrame:
    """Pings as text: six decimals of position, one of speed and heading, times in UTC with a Z."""
    fixed = lambda c, n: F.format_string(f"%.{n}f", F.col(c)).alias(c)
    when: Column = F.date_format(F.col("time"), "yyyy-MM-dd'T'HH:mm:ss'Z'").alias("time")
    return df.select("id", when, fixed("lat", 6), fixed("lon", 6), fixed("speed", 1), fixed("heading", 1))


def traces_to_csv(df: DataFrame, out: str) -> None:
    csv_columns(df).write.mode("overwrite").option("header", True).csv(out)


def traces_to_parquet(df: DataFrame, out: str) -> int:
    return to_file(df.withColumns({"speed": F.round("speed", 1), "heading": F.round("heading", 1)}), out)


def union_relaxed(frames: list[DataFrame]) -> DataFrame:
    """UNION ALL by name: columns that a frame lacks are null in it, and numeric types are widened."""
    out = frames[0]
    for f in frames[1:]:
        out = out.unionByName(f, allowMissingColumns=True)
    return out
