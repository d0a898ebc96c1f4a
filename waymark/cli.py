"""Command line: process, split-gap, split-stops, generate, partition."""

from __future__ import annotations

import argparse
import sys
from datetime import datetime, timedelta

from pyspark.sql import DataFrame

from waymark.operators import trajectory
from waymark.plans.layout import partition_existing_parquet
from waymark.session import session
from waymark.sources.readers import csv_columns, process, to_file


def emit(df: DataFrame, output: str | None, kind: str | None) -> None:
    """CSV to standard output unless told otherwise, Parquet to a file; Parquet does not go to a terminal."""
    kind = kind or ("parquet" if output else "csv")
    if kind == "parquet":
        if not output:
            raise SystemExit("parquet needs --output")
        print(f"{to_file(df, output)} rows written to {output}", file=sys.stderr)
    elif output:
        df.write.mode("overwrite").option("header", True).csv(output)
    else:
        print(",".join(df.columns))
        for row in df.toLocalIterator():
            print(",".join("" if v is None else str(v) for v in row))


def parser() -> argparse.ArgumentParser:
    p = argparse.ArgumentParser(prog="waymark")
    sub = p.add_subparsers(dest="command", required=True)
    common = argparse.ArgumentParser(add_help=False)
    common.add_argument("-o", "--output")
    common.add_argument("--format", choices=("csv", "parquet"))
    for name in ("process", "split-gap", "split-stops"):
        c = sub.add_parser(name, parents=[common])
        c.add_argument("input")
        if name == "split-gap":
            c.add_argument("--gap", type=float, default=1800.0, help="seconds")
        if name == "split-stops":
            c.add_argument("--diameter", type=float, default=250.0, help="metres")
            c.add_argument("--duration", type=float, default=300.0, help="seconds")
        if name != "process":
            c.add_argument("--min-length", type=int, default=0)
    g = sub.add_parser("generate", parents=[common])
    g.add_argument("--origin", required=True, help="lat,lon")
    g.add_argument("--destination", required=True, help="lat,lon")
    g.add_argument("--departure", default="2024-06-10T08:00:00")
    g.add_argument("--trip-id", default="trip_0")
    g.add_argument("--seed", type=int, default=0)
    g.add_argument("--errors", action="store_true", help="with the default error profile")
    c = sub.add_parser("partition")
    c.add_argument("input")
    c.add_argument("output")
    return p


def main(argv: list[str] | None = None) -> int:
    a = parser().parse_args(argv)
    spark = session("waymark-cli")
    if a.command == "partition":
        for tier, n in sorted(partition_existing_parquet(spark, a.input, a.output).items()):
            print(f"{tier}: {n}")
        return 0
    if a.command == "generate":
        from waymark.generate import TripConfig, default_error_profile, generate_traces

        place = lambda s: tuple(map(float, s.split(",")))
        trip = TripConfig(a.trip_id, place(a.origin), place(a.destination), datetime.fromisoformat(a.departure), seed=a.seed, errors=default_error_profile() if a.errors else [])
        df = generate_traces(spark, [trip])
        emit(csv_columns(df) if a.format != "parquet" else df, a.output, a.format)
        return 0
    df = spark.read.parquet(a.input)
    if a.command == "process":
        df = process(df)
    elif a.command == "split-gap":
        df = trajectory.split_by_observation_gap(df, timedelta(seconds=a.gap), min_length=a.min_length)
    else:
        df = trajectory.split_by_stops(df, a.diameter, timedelta(seconds=a.duration), min_length=a.min_length)
    emit(df, a.output, a.format)
    return 0
