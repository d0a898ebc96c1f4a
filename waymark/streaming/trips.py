"""Streams of pings (an extension): observation gaps as session windows, and the two cleaning filters with state."""

from __future__ import annotations

from collections.abc import Iterator
from datetime import timedelta

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from waymark.functions.geo import KMH_TO_MPS
from waymark.operators import walk


def gap_segments(stream: DataFrame, gap: timedelta, delay: timedelta, id_col: str = "id", time_col: str = "time") -> DataFrame:
    """A row per vehicle and stretch without a silence longer than gap: start, end and pings; later pings than delay are dropped."""
    seconds = lambda x: f"{int(x.total_seconds())} seconds"
    timed = stream.withColumn("_at", F.col(time_col).cast("timestamp")).withWatermark("_at", seconds(delay))
    found = timed.groupBy(id_col, F.session_window("_at", seconds(gap))).agg(F.min(time_col).alias("start"), F.max(time_col).alias("end"), F.count(F.lit(1)).alias("n_points"))
    return found.drop("session_window")


COLUMNS = ["time", "lat", "lon", "speed", "heading"]


def tracks_of(rows: pd.DataFrame) -> walk.Tracks:
    """Rows of one vehicle; times in microseconds."""
    known = {c: rows[c].notna().to_numpy() for c in COLUMNS}
    value = {c: rows[c].fillna(0).to_numpy(float) for c in COLUMNS[1:]}
    value["time"] = pd.to_datetime(rows["time"]).fillna(pd.Timestamp(0)).astype("datetime64[us]").astype("int64").to_numpy()
    return walk.Tracks(value, known, np.arange(len(rows)) == 0)


def kept_rows(tracks: walk.Tracks, held: np.ndarray) -> list[list[float]]:
    return [[float(tracks.value[c][i]) for c in COLUMNS] for i in held.tolist()]


def held_rows(state: list[list[float]]) -> walk.Tracks:
    """Rows of a state again; what they are held against is never null."""
    rows = np.array(state, float).reshape(-1, len(COLUMNS))
    value = {c: rows[:, i] for i, c in enumerate(COLUMNS)} | {"time": rows[:, 0].astype(np.int64)}
    return walk.Tracks(value, {c: np.ones(len(rows), bool) for c in COLUMNS}, np.arange(len(rows)) == 0)


def clean(stream: DataFrame, stale_window: int = 5, max_speed_kmh: float = 200.0) -> DataFrame:
    """Pings (id, time, lat, lon, speed, heading) that neither repeat a recent one nor need an impossible speed.

    State per vehicle: the last kept moving pings and the anchor. Pings of a micro-batch are taken by time.
    """
    kinds = ", ".join(f"`{c}` {t}" for c, t in stream.dtypes)

    def run(key: tuple, frames: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        ring, anchor = state.get if state.exists else ([], [])
        rows = pd.concat(list(frames)).sort_values("time", na_position="first", kind="stable")
        steps = ((ring, lambda t: walk.fresh(t, COLUMNS[1:], "speed", stale_window)), (anchor, lambda t: walk.possible(t, "time", "lat", "lon", max_speed_kmh * KMH_TO_MPS)))
        held = []
        for before, step in steps:
            earlier = held_rows(before)
            given = tracks_of(rows).after(earlier) if len(rows) else earlier
            stay, last = step(given)
            held.append(kept_rows(given, last))
            rows = rows[stay[earlier.n :]]
        state.update(tuple(held))
        yield rows

    return stream.groupBy("id").applyInPandasWithState(run, kinds, "ring array<array<double>>, anchor array<array<double>>", "append", GroupStateTimeout.NoTimeout)
