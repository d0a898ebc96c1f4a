"""Walks over trajectories: what no window function can say, because each step depends on the last verdict.

Rows are dealt by vehicle and sorted by time within partitions. A walk sees its rows as arrays and
decides most of them at once; Python steps only where a verdict hangs on an earlier one: repeated
tuples, impossible moves, stops. Filters that look back carry a few rows from batch to batch; walks
that look ahead get all rows of a vehicle, several vehicles at a time where these are short.
"""

from __future__ import annotations

import math
from bisect import bisect_left
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import types as T

from waymark.functions.geo import EARTH_M
from waymark.schema import micros

US = "_micros"
#: Rows of a stop that are stepped through singly; longer ones go on in blocks.
SINGLY = 64


def haversine(lat1, lon1, lat2, lon2) -> np.ndarray:
    dy, dx = np.sin(np.radians(lat2 - lat1) / 2), np.sin(np.radians(lon2 - lon1) / 2)
    return 2 * EARTH_M * np.arcsin(np.sqrt(np.minimum(1.0, dy * dy + np.cos(np.radians(lat1)) * np.cos(np.radians(lat2)) * dx * dx)))


def metres(lat1: float, lon1: float, lat2: float, lon2: float) -> float:
    """The same for one pair."""
    dy, dx = math.sin(math.radians(lat2 - lat1) / 2), math.sin(math.radians(lon2 - lon1) / 2)
    return 2 * EARTH_M * math.asin(math.sqrt(min(1.0, dy * dy + math.cos(math.radians(lat1)) * math.cos(math.radians(lat2)) * dx * dx)))


def bearing_of(lat1: float, lon1: float, lat2: float, lon2: float) -> float:
    """Bearing from one position to another."""
    return float(bearing(lat1, lon1, lat2, lon2))


def bearing(lat1, lon1, lat2, lon2) -> np.ndarray:
    a, b, d = np.radians(lat1), np.radians(lat2), np.radians(lon2 - lon1)
    return np.degrees(np.arctan2(np.sin(d) * np.cos(b), np.cos(a) * np.sin(b) - np.sin(a) * np.cos(b) * np.cos(d))) % 360.0


class Tracks:
    """Rows of vehicles one after another: arrays by column, which of their values are not null, and where vehicles begin."""

    def __init__(self, value: dict[str, np.ndarray], known: dict[str, np.ndarray], begins: np.ndarray, named: np.ndarray | None = None):
        self.value, self.known, self.begins, self.n = value, known, begins, len(begins)
        self.named = np.ones(self.n, bool) if named is None else named  # rows with an id

    @classmethod
    def of(cls, table: pa.Table | pa.RecordBatch, id_col: str, columns: list[str]) -> Tracks:
        value, known = {}, {}
        for c in columns:
            column = table[c].combine_chunks() if isinstance(table, pa.Table) else table.column(c)
            known[c] = pc.is_valid(column).to_numpy(zero_copy_only=False)
            value[c] = (column.fill_null(False if pa.types.is_boolean(column.type) else 0) if column.null_count else column).to_numpy(zero_copy_only=False)
        ids = table[id_col].combine_chunks() if isinstance(table, pa.Table) else table.column(id_col)
        code = ids.dictionary_encode(null_encoding="encode").indices.to_numpy()
        return cls(value, known, np.append(True, code[1:] != code[:-1])[: len(code)], pc.is_valid(ids).to_numpy(zero_copy_only=False))

    @property
    def first(self) -> np.ndarray:
        """Index of the first row of each row's vehicle."""
        return np.maximum.accumulate(np.where(self.begins, np.arange(self.n), 0))

    @property
    def behind(self) -> np.ndarray:
        """Index behind the last row of each row's vehicle."""
        starts = np.flatnonzero(self.begins)
        return np.repeat(np.append(starts[1:], self.n), np.diff(np.append(starts, self.n)))

    def all_known(self, *columns: str) -> np.ndarray:
        return np.logical_and.reduce([self.known[c] for c in columns])

    def take(self, mask: np.ndarray) -> Tracks:
        vehicle = np.cumsum(self.begins)[mask]
        return Tracks({c: v[mask] for c, v in self.value.items()}, {c: v[mask] for c, v in self.known.items()}, np.append(True, vehicle[1:] != vehicle[:-1])[: len(vehicle)], self.named[mask])

    def after(self, earlier: Tracks | None) -> Tracks:
        """With the rows of `earlier` in front, which belong to the first vehicle."""
        if earlier is None or not earlier.n:
            return self
        joined = lambda a, b: {c: np.concatenate([a[c], b[c]]) for c in a}
        begins = np.concatenate([earlier.begins, self.begins])
        begins[earlier.n] = False
        return Tracks(joined(earlier.value, self.value), joined(earlier.known, self.known), begins, np.concatenate([earlier.named, self.named]))


# --- Filters: rows that stay, and the rows at the end that later ones are held against -----------


def fresh(tracks: Tracks, columns: list[str], speed: str, window: int) -> tuple[np.ndarray, np.ndarray]:
    """Rows whose position, speed and heading are not among those of the last `window` kept moving rows of the vehicle.

    A row can only be dropped if an equal one came before it, and it is if that one's place among
    the kept rows is at most `window` back; so only such rows are stepped through.
    """
    keep = np.ones(tracks.n, bool)
    moving = np.flatnonzero(tracks.all_known(*columns) & (tracks.value[speed] != 0))
    bits = np.stack([np.cumsum(tracks.begins)[moving], *(tracks.value[c][moving].view(np.int64) for c in columns)], 1)  # -0.0 and 0.0 differ
    code = pa.Array.from_buffers(pa.binary(8 * bits.shape[1]), len(bits), [None, pa.py_buffer(np.ascontiguousarray(bits))]).dictionary_encode().indices.to_numpy()
    _, first = np.unique(code, return_index=True)
    again = np.ones(len(moving), bool)
    again[first] = False
    dropped: list[int] = []
    place: dict[int, int] = {}  # of the last kept row of a code, among kept rows
    firsts = first.tolist()
    for i, c in zip(np.flatnonzero(again).tolist(), code[again].tolist()):
        if c not in place:
            place[c] = firsts[c] - bisect_left(dropped, firsts[c])
        here = i - len(dropped)
        if here - place[c] <= window:
            dropped.append(i)
        else:
            place[c] = here
    keep[moving[dropped]] = False
    left = moving[keep[moving]]
    return keep, left[left >= tracks.first[-1]][-window:] if tracks.n else left


def possible(tracks: Tracks, time: str, lat: str, lon: str, limit: float) -> tuple[np.ndarray, np.ndarray]:
    """Rows that the last kept row (the anchor) can reach at `limit` metres a second; dt <= 0 and nulls pass and leave the anchor.

    Where every move between neighbours is possible, each row is the next one's anchor: steps are
    taken only from an impossible or standing move on, until a row becomes the anchor again.
    """
    keep = np.ones(tracks.n, bool)
    at = np.flatnonzero(tracks.all_known(time, lat, lon))
    t, y, x, vehicle = tracks.value[time][at], tracks.value[lat][at], tracks.value[lon][at], tracks.first[at]
    seconds = np.diff(t) / 1e6
    with np.errstate(divide="ignore", invalid="ignore"):
        odd = (vehicle[1:] == vehicle[:-1]) & ((seconds <= 0) | (haversine(y[:-1], x[:-1], y[1:], x[1:]) / seconds > limit))
    odd = np.flatnonzero(odd) + 1
    anchor, n = max(0, len(at) - 1), len(at)
    todo = 0
    while todo < len(odd):
        anchor = i = int(odd[todo]) - 1
        while (i := i + 1) < n and vehicle[i] == vehicle[anchor]:
            dt = (int(t[i]) - int(t[anchor])) / 1e6
            if dt > 0:
                if metres(float(y[anchor]), float(x[anchor]), float(y[i]), float(x[i])) / dt > limit:
                    keep[at[i]] = False
                else:
                    break
        if i < n:
            anchor = n - 1
        todo = int(np.searchsorted(odd, i + 1))
    last = at[anchor : anchor + 1]
    return keep, last[last >= tracks.first[-1]] if tracks.n else last


# --- Splits ---------------------------------------------------------------------------------------


def numbers(tracks: Tracks, turn: np.ndarray) -> np.ndarray:
    """0 at each vehicle's first row, and one more wherever `turn` holds."""
    total = np.cumsum(turn & ~tracks.begins)
    return (total - total[tracks.first]).astype(np.int32) if tracks.n else total.astype(np.int32)


def changes(flags: np.ndarray) -> np.ndarray:
    return np.append(False, flags[1:] != flags[:-1])[: len(flags)]


def late(tracks: Tracks, time: str, gap: int) -> np.ndarray:
    """Rows more than `gap` microseconds after the row before."""
    t, known = tracks.value[time], tracks.known[time]
    return np.append(False, (np.diff(t) > gap) & known[1:] & known[:-1])[: tracks.n]


def times_in(tracks: Tracks, time: str, number: np.ndarray) -> np.ndarray:
    """Rows with a time in each row's segment."""
    run = np.cumsum(tracks.begins | changes(number))
    return np.bincount(run, tracks.known[time], tracks.n + 1)[run] if tracks.n else run


def first_at(t: np.ndarray, target: np.ndarray, low: np.ndarray, high: np.ndarray) -> np.ndarray:
    """First index from low to below high with t >= target (else high), for all rows at once; t ascends there."""
    low, high = low.copy(), high.copy()
    for _ in range(int(max(1, len(t))).bit_length() + 1):
        middle = (low + high) // 2
        open_ = low < high
        short = open_ & (t[np.minimum(middle, len(t) - 1)] < target)
        low = np.where(short, middle + 1, low)
        high = np.where(open_ & ~short, middle, high)
    return low


def extremes(v: np.ndarray, a: np.ndarray, b: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(min, max) of v[a : b + 1] of each pair, from runs of ever doubled length."""
    power = np.log2(b - a + 1).astype(np.int64)
    low, high = np.empty(len(a)), np.empty(len(a))
    least = most = v
    for k in range(int(power.max(initial=0)) + 1):
        if k:
            half = 1 << (k - 1)
            least, most = np.fmin(least[:-half], least[half:]), np.fmax(most[:-half], most[half:])
        own = np.flatnonzero(power == k)
        other = b[own] - (1 << k) + 1
        low[own], high[own] = np.fmin(least[a[own]], least[other]), np.fmax(most[a[own]], most[other])
    return low, high


def stop_ranges(tracks: Tracks, time: str, lat: str, lon: str, diameter: float, duration: int) -> list[tuple[int, int]]:
    """Inclusive ranges of rows that stay in a box of the given diagonal for the given microseconds, taken greedily.

    A stop that begins at a row must still be in its box at the first row that is late enough; the
    box of all rows up to there rules out nearly all beginnings at once. The others are followed to
    the row that leaves the box, where the next beginning is looked for.
    """
    n = tracks.n
    if not n:
        return []
    degrees = diameter / 111_000.0
    t, timed, placed = tracks.value[time], tracks.known[time], tracks.all_known(lat, lon)
    y, x, behind, rows = tracks.value[lat], tracks.value[lon], tracks.behind, np.arange(n)
    due = rows if duration <= 0 else np.where(timed, first_at(t, t + duration, rows, behind), behind)
    gone = np.cumsum(~placed)
    start = np.flatnonzero(placed & (due < behind))
    start = start[gone[due[start]] == gone[start]]
    south, north = extremes(y, start, due[start])
    west, east = extremes(x, start, due[start])
    out = (north - south > degrees) | (east - west > degrees) | (haversine(south, west, north, east) > diameter)
    start = start[~out]
    ys, xs, ok = y.tolist(), x.tolist(), placed.tolist()
    found, todo, starts = [], 0, start.tolist()

    def leaves(a: int, end: int) -> int:
        """The first row from a on that is outside the box of those before it."""
        s = north = ys[a]
        w = east = xs[a]
        for i in range(a + 1, min(end, a + SINGLY)):
            if not ok[i]:
                return i
            v, u = ys[i], xs[i]
            if not (s <= v <= north and w <= u <= east):
                s, north, w, east = np.fmin(s, v), np.fmax(north, v), np.fmin(w, u), np.fmax(east, u)
                if north - s > degrees or east - w > degrees or metres(s, w, north, east) > diameter:
                    return i
        i, step = a + SINGLY, 4 * SINGLY
        while i < end:
            part = slice(i, min(end, i + step))
            s_, n_ = np.fmin(np.fmin.accumulate(y[part]), s), np.fmax(np.fmax.accumulate(y[part]), north)
            w_, e_ = np.fmin(np.fmin.accumulate(x[part]), w), np.fmax(np.fmax.accumulate(x[part]), east)
            away = ~placed[part] | (n_ - s_ > degrees) | (e_ - w_ > degrees) | (haversine(s_, w_, n_, e_) > diameter)
            if away.any():
                return i + int(away.argmax())
            s, north, w, east = s_[-1], n_[-1], w_[-1], e_[-1]
            i, step = part.stop, 4 * step
        return end

    while todo < len(starts):
        a = starts[todo]
        end = leaves(a, int(behind[a]))
        if end > due[a]:
            found.append((a, end - 1))
            todo = bisect_left(starts, end, todo)
        else:
            todo += 1
    return found


def find_stops(lat: list, lon: list, t: list, diameter: float, duration: int) -> list[tuple[int, int]]:
    """stop_ranges of one vehicle, from lists with None for null."""
    columns = {"t": t, "lat": lat, "lon": lon}
    value = {c: np.array([0 if x is None else x for x in v], np.int64 if c == "t" else float) for c, v in columns.items()}
    known = {c: np.array([x is not None for x in v], bool) for c, v in columns.items()}
    return stop_ranges(Tracks(value, known, np.arange(len(t)) == 0), "t", "lat", "lon", diameter, duration)


def stop_flags(tracks: Tracks, time: str, lat: str, lon: str, diameter: float, duration: int) -> np.ndarray:
    edges = np.zeros(tracks.n + 1, np.int64)
    for a, b in stop_ranges(tracks, time, lat, lon, diameter, duration):
        edges[a] += 1
        edges[b + 1] -= 1
    return np.cumsum(edges)[:-1] > 0


def traffic_flags(tracks: Tracks, stop: np.ndarray, lat: str, lon: str, angle: float, distance: float) -> np.ndarray:
    """Stop flags without the stops that a vehicle leaves in the direction it came from.

    The direction is that of the nearest row with a position and the nearest one `distance` metres
    from it, before the stop and behind it. All stops look for their rows together, a step at a time.
    """
    if not stop.any():
        return stop.copy()
    y, x, first, behind = tracks.value[lat], tracks.value[lon], tracks.first, tracks.behind
    placed = np.flatnonzero(tracks.all_known(lat, lon))
    begin = np.flatnonzero(stop & (tracks.begins | np.append(True, ~stop[:-1])))
    end = np.flatnonzero(stop & np.append(tracks.begins[1:] | ~stop[1:], True)) + 1  # behind each stop

    def heading(near: np.ndarray, step: int) -> np.ndarray:
        """Bearing past the near rows (numbers in `placed`), NaN where there is none; step -1 looks back, 1 ahead."""
        out = np.full(len(near), np.nan)
        inside = lambda k, s: (k >= 0) & (k < len(placed)) & (placed[np.clip(k, 0, len(placed) - 1)] >= first[begin[s]]) & (placed[np.clip(k, 0, len(placed) - 1)] < behind[begin[s]])
        todo = np.flatnonzero(inside(near, np.arange(len(near))))
        far = near + step
        while len(todo):
            todo = todo[inside(far[todo], todo)]
            a, b = placed[far[todo]], placed[near[todo]]
            there = haversine(y[a], x[a], y[b], x[b]) >= distance
            p, q = (a[there], b[there]) if step < 0 else (b[there], a[there])
            out[todo[there]] = bearing(y[p], x[p], y[q], x[q])
            todo = todo[~there]
            far[todo] += step
        return out

    if not len(placed):
        return stop.copy()
    turn = (heading(np.searchsorted(placed, begin) - 1, -1) - heading(np.searchsorted(placed, end), 1)) % 360.0
    straight = np.minimum(turn, 360.0 - turn) < angle  # NaN: the stop stays
    edges = np.zeros(tracks.n + 1, np.int64)
    edges[begin[straight]] += 1
    np.subtract.at(edges, end[straight], 1)
    return stop & (np.cumsum(edges)[:-1] == 0)


# --- Plans ----------------------------------------------------------------------------------------


def prepared(df: DataFrame, id_col: str, time_col: str) -> DataFrame:
    """Dealt by vehicle and sorted by time (nulls first), with the time in microseconds.

    The number of partitions is given, so that adaptive execution does not merge small ones: a walk
    is bound by its steps and not by bytes.
    """
    n = int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    return df.withColumn(US, micros(time_col)).repartition(n, id_col).sortWithinPartitions(id_col, time_col)


Step = Callable[[Tracks], tuple[np.ndarray, np.ndarray]]


def walk_filter(df: DataFrame, id_col: str, columns: list[str], steps: list[Step]) -> DataFrame:
    """Rows of a prepared df that all steps keep, batch by batch; between batches only the rows that steps hold others against are carried."""
    names = [c for c in df.columns if c != US]
    schema = T.StructType([f for f in df.schema.fields if f.name != US])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        carried: list[Tracks | None] = [None] * len(steps)
        now = None
        for batch in batches:
            if not batch.num_rows:
                continue
            ids = batch.column(id_col)
            if now is None or ids[0] != now:
                carried = [None] * len(steps)
            now = ids[batch.num_rows - 1]
            keep, rows = np.arange(batch.num_rows), Tracks.of(batch, id_col, columns)
            other = np.flatnonzero(np.append(rows.begins[1:], True))[0] + 1  # where a second vehicle begins
            for k, step in enumerate(steps):
                if not rows.n:
                    break  # all rows were repeats of one vehicle, which goes on
                given = rows.after(carried[k]) if keep[0] < other else rows
                stay, held = step(given)
                carried[k] = given.take(np.isin(np.arange(given.n), held))
                here = stay[given.n - rows.n :]
                keep, rows = keep[here], rows.take(here)
            yield batch.take(pa.array(keep)).select(names)

    return df.mapInArrow(run, schema)


def whole_vehicles(batches: Iterator[pa.RecordBatch], id_col: str) -> Iterator[pa.Table]:
    """The rows of batches, cut only where a vehicle ends."""
    held: list[pa.RecordBatch] = []
    for batch in batches:
        if not batch.num_rows:
            continue
        code = batch.column(id_col).dictionary_encode(null_encoding="encode").indices.to_numpy()
        cut = int(np.flatnonzero(np.append(True, code[1:] != code[:-1]))[-1])  # where the last vehicle begins
        if held and cut == 0 and held[-1].column(id_col)[held[-1].num_rows - 1] == batch.column(id_col)[0]:
            held.append(batch)
            continue
        done = [*held, batch.slice(0, cut)]
        if sum(b.num_rows for b in done):
            yield pa.Table.from_batches(done)
        held = [batch.slice(cut)]
    if held:
        yield pa.Table.from_batches(held)


Marked = tuple[np.ndarray, dict[str, np.ndarray]]


def walk_marks(df: DataFrame, id_col: str, columns: list[str], marks: Callable[[Tracks], Marked], new: list[T.StructField]) -> DataFrame:
    """A prepared df with new columns in place of those of their names; marks(tracks) gives the rows that stay (a mask or indices), and the columns for these."""
    names = [c for c in df.columns if c != US and c not in {f.name for f in new}]
    schema = T.StructType([*(df.schema[c] for c in names), *new])
    kinds = {f.name: pa.bool_() if isinstance(f.dataType, T.BooleanType) else pa.int32() for f in new}

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for table in whole_vehicles(batches, id_col):
            stay, found = marks(Tracks.of(table, id_col, columns))
            out = table.select(names).take(pa.array(np.flatnonzero(stay) if stay.dtype == bool else stay))
            for f in new:
                out = out.append_column(f.name, pa.array(found[f.name], kinds[f.name]))
            yield from out.to_batches(max_chunksize=10_000)

    return df.mapInArrow(run, schema)
