"""Distances, bearings, tiles and Hilbert numbers as column expressions (no UDF)."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Radius of the earth, metres in a degree, tier limits (km), tile sizes (degrees), Hilbert grid.
EARTH_M = 6_371_000.0
METERS_PER_DEGREE = 111_320.0
TIERS = (("local", 100.0, 1.0), ("regional", 800.0, 4.0), ("longhaul", None, 8.0))
HILBERT_ORDER, LAT_RANGE, LON_RANGE = 12, (24.0, 84.0), (-141.0, -52.0)
KMH_TO_MPS, MPS_TO_MPH, MPH_TO_MPS = 1000.0 / 3600.0, 2.23694, 0.44704


def col(x: Column | str | float) -> Column:
    return F.col(x) if isinstance(x, str) else x if isinstance(x, Column) else F.lit(float(x))


def _haversine_a(lat1, lon1, lat2, lon2) -> Column:
    lat1, lon1, lat2, lon2 = map(col, (lat1, lon1, lat2, lon2))
    dy, dx = F.sin(F.radians(lat2 - lat1) / 2), F.sin(F.radians(lon2 - lon1) / 2)
    return dy * dy + F.cos(F.radians(lat1)) * F.cos(F.radians(lat2)) * dx * dx


def haversine_m(lat1, lon1, lat2, lon2) -> Column:
    """Great-circle distance in metres."""
    return F.lit(2 * EARTH_M) * F.asin(F.sqrt(_haversine_a(lat1, lon1, lat2, lon2)))


def haversine_km(lat1, lon1, lat2, lon2) -> Column:
    return haversine_m(lat1, lon1, lat2, lon2) / 1000.0


def haversine_atan2_m(lat1, lon1, lat2, lon2) -> Column:
    """The same distance in its atan2 form, with the argument kept within 0 and 1."""
    raw = _haversine_a(lat1, lon1, lat2, lon2)
    a = F.when(raw.isNotNull(), F.least(F.greatest(raw, F.lit(0.0)), F.lit(1.0)))  # least and greatest pass nulls over
    return F.lit(2 * EARTH_M) * F.atan2(F.sqrt(a), F.sqrt(1 - a))


def bearing(lat1, lon1, lat2, lon2) -> Column:
    """Initial bearing in degrees, 0 to 360."""
    lat1, lon1, lat2, lon2 = (F.radians(col(x)) for x in (lat1, lon1, lat2, lon2))
    x = F.sin(lon2 - lon1) * F.cos(lat2)
    y = F.cos(lat1) * F.sin(lat2) - F.sin(lat1) * F.cos(lat2) * F.cos(lon2 - lon1)
    return F.pmod(F.degrees(F.atan2(x, y)), F.lit(360.0))


def angular_difference(a, b) -> Column:
    """Smallest angle between bearings, 0 to 180."""
    d = F.pmod(col(a) - col(b), F.lit(360.0))
    return F.when(d > 180, 360 - d).otherwise(d)


def shortest_arc(a, b) -> Column:
    """Signed turn from bearing a to b, -180 to 180."""
    return F.pmod(col(b) - col(a) + 540, F.lit(360.0)) - 180


def offset(lat, lon, north_m, east_m) -> tuple[Column, Column]:
    """A position moved by metres north and east."""
    lat, lon, north_m, east_m = map(col, (lat, lon, north_m, east_m))
    return lat + north_m / METERS_PER_DEGREE, lon + east_m / (METERS_PER_DEGREE * F.cos(F.radians(lat)))


def speed_mps(speed) -> Column:
    """km/h to m/s."""
    return col(speed) * F.lit(KMH_TO_MPS)


def mps_to_mph(speed) -> Column:
    return col(speed) * F.lit(MPS_TO_MPH)


def mph_to_mps(speed) -> Column:
    return col(speed) * F.lit(MPH_TO_MPS)


def truck_speed_cap(speed) -> Column:
    """Highest truck speed (m/s) on a road whose cars drive at `speed` m/s."""
    v = col(speed)
    return F.when(v > 22, F.least(v, F.lit(29.0))).when(v > 11, F.least(v, F.lit(15.6))).otherwise(F.least(v, F.lit(11.2)))


def tile_id(lat, lon, degrees: float | Column) -> Column:
    """Row-major number of the tile of `degrees`, counted from (-90, -180) and clamped at the edges."""
    if not isinstance(degrees, Column) and degrees <= 0:
        raise ValueError("tile size must be positive")
    deg = col(degrees)
    n_cols, n_rows = F.ceil(360.0 / deg).cast("long"), F.ceil(180.0 / deg).cast("long")
    within = lambda x, n: F.greatest(F.least(F.floor(x).cast("long"), n - 1), F.lit(0).cast("long"))
    return within((col(lat) + 90.0) / deg, n_rows) * n_cols + within((col(lon) + 180.0) / deg, n_cols)


def tier(diagonal_km) -> Column:
    d = col(diagonal_km)
    return F.when(d < TIERS[0][1], TIERS[0][0]).when(d < TIERS[1][1], TIERS[1][0]).otherwise(TIERS[2][0])


def partition_id(lat, lon, diagonal_km) -> Column:
    """Tier number (in the bits above 60) and the number of its tile."""
    d = col(diagonal_km)
    ids = [F.shiftleft(F.lit(i).cast("long"), 60).bitwiseOR(tile_id(lat, lon, deg)) for i, (_, _, deg) in enumerate(TIERS)]
    return F.when(d < TIERS[0][1], ids[0]).when(d < TIERS[1][1], ids[1]).otherwise(ids[2])


def _hilbert_table(bits: int) -> list[int]:
    """By (state, x bits, y bits): the place on the curve of that many bits, times four, plus the state behind them.

    A state tells whether the axes are swapped (1) and whether both run backwards (2); each bit of x
    and y gives a quarter's place, 3x xor y, and the state within it.
    """
    out = []
    for entry in range(4 << 2 * bits):
        state, place = entry >> 2 * bits, 0
        for i in reversed(range(bits)):
            pair = entry >> bits + i & 1, entry >> i & 1
            x, y = (b ^ state >> 1 for b in (pair[::-1] if state & 1 else pair))
            place, state = place * 4 + (3 * x ^ y), state ^ (0 if y else 1 + 2 * x)
        out.append(place * 4 + state)
    return out


def hilbert_index(lat, lon) -> Column:
    """Number on the textbook Hilbert curve of order 12 over the fixed box; positions outside it are clamped.

    Four steps of three bits each through a table of 256 entries, in generated code.
    """
    most, step = (1 << HILBERT_ORDER) - 1, 3
    cell = lambda v, lo, hi: F.least(F.greatest((col(v) - lo) / (hi - lo) * float(most), F.lit(0.0)), F.lit(float(most))).cast("int")
    x, y, table = cell(lon, *LON_RANGE), cell(lat, *LAT_RANGE), F.array(*map(F.lit, _hilbert_table(step)))
    state, number = F.lit(0), F.lit(0)
    for shift in range(HILBERT_ORDER - step, -1, -step):
        part = lambda v: F.shiftright(v, shift).bitwiseAND(F.lit((1 << step) - 1))  # noqa: B023, E731
        entry = F.get(table, state * 64 + part(x) * 8 + part(y))
        number, state = number * 64 + F.shiftright(entry, 2), entry.bitwiseAND(F.lit(3))
    return F.when(col(lat).isNotNull() & col(lon).isNotNull(), number.cast("long"))


def breakage_distance(max_gap_m, cap: float) -> Column:
    """Matcher breakage distance from the largest step of a trace: 1.5 times it, 3000 at least, `cap` at most."""
    return F.greatest(F.lit(3000.0), F.least(F.lit(float(cap)), 1.5 * col(max_gap_m)))
