"""Maps of traces: thinned pings as GeoJSON or as one HTML file without outside parts."""

from __future__ import annotations

import html
import json
from datetime import date
from http.server import BaseHTTPRequestHandler, ThreadingHTTPServer

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from waymark.operators.segments import downsample, stop_summary
from waymark.sources import readers

COLORS = ("#1f77b4", "#ff7f0e", "#2ca02c", "#d62728", "#9467bd", "#8c564b", "#e377c2", "#17becf")


def mode_of(df: DataFrame) -> str:
    """matched, stop, gap or raw, by the columns that a frame has."""
    has = set(df.columns)
    return "matched" if {"matched_lat", "matched_lon"} <= has else "stop" if {"segment_id", "is_stop"} <= has else "gap" if "segment_id" in has else "raw"


def geojson(df: DataFrame, max_points: int = 5000) -> dict:
    """Lines of segments and points of stops; a vehicle brings at most about max_points pings to the driver."""
    if "id" not in df.columns:
        df = df.withColumn("id", F.lit(""))
    kind = mode_of(df)
    whole = df if "segment_id" in df.columns else df.withColumn("segment_id", F.lit(0))
    lat, lon = ("matched_lat", "matched_lon") if kind == "matched" else ("lat", "lon")
    thin = downsample(whole.filter(F.col(lat).isNotNull() & F.col(lon).isNotNull()), max_points)
    lines = thin.groupBy("id", "segment_id").agg(F.array_sort(F.collect_list(F.struct("time", lon, lat))).alias("line"), (F.max("is_stop") if "is_stop" in whole.columns else F.lit(False)).alias("is_stop"))
    features = []
    for r in lines.orderBy("id", "segment_id").collect():
        path = [[p[1], p[2]] for p in r["line"]]
        features.append({"type": "Feature", "geometry": {"type": "LineString", "coordinates": path}, "properties": {"id": r["id"], "segment_id": r["segment_id"], "is_stop": bool(r["is_stop"]), "color": COLORS[r["segment_id"] % len(COLORS)], "mode": kind}})
    if kind == "stop":
        for r in stop_summary(whole).orderBy("id", "segment_id").collect():
            features.append({"type": "Feature", "geometry": {"type": "Point", "coordinates": [r["centroid_lon"], r["centroid_lat"]]}, "properties": {"id": r["id"], "segment_id": r["segment_id"], "n_points": r["n_points"], "duration_s": r["duration_s"], "start": str(r["start"]), "end": str(r["end"])}})
    return {"type": "FeatureCollection", "features": features}


def to_html(collection: dict, title: str = "trace") -> str:
    """One page that draws a collection as SVG, with a tooltip on each part."""
    points = [p for f in collection["features"] for p in ([f["geometry"]["coordinates"]] if f["geometry"]["type"] == "Point" else f["geometry"]["coordinates"])]
    x0, x1 = min((p[0] for p in points), default=0), max((p[0] for p in points), default=1)
    y0, y1 = min((p[1] for p in points), default=0), max((p[1] for p in points), default=1)
    scale = 960 / max(x1 - x0, y1 - y0, 1e-9)
    at = lambda p: f"{20 + (p[0] - x0) * scale:.1f},{20 + (y1 - p[1]) * scale:.1f}"
    parts = []
    for f in collection["features"]:
        tip = f"<title>{html.escape(json.dumps(f['properties'], default=str))}</title>"
        if f["geometry"]["type"] == "Point":
            x, y = at(f["geometry"]["coordinates"]).split(",")
            parts.append(f'<circle class="stop" cx="{x}" cy="{y}" r="5">{tip}</circle>')
        else:
            parts.append(f'<polyline points="{" ".join(map(at, f["geometry"]["coordinates"]))}" stroke="{f["properties"]["color"]}">{tip}</polyline>')
    style = "polyline{fill:none;stroke-width:2}.stop{fill:#d62728;fill-opacity:.6}"
    return f'<!DOCTYPE html><meta charset="utf-8"><title>{html.escape(title)}</title><style>{style}</style><svg viewBox="0 0 1000 1000" width="1000" height="1000">{"".join(parts)}</svg>'


def save_map(df: DataFrame, path: str, max_points: int = 5000) -> None:
    with open(path, "w") as f:
        f.write(to_html(geojson(df, max_points)))


def layered(max_points: int = 5000, **layers: DataFrame | None) -> dict:
    """One collection of several frames, each feature with the name of its layer; frames that are None are left out."""
    features = []
    for name, df in layers.items():
        if df is not None:
            features += [f | {"properties": f["properties"] | {"layer": name}} for f in geojson(df, max_points)["features"]]
    return {"type": "FeatureCollection", "features": features}


def shape_features(matched: DataFrame, max_points: int = 5000) -> list[dict]:
    """Lines of matched shapes (segment_id, shapes): a colour a segment, a line a shape, thinned to about max_points each."""
    n = F.size("line")
    step = F.greatest(F.lit(1), F.ceil(n / max_points).cast("int"))
    lines = matched.select("segment_id", F.posexplode("shapes").alias("part", "line"))
    thin = lines.withColumn("line", F.filter("line", lambda q, i: (i % step == 0) | (i == n - 1)))
    found = []
    for r in thin.orderBy("segment_id", "part").collect():
        path = [[q["lon"], q["lat"]] for q in r["line"]]
        found.append({"type": "Feature", "geometry": {"type": "LineString", "coordinates": path}, "properties": {"id": "", "segment_id": r["segment_id"], "color": COLORS[r["segment_id"] % len(COLORS)], "mode": "shape", "layer": "shape"}})
    return found


def plot_inspection(raw: DataFrame, split: DataFrame, matched: DataFrame | None = None, max_points: int = 5000) -> dict:
    """Raw pings, segments and, from match_segments' rows, matched points and shapes as layers of one collection."""
    points = None
    if matched is not None:
        points = matched.select("segment_id", F.explode("points").alias("p")).select("segment_id", "p.*").filter("matched_lat is not null")
    found = layered(max_points, raw=raw, segments=split, matched=points)
    return found | {"features": found["features"] + (shape_features(matched, max_points) if matched is not None else [])}


def stage_trips(spark: SparkSession, root: str, truck: str | None = None, trip: str | None = None, trips: list[str] | None = None) -> DataFrame:
    """Rows of a stage's dataset for exactly one of a truck, a trip or some trips."""
    if sum(x is not None for x in (truck, trip, trips)) != 1:
        raise ValueError("give exactly one of truck, trip and trips")
    if truck is not None:
        return readers.scan_partitioned_truck(spark, root, truck)
    return readers.scan_trips(spark, root, trips) if trips is not None else readers.scan_partitioned_trip(spark, root, trip)


def inspect_truck(spark: SparkSession, truck: str, raw_dir: str, first: date | None = None, last: date | None = None, max_points: int = 5000) -> dict:
    """A truck's raw pings of the days first to last."""
    df = readers.scan_raw_truck(spark, raw_dir, truck)
    return layered(max_points, raw=readers.date_range(df, first, last) if first and last else df)


def inspect_trip(spark: SparkSession, trip: str, partitioned_dir: str, max_points: int = 5000) -> dict:
    """A trip's segments."""
    return layered(max_points, segments=stage_trips(spark, partitioned_dir, trip=trip))


def inspect_pipeline(spark: SparkSession, truck: str, raw_dir: str, partitioned_dir: str, first: date, last: date, matched: DataFrame | None = None, max_points: int = 5000) -> dict:
    """A truck's way through the pipeline on the days first to last: raw pings, trips, and (given as a frame) matched pings."""
    days = lambda df: readers.date_range(df, first, last)
    own = None if matched is None else days(readers.of_truck(matched, truck))
    return layered(max_points, raw=days(readers.scan_raw_truck(spark, raw_dir, truck)), segments=days(stage_trips(spark, partitioned_dir, truck=truck)), matched=own)


def serve_map(collection: dict, port: int = 8000, title: str = "trace", forever: bool = True) -> ThreadingHTTPServer:
    """Serve a collection's page on this machine; with forever=False the server is returned and not yet started."""
    page = to_html(collection, title).encode()

    class Page(BaseHTTPRequestHandler):
        def do_GET(self) -> None:
            self.send_response(200)
            self.send_header("Content-Type", "text/html; charset=utf-8")
            self.send_header("Content-Length", str(len(page)))
            self.end_headers()
            self.wfile.write(page)

        def log_message(self, *_: object) -> None:
            """Requests are not worth a line."""

    server = ThreadingHTTPServer(("127.0.0.1", port), Page)
    if forever:
        server.serve_forever()
    return server
