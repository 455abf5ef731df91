"""Red-zone import: buffers, simplification, areas and dissolving of GeoJSON features."""

from __future__ import annotations

import json
import math
from collections.abc import Iterator
from dataclasses import dataclass

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from georank.functions import geo, text
from georank.operators.select_items import dissolve
from georank.shipping import ship

Ring = list[tuple[float, float]]
#: Corners of a buffer's circle.
CORNERS = 64


@dataclass(frozen=True)
class Options:
    name_field: str = "name"
    category_field: str | None = None
    include: tuple[str, ...] = ()
    exclude: tuple[str, ...] = ()
    buffer_m: float = 0.0
    point_buffer_m: float = 100.0
    line_buffer_m: float = 50.0
    simplify_m: float = 0.0
    min_area_ha: float = 0.0
    dissolve_by: str = "none"


def circle(x: float, y: float, radius: float) -> Ring:
    return [(x + radius * math.cos(2 * math.pi * i / CORNERS), y + radius * math.sin(2 * math.pi * i / CORNERS)) for i in range(CORNERS)]


def capsule(a: tuple[float, float], b: tuple[float, float], radius: float) -> Ring:
    """The ground within a distance of a segment."""
    if a == b:
        return circle(*a, radius)
    turn = math.atan2(b[1] - a[1], b[0] - a[0])
    half = CORNERS // 2
    arc = lambda p, start: [(p[0] + radius * math.cos(start + math.pi * i / half), p[1] + radius * math.sin(start + math.pi * i / half)) for i in range(half + 1)]
    return arc(b, turn - math.pi / 2) + arc(a, turn + math.pi / 2)


def simplify(ring: Ring, tolerance: float) -> Ring:
    """Douglas-Peucker on a closed ring, begun at its two corners that are farthest apart along it; never below three corners."""
    if len(ring) <= 4:
        return ring
    far = max(range(len(ring)), key=lambda i: math.dist(ring[0], ring[i]))
    keep = {0, far}
    spans = [(0, far), (far, len(ring))]
    closed = ring + ring[:1]
    while spans:
        i, j = spans.pop()
        (x1, y1), (x2, y2) = closed[i], closed[j]
        length = math.hypot(x2 - x1, y2 - y1)
        off = lambda p: abs((x2 - x1) * (y1 - p[1]) - (x1 - p[0]) * (y2 - y1)) / length if length else math.dist(p, (x1, y1))  # noqa: B023, E731
        best = max(range(i + 1, j), key=lambda n: off(closed[n]), default=None)
        if best is not None and off(closed[best]) > tolerance:
            keep.add(best)
            spans += [(i, best), (best, j)]
    out = [ring[i] for i in sorted(keep)]
    return out if len(out) >= 3 else ring


def union_area(polygons: list[list[Ring]]) -> float:
    """Area of the union of polygons (rings, even-odd), which may overlap: strips between all corners and crossings, each
    strip's covered length at its middle times its width, which is exact as no edges cross within a strip."""
    edges = [[(a, b) for ring in p for a, b in zip(ring, ring[1:] + ring[:1]) if a[0] != b[0]] for p in polygons]
    every = [e for p in edges for e in p]
    xs = {q[0] for e in every for q in e}
    for i, (a, b) in enumerate(every):
        for c, d in every[:i]:
            if max(min(a[0], b[0]), min(c[0], d[0])) >= min(max(a[0], b[0]), max(c[0], d[0])):
                continue
            m, n = (b[1] - a[1]) / (b[0] - a[0]), (d[1] - c[1]) / (d[0] - c[0])
            if m != n:
                xs.add((c[1] - n * c[0] - a[1] + m * a[0]) / (m - n))
    total, cuts = 0.0, sorted(xs)
    for x1, x2 in zip(cuts, cuts[1:]):
        x = (x1 + x2) / 2
        spans = []
        for p in edges:
            ys = sorted(a[1] + (x - a[0]) * (b[1] - a[1]) / (b[0] - a[0]) for a, b in p if (a[0] > x) != (b[0] > x))
            spans += list(zip(ys[::2], ys[1::2]))
        end = -math.inf
        for low, high in sorted(spans):
            total += max(high - max(low, end), 0.0) * (x2 - x1)
            end = max(end, high)
    return total


def shapes(kind: str, coordinates, options: Options) -> list[list[Ring]]:
    """Polygons in metres of a geometry whose coordinates are in metres: points and lines buffered, then the extra buffer, then simplified.

    A buffer is kept as parts that overlap: discs, capsules along lines and edges, and the polygon itself.
    """
    places = lambda line: [tuple(p[:2]) for p in line]
    opened = lambda ring: ring[:-1] if len(ring) > 1 and ring[0] == ring[-1] else ring
    if kind in ("Point", "MultiPoint"):
        radius = options.point_buffer_m + max(options.buffer_m, 0)
        out = [[circle(*p, radius)] for p in places([coordinates] if kind == "Point" else coordinates)]
    elif kind in ("LineString", "MultiLineString"):
        radius = options.line_buffer_m + max(options.buffer_m, 0)
        out = [[capsule(a, b, radius)] for line in ([coordinates] if kind == "LineString" else coordinates) for a, b in zip(places(line), places(line)[1:])]
    elif kind in ("Polygon", "MultiPolygon"):
        out = [[opened(places(r)) for r in p] for p in ([coordinates] if kind == "Polygon" else coordinates)]
        if options.buffer_m > 0:
            out += [[capsule(a, b, options.buffer_m)] for p in list(out) for r in p for a, b in zip(r, r[1:] + r[:1])]
    else:
        return []
    out = [[r for r in p if len(r) >= 3] for p in out]
    return [[simplify(r, options.simplify_m) if options.simplify_m > 0 else r for r in p] for p in out if p and p[0]]


def import_zones(features: DataFrame, options: Options) -> tuple[DataFrame, DataFrame]:
    """(kept, dissolved) from features (idx, type, coordinates as JSON, p a map of properties as text).

    kept: idx, name, category, polygons (degrees), area_ha, of the features with a geometry and an allowed category whose
    area is at least the minimum. dissolved: one row for each group with its first feature's name and category,
    source_count, source_names and all its polygons. Each feature is measured in its own UTM zone.
    """
    ship(features.sparkSession)
    named = features.where("coordinates is not null and type is not null").select(
        "idx", text.zone_name(F.element_at("p", F.lit(options.name_field)), F.col("idx")).alias("name"),
        (F.element_at("p", F.lit(options.category_field)) if options.category_field else F.lit(None).cast("string")).alias("category"), "type", "coordinates",
    ).where(text.category_allowed(F.col("category"), options.include, options.exclude))  # before any geometry work

    def measure(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        def each(c, change):
            return change(c) if not isinstance(c[0], list) else [each(x, change) for x in c]

        for pdf in batches:
            polygons, areas = [], []
            for kind, raw in zip(pdf["type"], pdf["coordinates"]):
                coordinates, flat = json.loads(raw), []
                if not coordinates:
                    polygons.append(None)
                    areas.append(0.0)
                    continue
                each(coordinates, flat.append)
                lon, lat = sum(p[0] for p in flat) / len(flat), sum(p[1] for p in flat) / len(flat)
                zone, south = min(int((lon + 180) // 6) + 1, 60), lat < 0
                parts = shapes(kind, each(coordinates, lambda p: list(geo.project(p[1], p[0], zone))), options)  # noqa: B023
                areas.append(union_area(parts) / 10_000 if parts else 0.0)
                back = []
                for p in parts:
                    rings = []
                    for r in p:
                        xs, ys = (geo.np.array(v) for v in zip(*r))
                        la, lo = geo.inverse_arrays(xs, ys, zone, south)
                        rings.append([[float(a), float(b)] for a, b in zip([*lo, lo[0]], [*la, la[0]])])
                    back.append(rings)
                polygons.append(back or None)
            yield pd.DataFrame({"idx": pdf["idx"], "name": pdf["name"], "category": pdf["category"], "polygons": polygons, "area_ha": areas})

    kept = named.mapInPandas(measure, "idx int, name string, category string, polygons array<array<array<array<double>>>>, area_ha double")
    kept = kept.where(F.col("polygons").isNotNull() & (F.col("area_ha") >= max(options.min_area_ha, 0.0)))
    key = text.dissolve_key(options.dissolve_by, F.col("name"), F.col("category"), F.col("idx"))
    groups = dissolve(kept, key)
    parts = kept.withColumn("key", key).groupBy("key").agg(F.flatten(F.transform(F.array_sort(F.collect_list(F.struct("idx", "polygons"))), lambda x: x["polygons"])).alias("polygons"))
    return kept, groups.join(parts, "key").drop("key")


def zone_features(dissolved: DataFrame) -> DataFrame:
    """GeoJSON features (first_idx, feature) of the dissolved zones."""
    properties = F.struct("name", "category", F.col("source_count").cast("int").alias("source_count"), "source_names")
    geometry = F.struct(F.lit("MultiPolygon").alias("type"), F.col("polygons").alias("coordinates"))
    return dissolved.select("first_idx", F.to_json(F.struct(F.lit("Feature").alias("type"), geometry.alias("geometry"), properties.alias("properties")), {"ignoreNullFields": "false"}).alias("feature"))
