"""Sources: candidate arrays, GeoJSON zones, catalog items."""

from __future__ import annotations

import json
from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from georank.functions import scoring
from georank.functions.text import zone_name

_CANDIDATE = ", ".join(
    ["candidate_id string", "lat double", "lon double", "landscape string", "sensitivity string", *[f"{e} variant" for e in scoring.EVIDENCE], "tags array<string>", "source_dates array<string>", "notes array<string>"]
)


def read_candidates(spark: SparkSession, path: str, strict: bool = False) -> DataFrame:
    """Candidates from a JSON array of flat objects; seq is the place in the array. Evidence is cleaned and limited."""
    whole = spark.read.text(path, wholetext=True)
    rows = whole.select(F.posexplode(F.from_json("value", f"array<struct<{_CANDIDATE.replace(' ', ': ').replace(',:', ',')}>>")).alias("seq", "c")).select("seq", "c.*")
    for name in scoring.EVIDENCE:
        raw, boolean = F.try_variant_get(name, "$", "string"), F.schema_of_variant(name) == "BOOLEAN"
        rows = rows.withColumn(name, scoring.evidence(raw, 1.0 if name == "data_quality" else 0.0, F.coalesce(boolean, F.lit(False))))
    empty = F.array().cast("array<string>")
    for name in ("tags", "source_dates", "notes"):
        rows = rows.withColumn(name, F.coalesce(name, empty))
    return rows.withColumn("landscape", scoring.normalize_landscape(F.col("landscape"))).withColumn("sensitivity", scoring.normalize_sensitivity(F.col("sensitivity"), strict))


@dataclass(frozen=True)
class Area:
    """An area of interest: outer rings and holes as (lon, lat) corners without the closing one."""

    rings: list[list[tuple[float, float]]]
    holes: list[list[tuple[float, float]]]

    def centre(self) -> tuple[float, float]:
        """(lat, lon) of the centroid; holes don't count."""
        total = x = y = 0.0
        for r in self.rings:
            signed = 0.0
            for (a, b), (c, d) in zip(r, r[1:] + r[:1]):
                cross = (a - r[0][0]) * (d - r[0][1]) - (c - r[0][0]) * (b - r[0][1])
                signed += cross
                x += cross * ((a - r[0][0]) + (c - r[0][0])) / 3 + 0.0
                y += cross * ((b - r[0][1]) + (d - r[0][1])) / 3
            x += signed * r[0][0]
            y += signed * r[0][1]
            total += signed
        return y / total, x / total

    def utm(self) -> tuple[int, bool]:
        """(zone, south) of the centroid."""
        lat, lon = self.centre()
        return min(int((lon + 180) // 6) + 1, 60), lat < 0


def area_of_box(west: float, south: float, east: float, north: float) -> Area:
    return Area([[(west, south), (east, south), (east, north), (west, north)]], [])


def read_area(spark: SparkSession, path: str) -> Area:
    """The polygons of a GeoJSON file, a collection, one feature or a bare geometry; without any a ValueError."""
    rings, holes = [], []
    for r in read_features(spark, path).where(F.col("type").isin("Polygon", "MultiPolygon")).orderBy("idx").collect():
        shape = json.loads(r["coordinates"])
        for polygon in [shape] if r["type"] == "Polygon" else shape:
            for i, ring in enumerate(polygon):
                corners = [(float(p[0]), float(p[1])) for p in ring]
                corners = corners[:-1] if len(corners) > 1 and corners[0] == corners[-1] else corners
                if (sum(a[0] * b[1] - b[0] * a[1] for a, b in zip(corners, corners[1:] + corners[:1])) < 0) != (i > 0):
                    corners.reverse()  # outer rings turn left, holes right
                (holes if i else rings).append(corners)
    if not rings:
        raise ValueError(f"no polygon in {path}")
    return Area(rings, holes)


#: Coordinates of each geometry type as its JSON nests them; every place may carry an altitude.
_NESTING = {"Point": 1, "MultiPoint": 2, "LineString": 2, "MultiLineString": 3, "Polygon": 3, "MultiPolygon": 4}


def parts(kind, coordinates):
    """The parts of a geometry, arrays of places [x, y, ...]: rings of polygons, lines, or single points; null for other types."""
    out = F.lit(None).cast("array<array<array<double>>>")
    for name, depth in _NESTING.items():
        nested = F.from_json(coordinates, "array<" * depth + "double" + ">" * depth)
        lifted = {1: F.array(F.array(nested)), 2: F.array(nested), 3: nested, 4: F.flatten(nested) if depth == 4 else nested}[depth]
        out = F.when(kind == name, lifted).otherwise(out)
    return out


def read_features(spark: SparkSession, path: str, name: str = "struct<name: string, title: string, category: string, kind: string>") -> DataFrame:
    """Rows (idx, type, coordinates, p) of a GeoJSON file: a feature collection, one feature or a bare geometry; p has the properties."""
    geometry = "struct<type: string, coordinates: string>"
    schema = f"struct<type: string, coordinates: string, geometry: {geometry}, properties: {name}, features: array<struct<geometry: {geometry}, properties: {name}>>>"
    whole = spark.read.text(path, wholetext=True).select(F.from_json("value", schema).alias("j"))
    bare = F.when(F.col("j.type") == "Feature", F.struct("j.geometry", "j.properties")).otherwise(F.struct(F.struct("j.type", "j.coordinates").alias("geometry"), "j.properties"))
    features = F.when(F.col("j.features").isNotNull(), F.col("j.features")).when(F.col("j.type") != "FeatureCollection", F.array(bare))
    return whole.select(F.posexplode(features).alias("idx", "f")).select("idx", "f.geometry.type", "f.geometry.coordinates", F.col("f.properties").alias("p"))


def read_zones(spark: SparkSession, path: str) -> DataFrame:
    """Zones (zone_ord, name, category, bounds, geometry as JSON, edges of polygons) of a GeoJSON file; features without geometry are left out.

    Names are taken over all features, so numbers of unnamed ones don't depend on what is left out. Polygons have the edges
    of all their rings; other types have none and stand for their box.
    """
    shaped = read_features(spark, path).withColumn("parts", parts(F.col("type"), F.col("coordinates"))).where("coordinates is not null")
    places = F.flatten("parts")
    xs, ys = F.transform(places, lambda q: q[0]), F.transform(places, lambda q: q[1])
    edge = lambda a, b: F.struct(a[0].alias("x1"), a[1].alias("y1"), b[0].alias("x2"), b[1].alias("y2"))
    following = lambda r: F.concat(F.slice(r, 2, F.size(r)), F.slice(r, 1, 1))
    edges = F.when(F.col("type").isin("Polygon", "MultiPolygon"), F.flatten(F.transform("parts", lambda r: F.zip_with(r, following(r), edge))))
    return shaped.select(
        F.col("idx").alias("zone_ord"), zone_name(F.coalesce("p.name", "p.title"), F.col("idx")).alias("name"), F.coalesce("p.category", "p.kind").alias("category"),
        F.array_min(ys).alias("min_lat"), F.array_max(ys).alias("max_lat"), F.array_min(xs).alias("min_lon"), F.array_max(xs).alias("max_lon"), "coordinates", edges.alias("edges"),
    )


def demo_zones(spark: SparkSession) -> DataFrame:
    """The built-in zone: one box of fixed values."""
    return spark.range(1).select(
        F.lit(0).alias("zone_ord"), F.lit("demo-sensitive-zone").alias("name"), F.lit(48.0).alias("min_lat"), F.lit(48.4).alias("max_lat"), F.lit(90.0).alias("min_lon"), F.lit(90.4).alias("max_lon")
    )
