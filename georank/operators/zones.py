"""Red zones: semi, anti and collecting joins by containment or overlap; boxes first, then the polygon where a zone has edges."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from georank.functions.geo import edges_meet_box, in_zone


#: Degrees of a grid cell by which rows and zones meet.
CELL = 0.05


def _by_cell(df: DataFrame, zones: DataFrame, how: str, cell: float) -> DataFrame:
    """An equi join on the row's grid cell, then the exact test; a row without a place is in no zone."""
    z = with_cells(zones, cell)
    same = (F.floor(df["lat"] / cell) == z["cell_y"]) & (F.floor(df["lon"] / cell) == z["cell_x"])
    return df.join(z, same & in_zone(df["lat"], df["lon"], z), how)


def inside_any(df: DataFrame, zones: DataFrame, cell: float = CELL) -> DataFrame:
    return _by_cell(df, zones, "left_semi", cell)


def outside_all(df: DataFrame, zones: DataFrame, cell: float = CELL) -> DataFrame:
    return _by_cell(df, zones, "left_anti", cell)


def with_cells(zones: DataFrame, cell: float) -> DataFrame:
    """Zones once for each grid cell that they touch, for an equi join instead of a nested loop."""
    span = lambda a, b: F.explode(F.sequence(F.floor(F.col(a) / cell), F.floor(F.col(b) / cell)))
    return zones.withColumn("cell_y", span("min_lat", "max_lat")).withColumn("cell_x", span("min_lon", "max_lon"))


def tag(df: DataFrame, zones: DataFrame, half=0.0, cell: float = CELL, half_lon=None) -> DataFrame:
    """df with zone_names (in zone order), sensitivity from them and tags; a row's box reaches ``half`` degrees around it
    (numbers or names of columns; half_lon where the sides differ).

    Touching counts. Rows and zones meet by grid cell; a box wider than a cell meets each of its cells.
    """
    reach = lambda h: F.col(h) if isinstance(h, str) else F.lit(float(h))
    dy, dx = reach(half), reach(half if half_lon is None else half_lon)
    lat, lon = F.col("lat"), F.col("lon")
    span = lambda at, d: F.explode(F.sequence(F.floor((at - d) / cell), F.floor((at + d) / cell)))
    own = [c for c in (half, half_lon) if isinstance(c, str)]
    boxes = df.select("seq", "lat", "lon", *own, span(lat, dy).alias("cell_y")).withColumn("cell_x", span(lon, dx))
    z = with_cells(zones, cell)
    shaped = F.col("edges").isNull() | edges_meet_box(lon - dx, lat - dy, lon + dx, lat + dy, F.col("edges")) if "edges" in zones.columns else F.lit(True)
    hit = (
        boxes.join(z, ["cell_x", "cell_y"])
        .where((lat + dy >= F.col("min_lat")) & (lat - dy <= F.col("max_lat")) & (lon + dx >= F.col("min_lon")) & (lon - dx <= F.col("max_lon")))
        .where(shaped)
        .select("seq", F.struct("zone_ord", "name").alias("z")).distinct()
    )
    names = hit.groupBy("seq").agg(F.transform(F.array_sort(F.collect_list("z")), lambda x: x["name"]).alias("zone_names"))
    out = df.join(names, "seq", "left").withColumn("zone_names", F.coalesce("zone_names", F.array().cast("array<string>")))
    tags = F.concat(F.array(F.concat(F.lit("landscape:"), F.col("landscape"))), F.transform("zone_names", lambda n: F.concat(F.lit("red-zone:"), n)))
    return out.withColumn("sensitivity", F.when(F.size("zone_names") > 0, "sensitive").otherwise("normal")).withColumn("tags", tags)
