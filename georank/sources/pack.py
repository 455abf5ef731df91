"""Raster packs: a folder with a table of blocks by kind and label, its catalog, and the synthetic demo pack."""

from __future__ import annotations

import json
from dataclasses import dataclass

import numpy as np
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: Kinds of a pack; the first three are series in order of their labels, the others single layers.
SERIES = ("optical", "sar", "historical")
SINGLE = ("dem", "disturbance", "confounder", "water_proximity", "quality", "forest")
BLOCK = 128

BLOCKS = "kind string, label string, crs string, left double, top double, dx double, dy double, height int, width int, row0 int, col0 int, h int, w int, data binary"


@dataclass(frozen=True)
class Grid:
    """Upper left corner and cell size (positive) of a raster in its reference system, EPSG:4326 or a UTM zone."""

    crs: str
    left: float
    top: float
    dx: float
    dy: float


def to_blocks(kind: str, label: str, grid: Grid, values: np.ndarray) -> list[tuple]:
    """Rows of the block table for a whole raster; NaN is missing."""
    height, width = values.shape
    out = []
    for r in range(0, height, BLOCK):
        for c in range(0, width, BLOCK):
            part = np.ascontiguousarray(values[r : r + BLOCK, c : c + BLOCK], "<f4")
            out.append((kind, label, grid.crs, grid.left, grid.top, grid.dx, grid.dy, height, width, r, c, *part.shape, part.tobytes()))
    return out


def write_blocks(blocks: DataFrame, folder: str, mode: str = "overwrite") -> None:
    """Add blocks to a pack; with overwrite the kinds that they hold are replaced, others stay."""
    blocks.write.mode(mode).option("partitionOverwriteMode", "dynamic").partitionBy("kind").parquet(f"{folder}/blocks")


def read_blocks(spark: SparkSession, folder: str) -> DataFrame:
    """The pack's blocks; a pack without a table raises FileNotFoundError."""
    path = spark._jvm.org.apache.hadoop.fs.Path(f"{folder}/blocks")
    if not path.getFileSystem(spark._jsc.hadoopConfiguration()).exists(path):
        raise FileNotFoundError(f"no raster pack at {folder}")
    return spark.read.schema(BLOCKS).parquet(f"{folder}/blocks")


def catalog(spark: SparkSession, folder: str) -> list[tuple[str, str, Grid, int, int]]:
    """(kind, label, grid, height, width) of every layer, series by label; one row a layer reaches the driver.

    A pack without an elevation layer raises FileNotFoundError.
    """
    rows = read_blocks(spark, folder).groupBy("kind", "label").agg(*[F.first(c).alias(c) for c in ("crs", "left", "top", "dx", "dy", "height", "width")]).collect()
    order = {k: i for i, k in enumerate((*SERIES, *SINGLE))}
    layers = sorted(((r["kind"], r["label"], Grid(r["crs"], r["left"], r["top"], r["dx"], r["dy"]), r["height"], r["width"]) for r in rows if r["kind"] in order), key=lambda x: (order[x[0]], x[1]))
    if not any(x[0] == "dem" for x in layers):
        raise FileNotFoundError(f"the pack at {folder} has no dem layer")
    return layers


def scene_catalog(blocks: DataFrame) -> list[tuple[str, str, Grid, int, int]]:
    """(kind, label, grid, height, width) of every raster of a block table of scenes; one row a raster reaches the driver."""
    rows = blocks.groupBy("kind", "label").agg(*[F.first(c).alias(c) for c in ("crs", "left", "top", "dx", "dy", "height", "width")]).collect()
    return sorted(((r["kind"], r["label"], Grid(r["crs"], r["left"], r["top"], r["dx"], r["dy"]), r["height"], r["width"]) for r in rows), key=lambda x: x[:2])


def manifest(spark: SparkSession, folder: str, **updates) -> dict:
    """The pack's manifest (a JSON text) after merging ``updates`` into its outputs; without updates it is only read."""
    path = spark._jvm.org.apache.hadoop.fs.Path(f"{folder}/pack_manifest.json")
    files = path.getFileSystem(spark._jsc.hadoopConfiguration())
    held = json.loads("\n".join(r["value"] for r in spark.read.text(f"{folder}/pack_manifest.json", wholetext=True).collect())) if files.exists(path) else {"outputs": {}}
    if updates:
        held["outputs"] = held.get("outputs", {}) | updates
        stream = files.create(path, True)
        stream.write(bytearray(json.dumps(held, indent=2, ensure_ascii=False), "utf-8"))
        stream.close()
    return held


#: Fixed values of the demo: bounds in degrees, cells a side, and corners of its red zone.
DEMO_BOUNDS = (91.0, 47.0, 91.032, 47.032)
DEMO_CELLS = 128
DEMO_ZONE = (91.0205, 47.0225, 91.0285, 47.0295)


def _box(west: float, south: float, east: float, north: float) -> list[list[list[float]]]:
    return [[[west, south], [east, south], [east, north], [west, north], [west, south]]]


def demo_layers() -> dict[tuple[str, str], np.ndarray]:
    """The demo's rasters by (kind, label). The order of the random draws is fixed."""
    n, rng = DEMO_CELLS, np.random.default_rng(42)
    row, col = np.indices((n, n))
    trend = col / n * 0.08 + row / n * 0.04

    def draw(scale: float) -> np.ndarray:
        return rng.normal(0.0, scale, (n, n))

    def bump(x: float, y: float, width: float) -> np.ndarray:
        return np.exp(-((col - x) ** 2 + (row - y) ** 2) / (2 * width**2))

    reach = np.hypot(col - 96, row - 28)
    plot = ((col >= 48) & (col <= 72) & (row >= 44) & (row <= 66)).astype(float)
    ring = ((reach >= 7) & (reach <= 11)).astype(float)
    road = (np.abs(row - (0.55 * col + 12)) <= 1.3).astype(float)
    gully = ((col < 24) & (row < 34)).astype(float)
    noise = draw(0.03).astype("float32")
    layers = {
        ("optical", "2025-06-12"): 0.20 + trend + noise + 0.55 * plot + 0.28 * ring + 0.10 * road,
        ("optical", "2025-09-03"): 0.18 + trend + draw(0.03) + 0.50 * plot + 0.24 * ring + 0.08 * road,
        ("sar", "2025-06-14"): 0.10 + 0.8 * noise + 0.42 * plot + 0.18 * ring + 0.15 * road,
        ("sar", "2025-09-05"): 0.11 + draw(0.03) + 0.38 * plot + 0.16 * ring + 0.13 * road,
        ("historical", "1968-corona"): 0.16 + trend + draw(0.02) + 0.42 * plot + 0.22 * ring,
        ("dem", "dem"): 1500 + 0.7 * col + 0.35 * row + 3.2 * bump(60, 55, 7.5) + 1.5 * bump(96, 28, 5) + 0.4 * gully,
        ("disturbance", "disturbance"): np.clip(0.05 + 0.75 * road + 0.08 * rng.random((n, n)), 0, 1),
        ("confounder", "confounder"): np.clip(0.08 + 0.55 * gully + 0.08 * rng.random((n, n)), 0, 1),
        ("water_proximity", "water_proximity"): np.clip(1 - np.abs(row - 104) / 52, 0, 1),
        ("quality", "quality"): 0.88 - 0.35 * (np.hypot(col - 20, row - 96) < 12),
        ("forest", "forest"): np.zeros((n, n)),
    }
    return layers


def write_demo(spark: SparkSession, folder: str) -> dict[str, str]:
    """The demo pack, its area and its red zone under a folder; paths by name."""
    west, south, east, north = DEMO_BOUNDS
    step = (east - west) / DEMO_CELLS
    rows = [b for (kind, label), a in demo_layers().items() for b in to_blocks(kind, label, Grid("EPSG:4326", west, north, step, step), a)]
    pack = f"{folder}/demo_pack"
    write_blocks(spark.createDataFrame(rows, BLOCKS), pack)
    aoi = {"type": "Feature", "geometry": {"type": "Polygon", "coordinates": _box(west + 0.001, south + 0.001, east - 0.001, north - 0.001)}, "properties": {"name": "Demo AOI"}}
    zone = {"type": "Feature", "geometry": {"type": "Polygon", "coordinates": _box(*DEMO_ZONE)}, "properties": {"name": "demo-sensitive-zone", "category": "protected-demo"}}
    out = {"pack": pack}
    for name, value in (("aoi", aoi), ("red_zones", {"type": "FeatureCollection", "features": [zone]})):
        out[name] = f"{folder}/demo_{name}.geojson"
        path = spark._jvm.org.apache.hadoop.fs.Path(out[name])
        stream = path.getFileSystem(spark._jsc.hadoopConfiguration()).create(path, True)
        stream.write(bytearray(json.dumps(value, indent=2), "utf-8"))
        stream.close()
    return out
