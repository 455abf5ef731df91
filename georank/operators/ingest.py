"""Raster packs from selected scenes: warp to the target grid, cut to the area, derive, mosaic; one task a target block."""

from __future__ import annotations

import math
import re

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from georank.functions.geo import inverse_arrays, project
from georank.operators.tile_features import tile_windows, with_corners
from georank.recipe import Recipe
from georank.shipping import ship
from georank.sources.pack import BLOCK, BLOCKS, Grid
from georank.sources.readers import Area


def target_grid(area: Area, resolution: float) -> tuple[Grid, int, int]:
    """(grid, height, width) in the area's UTM zone, its corner snapped to whole cells."""
    zone, south = area.utm()
    xs, ys = zip(*[project(lat, lon, zone) for r in area.rings for lon, lat in r])
    left, top = math.floor(min(xs) / resolution) * resolution, math.ceil(max(ys) / resolution) * resolution
    grid = Grid(f"EPSG:{(32700 if south else 32600) + zone}", left, top, resolution, resolution)
    return grid, max(math.ceil((top - min(ys)) / resolution), 1), max(math.ceil((max(xs) - left) / resolution), 1)


def in_rings(x: np.ndarray, y: np.ndarray, rings: list) -> np.ndarray:
    """Even-odd test of places against rings, holes among them."""
    odd = np.zeros(x.shape, bool)
    for ring in rings:
        for (x1, y1), (x2, y2) in zip(ring, ring[1:] + ring[:1]):
            if y1 != y2:
                odd ^= ((y1 > y) != (y2 > y)) & (x < x1 + (y - y1) * (x2 - x1) / (y2 - y1))
    return odd


def _cubic(t: np.ndarray) -> np.ndarray:
    t = np.abs(t)
    return np.where(t < 1, (1.5 * t - 2.5) * t * t + 1, np.where(t < 2, ((-0.5 * t + 2.5) * t - 4) * t + 2, 0.0))


def resample(a: np.ndarray, row: np.ndarray, col: np.ndarray, how: str, spread: float = 1.0) -> np.ndarray:
    """Values of a raster at places given in its cells (centres at .5); missing cells have no weight, outside is missing.

    spread is the target cell's size in source cells, over which ``average`` takes the mean.
    """
    height, width = a.shape
    inside = (row >= 0) & (row <= height) & (col >= 0) & (col <= width)
    if how == "nearest":
        got = a[np.clip(np.floor(row), 0, height - 1).astype(int), np.clip(np.floor(col), 0, width - 1).astype(int)]
        return np.where(inside, got, np.nan)
    if how == "average":
        reach = max(int(math.ceil(spread / 2)), 1)
        kernel = lambda t: np.clip(spread / 2 + 0.5 - np.abs(t), 0, 1)  # noqa: E731  (overlap of two intervals)
        steps = range(-reach, reach + 1)
    else:
        kernel = (lambda t: np.clip(1 - np.abs(t), 0, 1)) if how == "bilinear" else _cubic
        steps = range(-1, 3) if how == "cubic" else range(0, 2)
    r, c = row - 0.5, col - 0.5
    r0, c0 = (np.round(r), np.round(c)) if how == "average" else (np.floor(r), np.floor(c))
    total, weight = np.zeros(row.shape), np.zeros(row.shape)
    for i in steps:
        for j in steps:
            rr, cc = r0 + i, c0 + j
            w = kernel(r - rr) * kernel(c - cc)
            v = a[np.clip(rr, 0, height - 1).astype(int), np.clip(cc, 0, width - 1).astype(int)]
            ok = np.isfinite(v)
            total += np.where(ok, w * np.where(ok, v, 0), 0)
            weight += np.where(ok, w, 0)
    return np.where(inside & (np.abs(weight) > 1e-9), total / np.where(np.abs(weight) > 1e-9, weight, 1), np.nan)


def item_labels(selected: list[dict], recipe: Recipe) -> list[str]:
    """Each item's layer label: its series' file name template with date (item-N without a time), item_id and index, less the extension.

    Items that come to one label raise ValueError, as one would replace the other.
    """
    clean = lambda x: re.sub(r"[^A-Za-z0-9_.-]+", "_", x).strip("_") or "item"
    seen: dict[tuple[str, str], str] = {}
    counts: dict[str, int] = {}
    out = []
    for item in selected:
        n = counts[item["series"]] = counts.get(item["series"], 0) + 1
        date = clean((item["datetime"] or f"item-{n}")[:10])
        name = recipe.series[item["series"]].filename_template.format(date=date, item_id=clean(item["item_id"]), index=n)
        label = re.sub(r"\.tiff?$", "", name)
        if (item["series"], label) in seen:
            raise ValueError(f"items {seen[item['series'], label]} and {item['item_id']} are both named {label}")
        seen[item["series"], label] = item["item_id"]
        out.append(label)
    return out


def prepare(spark: SparkSession, selected: list[dict], scenes: DataFrame, scene_layers: list, area: Area, recipe: Recipe) -> DataFrame:
    """Blocks of a pack from selected items, each {series, item_id, datetime, found: {group: href}}, and the scenes' blocks.

    scenes are blocks whose label is the asset's href, scene_layers their catalog. Optical items become NDVI or a band, radar
    and historical ones a band (to_db: decibels), all elevation items one mean; quality is the share of optical and radar
    items with a value, 0 where none has. Cells outside the area are missing, of which quality is no layer. Without an elevation item ValueError.
    """
    ship(spark)
    if not any(i["series"] == "dem" for i in selected):
        raise ValueError("no elevation item was selected")
    zone, south = area.utm()
    grid, height, width = target_grid(area, recipe.target.resolution_m)
    rings = [[project(lat, lon, zone) for lon, lat in r] for r in (*area.rings, *area.holes)]
    number = {label: n for n, (_, label, *_) in enumerate(scene_layers)}
    grids = [x[2] for x in scene_layers]
    for item in selected:
        for group, href in item["found"].items():
            if href not in number:
                raise ValueError(f"item {item['item_id']}: no raster at {href} for {group}")
    labels = item_labels(selected, recipe)
    how = {s: recipe.series[s].resampling or "bilinear" for s in recipe.series}
    to_metres = lambda g: 111_320.0 if g.crs == "EPSG:4326" else 1.0
    margin = 3 * max(g.dx * to_metres(g) for g in grids) + recipe.target.resolution_m
    size, nc = BLOCK * grid.dx, -(-width // BLOCK)
    tiles = spark.range(-(-height // BLOCK) * nc).select(
        F.col("id").alias("seq"), (F.lit(grid.left - margin) + (F.col("id") % nc) * size).alias("x0"), (F.lit(grid.top + margin) - (F.floor(F.col("id") / nc) + 1) * size - 2 * margin).alias("y0"), F.lit(size + 2 * margin).alias("size"),
    )
    windows = tile_windows(with_corners(tiles, zone, south), scenes, scene_layers, grid.crs)

    def build(pdf: pd.DataFrame) -> pd.DataFrame:
        seq = int(pdf["seq"].iloc[0])
        r0, c0 = seq // nc * BLOCK, seq % nc * BLOCK
        shape = (min(BLOCK, height - r0), min(BLOCK, width - c0))
        row, col = np.indices(shape)
        x, y = grid.left + (col + c0 + 0.5) * grid.dx, grid.top - (row + r0 + 0.5) * grid.dy
        lat, lon = inverse_arrays(x, y, zone, south)
        own = in_rings(x, y, rings)
        found: dict[int, tuple[np.ndarray, int, int]] = {}
        for n, part in pdf.groupby("layer"):
            t = next(part.itertuples())
            a = np.full((t.r1 - t.r0, t.c1 - t.c0), np.nan)
            for p in part.itertuples():
                a[p.row0 : p.row0 + p.h, p.col0 : p.col0 + p.w] = np.frombuffer(p.data, "<f4").reshape(p.h, p.w)
            found[int(n)] = a, t.r0, t.c0

        def band(series: str, href: str) -> np.ndarray:
            n = number[href]
            if n not in found:
                return np.full(shape, np.nan)
            a, top, left = found[n]
            g = grids[n]
            px, py = (lon, lat) if g.crs == "EPSG:4326" else (x, y)
            return np.where(own, resample(a, (g.top - py) / g.dy - top, (px - g.left) / g.dx - left, how[series], grid.dx / (g.dx * to_metres(g))), np.nan)

        out: list[tuple[str, str, np.ndarray]] = []
        heights = []
        for item, label in zip(selected, labels):
            s, bands = item["series"], item["found"]
            if s == "dem":
                heights += [band(s, h) for h in bands.values()]
            elif recipe.series[s].output_kind == "ndvi":
                red, nir = band(s, bands["red"]), band(s, bands["nir"])
                total = nir + red
                out.append((s, label, np.where(np.abs(total) > 1e-6, (nir - red) / np.where(np.abs(total) > 1e-6, total, 1), np.nan)))
            else:
                v = band(s, next(iter(bands.values())))
                if recipe.series[s].to_db:
                    v = np.where(v > 0, 10 * np.log10(np.where(v > 0, v, 1)), np.nan)
                out.append((s, label, v))
        some = np.isfinite(heights).any(axis=0)
        out.append(("dem", "dem", np.where(some, np.nanmean(np.where(some, heights, 0.0), axis=0), np.nan)))
        seen = [np.isfinite(a) for s, _, a in out if s in ("optical", "sar")]
        if seen:
            out.append(("quality", "quality", np.mean(seen, axis=0)))
        rows = [(s, label, grid.crs, grid.left, grid.top, grid.dx, grid.dy, height, width, r0, c0, *shape, np.ascontiguousarray(a, "<f4").tobytes()) for s, label, a in out]
        return pd.DataFrame(rows, columns=[c.split()[0] for c in BLOCKS.split(", ")])

    return windows.groupBy("seq").applyInPandas(build, BLOCKS)
