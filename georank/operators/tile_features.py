"""Evidence of tiles from a raster pack: a range join of tiles with blocks, then kernels over each tile's own window."""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from georank.functions.geo import utm_inverse
from georank.functions.scoring import EVIDENCE, METRES_PER_DEGREE
from georank.operators import kernels as k
from georank.settings import FeatureEngine
from georank.shipping import ship
from georank.sources.pack import BLOCK, SERIES

#: Notes of a tile's evidence.
NOTES = {
    "few_dates": "limited multitemporal support", "no_history": "no historical layer in raster pack",
    "no_disturbance": "no explicit disturbance layer supplied", "low_quality": "data quality is low; manual review should be conservative",
}
OUTPUT = f"seq bigint, {', '.join(f'{e} double' for e in EVIDENCE)}, notes array<string>, landscape string, metrics map<string, double>"


def with_corners(tiles: DataFrame, zone: int, south: bool) -> DataFrame:
    """tiles with lat, lon of their centre, x and y of it, and corners, an array of (lat, lon, x, y) around the tile."""
    out = tiles.withColumn("x", F.col("x0") + F.col("size") / 2).withColumn("y", F.col("y0") + F.col("size") / 2)
    lat, lon = utm_inverse(F.col("x"), F.col("y"), zone, south)
    corners = []
    for right, up in ((0, 0), (1, 0), (1, 1), (0, 1)):
        x, y = F.col("x0") + right * F.col("size"), F.col("y0") + up * F.col("size")
        a, o = utm_inverse(x, y, zone, south)
        corners.append(F.struct(a.alias("lat"), o.alias("lon"), x.alias("x"), y.alias("y")))
    return out.withColumn("lat", lat).withColumn("lon", lon).withColumn("corners", F.array(*corners))


def tile_windows(tiles: DataFrame, blocks: DataFrame, layers: list, epsg: str) -> DataFrame:
    """(seq, lat, layer, r0, c0, h, w, corners in cells, part r, part c, part h, part w, data): each tile's crop of each layer.

    A tile meets the blocks that its bounding window touches by an equi join on block numbers; blocks are cut to the
    window before they travel to the tile. layers is the pack's catalog; its position is the layer's number.
    """
    listed = []
    for n, (kind, label, grid, height, width) in enumerate(layers):
        if grid.crs not in ("EPSG:4326", epsg):
            raise ValueError(f"layer {kind}/{label} is in {grid.crs}, neither in EPSG:4326 nor in the area's {epsg}")
        listed.append(F.struct(F.lit(n).alias("layer"), F.lit(kind).alias("kind"), F.lit(label).alias("label"), *[F.lit(float(v)).alias(c) for v, c in ((grid.left, "left"), (grid.top, "top"), (grid.dx, "dx"), (grid.dy, "dy"))],
                               F.lit(height).alias("height"), F.lit(width).alias("width"), F.lit(grid.crs == "EPSG:4326").alias("degrees")))
    seen = tiles.select("seq", "lat", "corners", F.explode(F.array(*listed)).alias("l")).select("seq", "lat", "corners", "l.*")
    cells = F.transform("corners", lambda p: F.struct(
        ((F.when(F.col("degrees"), p["lon"]).otherwise(p["x"]) - F.col("left")) / F.col("dx")).alias("col"),
        ((F.col("top") - F.when(F.col("degrees"), p["lat"]).otherwise(p["y"])) / F.col("dy")).alias("row"),
    ))
    cut = seen.withColumn("cells", cells)
    low = lambda axis, end: F.greatest(F.floor(F.array_min(F.transform("cells", lambda p: p[axis])) + 1e-9), F.lit(0)).cast("int")
    high = lambda axis, end: F.least(F.ceil(F.array_max(F.transform("cells", lambda p: p[axis])) - 1e-9), F.col(end)).cast("int")
    cut = cut.withColumn("r0", low("row", "height")).withColumn("c0", low("col", "width")).withColumn("r1", high("row", "height")).withColumn("c1", high("col", "width"))
    span = lambda a, b: F.explode(F.sequence((F.col(a) / BLOCK).cast("int"), ((F.col(b) - 1) / BLOCK).cast("int")))
    cut = cut.where("r1 > r0 and c1 > c0").withColumn("br", span("r0", "r1")).withColumn("bc", span("c0", "c1"))
    keyed = blocks.select("kind", "label", "row0", "col0", "h", "w", "data", (F.col("row0") / BLOCK).cast("int").alias("br"), (F.col("col0") / BLOCK).cast("int").alias("bc"))
    met = cut.join(keyed, ["kind", "label", "br", "bc"]).select("seq", "lat", "layer", "r0", "c0", "r1", "c1", "dx", "dy", "degrees", F.col("cells.col").alias("xs"), F.col("cells.row").alias("ys"), "row0", "col0", "h", "w", "data")

    def trim(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            rows, cols, shapes, data = [], [], [], []
            for t in pdf.itertuples():
                a = np.frombuffer(t.data, "<f4").reshape(t.h, t.w)
                r, c = max(t.r0, t.row0), max(t.c0, t.col0)
                part = np.ascontiguousarray(a[r - t.row0 : t.r1 - t.row0, c - t.col0 : t.c1 - t.col0])
                rows.append(r - t.r0)
                cols.append(c - t.c0)
                shapes.append(part.shape)
                data.append(part.tobytes())
            yield pdf.assign(row0=rows, col0=cols, h=[s[0] for s in shapes], w=[s[1] for s in shapes], data=data)[list(pdf.columns)]

    return met.mapInPandas(trim, met.schema)


def _inside(xs, ys, r0: int, c0: int, shape: tuple[int, int]) -> np.ndarray:
    """Cells of a window whose centre lies in a convex ring given in cells."""
    row, col = np.indices(shape)
    x, y = col + c0 + 0.5, row + r0 + 0.5
    sides = [(xs[i - 3] - xs[i]) * (y - ys[i]) - (ys[i - 3] - ys[i]) * (x - xs[i]) for i in range(4)]
    return np.all([s >= 0 for s in sides], axis=0) | np.all([s <= 0 for s in sides], axis=0)


def cell_metres(lat: float, dx: float, dy: float, degrees: bool) -> tuple[float, float]:
    """Width and height of a cell in metres."""
    if degrees:
        dx, dy = dx * METRES_PER_DEGREE * max(math.cos(math.radians(lat)), 0.1), dy * METRES_PER_DEGREE
    return max(dx, 1e-6), max(dy, 1e-6)


def evidence(series: dict[str, list[np.ndarray]], single: dict[str, np.ndarray | None], metres: tuple[float, float], cfg: FeatureEngine) -> dict | None:
    """Evidence, notes, landscape and metrics of one tile from its windows (NaN is missing); null without any usable data.

    A layer that the pack has but that doesn't meet the tile is an empty array; one that the pack lacks is not there.
    """
    seen = lambda a: a is not None and np.isfinite(a).any()
    optical, sar, history = (series[s] for s in SERIES)
    dem = single["dem"]
    if not any(map(seen, optical + sar)) and not seen(dem):
        return None
    strength = lambda stack: float(np.mean([k.robust_strength(k.residual(a, cfg.anomaly_sigma_px), cfg.anomaly_z_cap) for a in stack])) if stack else 0.0
    micro, rugged, slope, steep = k.terrain(dem, *metres, cfg.dem_sigma_px)
    surface = k.current_surface(optical, sar, dem, cfg.anomaly_sigma_px, cfg.dem_sigma_px)
    mask = k.surface_mask(surface, cfg.mask_quantile)
    lasting = [p for p in (k.persistence(s, cfg.anomaly_sigma_px, cfg.temporal_anomaly_z) for s in (optical, sar)) if p > 0]
    water, confounder, disturbance, quality = (k.mean_probability(single[n]) if single.get(n) is not None else None for n in ("water_proximity", "confounder", "disturbance", "quality"))
    wood = single.get("forest")
    forest = float((wood[np.isfinite(wood)] > 0.5).mean()) if seen(wood) else None
    clip = lambda v: float(min(max(v, 0.0), 1.0))
    risk = rugged if confounder is None else clip(0.5 * rugged + 0.5 * confounder)
    wet = 0.5 if water is None else water
    shares = [k.valid_fraction(dem), *[k.valid_fraction(a) for a in optical + sar + history if a.size]] + ([quality] if quality is not None else [])
    good = clip(float(np.mean(shares)))
    notes = [NOTES[n] for n, said in (("few_dates", len(optical) < 2 and len(sar) < 2), ("no_history", not history), ("no_disturbance", single.get("disturbance") is None), ("low_quality", good < 0.45)) if said]
    if forest is not None and forest >= 0.5:
        landscape = "forest"
    elif steep >= 18 or rugged >= 0.65:
        landscape = "mountain"
    elif water is not None and water >= 0.6 and slope <= 10:
        landscape = "valley"
    else:
        landscape = "steppe" if slope <= 8 else "unknown"
    fit = clip(0.45 * clip(1 - max(slope - 6, 0) / 18) + 0.35 * wet + 0.20 * (1 - risk))
    values = (strength(optical), strength(sar), micro, k.enclosure(mask), k.line_strength(surface, cfg.edge_sigma), float(np.mean(lasting)) if lasting else 0.0,
              k.historical_match(mask, history, cfg.anomaly_sigma_px, cfg.mask_quantile), fit, disturbance or 0.0, risk, good)
    return dict(zip(EVIDENCE, map(clip, values))) | {
        "notes": notes, "landscape": landscape, "metrics": {"median_slope_deg": slope, "slope_p90_deg": steep, "terrain_ruggedness_risk": rugged, "water_proximity_mean": wet},
    }


def tile_features(tiles: DataFrame, blocks: DataFrame, layers: list, epsg: str, cfg: FeatureEngine | None = None) -> DataFrame:
    """Rows (seq, evidence, notes, landscape, metrics) of the tiles (with_corners) that have usable data, from the pack's blocks and catalog."""
    ship(tiles.sparkSession)
    cfg = cfg or FeatureEngine()
    kinds = [x[0] for x in layers]
    windows = tile_windows(tiles, blocks, layers, epsg)

    def kernel(pdf: pd.DataFrame) -> pd.DataFrame:
        found: dict[int, np.ndarray] = {}
        metres = (1.0, 1.0)
        for n, part in pdf.groupby("layer"):
            t = next(part.itertuples())
            shape = (t.r1 - t.r0, t.c1 - t.c0)
            a = np.full(shape, np.nan)
            for p in part.itertuples():
                a[p.row0 : p.row0 + p.h, p.col0 : p.col0 + p.w] = np.frombuffer(p.data, "<f4").reshape(p.h, p.w)
            a[~_inside(t.xs, t.ys, t.r0, t.c0, shape)] = np.nan
            found[n] = a
            if kinds[n] == "dem":
                metres = cell_metres(t.lat, t.dx, t.dy, t.degrees)
        empty = np.full((0, 0), np.nan)
        series = {s: [found.get(n, empty) for n, kind in enumerate(kinds) if kind == s] for s in SERIES}
        single = {kind: found.get(n, empty) for n, kind in enumerate(kinds) if kind not in SERIES}
        got = evidence(series, single, metres, cfg)
        if got is None:
            return pd.DataFrame(columns=["seq", *EVIDENCE, "notes", "landscape", "metrics"])
        return pd.DataFrame([{"seq": int(pdf["seq"].iloc[0])} | got])

    return windows.groupBy("seq").applyInPandas(kernel, OUTPUT)
