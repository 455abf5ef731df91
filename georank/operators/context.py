"""Context layers of a raster pack: forest, natural confounders, water proximity, disturbance and quality from its own rasters."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from georank.operators import kernels as k
from georank.operators.tile_features import cell_metres
from georank.settings import ContextLayers
from georank.shipping import ship
from georank.sources.pack import BLOCKS, SERIES, Grid, to_blocks

#: The layers, in building order.
LAYERS = ("forest", "confounder", "water_proximity", "disturbance", "quality")


def _zero(a: np.ndarray) -> np.ndarray:
    return np.nan_to_num(a, nan=0.0)


def stack(arrays: list[np.ndarray]) -> np.ndarray | None:
    """Rasters of one shape on top of each other; other shapes raise."""
    if not arrays:
        return None
    if len({a.shape for a in arrays}) > 1:
        raise ValueError(f"rasters of a series differ in shape: {sorted({a.shape for a in arrays})}")
    return np.stack(arrays)


def _over_time(values: np.ndarray, how) -> np.ndarray:
    """how (a nan-aware statistic) by cell; missing where no date has a value."""
    some = np.isfinite(values).any(axis=0)
    return np.where(some, how(np.where(some, values, 0.0), axis=0), np.nan)


def slope(dem: np.ndarray, metres: tuple[float, float]) -> np.ndarray:
    dx, dy = metres
    return np.where(np.isfinite(dem), np.degrees(np.arctan(np.hypot(*np.gradient(k.fill_median(dem), dy, dx)))), np.nan)


def forest(optical: list[np.ndarray], cfg: ContextLayers) -> np.ndarray | None:
    """Ramp of the median over dates above the threshold where values are an index, else above the stretch's p80; smoothed."""
    dates = stack(optical)
    if dates is None:
        return None
    middle = _over_time(dates, np.nanmedian)
    ok = np.isfinite(middle)
    if not ok.any():
        return None
    if ok.sum() < 10:
        return np.zeros(middle.shape)
    start, values = cfg.forest_threshold, middle
    if np.abs(middle[ok]).max() > 1.2:
        values = k.normalize(middle, 10, fill=False)
        start = float(np.quantile(values[ok], 0.8))
    ramp = np.clip((values - start) / max(1 - start, 0.05), 0, 1)
    return np.where(ok, k.gaussian(_zero(ramp), cfg.forest_smoothing_sigma_px), np.nan)


def confounder(dem: np.ndarray, metres: tuple[float, float], cfg: ContextLayers) -> np.ndarray:
    """.55 slope up to 25 degrees, .30 roughness, .15 concavity."""
    filled = k.fill_median(dem)
    rough = k.normalize(np.abs(filled - k.gaussian(filled, max(cfg.relief_sigma_px, 1))), 10, fill=False)
    concave = k.normalize(-k.laplace(filled, max(cfg.curvature_sigma_px, 1)), 10, fill=False)
    steep = np.clip(slope(dem, metres) / 25, 0, 1)
    return np.where(np.isfinite(dem), np.clip(0.55 * _zero(steep) + 0.30 * _zero(rough) + 0.15 * _zero(concave), 0, 1), np.nan)


def water_proximity(dem: np.ndarray, metres: tuple[float, float], cfg: ContextLayers) -> np.ndarray:
    """exp(-distance / scale) to low, gentle ground: cells from the seed quantile of wetness, cleaned, or from its p80 if none is left."""
    filled = k.fill_median(dem)
    low = k.normalize(k.gaussian(filled, max(cfg.valley_sigma_px, 1)) - filled, 10, fill=False)
    gentle = 1 - np.nan_to_num(np.clip(slope(dem, metres) / 20, 0, 1), nan=1.0)
    wet = np.clip(0.65 * _zero(low) + 0.35 * gentle, 0, 1)
    if wet.size < 10:
        return np.where(np.isfinite(dem), 0.0, np.nan)
    seeds = k.clean_mask(wet >= np.quantile(wet, np.clip(cfg.water_seed_quantile, 0.5, 0.99)))
    if not seeds.any():
        seeds = wet >= np.quantile(wet, 0.8)
    near = np.exp(-k.distance(seeds, *metres) / max(cfg.water_distance_scale_m, 1))
    return np.where(np.isfinite(dem), np.where(seeds, 1.0, np.clip(near, 0, 1)), np.nan)


def disturbance(optical: list[np.ndarray], sar: list[np.ndarray], cfg: ContextLayers) -> np.ndarray | None:
    """.45 gradient, .25 local variance, .30 density of straight lines of the mean surface; lines by a full Hough vote, so reruns agree."""
    surfaces = []
    for series in (optical, sar):
        dates = stack(series)
        if dates is not None and np.isfinite(dates).any():
            surface = k.normalize(_over_time(dates, np.nanmean), 10, fill=False)
            ok = np.isfinite(surface)
            surfaces.append(np.where(ok, surface, np.median(surface[ok])))
    if not surfaces:
        return None
    base = k.fill_median(np.mean(stack(surfaces), axis=0))
    gradient = k.normalize(k.gradient_magnitude(base, max(cfg.disturbance_sigma_px, 0.5)), 10, fill=False)
    variance = k.normalize(k.local_variance(base, max(cfg.disturbance_variance_sigma_px, 1)), 10, fill=False)
    lines = k.line_cells(base, max(cfg.disturbance_canny_sigma, 0.5), max(8, min(base.shape) // 20))
    density = k.normalize(k.gaussian(lines, max(cfg.disturbance_line_sigma_px, 0.5)), 10, fill=False)
    return np.clip(0.45 * _zero(gradient) + 0.25 * _zero(variance) + 0.30 * _zero(density), 0, 1)


def quality(series: list[np.ndarray]) -> np.ndarray | None:
    """Share of dates with a value by cell; missing where none has."""
    dates = stack(series)
    if dates is None:
        return None
    share = np.isfinite(dates).mean(axis=0)
    return np.where(share > 0, share, np.nan)


def context_blocks(blocks: DataFrame, layers: list, missing: list[str], cfg: ContextLayers | None = None) -> DataFrame:
    """Blocks of the layers named in ``missing``, from the pack's blocks and catalog; where they can't be told, forest and
    disturbance are 0 and quality is left out.

    Quantiles, distances and lines are of the whole raster, so each layer is one task that gathers the rasters it needs:
    its memory is that of one pack's series, and layers and packs run beside each other.
    """
    ship(blocks.sparkSession)
    cfg = cfg or ContextLayers()
    kinds = [(x[0], x[1]) for x in layers]
    dem_at, (grid, height, width) = next((i, x[2:]) for i, x in enumerate(layers) if x[0] == "dem")
    needs = {"forest": ["optical"], "confounder": ["dem"], "water_proximity": ["dem"], "disturbance": ["optical", "sar"], "quality": list(SERIES)}
    wanted = F.explode(F.array(*[F.struct(F.lit(n).alias("layer"), F.array(*[F.lit(x) for x in needs[n]]).alias("needs")) for n in missing]))
    middle = grid.top - grid.dy * height / 2
    metres = cell_metres(middle, grid.dx, grid.dy, grid.crs == "EPSG:4326")

    def build(pdf: pd.DataFrame) -> pd.DataFrame:
        name = pdf["layer"].iloc[0]
        rasters = []
        for i, (kind, label) in enumerate(kinds):
            part = pdf[(pdf["kind"] == kind) & (pdf["label"] == label)]
            a = np.full((layers[i][3], layers[i][4]), np.nan)
            for t in part.itertuples():
                a[t.row0 : t.row0 + t.h, t.col0 : t.col0 + t.w] = np.frombuffer(t.data, "<f4").reshape(t.h, t.w)
            rasters.append(a)
        of = lambda *names: [a for a, (kind, _) in zip(rasters, kinds) if kind in names]
        dem = rasters[dem_at]
        made = {
            "forest": lambda: forest(of("optical"), cfg), "confounder": lambda: confounder(dem, metres, cfg), "water_proximity": lambda: water_proximity(dem, metres, cfg),
            "disturbance": lambda: disturbance(of("optical"), of("sar"), cfg), "quality": lambda: quality(of(*SERIES)),
        }[name]()
        if made is None and name != "quality":
            made = np.zeros((height, width))
        rows = [] if made is None else to_blocks(name, name, grid, made)
        return pd.DataFrame(rows, columns=[c.split()[0] for c in BLOCKS.split(", ")])

    # A layer's group has at least the elevation's first block, so that it is built without any series too.
    met = blocks.select("*", wanted.alias("x")).select("*", "x.layer", "x.needs").where(F.array_contains("needs", F.col("kind")) | ((F.col("kind") == "dem") & (F.col("row0") == 0) & (F.col("col0") == 0)))
    return met.groupBy("layer").applyInPandas(build, BLOCKS)
