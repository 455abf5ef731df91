"""Typed settings and their TOML loader; missing keys take the defaults below, which are fixed values."""

from __future__ import annotations

import tomllib
from dataclasses import dataclass, field, fields

from georank.functions.scoring import POSITIVES

#: Landscape weights in the order of POSITIVES.
WEIGHTS: dict[str, tuple[float, ...]] = {
    "steppe": (0.9, 0.6, 1.2, 1.1, 0.9, 1.0, 1.0, 0.8),
    "valley": (1.0, 0.7, 0.8, 0.7, 1.0, 1.0, 0.9, 1.1),
    "mountain": (0.6, 0.8, 1.0, 0.6, 0.7, 1.1, 0.8, 0.8),
    "forest": (0.3, 0.8, 0.7, 0.4, 0.5, 0.8, 0.5, 0.6),
}


@dataclass(frozen=True)
class Scoring:
    penalty_strength: float = 0.35
    uncertainty_strength: float = 0.25


@dataclass(frozen=True)
class Analysis:
    tile_size_m: float = 500.0
    tile_step_m: float = 500.0
    min_tile_coverage: float = 0.2
    min_valid_pixel_fraction: float = 0.3
    min_adjusted_score: float = 0.3
    max_candidates: int = 500
    cluster_distance_m: float = 250.0
    cluster_min_members: int = 1


@dataclass(frozen=True)
class FeatureEngine:
    anomaly_sigma_px: float = 2.0
    dem_sigma_px: float = 3.0
    anomaly_z_cap: float = 6.0
    temporal_anomaly_z: float = 2.5
    edge_sigma: float = 1.2
    mask_quantile: float = 0.85


@dataclass(frozen=True)
class ContextLayers:
    relief_sigma_px: float = 8.0
    curvature_sigma_px: float = 3.0
    valley_sigma_px: float = 14.0
    water_seed_quantile: float = 0.9
    water_distance_scale_m: float = 1200.0
    forest_threshold: float = 0.55
    forest_smoothing_sigma_px: float = 1.2
    disturbance_sigma_px: float = 1.4
    disturbance_variance_sigma_px: float = 3.0
    disturbance_canny_sigma: float = 1.0
    disturbance_line_sigma_px: float = 2.0


@dataclass(frozen=True)
class Guardrails:
    public_blur_m: float = 5000.0
    restricted_blur_m: float = 1000.0
    block_in_red_zones: bool = True
    red_zone_access: str = "authorized-only"
    withhold_sensitive: bool = True


@dataclass(frozen=True)
class Settings:
    scoring: Scoring = field(default_factory=Scoring)
    analysis: Analysis = field(default_factory=Analysis)
    guardrails: Guardrails = field(default_factory=Guardrails)
    feature_engine: FeatureEngine = field(default_factory=FeatureEngine)
    context_layers: ContextLayers = field(default_factory=ContextLayers)
    weights: dict[str, tuple[float, ...]] = field(default_factory=lambda: dict(WEIGHTS))


def load_settings(path: str | None = None) -> Settings:
    """Settings from a TOML file with tables scoring, analysis, guardrails, feature_engine, context_layers and landscape_weights; defaults without one.

    An unknown key or a weight table without all eight weights raises.
    """
    if path is None:
        return Settings()
    with open(path, "rb") as f:
        raw = tomllib.load(f)
    if extra := set(raw) - {f.name for f in fields(Settings)} - {"landscape_weights"}:
        raise TypeError(f"unknown tables: {sorted(extra)}")
    parts = {}
    for name, kind in (("scoring", Scoring), ("analysis", Analysis), ("guardrails", Guardrails), ("feature_engine", FeatureEngine), ("context_layers", ContextLayers)):
        known = {x.name for x in fields(kind)}
        given = raw.get(name, {})
        if extra := set(given) - known:
            raise TypeError(f"unknown keys in [{name}]: {sorted(extra)}")
        parts[name] = kind(**given)
    weights = {k: tuple(float(v[p]) for p in POSITIVES) for k, v in raw.get("landscape_weights", {}).items()}
    return Settings(weights=weights or dict(WEIGHTS), **parts)
