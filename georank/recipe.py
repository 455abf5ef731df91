"""Ingest recipes: which scenes to select for each series of a raster pack, and the grid to bring them to."""

from __future__ import annotations

import tomllib
from dataclasses import dataclass, field, fields

SERIES = ("optical", "sar", "dem", "historical")
RESAMPLING = ("nearest", "bilinear", "cubic", "average")
OUTPUTS = ("single-band", "ndvi")


@dataclass(frozen=True)
class Rule:
    """A test of an item's property; every operator that is given must hold."""

    property: str
    eq: str | float | int | bool | None = None
    ne: str | float | int | bool | None = None
    lte: float | None = None
    gte: float | None = None
    contains: str | None = None


@dataclass(frozen=True)
class Client:
    endpoint: str = ""
    timeout_s: float = 120.0
    max_pages: int = 10
    asset_href_signing: str = "none"
    headers: dict[str, str] = field(default_factory=dict)


@dataclass(frozen=True)
class Target:
    resolution_m: float = 30.0
    resampling: str = "bilinear"
    compress: str = "deflate"
    nodata: float = -9999.0
    output_crs: str | None = None


@dataclass(frozen=True)
class Series:
    enabled: bool = False
    collection: str = ""
    datetime: str | None = None
    max_items: int = 4
    search_limit: int = 50
    output_kind: str = "single-band"
    filename_template: str = "{date}_{item_id}.tif"
    sort_by: str = "datetime"
    sort_ascending: bool = True
    asset_groups: dict[str, list[str]] = field(default_factory=dict)
    filters: tuple[Rule, ...] = ()
    resampling: str | None = None
    to_db: bool = False


@dataclass(frozen=True)
class Recipe:
    stac: Client = field(default_factory=Client)
    target: Target = field(default_factory=Target)
    series: dict[str, Series] = field(default_factory=lambda: {s: Series() for s in SERIES})


def _typed(kind, given: dict, where: str):
    if extra := set(given) - {f.name for f in fields(kind)}:
        raise TypeError(f"unknown keys in [{where}]: {sorted(extra)}")
    return kind(**given)


def load_recipe(path: str) -> Recipe:
    """A recipe from a TOML file; missing keys and sections take the defaults, unknown keys raise TypeError, a series
    without a section is disabled, unknown resampling and output kinds raise ValueError."""
    with open(path, "rb") as f:
        raw = tomllib.load(f)
    series = {}
    for name in SERIES:
        given = dict(raw.get(name, {}))
        rules = tuple(_typed(Rule, r, f"{name}.filters") for r in given.pop("filters", []))
        series[name] = _typed(Series, given | {"filters": rules}, name)
        if (series[name].resampling or "bilinear") not in RESAMPLING:
            raise ValueError(f"unknown resampling {series[name].resampling!r}")
        if series[name].output_kind not in OUTPUTS:
            raise ValueError(f"unknown output kind {series[name].output_kind!r}")
    target = _typed(Target, raw.get("target", {}), "target")
    if target.resolution_m <= 0:
        raise ValueError("the resolution must be positive")
    return Recipe(_typed(Client, raw.get("stac", {}), "stac"), target, series)
