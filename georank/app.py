"""The engine's entry points: analyze an area over a raster pack, build its context layers, import red zones, run the demo."""

from __future__ import annotations

import json
from dataclasses import asdict, dataclass, replace
from pathlib import Path

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from georank.functions import geo
from georank.operators import cluster, context, ingest, rank, redzones, tiles, zones
from georank.operators.select_items import select_series
from georank.operators.tile_features import tile_features, with_corners
from georank.recipe import SERIES as RECIPE_SERIES
from georank.recipe import Recipe
from georank.settings import Settings
from georank.sources import pack as packs
from georank.sources.readers import Area, read_features


@dataclass(frozen=True)
class Result:
    """What analyze() found; the frames are checkpointed, so they are read and not computed again."""

    mode: str
    total_tiles: int
    processed_tiles: int
    records: DataFrame
    ranked: DataFrame
    clusters: DataFrame


def _kept(df: DataFrame) -> DataFrame:
    """df written to the shared checkpoint folder; lineage ends there."""
    context = df.sparkSession.sparkContext
    if context.getCheckpointDir() is None:
        folder = df.sparkSession.conf.get("spark.checkpoint.dir", None)
        if folder is None:
            raise RuntimeError("set spark.checkpoint.dir to a folder that driver and executors share")
        context.setCheckpointDir(folder)
    return df.checkpoint()


def analyze(spark: SparkSession, area: Area, pack: str, mode: str = "public", red_zones: DataFrame | None = None, settings: Settings | None = None, **overrides) -> Result:
    """Tiles of the area with evidence from the pack, ranked and clustered; overrides are fields of the settings' analysis part.

    Tiles without usable data or below the least share of valid cells go. A tile whose footprint meets a red zone is
    sensitive, one whose centre is in a zone is withheld where the mode has no access. Ranked rows reach the least score
    and are at most max_candidates. Null overrides count as not given.
    """
    settings = settings or Settings()
    settings = replace(settings, analysis=replace(settings.analysis, **{k: v for k, v in overrides.items() if v}))
    a = settings.analysis
    layers = packs.catalog(spark, pack)
    if not any(x[0] in ("optical", "sar") for x in layers):
        raise ValueError("the pack has neither an optical nor a radar series")
    zone, south = area.utm()
    rings = [[geo.project(lat, lon, zone) for lon, lat in r] for r in area.rings]
    holes = tuple([geo.project(lat, lon, zone) for lon, lat in r] for r in area.holes)
    cover = tiles.tile_aoi(spark, rings[0], a.tile_size_m, a.tile_step_m, a.min_tile_coverage, tuple(rings[1:]), holes)
    placed = _kept(with_corners(cover, zone, south))
    found = tile_features(placed, packs.read_blocks(spark, pack), layers, f"EPSG:{(32700 if south else 32600) + zone}", settings.feature_engine)
    rows = placed.join(found.where(F.col("data_quality") >= a.min_valid_pixel_fraction), "seq").withColumnRenamed("tile_id", "candidate_id")
    reach = lambda c: (F.array_max(F.transform("corners", lambda p: p[c])) - F.array_min(F.transform("corners", lambda p: p[c]))) / 2
    rows = rows.withColumn("half_lat", reach("lat")).withColumn("half_lon", reach("lon"))
    if red_zones is not None:
        rows = zones.tag(rows, red_zones, half="half_lat", half_lon="half_lon")
    else:
        rows = rows.withColumn("zone_names", F.array().cast("array<string>")).withColumn("sensitivity", F.lit("normal")).withColumn("tags", F.array(F.concat(F.lit("landscape:"), F.col("landscape"))))
    dates = [x[1] for kind in packs.SERIES for x in layers if x[0] == kind]
    records = _kept(rows.withColumn("source_dates", F.array(*map(F.lit, dates))).drop("half_lat", "half_lon"))
    ranked = _kept(rank.top(rank.rank(records, mode, red_zones, settings), a.max_candidates, a.min_adjusted_score))
    members = ranked.join(records.select("seq", "lat", "lon", "x", "y", "x0", "y0", F.col("zone_names").alias("red_zone_names")), "seq")
    members = _kept(members.join(cluster.components_within(members, a.cluster_distance_m), "seq"))
    clusters = cluster.summarize(members, mode, a.cluster_min_members, settings)
    squares = members.select("component", F.col("x0").alias("x"), F.col("y0").alias("y"))
    clusters = _kept(clusters.join(cluster.union_area_ha(squares, a.tile_size_m, a.tile_step_m), "component"))
    return Result(mode, placed.count(), records.count(), records, ranked, clusters)


def build_context(spark: SparkSession, pack: str, settings: Settings | None = None, overwrite: bool = False) -> dict[str, list[str]]:
    """Add the context layers that a pack lacks, or all of them with overwrite; {created, reused}, and the pack's manifest names them."""
    layers = packs.catalog(spark, pack)
    own = {x[0] for x in layers}
    wanted = [n for n in context.LAYERS if overwrite or n not in own]
    sources = [x for x in layers if x[0] in (*packs.SERIES, "dem")]
    created: list[str] = []
    if wanted:
        blocks = packs.read_blocks(spark, pack).where(F.col("kind").isin(*packs.SERIES, "dem"))
        made = _kept(context.context_blocks(blocks, sources, wanted, (settings or Settings()).context_layers))
        packs.write_blocks(made, pack)
        created = [r["kind"] for r in made.select("kind").distinct().orderBy("kind").collect()]
    reused = [n for n in context.LAYERS if n in own and n not in wanted]
    packs.manifest(spark, pack, **{n: f"blocks/kind={n}" if n in created or n in reused else None for n in context.LAYERS})
    return {"created": created, "reused": reused}


def select_scenes(items: DataFrame, recipe: Recipe, area: Area | None = None) -> list[dict]:
    """The selection manifest's items by series, each series in its order; at most max_items of each reach the driver."""
    corners = [p for r in area.rings for p in r] if area else []
    box = (min(p[0] for p in corners), min(p[1] for p in corners), max(p[0] for p in corners), max(p[1] for p in corners)) if corners else None
    out = []
    for name in RECIPE_SERIES:
        series = recipe.series[name]
        if series.enabled:
            for r in select_series(items, name, series, box).collect():
                out.append({
                    "series": name, "item_id": r["item_id"], "collection": r["collection"], "datetime": r["datetime"], "bbox": r["bbox"], "properties": json.loads(r["properties"] or "{}"),
                    "found": {f["group"]: f["href"] for f in r["found"]}, "keys": {f["group"]: f["key"] for f in r["found"]},
                })
    return out


def prepare_pack(spark: SparkSession, area: Area, recipe: Recipe, selected: list[dict], scenes: str, pack: str) -> dict:
    """A pack from selected items whose assets are rasters (labels) of the block table at ``scenes``; its manifest."""
    wanted = [h for i in selected for h in i["found"].values()]
    blocks = packs.read_blocks(spark, scenes).where(F.col("label").isin(wanted) if wanted else F.lit(False))
    layers = packs.scene_catalog(blocks)
    made = ingest.prepare(spark, selected, blocks, layers, area, recipe)
    packs.write_blocks(made, pack)
    grid, height, width = ingest.target_grid(area, recipe.target.resolution_m)
    listed = {k: sorted(x[1] for x in packs.catalog(spark, pack) if x[0] == k) for k in (*packs.SERIES, "dem", "quality")}
    return packs.manifest(spark, pack, target_grid=asdict(grid) | {"height": height, "width": width}, selection=[{k: i[k] for k in ("series", "item_id")} for i in selected], **listed)


def import_red_zones(spark: SparkSession, source: str, target: str, options: redzones.Options | None = None, summary: str | None = None) -> dict:
    """Normalize a GeoJSON file of zones into another on the driver's disk; counts of the run. Nothing left raises ValueError."""
    options = options or redzones.Options()
    features = read_features(spark, source, "map<string, string>")
    kept, dissolved = redzones.import_zones(features, options)
    kept, dissolved = _kept(kept), _kept(dissolved)
    rows = [json.loads(r["feature"]) for r in redzones.zone_features(dissolved).orderBy("first_idx").collect()]
    if not rows:
        raise ValueError(f"no zone of {source} is left")
    counts = {"input_features": features.count(), "kept_features": kept.count(), "output_features": len(rows), "options": asdict(options), "output": target}
    Path(target).write_text(json.dumps({"type": "FeatureCollection", "features": rows}, indent=2, ensure_ascii=False), encoding="utf-8")
    if summary:
        Path(summary).write_text(json.dumps(counts, indent=2, ensure_ascii=False), encoding="utf-8")
    return counts


def demo(spark: SparkSession, folder: str, mode: str = "public", settings: Settings | None = None) -> dict[str, str]:
    """The demo pack under a folder, analyzed with its red zone; paths of the eight artefacts."""
    from georank.sinks.writers import write_analysis
    from georank.sources.readers import read_area, read_zones

    paths = packs.write_demo(spark, folder)
    area, red = read_area(spark, paths["aoi"]), read_zones(spark, paths["red_zones"])
    result = analyze(spark, area, paths["pack"], mode, red, settings)
    return write_analysis(f"{folder}/outputs", result, area, red)
