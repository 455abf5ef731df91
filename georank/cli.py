"""Command line: python -m georank.cli COMMAND ...; without a known command, the arguments are those of rank."""

from __future__ import annotations

import argparse
import json
import sys
from pathlib import Path

from georank.operators.rank import MODES

COMMANDS = ("rank", "analyze", "stac-search", "prepare-pack", "analyze-stac", "build-context", "import-red-zones", "demo", "make-demo")


def parser() -> argparse.ArgumentParser:
    top = argparse.ArgumentParser(prog="georank")
    commands = top.add_subparsers(dest="command", required=True)
    made = {name: commands.add_parser(name) for name in COMMANDS}
    flag = lambda names, *a, **k: [made[n].add_argument(*a, **k) for n in names]
    flag(["rank"], "input")
    flag(["rank"], "output")
    flag(["demo", "make-demo"], "output_dir")
    flag(["analyze", "stac-search", "prepare-pack", "analyze-stac"], "--aoi", required=True)
    flag(["analyze", "build-context"], "--data-pack", required=True)
    flag(["analyze", "prepare-pack"], "--output-dir", required=True)
    flag(["analyze-stac"], "--work-dir", required=True)
    flag(["stac-search", "prepare-pack", "analyze-stac"], "--recipe", required=True)
    flag(["stac-search", "prepare-pack", "analyze-stac"], "--catalog", help="scene items on file, a page or item a line")
    flag(["prepare-pack", "analyze-stac"], "--scenes", required=True, help="block table of the scenes' rasters, by href")
    flag(["stac-search"], "--output", required=True)
    flag(["prepare-pack"], "--selection-manifest")
    flag(["rank", "analyze", "analyze-stac", "demo"], "--permit-mode", default="public", choices=MODES)
    flag(["analyze", "analyze-stac"], "--red-zones-geojson")
    flag(["rank", "analyze", "analyze-stac"], "--use-demo-red-zones", action="store_true")
    flag(["rank", "analyze", "prepare-pack", "analyze-stac", "build-context", "demo"], "--config")
    for name, kind in (("tile-size-m", float), ("tile-step-m", float), ("cluster-distance-m", float), ("min-adjusted-score", float), ("max-candidates", int)):
        flag(["analyze", "analyze-stac"], f"--{name}", type=kind)
    flag(["analyze", "prepare-pack", "analyze-stac"], "--context-mode", default="auto", choices=("auto", "off", "overwrite"))
    flag(["build-context"], "--overwrite", action="store_true")
    zones = made["import-red-zones"].add_argument
    zones("--input", required=True)
    zones("--output", required=True)
    zones("--summary-output")
    zones("--name-field", default="name")
    zones("--category-field")
    zones("--include-category", action="append", default=[])
    zones("--exclude-category", action="append", default=[])
    for name, value in (("buffer-m", 0.0), ("point-buffer-m", 100.0), ("line-buffer-m", 50.0), ("simplify-m", 0.0), ("min-area-ha", 0.0)):
        zones(f"--{name}", type=float, default=value)
    zones("--dissolve-by", default="none", choices=("none", "name", "category", "all"))
    return top


def run(spark, argv: list[str]) -> dict:
    """Run one command on a session; what it wrote or counted."""
    from georank import app
    from georank.operators import rank, redzones
    from georank.recipe import load_recipe
    from georank.settings import load_settings
    from georank.sinks.writers import write_analysis, write_ranked
    from georank.sources import catalog, pack, search
    from georank.sources.readers import demo_zones, read_area, read_candidates, read_zones

    args = parser().parse_args(argv if argv and (argv[0] in COMMANDS or argv[0] in ("-h", "--help")) else ["rank", *argv])
    given = vars(args)
    settings = load_settings(given.get("config"))

    def red_zones():
        found = [demo_zones(spark)] if given.get("use_demo_red_zones") else []
        found += [read_zones(spark, given["red_zones_geojson"])] if given.get("red_zones_geojson") else []
        return found[0] if len(found) == 1 else found[0].unionByName(found[1], allowMissingColumns=True) if found else None

    def select(area):
        if given.get("selection_manifest"):
            return json.loads(Path(given["selection_manifest"]).read_text(encoding="utf-8"))["items"]
        recipe = load_recipe(args.recipe)
        if not args.catalog and not recipe.stac.endpoint:
            raise SystemExit("a --catalog on file or an endpoint in the recipe is needed")
        items = catalog.read_items(spark, args.catalog) if args.catalog else search.search_items(spark, recipe, area.rings)
        return app.select_scenes(items, recipe, area)

    def add_context(folder):
        return {} if args.context_mode == "off" else app.build_context(spark, folder, settings, args.context_mode == "overwrite")

    def analyzed(folder, out):
        limits = {k: given[k] for k in ("tile_size_m", "tile_step_m", "cluster_distance_m", "min_adjusted_score", "max_candidates")}
        area, red = read_area(spark, args.aoi), red_zones()
        return write_analysis(out, app.analyze(spark, area, folder, args.permit_mode, red, settings, **limits), area, red)

    if args.command == "rank":
        write_ranked(rank.rank(read_candidates(spark, args.input), args.permit_mode, red_zones(), settings), args.output)
        return {"output": args.output}
    if args.command == "analyze":
        add_context(args.data_pack)
        return analyzed(args.data_pack, args.output_dir)
    if args.command == "build-context":
        return app.build_context(spark, args.data_pack, settings, args.overwrite)
    if args.command == "import-red-zones":
        o = redzones.Options(args.name_field, args.category_field, tuple(args.include_category), tuple(args.exclude_category), args.buffer_m, args.point_buffer_m, args.line_buffer_m, args.simplify_m, args.min_area_ha, args.dissolve_by)
        return app.import_red_zones(spark, args.input, args.output, o, args.summary_output)
    if args.command == "make-demo":
        return pack.write_demo(spark, args.output_dir)
    if args.command == "demo":
        return app.demo(spark, args.output_dir, args.permit_mode, settings)
    area = read_area(spark, args.aoi)
    if args.command == "stac-search":
        Path(args.output).write_text(json.dumps({"items": select(area)}, indent=2, ensure_ascii=False), encoding="utf-8")
        return {"output": args.output}
    folder = args.output_dir if args.command == "prepare-pack" else f"{args.work_dir}/pack"
    made = app.prepare_pack(spark, area, load_recipe(args.recipe), select(area), args.scenes, folder)
    add_context(folder)
    return made if args.command == "prepare-pack" else analyzed(folder, f"{args.work_dir}/outputs")


def main(argv: list[str] | None = None) -> None:
    from pyspark.sql import SparkSession

    print(json.dumps(run(SparkSession.builder.appName("georank").getOrCreate(), sys.argv[1:] if argv is None else argv), indent=2, default=str))


if __name__ == "__main__":
    main()
