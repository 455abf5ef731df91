"""The analysis from a raster pack to its artefacts, on the demo pack, and its parts by brute force."""

import json
import math
import re
from pathlib import Path

import numpy as np
import pytest
from pyspark.sql import functions as F

from georank import app
from georank.functions import geo
from georank.operators import cluster, context, kernels
from georank.operators.tile_features import evidence
from georank.settings import FeatureEngine, Settings
from georank.sinks.writers import write_analysis
from georank.sources import pack as packs
from georank.sources.readers import area_of_box, read_area, read_zones


@pytest.fixture(scope="module")
def demo(spark, tmp_path_factory):
    return packs.write_demo(spark, str(tmp_path_factory.mktemp("demo")))


@pytest.fixture(scope="module")
def runs(spark, demo, tmp_path_factory):
    area, red = read_area(spark, demo["aoi"]), read_zones(spark, demo["red_zones"])
    out = {}
    for mode in ("public", "authorized"):
        result = app.analyze(spark, area, demo["pack"], mode, red, tile_size_m=500, tile_step_m=250)
        out[mode] = result, write_analysis(str(tmp_path_factory.mktemp(mode)), result, area, red)
    return out


def test_inverse_utm(spark):
    places = [(lat, lon) for lat in (-55.0, -3.2, 0.5, 47.05, 71.9) for lon in (87.1, 90.0, 92.8)]
    df = spark.createDataFrame([(*geo.project(a, o, 46), a, o) for a, o in places], "e double, n double, lat double, lon double")
    for south in (False, True):
        lat, lon = geo.utm_inverse(F.col("e"), F.col("n"), 46, south)
        for r in df.where("lat < 0" if south else "lat >= 0").select(lat.alias("a"), lon.alias("o"), "lat", "lon").collect():
            assert r["a"] == pytest.approx(r["lat"], abs=1e-9) and r["o"] == pytest.approx(r["lon"], abs=1e-9)


def test_public_run(runs):
    result, files = runs["public"]
    assert result.total_tiles == 124 and 0 < result.processed_tiles <= 124
    ranked = json.load(open(files["ranked_candidates.json"]))
    assert ranked and ranked[0]["adjusted_score"] >= 0.3 and all(r["exact_location"] is None and r["sensitivity"] != "sensitive" for r in ranked)
    shapes = json.load(open(files["ranked_candidates.geojson"]))["features"]
    assert len(shapes) == len(ranked) and {s["geometry"]["type"] for s in shapes} == {"Point"}
    clusters = json.load(open(files["ranked_clusters.json"]))
    assert 0 < len(clusters) < len(ranked) and clusters[0]["member_count"] >= 2
    counts = json.load(open(files["analysis_summary.json"]))
    assert counts["ranked_candidates"] == len(ranked) and counts["top_cluster_id"] == clusters[0]["cluster_id"]
    raw = json.load(open(files["raw_candidates.json"]))
    assert [r["candidate_id"] for r in raw] == [r["candidate_id"] for r in ranked] and {r["location_mode"] for r in raw} == {"redacted"} and set(raw[0]["metrics"]) == {"median_slope_deg", "slope_p90_deg", "terrain_ruggedness_risk", "water_proximity_mean"}


def test_no_public_artefact_has_an_exact_place(runs):
    result, files = runs["public"]
    exact = [(r["lat"], r["lon"]) for r in result.records.collect()]
    exact += [(c["lat"], c["lon"]) for r in result.records.collect() for c in r["corners"]]
    shown = set()
    for name, path in files.items():
        if name != "analysis_report.md":  # it gives the area's own centre
            shown |= {float(x) for x in re.findall(r"-?\d+\.\d{3,}", Path(path).read_text())}
    shown = sorted(shown)
    lats = np.array([x for x in shown if 40 < x < 60])
    assert len(lats) and min(np.abs(lats - a).min() for a, _ in exact) > 1e-7


def test_authorized_run(runs, demo, spark):
    result, files = runs["authorized"]
    ranked = json.load(open(files["ranked_candidates.json"]))
    assert any(r["sensitivity"] == "sensitive" for r in ranked) and all(r["exact_location"] for r in ranked)
    for name in ("ranked_candidates.geojson", "ranked_clusters.geojson"):
        assert {s["geometry"]["type"] for s in json.load(open(files[name]))["features"]} == {"MultiPolygon"}
    page = Path(files["review_map.html"]).read_text()
    assert "demo-sensitive-zone" in page and "demo-sensitive-zone" not in Path(runs["public"][1]["review_map.html"]).read_text() and page.count('class="candidate"') == len(ranked)
    assert "## Top clusters" in Path(files["analysis_report.md"]).read_text()


def test_features_of_a_tile_by_hand(runs, demo):
    """A tile's evidence from the whole rasters, cut in plain Python."""
    result, _ = runs["public"]
    west, south, east, north = packs.DEMO_BOUNDS
    step, layers = (east - west) / packs.DEMO_CELLS, packs.demo_layers()
    for t in result.records.orderBy("seq").collect()[5::29]:
        xs = [(c["lon"] - west) / step for c in t["corners"]]
        ys = [(north - c["lat"]) / step for c in t["corners"]]
        r0, r1, c0, c1 = max(math.floor(min(ys)), 0), min(math.ceil(max(ys)), 128), max(math.floor(min(xs)), 0), min(math.ceil(max(xs)), 128)

        def inside(r, c):
            x, y, odd = c + 0.5, r + 0.5, False
            for i in range(4):
                if (ys[i] > y) != (ys[i - 1] > y) and x < (xs[i - 1] - xs[i]) * (y - ys[i]) / (ys[i - 1] - ys[i]) + xs[i]:
                    odd = not odd
            return odd

        keep = np.array([[inside(r, c) for c in range(c0, c1)] for r in range(r0, r1)])
        cut = {k: np.where(keep, v.astype("float32").astype(float)[r0:r1, c0:c1], np.nan) for k, v in layers.items()}
        series = {s: [a for (kind, _), a in sorted(cut.items()) if kind == s] for s in packs.SERIES}
        single = {kind: a for (kind, _), a in cut.items() if kind not in packs.SERIES}
        metres = (step * 111320 * math.cos(math.radians(t["lat"])), step * 111320)
        want = evidence(series, single, metres, FeatureEngine())
        for name, value in want.items():
            assert t[name] == (pytest.approx(value, abs=1e-6) if not isinstance(value, (str, list)) else value), name


def test_context_layers(spark, demo, tmp_path):
    folder = str(tmp_path / "pack")
    blocks = packs.read_blocks(spark, demo["pack"])
    packs.write_blocks(blocks.where(F.col("kind").isin("dem", *packs.SERIES)), folder)
    made = app.build_context(spark, folder)
    assert made["created"] == sorted(context.LAYERS) and not made["reused"]
    again = app.build_context(spark, folder)
    assert not again["created"] and again["reused"] == list(context.LAYERS)
    assert app.build_context(spark, folder, overwrite=True)["created"] == sorted(context.LAYERS)
    assert packs.manifest(spark, folder)["outputs"]["forest"] == "blocks/kind=forest"
    for r in packs.read_blocks(spark, folder).where(F.col("kind").isin(*context.LAYERS)).collect():
        a = np.frombuffer(r["data"], "<f4")
        assert np.isfinite(a).all() and a.min() >= 0 and a.max() <= 1
    result = app.analyze(spark, area_of_box(91.001, 47.001, 91.031, 47.031), folder)
    assert result.ranked.count() > 0
    with pytest.raises(FileNotFoundError):
        packs.catalog(spark, str(tmp_path / "none"))
    packs.write_blocks(blocks.where("kind = 'dem'"), str(tmp_path / "dem"))
    with pytest.raises(ValueError):
        app.analyze(spark, area_of_box(91.001, 47.001, 91.031, 47.031), str(tmp_path / "dem"))


def test_union_area(spark):
    rng = np.random.default_rng(2)
    squares = [(int(c), float(x), float(y)) for c, x, y in zip(rng.integers(0, 4, 60), rng.integers(0, 40, 60) * 50, rng.integers(0, 40, 60) * 50)]
    got = {r["component"]: r["area_ha"] for r in cluster.union_area_ha(spark.createDataFrame(squares, "component long, x double, y double"), 300, 50).collect()}
    for k in got:
        cells = {(int(x // 50) + i, int(y // 50) + j) for c, x, y in squares if c == k for i in range(6) for j in range(6)}
        assert got[k] == pytest.approx(len(cells) * 0.25)


def test_kernels_on_known_shapes():
    flat = np.zeros((40, 40))
    assert kernels.mean_probability(np.full((3, 3), 0.5)) is None and kernels.mean_probability(np.full((4, 4), 0.5)) == 0.5
    assert kernels.valid_fraction(np.array([[1.0, np.nan]])) == 0.5 and kernels.common_shape([flat, np.zeros((0, 0)), np.zeros((3, 50))]) == (3, 40)
    slope = np.add.outer(np.arange(40.0) * 2, np.arange(40.0) * 0)
    assert kernels.gradient_magnitude(slope, 1.0)[10:30, 10:30] == pytest.approx(np.full((20, 20), 2.0), abs=1e-6)
    assert np.abs(kernels.laplace(slope, 1.0)[10:30]).max() < 1e-6 and kernels.local_variance(flat, 2.0).max() == 0
    line = flat.copy()
    line[20] = 1
    assert kernels.line_cells(line, 1.0, 8).sum() > 30
    micro, rugged, median, steep = kernels.terrain(slope * 10, 10.0, 10.0)
    assert median == pytest.approx(math.degrees(math.atan(2.0))) and steep == pytest.approx(median) and 0 <= rugged <= 1
    assert kernels.historical_match(line > 0, [], 2, 0.85) == 0.0


def test_settings_reach_the_kernels(tmp_path):
    from georank.settings import load_settings

    p = tmp_path / "s.toml"
    p.write_text("[feature_engine]\nanomaly_sigma_px = 5.0\n[context_layers]\nforest_threshold = 0.2\n")
    s = load_settings(str(p))
    assert s.feature_engine.anomaly_sigma_px == 5 and s.context_layers.forest_threshold == 0.2 and Settings().feature_engine.mask_quantile == 0.85
    p.write_text("[features]\nx = 1\n")
    with pytest.raises(TypeError):
        load_settings(str(p))
