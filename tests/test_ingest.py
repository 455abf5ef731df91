"""Red-zone import, scene selection, pack preparation and the command line."""

import json
import math
import threading
from http.server import BaseHTTPRequestHandler, ThreadingHTTPServer
from urllib.parse import parse_qsl, urlsplit

import numpy as np
import pytest

from georank import app, cli
from georank.operators import ingest, redzones
from georank.recipe import load_recipe
from georank.sources import pack as packs
from georank.sources import search
from georank.sources.catalog import read_items
from georank.sources.readers import area_of_box, read_zones

RECIPE = """
[target]
resolution_m = 1000.0
[optical]
enabled = true
collection = "scenes"
output_kind = "ndvi"
max_items = 2
sort_by = "eo:cloud_cover"
[[optical.filters]]
property = "eo:cloud_cover"
lte = 25.0
[optical.asset_groups]
red = ["red"]
nir = ["nir08", "nir"]
[dem]
enabled = true
collection = "heights"
[dem.asset_groups]
primary = ["data", "dem"]
"""


def _item(name, collection, cloud, assets, when="2024-06-01T00:00:00Z"):
    return {"id": name, "collection": collection, "bbox": [90.0, 47.0, 90.2, 47.2], "properties": {"datetime": when} | ({"eo:cloud_cover": cloud} if cloud is not None else {}), "assets": assets}


def _bands(name):
    return {"SR_B4": {"href": f"file://{name}/red", "eo:bands": [{"name": "B4", "common_name": "red"}]}, "SR_B5": {"href": f"{name}/nir", "eo:bands": [{"name": "B5", "common_name": "nir"}]}}


@pytest.fixture(scope="module")
def scenes(spark, tmp_path_factory):
    """A catalog, its rasters (red .2, nir .6, heights 1000 to 1100) and a recipe."""
    root = tmp_path_factory.mktemp("scenes")
    items = [_item("cloudy", "scenes", 35, _bands("cloudy")), _item("good", "scenes", 8, _bands("good")), _item("best", "scenes", 2.5, _bands("best")), _item("half", "scenes", 1, {"red": {"href": "x"}}),
             _item("third", "scenes", 9, _bands("third")), _item("unknown", "scenes", None, _bands("unknown")), _item("tile", "heights", None, {"data": {"href": "tile/data"}})]
    (root / "items.jsonl").write_text(json.dumps({"features": items[:4]}) + "\n" + "\n".join(json.dumps(i) for i in items[3:]) + "\n")
    (root / "recipe.toml").write_text(RECIPE)
    grid = packs.Grid("EPSG:4326", 90.0, 47.2, 0.002, 0.002)
    ramp = np.linspace(1000, 1100, 10_000).reshape(100, 100)
    rasters = {f"{n}/{b}": np.full((100, 100), v) for n in ("good", "best") for b, v in (("red", 0.2), ("nir", 0.6))} | {"tile/data": ramp}
    packs.write_blocks(spark.createDataFrame([b for label, a in rasters.items() for b in packs.to_blocks("scene", label, grid, a)], packs.BLOCKS), str(root / "rasters"))
    return root


def test_selection(spark, scenes):
    recipe = load_recipe(str(scenes / "recipe.toml"))
    items = read_items(spark, str(scenes / "items.jsonl"))
    assert items.count() == 7  # an item given twice counts once
    got = app.select_scenes(items, recipe, area_of_box(90.02, 47.02, 90.1, 47.1))
    assert [(i["series"], i["item_id"]) for i in got] == [("optical", "best"), ("optical", "good"), ("dem", "tile")]
    assert got[0]["keys"] == {"red": "SR_B4", "nir": "SR_B5"} and got[0]["found"]["red"] == "best/red"
    assert app.select_scenes(items, recipe, area_of_box(10, 10, 11, 11)) == []


@pytest.fixture
def endpoint():
    """A catalog server of two pages a collection, the last with a link back, and the requests it had."""
    had = []

    class Handler(BaseHTTPRequestHandler):
        def answer(self, body):
            url = urlsplit(self.path)
            query = dict(parse_qsl(url.query))
            had.append((self.command, url.path, body or query, self.headers.get("X-Key")))
            name = body["collections"][0] if body else query["c"]
            first = self.command == "POST"
            clouds = (8, 2.5) if first else (9,)
            assets = _bands if name == "scenes" else lambda n: {"data": {"href": f"{n}/data"}}
            page = {"features": [_item(f"{name}{c}", name, c, assets(f"{name}{c}")) for c in clouds]}
            page["links"] = [{"rel": "self", "href": "x"}, {"rel": "next", "href": "more", "body": {"c": name}}]
            raw = json.dumps(page).encode()
            self.send_response(200)
            self.end_headers()
            self.wfile.write(raw)

        def do_POST(self):
            self.answer(json.loads(self.rfile.read(int(self.headers["Content-Length"]))))

        def do_GET(self):
            self.answer(None)

        def log_message(self, *args):
            pass

    server = ThreadingHTTPServer(("127.0.0.1", 0), Handler)
    threading.Thread(target=server.serve_forever, daemon=True).start()
    yield f"http://127.0.0.1:{server.server_port}/api", had
    server.shutdown()
    server.server_close()


def test_search(spark, endpoint, tmp_path):
    url, had = endpoint
    recipe = tmp_path / "recipe.toml"
    recipe.write_text(f'[stac]\nendpoint = "{url}"\nheaders = {{ X-Key = "k" }}\n' + RECIPE)
    area = area_of_box(90.02, 47.02, 90.1, 47.1)
    items = search.search_items(spark, load_recipe(str(recipe)), area.rings).collect()
    assert sorted(i["item_id"] for i in items) == ["heights2.5", "heights8", "heights9", "scenes2.5", "scenes8", "scenes9"]
    asked = sorted((h[:3] for h in had if h[0] == "POST"), key=repr)
    assert {h[1] for h in asked} == {"/api/search"} and {h[2]["collections"][0] for h in asked} == {"scenes", "heights"}
    assert all(h[2]["limit"] == 50 and h[2]["intersects"]["type"] == "Polygon" and h[2]["intersects"]["coordinates"][0][0] == h[2]["intersects"]["coordinates"][0][-1] for h in asked)
    assert {h[1] for h in had if h[0] == "GET"} == {"/api/more"} and {h[3] for h in had} == {"k"}
    assert all(sum(h[0] == "GET" and h[2] == {"c": c} for h in had) == sum(h[0] == "POST" and h[2]["collections"] == [c] for h in had) for c in ("scenes", "heights"))  # a link followed before ends a search
    aoi = tmp_path / "aoi.geojson"
    aoi.write_text(json.dumps({"type": "Polygon", "coordinates": [[[90.02, 47.02], [90.1, 47.02], [90.1, 47.1], [90.02, 47.1], [90.02, 47.02]]]}))
    cli.run(spark, ["stac-search", "--aoi", str(aoi), "--recipe", str(recipe), "--output", str(tmp_path / "m.json")])
    assert [i["item_id"] for i in json.loads((tmp_path / "m.json").read_text())["items"]][:2] == ["scenes2.5", "scenes8"]
    nothing = tmp_path / "nothing.toml"
    nothing.write_text(f'[stac]\nendpoint = "{url}"\n')
    assert search.search_items(spark, load_recipe(str(nothing)), area.rings).count() == 0


def test_pages_of_a_search():
    """At most max_pages; a next link without href is passed over; of links followed before the next one counts."""
    links = [{"rel": "next"}, {"rel": "next", "href": "b"}, {"rel": "next", "href": "c", "method": "post", "body": {"x": 1}}]
    had = []

    def ask(*step):
        had.append(step)
        return {"links": links}

    assert len(list(search.follow("http://h/a", {"q": 1}, 10, ask))) == 3
    assert had == [("POST", "http://h/a", {"q": 1}, {}), ("GET", "http://h/b", None, {}), ("POST", "http://h/c", {"x": 1}, {})]
    assert len(list(search.follow("http://h/a", {}, 2, ask))) == 2
    with pytest.raises(ValueError):
        search.send("GET", "file:///etc/hosts", None, {}, 1)


def test_recipe_errors(tmp_path):
    p = tmp_path / "r.toml"
    for text, error in (("[optical]\nnope = 1\n", TypeError), ('[sar]\nresampling = "best"\n', ValueError), ("[target]\nresolution_m = 0\n", ValueError), ("[[dem.filters]]\nproperty = 'a'\nlike = 3\n", TypeError)):
        p.write_text(text)
        with pytest.raises(error):
            load_recipe(str(p))


def test_pack_preparation(spark, scenes, tmp_path):
    recipe = load_recipe(str(scenes / "recipe.toml"))
    area = area_of_box(90.02, 47.02, 90.1, 47.1)
    selected = app.select_scenes(read_items(spark, str(scenes / "items.jsonl")), recipe, area)
    made = app.prepare_pack(spark, area, recipe, selected, str(scenes / "rasters"), str(tmp_path / "pack"))
    assert made["outputs"]["optical"] == ["2024-06-01_best", "2024-06-01_good"] and made["outputs"]["target_grid"]["crs"] == "EPSG:32646"
    layers = {r["label"]: np.frombuffer(r["data"], "<f4").reshape(r["h"], r["w"]) for r in packs.read_blocks(spark, str(tmp_path / "pack")).collect()}
    ndvi = layers["2024-06-01_best"]
    assert np.isfinite(ndvi).sum() >= 30 and ndvi[np.isfinite(ndvi)] == pytest.approx(0.5, abs=1e-6)
    dem = layers["dem"]
    grid, height, width = ingest.target_grid(area, 1000.0)
    from georank.functions.geo import inverse_arrays

    for r in range(height):
        for c in range(width):
            if np.isfinite(dem[r, c]):
                lat, lon = inverse_arrays(np.array(grid.left + (c + 0.5) * 1000), np.array(grid.top - (r + 0.5) * 1000), 46, False)
                row, col = (47.2 - lat) / 0.002 - 0.5, (lon - 90.0) / 0.002 - 0.5
                assert dem[r, c] == pytest.approx(1000 + (row * 100 + col) * 100 / 9999, abs=1e-2)
    assert set(np.unique(layers["quality"])) <= {0.0, 1.0}
    with pytest.raises(ValueError):
        app.prepare_pack(spark, area, recipe, selected[:2], str(scenes / "rasters"), str(tmp_path / "none"))


def test_item_labels(scenes):
    from dataclasses import replace

    recipe = load_recipe(str(scenes / "recipe.toml"))
    items = [{"series": "optical", "item_id": "a b/c", "datetime": "2024-06-01T10:00:00Z"}, {"series": "optical", "item_id": "x", "datetime": None}, {"series": "dem", "item_id": "///", "datetime": None}]
    assert ingest.item_labels(items, recipe) == ["2024-06-01_a_b_c", "item-2_x", "item-1_item"]
    numbered = replace(recipe, series=recipe.series | {"optical": replace(recipe.series["optical"], filename_template="{index}.tiff")})
    assert ingest.item_labels(items[:2], numbered) == ["1", "2"]
    with pytest.raises(ValueError):
        ingest.item_labels([items[0], items[0]], recipe)


def test_resampling():
    a = np.add.outer(np.arange(20.0) * 3, np.arange(20.0))
    row, col = np.array([5.5, 7.25, 9.0]), np.array([4.5, 6.75, 3.0])
    plane = (row - 0.5) * 3 + col - 0.5
    for how in ("bilinear", "cubic"):
        assert ingest.resample(a, row, col, how) == pytest.approx(plane)
    assert ingest.resample(a, row[:1], col[:1], "nearest").tolist() == [5 * 3 + 4] and ingest.resample(a, row[:1], col[:1], "average", 3.0) == pytest.approx(plane[:1])
    assert np.isnan(ingest.resample(a, np.array([-1.0]), np.array([3.0]), "bilinear")).all()
    a[5, 4] = np.nan
    assert np.isfinite(ingest.resample(a, np.array([5.9]), np.array([4.6]), "bilinear")).all()


def test_areas_and_shapes():
    square = [(0.0, 0.0), (10.0, 0.0), (10.0, 10.0), (0.0, 10.0)]
    moved = [(x + 5, y + 5) for x, y in square]
    hole = [(2.0, 2.0), (4.0, 2.0), (4.0, 4.0), (2.0, 4.0)]
    assert redzones.union_area([[square]]) == pytest.approx(100) and redzones.union_area([[square], [moved]]) == pytest.approx(175) and redzones.union_area([[square, hole]]) == pytest.approx(96)
    assert redzones.union_area([[redzones.circle(0, 0, 100)]]) == pytest.approx(math.pi * 1e4, rel=2e-3)
    assert redzones.union_area([[redzones.capsule((0, 0), (300, 400), 50)]]) == pytest.approx(500 * 100 + math.pi * 2500, rel=2e-3)
    bumpy = [(0.0, 0.0), (5.0, 0.1), (10.0, 0.0), (10.0, 10.0), (5.0, 9.95), (0.0, 10.0)]
    assert sorted(redzones.simplify(bumpy, 0.5)) == sorted(square)


@pytest.fixture(scope="module")
def raw_zones(tmp_path_factory):
    box = lambda w, s, e, n: {"type": "Polygon", "coordinates": [[[w, s], [e, s], [e, n], [w, n], [w, s]]]}
    rows = [({"title": "One", "kind": "protected"}, box(90, 47, 90.01, 47.01)), ({"title": " ", "kind": "Protected "}, {"type": "Point", "coordinates": [90.02, 47.0, 1500.0]}), ({"title": "Other", "kind": "restricted"}, box(91, 47, 91.1, 47.1)), ({}, None)]
    path = tmp_path_factory.mktemp("zones") / "raw.geojson"
    path.write_text(json.dumps({"type": "FeatureCollection", "features": [{"type": "Feature", "properties": p, "geometry": g} for p, g in rows]}))
    return path


def test_red_zone_import(spark, raw_zones, tmp_path):
    options = redzones.Options(name_field="title", category_field="kind", include=("protected",), point_buffer_m=250, dissolve_by="all")
    counts = app.import_red_zones(spark, str(raw_zones), str(tmp_path / "out.geojson"), options, str(tmp_path / "summary.json"))
    assert (counts["input_features"], counts["kept_features"], counts["output_features"]) == (4, 2, 1)
    (feature,) = json.load(open(tmp_path / "out.geojson"))["features"]
    assert feature["properties"] == {"name": "One", "category": "protected", "source_count": 2, "source_names": ["One", "red-zone-2"]}
    zones = read_zones(spark, str(tmp_path / "out.geojson")).first()
    assert zones["max_lon"] == pytest.approx(90.02 + 250 / (111_320 * math.cos(math.radians(47))), abs=1e-4) and zones["edges"]
    with pytest.raises(ValueError):
        app.import_red_zones(spark, str(raw_zones), str(tmp_path / "no.geojson"), redzones.Options(category_field="kind", include=("none",)))
    big = app.import_red_zones(spark, str(raw_zones), str(tmp_path / "big.geojson"), redzones.Options(min_area_ha=1000, buffer_m=10))
    assert big["kept_features"] == 1


def test_commands(spark, scenes, raw_zones, tmp_path):
    rows = [{"candidate_id": "a", "lat": 47.0, "lon": 91.0, "landscape": "steppe", "optical_anomaly": True, "sar_anomaly": "0.5"}, {"candidate_id": "b", "lat": 48.2, "lon": 90.2, "sensitivity": "normal"}]
    (tmp_path / "in.json").write_text(json.dumps(rows))
    cli.run(spark, [str(tmp_path / "in.json"), str(tmp_path / "ranked"), "--use-demo-red-zones"])
    got = [json.loads(r["value"]) for r in spark.read.text(str(tmp_path / "ranked")).collect()]
    assert [r["candidate_id"] for r in got] == ["a"] and got[0]["raw_score"] == round((0.9 + 0.6 * 0.5) / 7.5, 4)
    made = cli.run(spark, ["make-demo", str(tmp_path / "demo")])
    files = cli.run(spark, ["analyze", "--aoi", made["aoi"], "--data-pack", made["pack"], "--output-dir", str(tmp_path / "out"), "--red-zones-geojson", made["red_zones"], "--max-candidates", "5"])
    assert len(files) == 8 and 0 < len(json.load(open(files["ranked_candidates.json"]))) <= 5
    assert cli.run(spark, ["build-context", "--data-pack", made["pack"]])["created"] == []
    aoi = tmp_path / "aoi.geojson"
    aoi.write_text(json.dumps({"type": "Polygon", "coordinates": [[[90.02, 47.02], [90.1, 47.02], [90.1, 47.1], [90.02, 47.1], [90.02, 47.02]]]}))
    common = ["--aoi", str(aoi), "--recipe", str(scenes / "recipe.toml")]
    cli.run(spark, ["stac-search", *common, "--catalog", str(scenes / "items.jsonl"), "--output", str(tmp_path / "m.json")])
    pack = cli.run(spark, ["prepare-pack", *common, "--scenes", str(scenes / "rasters"), "--selection-manifest", str(tmp_path / "m.json"), "--output-dir", str(tmp_path / "pack")])
    assert pack["outputs"]["dem"] == ["dem"] and {x[0] for x in packs.catalog(spark, str(tmp_path / "pack"))} >= {"forest", "water_proximity", "confounder", "disturbance"}
    out = cli.run(spark, ["import-red-zones", "--input", str(raw_zones), "--output", str(tmp_path / "z.geojson"), "--name-field", "title"])
    assert out["output_features"] == 3
    with pytest.raises(SystemExit):
        cli.run(spark, ["stac-search", *common, "--output", str(tmp_path / "m2.json")])
