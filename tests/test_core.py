"""The engine against recorded results, the SQL of its queries and brute force."""

import json
import math

import duckdb
import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from georank.operators import cluster, kernels, rank, tiles, zones
from georank.plans.queries import QUERIES, SQL
from georank.settings import Settings, load_settings
from georank.sinks.writers import features, write_bundle
from georank.sources.readers import demo_zones, read_candidates, read_zones

DATA = "/root/testdata/sf0.001"
#: Place, landscape, sensitivity, evidence and expected public scores of the recorded sample.
SAMPLE = [
    ("tile-001", 47.125, 91.875, "steppe", "normal", [.62, .44, .81, .73, .41, .77, .58, .85, .12, .18, .93]),
    ("tile-002", 48.150, 90.150, "mountain", "restricted", [.55, .63, .57, .32, .48, .71, .35, .52, .28, .49, .76]),
    ("tile-003", 46.680, 95.400, "valley", "sensitive", [.68, .49, .44, .52, .81, .73, .66, .79, .10, .16, .89]),
]


@pytest.fixture(scope="module")
def sample(spark, tmp_path_factory):
    from georank.functions.scoring import EVIDENCE

    rows = [{"candidate_id": i, "lat": a, "lon": o, "landscape": l, "sensitivity": s, **dict(zip(EVIDENCE, e)), "tags": ["t"]} for i, a, o, l, s, e in SAMPLE]
    path = tmp_path_factory.mktemp("in") / "sample.json"
    path.write_text(json.dumps(rows))
    return read_candidates(spark, str(path))


def test_sample_ranks_as_recorded(spark, sample):
    got = rank.ordered(rank.rank(sample)).collect()
    assert [(r["candidate_id"], r["raw_score"], r["adjusted_score"], r["confidence"]) for r in got] == [("tile-001", 0.6661, 0.5757, "medium"), ("tile-002", 0.5327, 0.2465, "very-low")]
    assert got[0]["exact_location"] is None
    assert got[0]["public_location"]["lat"] == pytest.approx(47.16991555874955, abs=1e-12)
    assert got[0]["public_location"]["lon"] == pytest.approx(91.80898665288095, abs=1e-9)
    assert got[0]["reasons"][0] == "microrelief signal is strong" and len(got[0]["reasons"]) == 4
    assert [r["candidate_id"] for r in rank.rank(sample, "public", demo_zones(spark)).collect()] == ["tile-001"]
    assert rank.rank(sample, "authorized").where("exact_location is null").count() == 0


def test_bundle_and_geojson(sample, tmp_path):
    ranked = rank.rank(sample)
    comp = sample.select("seq", "candidate_id", "landscape", "lat", "lon", "tags").join(ranked.select("seq", "adjusted_score", "sensitivity", "reasons"), "seq").withColumn("component", sample["seq"].cast("long"))
    files = write_bundle(str(tmp_path), "public", ranked, cluster.summarize(comp), 3, 2)
    counts = json.loads(open(files["summary.json"]).read())
    assert counts["ranked_candidates"] == 2 and counts["largest_cluster"] == 1
    assert features(ranked).count() == 2


def test_bundle_writes_all_rows(spark, sample, tmp_path):
    many = spark.range(600).withColumnRenamed("id", "copy")
    ranked = rank.rank(sample).crossJoin(many).withColumn("seq", F.col("copy")).drop("copy")
    clusters = spark.createDataFrame([(f"c{i}", 0.5, i, i, 1, "low", ["r"]) for i in range(600)], "cluster_id string, cluster_score double, first_seq long, component long, member_count int, confidence string, reasons array<string>")
    files = write_bundle(str(tmp_path), "public", ranked, clusters, 3, 2)
    n = ranked.count()
    assert n > 500 and json.loads(open(files["summary.json"]).read())["ranked_candidates"] == n
    assert len(json.load(open(files["ranked.json"]))) == n == len(json.load(open(files["ranked.geojson"]))["features"]) and len(json.load(open(files["clusters.json"]))) == 600


def test_zones_keep_numbers_of_all_features(spark, tmp_path):
    box = {"type": "Polygon", "coordinates": [[[90, 47], [90.5, 47], [90.5, 47.5], [90, 47]]]}
    fc = {"type": "FeatureCollection", "features": [{"geometry": None, "properties": {}}, {"geometry": box, "properties": {}}, {"geometry": box, "properties": {"name": " a "}}]}
    p = tmp_path / "z.geojson"
    p.write_text(json.dumps(fc))
    got = read_zones(spark, str(p)).orderBy("zone_ord").collect()
    assert [r["name"] for r in got] == ["red-zone-2", "a"] and got[0]["max_lat"] == 47.5


def test_polygon_zones(spark, tmp_path):
    triangle = [[90, 47], [91, 47], [90, 48], [90, 47]]
    frame = [[[92, 47], [93, 47], [93, 48], [92, 48], [92, 47]], [[92.25, 47.25], [92.75, 47.25], [92.75, 47.75], [92.25, 47.75], [92.25, 47.25]]]
    far = [[[94, 47], [94.5, 47], [94.5, 47.5], [94, 47]]]
    kinds = [("Polygon", [triangle]), ("MultiPolygon", [frame, far])]
    p = tmp_path / "polygons.geojson"
    p.write_text(json.dumps({"type": "FeatureCollection", "features": [{"type": "Feature", "geometry": {"type": k, "coordinates": c}, "properties": {"name": k}} for k, c in kinds]}))
    got = read_zones(spark, str(p))
    points = [(0, 47.2, 90.2), (1, 47.8, 90.8), (2, 47.1, 92.1), (3, 47.5, 92.5), (4, 47.1, 94.4), (5, 47.4, 94.1), (6, 47.51, 90.5), (7, 47.5, 92.745)]
    df = spark.createDataFrame([(*x, "steppe", "normal") for x in points], "seq long, lat double, lon double, landscape string, sensitivity string")
    inside = {0, 2, 4}
    assert {r["seq"] for r in zones.inside_any(df, got).collect()} == inside
    assert {r["seq"] for r in zones.outside_all(df, got).collect()} == set(range(8)) - inside
    assert {r["seq"] for r in rank.drop_withheld(df, "public", got, Settings()).collect()} == set(range(8)) - inside
    tagged = {r["seq"]: r["zone_names"] for r in zones.tag(df, got, half=0.01).collect()}
    assert {k for k, v in tagged.items() if v} == inside | {6, 7} and tagged[7] == ["MultiPolygon"]


def test_settings(tmp_path):
    p = tmp_path / "s.toml"
    p.write_text("[analysis]\nmax_candidates = 7\n")
    assert load_settings(str(p)).analysis.max_candidates == 7 and load_settings().guardrails.public_blur_m == 5000
    p.write_text("[analysis]\nnope = 7\n")
    with pytest.raises(TypeError):
        load_settings(str(p))


def test_top_rejects_negative(sample):
    with pytest.raises(ValueError):
        rank.top(rank.rank(sample), -1)


def _utm(lat, lon):
    from georank.functions import geo

    zone = math.floor((lon + 180) / 6) + 1
    phi, lam = math.radians(lat), math.radians(lon - (zone * 6 - 183))
    t = math.sinh(math.atanh(math.sin(phi)) - geo._E * math.atanh(geo._E * math.sin(phi)))
    xi, eta = math.atan2(t, math.cos(lam)), math.asinh(math.sin(lam) / math.hypot(t, math.cos(lam)))
    x = eta + sum(a * math.cos(2 * j * xi) * math.sinh(2 * j * eta) for j, a in enumerate(geo._ALPHA, 1))
    y = xi + sum(a * math.sin(2 * j * xi) * math.cosh(2 * j * eta) for j, a in enumerate(geo._ALPHA, 1))
    return 500000 + 0.9996 * geo._RADIUS * x, 0.9996 * geo._RADIUS * y


@pytest.mark.parametrize(("box", "size", "step", "n"), [((90, 47, 90.12, 47.12), 500, 500, 512), ((91.001, 47.001, 91.031, 47.031), 500, 500, 35), ((91.001, 47.001, 91.031, 47.031), 500, 250, 124)])
def test_tile_counts_as_recorded(spark, box, size, step, n):
    a, b, c, d = box
    ring = [_utm(y, x) for x, y in ((a, b), (c, b), (c, d), (a, d))]
    assert tiles.tile_aoi(spark, ring, size, step).count() == n


def test_components_match_brute_force(spark):
    rng = np.random.default_rng(3)
    points = [(i, float(x), float(y)) for i, (x, y) in enumerate(rng.uniform(0, 1000, (120, 2)))]
    df = spark.createDataFrame(points, "seq long, x double, y double")
    pairs = cluster.distance_pairs(df, 70)
    want = {(i, j) for i, a, b in points for j, c, d in points if i < j and math.hypot(a - c, b - d) <= 70}
    assert {(r["a"], r["b"]) for r in pairs.collect()} == want
    root = list(range(len(points)))
    for _ in points:
        for i, j in want:
            root[i] = root[j] = min(root[i], root[j])
    assert {r["seq"]: r["component"] for r in cluster.connected_components(df, pairs).collect()} == dict(enumerate(root))


@settings(max_examples=30, deadline=None)
@given(st.integers(2, 9), st.integers(2, 9), st.integers(0, 10**6))
def test_kernels_by_brute_force(h, w, seed):
    rng = np.random.default_rng(seed)
    m = rng.random((h, w)) < 0.4
    cells = list(zip(*np.nonzero(m)))
    far = kernels.distance(m)
    for r in range(h):
        for c in range(w):
            want = min((math.hypot(r - a, c - b) for a, b in cells), default=math.inf)
            assert far[r, c] == pytest.approx(want)
    regions = kernels.label(m)
    for a in cells:
        for b in cells:
            if max(abs(a[0] - b[0]), abs(a[1] - b[1])) == 1:
                assert regions[a] == regions[b]
    assert (regions > 0).tolist() == m.tolist()
    assert kernels.gaussian(np.full((h, w), 2.0), 1.0) == pytest.approx(np.full((h, w), 2.0))


def test_stream_ranks_like_batch(spark, sample, tmp_path):
    from georank.streaming.rank_stream import rank_stream

    sample.write.parquet(str(tmp_path / "in"))
    stream = spark.readStream.schema(sample.schema).parquet(str(tmp_path / "in"))
    rank_stream(stream, str(tmp_path / "out"), str(tmp_path / "state")).awaitTermination()
    got = spark.read.parquet(str(tmp_path / "out")).select("candidate_id", "adjusted_score")
    assert sorted(got.collect()) == sorted(rank.rank(sample).select("candidate_id", "adjusted_score").collect())


def _same(v):
    return float(f"{v:.9g}") if isinstance(v, float) else v


@pytest.mark.parametrize("name", sorted(SQL))
def test_query_equals_its_sql(spark, name):
    con = duckdb.connect()
    for t in ("part", "lineitem", "orders", "events", "embeddings", "pages"):
        con.execute(f"create view {t} as select * from '{DATA}/{t}.parquet'")
    df = QUERIES[name](spark, DATA)
    result = con.execute(SQL[name])
    cols = [c[0] for c in result.description]
    assert sorted(cols) == sorted(df.columns)
    want = sorted((tuple(_same(v) for v in r) for r in result.fetchall()), key=repr)
    assert sorted((tuple(_same(v) for v in r) for r in df.select(*[f"`{c}`" for c in cols]).collect()), key=repr) == want


def _arc(n, radius, shift):
    return [(radius * math.cos(t + shift), radius * math.sin(t + shift)) for t in np.linspace(-0.2, 0.2, n)]


@pytest.mark.parametrize("kind", ["even", "clumps", "arcs", "arcs_apart"])
def test_components_within_by_brute_force(spark, kind):
    rng = np.random.default_rng(5)
    places = {
        "even": rng.uniform(-500, 500, (250, 2)), "clumps": np.repeat(rng.uniform(-300, 300, (40, 2)), 12, axis=0) + rng.normal(0, 12, (480, 2)),
        # Arcs a step or hardly more apart: only few of their points, or none, are near the other's.
        "arcs": _arc(300, 1000, 0) + _arc(300, 1070 + 9e-7, 0.0003), "arcs_apart": _arc(300, 1000, 0) + _arc(300, 1070.001, 0),
    }[kind]
    places = [(float(x), float(y)) for x, y in places]
    places += [places[0], (None, 1.0), (None, 1.0), (float("nan"), 0.0), (0.0, float("inf")), (5000.0, 5000.0), (5070.0, 5000.0), (5140.1, 5000.0)]
    near = lambda p, q: None not in (*p, *q) and math.hypot(p[0] - q[0], p[1] - q[1]) <= 70 + 1e-6
    root = list(range(len(places)))

    def top(i):
        while root[i] != i:
            i = root[i]
        return i

    for i, p in enumerate(places):
        for j in range(i):
            if near(p, places[j]):
                a, b = sorted((top(i), top(j)))
                root[b] = a
    df = spark.createDataFrame([(i, *p) for i, p in enumerate(places)], "seq long, x double, y double")
    assert {r["seq"]: r["component"] for r in cluster.components_within(df, 70).collect()} == {i: top(i) for i in range(len(root))}


def test_meets_by_brute_force():
    rng = np.random.default_rng(8)
    for gap in (0.0, 30.0, 69.0, 70.5, 90.0):
        one, two = rng.uniform(0, 60, (900, 2)), rng.uniform(0, 60, (700, 2)) + [60 + gap, 0]
        least = np.hypot(one[:, None, 0] - two[None, :, 0], one[:, None, 1] - two[None, :, 1]).min()
        assert all(cluster.meets(one, two, r) == (least <= r) for r in (least, least - 1e-9, least + 1e-9, 70.0))


def test_components_of_one_place_make_no_pairs(spark):
    df = spark.range(200_000).select(F.col("id").alias("seq"), (F.col("id") % 997 / 10).alias("x"), (F.col("id") % 991 / 10).alias("y"))
    assert cluster.components_within(df, 180).groupBy("component").count().collect() == [(0, 200_000)]


def test_utm_beyond_180(spark):
    from georank.functions import geo

    places = [(47.1, 186.5, -173.5), (47.1, 288.0, -72.0), (-30.0, 359.9, -0.1), (47.1, -190.0, 170.0), (10.0, 180.0, 180.0), (90.0, 200.0, -160.0), (-90.0, 12.0, 12.0)]
    df = spark.createDataFrame(places, "lat double, lon double, same double")
    got = df.select("lat", "same", *geo.utm_forward(F.col("lat"), F.col("lon")), *geo.utm_forward(F.col("lat"), F.col("same"))).collect()
    for lat, lon, *xy in got:
        zone = min(math.floor((lon + 180) / 6) + 1, 60)
        want = geo.project(lat, lon, zone) if abs(lat) < 90 else xy[2:]
        assert all(math.isfinite(v) for v in xy) and np.allclose(xy[:2], xy[2:], atol=1e-6) and np.allclose(xy[:2], want, atol=1e-6)


def test_utm_halves_as_in_sql(spark):
    from georank.functions import geo

    # Places of parts 163391 and 236671, whose northing ends in half a millimetre but for the last bits.
    df = spark.createDataFrame([(47 + k % 40 * 0.0045, 90 + k // 40 * 0.0066) for k in (163391, 236671)], "lat double, lon double")
    assert [r["n"] for r in df.select(F.round(geo.utm_forward(F.col("lat"), F.col("lon"))[1], 3).alias("n")).collect()] == [5220667.438] * 2
