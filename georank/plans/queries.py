"""The engine's queries over the fixture views, each with the SQL that must give the same rows."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from georank.functions import geo, scoring, text
from georank.operators import cluster, kernels, rank, raster, select_items, tiles, zones
from georank.plans import fixtures as fx
from georank.settings import Settings

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
SQL: dict[str, str] = {}


def query(name: str, sql: str | None = None):
    def register(f):
        QUERIES[name] = f
        if sql:
            SQL[name] = sql
        return f

    return register


def _ranked_sql(metres: float | None, where: str) -> str:
    place = "lat AS public_lat, lon AS public_lon" if metres is None else (
        f"round(lat + {metres / 111320.0!r}::DOUBLE, 9) AS public_lat, round(lon - {metres}::DOUBLE / (111320.0::DOUBLE * greatest(cos(radians(lat)), 0.1::DOUBLE)), 9) AS public_lon"
    )
    return f"""WITH {fx.SCORED}, {fx.ZONES_SQL}
SELECT candidate_id, round(raw, 4) AS raw_score, round(adjusted, 4) AS adjusted_score, {fx.BAND} AS confidence, {place}, {"lat" if metres is None else "NULL::DOUBLE"} AS exact_lat
FROM scored s WHERE {where}"""


_FREE = "NOT EXISTS (SELECT 1 FROM zones z WHERE s.lat BETWEEN z.min_lat AND z.max_lat AND s.lon BETWEEN z.min_lon AND z.max_lon) AND sensitivity <> 'sensitive'"


def _ranked(spark: SparkSession, sf_dir: str, mode: str) -> DataFrame:
    out = rank.rank(fx.candidates(spark, sf_dir), mode, fx.zone_boxes(spark))
    digits = (lambda c: c) if mode == "authorized" else (lambda c: F.round(c, 9))
    return out.select("candidate_id", "raw_score", "adjusted_score", "confidence", digits(F.col("public_location.lat")).alias("public_lat"), digits(F.col("public_location.lon")).alias("public_lon"), F.col("exact_location.lat").alias("exact_lat"))


for _mode, _metres, _where in (("public", 5000.0, _FREE), ("restricted", 1000.0, _FREE), ("authorized", None, "true")):
    query(f"rank_{_mode}", _ranked_sql(_metres, _where))(lambda spark, sf_dir, mode=_mode: _ranked(spark, sf_dir, mode))


@query("score_components", f"WITH {fx.SCORED} SELECT seq, round(raw, 10) AS raw, round(penalty, 10) AS penalty, round(uncertainty, 10) AS uncertainty, round(adjusted, 10) AS adjusted FROM scored")
def score_components(spark, sf_dir):
    return rank.score(fx.candidates(spark, sf_dir)).select("seq", *[F.round(c, 10).alias(c) for c in ("raw", "penalty", "uncertainty", "adjusted")])


@query("confidence_histogram", f"WITH {fx.SCORED} SELECT {fx.BAND} AS confidence, landscape, count(*) AS n FROM scored GROUP BY ALL")
def confidence_histogram(spark, sf_dir):
    scored = rank.score(fx.candidates(spark, sf_dir))
    return scored.groupBy(scoring.confidence_band(F.col("adjusted")).alias("confidence"), "landscape").agg(F.count("*").alias("n"))


_REASONS_SQL = "list_filter([" + ", ".join(f"CASE WHEN {n} >= {v} THEN '{t}' END" for n, v, t in scoring.REASONS) + f", CASE WHEN adjusted < 0.35 THEN '{scoring.LOW_SCORE[1]}' END], lambda x: x IS NOT NULL)"


@query("explain_reasons", f"WITH {fx.SCORED} SELECT seq, array_to_string({_REASONS_SQL}, '|') AS reasons FROM scored")
def explain_reasons(spark, sf_dir):
    scored = rank.score(fx.candidates(spark, sf_dir))
    return scored.select("seq", F.array_join(scoring.reasons(F.col("adjusted"), F.lit(None).cast("array<string>")), "|").alias("reasons"))


@query("weight_fallback_unknown", f"WITH {fx.SCORED} SELECT seq, round(raw, 10) AS raw FROM scored WHERE landscape = 'unknown'")
def weight_fallback_unknown(spark, sf_dir):
    return rank.score(fx.candidates(spark, sf_dir)).where("landscape = 'unknown'").select("seq", F.round("raw", 10).alias("raw"))


#: Raw evidence as text, by event; the last is the event's own value.
_RAW = ("true", "1_0", "NaN", "inf", " 0.25 ", "-3", "1.5e-1", "0x1", "")


@query("evidence_cleaning", "WITH r AS (SELECT event_id, CASE event_id % 11 " + " ".join(f"WHEN {i} THEN '{x}'" for i, x in enumerate(_RAW)) + """ WHEN 9 THEN NULL ELSE (value / 100)::VARCHAR END AS raw FROM events)
SELECT event_id, greatest(0, least(1, COALESCE(CASE WHEN raw LIKE '0x%' THEN NULL ELSE TRY_CAST(trim(raw) AS DOUBLE) END, 0))) AS cleaned FROM r""")
def evidence_cleaning(spark, sf_dir):
    e = fx.table(spark, sf_dir, "events")
    raw = F.when(F.col("event_id") % 11 == 9, None)
    for i, x in enumerate(_RAW):
        raw = raw.when(F.col("event_id") % 11 == i, x)
    return e.select("event_id", scoring.evidence(raw.otherwise((F.col("value") / 100).cast("string"))).alias("cleaned"))


_SETTINGS = [(access, mode) for access in ("block", "authorized-only", "allow-all") for mode in rank.MODES]


def _withheld_sql(access: str, mode: str) -> str:
    zone = access == "block" or access == "authorized-only" and mode != "authorized"
    return f"({'in_zone' if zone else 'false'} OR {'sensitive' if mode != 'authorized' else 'false'})"


@query("withhold_matrix", f"""WITH {fx.CANDIDATES}, {fx.ZONES_SQL},
f AS (SELECT sensitivity, sensitivity = 'sensitive' AS sensitive, EXISTS (SELECT 1 FROM zones z WHERE c.lat BETWEEN z.min_lat AND z.max_lat AND c.lon BETWEEN z.min_lon AND z.max_lon) AS in_zone FROM cand c)
""" + " UNION ALL ".join(f"SELECT '{a}' AS access, '{m}' AS mode, sensitivity, count(*) FILTER (WHERE {_withheld_sql(a, m)}) AS withheld, count(*) AS n FROM f GROUP BY sensitivity" for a, m in _SETTINGS))
def withhold_matrix(spark, sf_dir):
    from dataclasses import replace

    c = fx.candidates(spark, sf_dir)
    hit = zones.inside_any(c, fx.zone_boxes(spark)).select("seq", F.lit(True).alias("hit"))
    flagged = c.join(hit, "seq", "left").withColumn("in_zone", F.coalesce("hit", F.lit(False)))
    tests = []
    for access, mode in _SETTINGS:
        s = Settings()
        s = replace(s, guardrails=replace(s.guardrails, red_zone_access=access))
        tests.append(F.struct(F.lit(access).alias("access"), F.lit(mode).alias("mode"), rank.withhold(mode, F.col("in_zone"), s).alias("held")))
    rows = flagged.select("sensitivity", F.explode(F.array(*tests)).alias("t")).select("sensitivity", "t.*")
    return rows.groupBy("access", "mode", "sensitivity").agg(F.count_if("held").alias("withheld"), F.count("*").alias("n"))


_IN = "s.lat BETWEEN z.min_lat AND z.max_lat AND s.lon BETWEEN z.min_lon AND z.max_lon"


@query("zone_semi_join", f"WITH {fx.CANDIDATES}, {fx.ZONES_SQL} SELECT seq FROM cand s WHERE EXISTS (SELECT 1 FROM zones z WHERE {_IN})")
def zone_semi_join(spark, sf_dir):
    return zones.inside_any(fx.candidates(spark, sf_dir), fx.zone_boxes(spark)).select("seq")


@query("zone_anti_join", f"WITH {fx.CANDIDATES}, {fx.ZONES_SQL} SELECT seq FROM cand s WHERE NOT EXISTS (SELECT 1 FROM zones z WHERE {_IN})")
def zone_anti_join(spark, sf_dir):
    return zones.outside_all(fx.candidates(spark, sf_dir), fx.zone_boxes(spark)).select("seq")


#: A ring with a hole over the lattice, in degrees.
_SHAPE = ([(90.011, 47.021), (90.291, 47.041), (90.251, 47.161), (90.061, 47.131)], [(90.121, 47.061), (90.181, 47.061), (90.181, 47.111), (90.121, 47.111)])
_SHAPE_SQL = "(" + " + ".join(
    f"CASE WHEN ({y1} > lat) <> ({y2} > lat) AND lon < {x1} + (lat - {y1}) * ({x2 - x1!r}::DOUBLE) / ({y2 - y1!r}::DOUBLE) THEN 1 ELSE 0 END"
    for ring in _SHAPE for (x1, y1), (x2, y2) in zip(ring, ring[1:] + ring[:1]) if y1 != y2
) + ") % 2 = 1"


def _shape(spark):
    edges = F.array(*[F.struct(*[F.lit(v).alias(n) for v, n in zip((*a, *b), ("x1", "y1", "x2", "y2"))]) for ring in _SHAPE for a, b in zip(ring, ring[1:] + ring[:1])])
    xs, ys = zip(*_SHAPE[0])
    return spark.range(1).select(F.lit(0).alias("zone_ord"), F.lit("ring").alias("name"), F.lit(min(ys)).alias("min_lat"), F.lit(max(ys)).alias("max_lat"), F.lit(min(xs)).alias("min_lon"), F.lit(max(xs)).alias("max_lon"), edges.alias("edges"))


@query("zone_polygon_semi", f"WITH {fx.CANDIDATES} SELECT seq FROM cand WHERE {_SHAPE_SQL}")
def zone_polygon_semi(spark, sf_dir):
    return zones.inside_any(fx.candidates(spark, sf_dir), _shape(spark)).select("seq")


@query("zone_polygon_anti", f"WITH {fx.CANDIDATES} SELECT seq FROM cand WHERE NOT ({_SHAPE_SQL})")
def zone_polygon_anti(spark, sf_dir):
    return zones.outside_all(fx.candidates(spark, sf_dir), _shape(spark)).select("seq")


@query("zone_tagging_collect", f"""WITH {fx.CANDIDATES}, {fx.ZONES_SQL},
h AS (SELECT s.seq, string_agg(z.name, '|' ORDER BY z.zone_ord) AS names FROM cand s JOIN zones z ON s.lat + 0.002 >= z.min_lat AND s.lat - 0.002 <= z.max_lat AND s.lon + 0.002 >= z.min_lon AND s.lon - 0.002 <= z.max_lon GROUP BY 1)
SELECT s.seq, COALESCE(h.names, '') AS zone_names, CASE WHEN h.names IS NULL THEN 'normal' ELSE 'sensitive' END AS sensitivity FROM cand s LEFT JOIN h USING (seq)""")
def zone_tagging_collect(spark, sf_dir):
    return zones.tag(fx.candidates(spark, sf_dir), fx.zone_boxes(spark), half=0.002).select("seq", F.array_join("zone_names", "|").alias("zone_names"), "sensitivity")


@query("topk_adjusted", f"WITH {fx.SCORED} SELECT candidate_id, round(adjusted, 4) AS adjusted_score FROM scored WHERE sensitivity <> 'sensitive' AND round(adjusted, 4) >= 0.3 ORDER BY 2 DESC, seq LIMIT 50")
def topk_adjusted(spark, sf_dir):
    return rank.top(rank.rank(fx.candidates(spark, sf_dir)), 50, 0.3).select("candidate_id", "adjusted_score")


@query("per_group_topn", """SELECT event_id, event_type, rn FROM (SELECT event_id, event_type, row_number() OVER (PARTITION BY event_type ORDER BY value ASC NULLS LAST, event_id)::INTEGER AS rn FROM events) WHERE rn <= 4""")
def per_group_topn(spark, sf_dir):
    return select_items.pick(fx.table(spark, sf_dir, "events"), "event_type", F.col("value"), False, "event_id", 4).select("event_id", "event_type", "rn")


@query("nulls_first_desc", """SELECT event_id, event_type, rn FROM (SELECT event_id, event_type, row_number() OVER (PARTITION BY event_type ORDER BY nullif(user_id % 7, 0) DESC NULLS FIRST, event_id)::INTEGER AS rn FROM events) WHERE rn <= 6""")
def nulls_first_desc(spark, sf_dir):
    key = F.nullif(F.col("user_id") % 7, F.lit(0))
    return select_items.pick(fx.table(spark, sf_dir, "events"), "event_type", key, True, "event_id", 6).select("event_id", "event_type", "rn")


# Candidates scattered over a square by their number, so that all of them make small clusters.
_SCATTER = "(p_partkey * 7919) % 10007 * 1.0::DOUBLE AS x, (p_partkey * 104729) % 10009 * 1.0::DOUBLE AS y"
_POINTS = f"{fx.CANDIDATES}, pt AS (SELECT p_partkey AS seq, {_SCATTER} FROM part JOIN cand ON seq = p_partkey)"


def _points(spark, sf_dir):
    k = F.col("seq")
    return fx.candidates(spark, sf_dir).withColumn("x", (k * 7919 % 10007).cast("double")).withColumn("y", (k * 104729 % 10009).cast("double"))


_NEAR = "sqrt((a.x - b.x) * (a.x - b.x) + (a.y - b.y) * (a.y - b.y))"


@query("distance_pairs_bucketed", f"WITH {_POINTS} SELECT a.seq AS a, b.seq AS b FROM pt a JOIN pt b ON a.seq < b.seq AND abs(a.x - b.x) <= 500 AND abs(a.y - b.y) <= 500 AND {_NEAR} <= 500 + 1e-6")
def distance_pairs_bucketed(spark, sf_dir):
    return cluster.distance_pairs(_points(spark, sf_dir), 500)


_COMPONENTS = f"""{_POINTS},
pr AS (SELECT a.seq AS a, b.seq AS b FROM pt a JOIN pt b ON a.seq <> b.seq AND abs(a.x - b.x) <= 180 AND abs(a.y - b.y) <= 180 AND {_NEAR} <= 180 + 1e-6),
reach AS (SELECT seq AS x, seq AS y FROM pt UNION SELECT r.x, p.b FROM reach r JOIN pr p ON r.y = p.a),
comp AS (SELECT x AS seq, min(y) AS component FROM reach GROUP BY 1)"""


def _members(spark, sf_dir):
    c = rank.score(_points(spark, sf_dir))
    comp = cluster.components_within(c, 180)
    return c.join(comp, "seq").withColumn("adjusted_score", F.round("adjusted", 4)).withColumn("reasons", scoring.reasons(F.col("adjusted"), F.lit(None).cast("array<string>")))


@query("connected_components", f"WITH RECURSIVE {_COMPONENTS} SELECT seq, component FROM comp")
def connected_components(spark, sf_dir):
    return _members(spark, sf_dir).select("seq", "component")


_MEMBERS = f"{_COMPONENTS}, {fx.SCORED.replace(fx.CANDIDATES, '').strip().lstrip(',')}, mem AS (SELECT s.*, c.component, round(adjusted, 4) AS adj FROM scored s JOIN comp c USING (seq))"


@query("cluster_summary", f"""WITH RECURSIVE {_MEMBERS},
agg AS (SELECT component, count(*) AS member_count, sum(round(adj * 10000)::BIGINT) / (count(*) * 10000.0::DOUBLE) AS mean, max(adj) AS top, min_by(candidate_id, (-adj, seq)) AS top_candidate_id FROM mem GROUP BY 1),
v AS (SELECT *, greatest(0, least(1, 0.65 * top + 0.25 * mean + 0.10 * greatest(0, least(1, (member_count - 1) / 4.0)))) AS s FROM agg)
SELECT component, member_count, round(s::DECIMAL(20, 10), 4)::DOUBLE AS cluster_score, round(mean::DECIMAL(20, 10), 4)::DOUBLE AS mean_adjusted_score, top_candidate_id FROM v""")
def cluster_summary(spark, sf_dir):
    return cluster.summarize(_members(spark, sf_dir)).select("component", "member_count", "cluster_score", "mean_adjusted_score", "top_candidate_id")


@query("cluster_mode_tiebreak", f"""WITH RECURSIVE {_MEMBERS},
n AS (SELECT component, landscape, count(*) AS n, min(seq) AS f FROM mem GROUP BY ALL)
SELECT component, landscape AS dominant FROM (SELECT *, row_number() OVER (PARTITION BY component ORDER BY n DESC, f) AS k FROM n) WHERE k = 1""")
def cluster_mode_tiebreak(spark, sf_dir):
    return cluster.dominant(_members(spark, sf_dir), "landscape")


@query("cluster_reasons_capped", f"""WITH RECURSIVE {_MEMBERS},
each AS (SELECT seq, component, candidate_id, row_number() OVER (PARTITION BY component ORDER BY adj DESC, seq) AS k, count(*) OVER (PARTITION BY component) AS n, {_REASONS_SQL} AS reasons FROM mem),
said AS (SELECT component, 0 AS k, 0 AS i, 'cluster supported by ' || max(n) || ' adjacent tile(s)' AS r FROM each GROUP BY 1 UNION ALL
  SELECT component, k, unnest(range(1, len(reasons) + 1)) AS i, unnest(reasons) AS r FROM each WHERE k <= 3),
once AS (SELECT component, r, min(k * 100 + i) AS pos FROM said GROUP BY ALL),
capped AS (SELECT component, r, pos, row_number() OVER (PARTITION BY component ORDER BY pos) AS p FROM once)
SELECT component, string_agg(r, '|' ORDER BY pos) AS reasons, (SELECT string_agg(candidate_id, '|' ORDER BY k) FROM each e WHERE e.component = c.component) AS members FROM capped c WHERE p <= 8 GROUP BY component""")
def cluster_reasons_capped(spark, sf_dir):
    return cluster.summarize(_members(spark, sf_dir)).select("component", F.array_join("reasons", "|").alias("reasons"), F.array_join("member_ids", "|").alias("members"))


@query("cluster_public_location", f"""WITH RECURSIVE {_MEMBERS}, place AS (SELECT component, avg(lat) AS lat, avg(lon) AS lon FROM mem GROUP BY 1)
SELECT component, round(lat + 5000 / 111320.0::DOUBLE, 9) AS lat, round(lon - 5000.0::DOUBLE / (111320.0::DOUBLE * greatest(cos(radians(lat)), 0.1::DOUBLE)), 9) AS lon, 'redacted' AS location_mode FROM place""")
def cluster_public_location(spark, sf_dir):
    return cluster.summarize(_members(spark, sf_dir), "public").select("component", F.round("lat", 9).alias("lat"), F.round("lon", 9).alias("lon"), "location_mode")


@query("cluster_area_cells", f"""WITH RECURSIVE {_COMPONENTS},
cell AS (SELECT DISTINCT component, round(x / 250)::BIGINT + i AS cx, round(y / 250)::BIGINT + j AS cy FROM comp JOIN pt USING (seq), range(2) a(i), range(2) b(j))
SELECT component, count(*) * 6.25::DOUBLE AS area_ha FROM cell GROUP BY 1""")
def cluster_area_cells(spark, sf_dir):
    return cluster.covered_area_ha(_members(spark, sf_dir), 500, 250)


@query("utm_zone", f"WITH {fx.CANDIDATES} SELECT seq, least(floor((lon * 2 - 180 + 180) / 6) + 1, 60)::INTEGER AS zone FROM cand")
def utm_zone(spark, sf_dir):
    return fx.candidates(spark, sf_dir).select("seq", geo.utm_zone(F.col("lon") * 2 - 180).alias("zone"))


def _utm_sql() -> str:
    a, e = geo._ALPHA, geo._E
    x = " + ".join(f"{c!r}::DOUBLE * cos({2 * j} * xi) * ((exp({2 * j} * eta) - exp(-{2 * j} * eta)) / 2)" for j, c in enumerate(a, 1))
    y = " + ".join(f"{c!r}::DOUBLE * sin({2 * j} * xi) * ((exp({2 * j} * eta) + exp(-{2 * j} * eta)) / 2)" for j, c in enumerate(a, 1))
    return f"""WITH {fx.CANDIDATES},
r AS (SELECT seq, radians(lat) AS phi, radians(lon - ((floor((lon + 180) / 6) + 1) * 6 - 183)) AS lam FROM cand),
g AS (SELECT seq, lam, 0.5 * ln((1 + sin(phi)) / (1 - sin(phi))) - {e!r}::DOUBLE * 0.5 * ln((1 + {e!r}::DOUBLE * sin(phi)) / (1 - {e!r}::DOUBLE * sin(phi))) AS q FROM r),
h AS (SELECT seq, lam, (exp(q) - exp(-q)) / 2 AS t FROM g),
k AS (SELECT seq, atan2(t, cos(lam)) AS xi, ln(sin(lam) / sqrt(t * t + cos(lam) * cos(lam)) + sqrt(sin(lam) * sin(lam) / (t * t + cos(lam) * cos(lam)) + 1)) AS eta FROM h)
SELECT seq, round(500000 + {0.9996 * geo._RADIUS!r}::DOUBLE * (eta + {x}), 3) AS easting, round({0.9996 * geo._RADIUS!r}::DOUBLE * (xi + {y}), 3) AS northing FROM k"""


@query("utm_forward", _utm_sql())
def utm_forward(spark, sf_dir):
    e, n = geo.utm_forward(F.col("lat"), F.col("lon"))
    return fx.candidates(spark, sf_dir).select("seq", F.round(e, 3).alias("easting"), F.round(n, 3).alias("northing"))


@query("tile_grid", """WITH t AS (SELECT i, j, i * 250.0::DOUBLE AS x0, j * 250.0::DOUBLE AS y0 FROM range(40) a(i), range(25) b(j)),
c AS (SELECT *, greatest(0, least(x0 + 500, 9800.0) - x0) * greatest(0, least(y0 + 500, 6100.0) - y0) / 250000.0::DOUBLE AS coverage FROM t WHERE x0 < 9800 AND y0 < 6100)
SELECT printf('tile-%05d', row_number() OVER (ORDER BY i, j)) AS tile_id, x0, y0, coverage FROM c WHERE coverage >= 0.2""")
def tile_grid(spark, sf_dir):
    ring = [(0.0, 0.0), (9800.0, 0.0), (9800.0, 6100.0), (0.0, 6100.0)]
    return tiles.tile_aoi(spark, ring, 500, 250).select("tile_id", "x0", "y0", "coverage")


@query("target_grid_snap", f"WITH {fx.CANDIDATES}, b AS (SELECT landscape, min(x) AS a, min(y) AS b, max(x) AS c, max(y) AS d FROM cand GROUP BY 1) SELECT landscape, floor(a / 30) * 30 AS origin_x, ceil(d / 30) * 30 AS origin_y, greatest(ceil((c - floor(a / 30) * 30) / 30), 1)::BIGINT AS width, greatest(ceil((ceil(d / 30) * 30 - b) / 30), 1)::BIGINT AS height FROM b")
def target_grid_snap(spark, sf_dir):
    b = fx.candidates(spark, sf_dir).groupBy("landscape").agg(F.min("x").alias("a"), F.min("y").alias("b"), F.max("x").alias("c"), F.max("y").alias("d"))
    x, y, w, h = geo.snap_grid(F.col("a"), F.col("b"), F.col("c"), F.col("d"), 30)
    return b.select("landscape", x.alias("origin_x"), y.alias("origin_y"), w.cast("bigint").alias("width"), h.cast("bigint").alias("height"))


_RING = [(500.0, 300.0), (9000.0, 1200.0), (7200.0, 9100.0), (2600.0, 5200.0)]


def _ring_sql() -> str:
    parts = []
    for (x1, y1), (x2, y2) in zip(_RING, _RING[1:] + _RING[:1]):
        parts.append(f"CASE WHEN ({y1} > y) <> ({y2} > y) AND x < {x1} + (y - {y1}) * {(x2 - x1) / (y2 - y1)!r}::DOUBLE THEN 1 ELSE 0 END")
    return " + ".join(parts)


@query("ray_cast_contains", f"WITH {fx.CANDIDATES} SELECT seq FROM cand WHERE ({_ring_sql()}) % 2 = 1")
def ray_cast_contains(spark, sf_dir):
    return fx.candidates(spark, sf_dir).where(geo.in_ring(F.col("x"), F.col("y"), _RING)).select("seq")


@query("filter_rules_all_ops", """SELECT event_id FROM events WHERE event_type <> 'click' AND COALESCE((props::JSON ->> 'k')::DOUBLE <= 80, false) AND COALESCE((props::JSON ->> 'k')::DOUBLE >= 10, false) AND contains(props::JSON ->> 'k', '1')""")
def filter_rules_all_ops(spark, sf_dir):
    e = fx.table(spark, sf_dir, "events")
    value, number = text.property_value(F.col("props"), "k"), text.property_value(F.col("props"), "k", "double")
    kind = text.rule(F.col("event_type"), F.lit(None).cast("double"), ne="click")
    return e.where(kind & text.rule(value, number, lte=80, gte=10, contains="1")).select("event_id")


@query("filter_rules_typed", """WITH v AS (SELECT event_id, CASE event_id % 5 WHEN 0 THEN '{"a": 5}' WHEN 1 THEN '{"a": "5"}' WHEN 2 THEN '{"a": true}' WHEN 3 THEN '{"a": 1.0}' ELSE '{}' END::JSON AS p FROM events),
t AS (SELECT event_id, json_type(p, '$.a') AS k, p ->> 'a' AS x FROM v),
n AS (SELECT *, CASE WHEN k = 'BOOLEAN' THEN (x = 'true')::INTEGER::DOUBLE WHEN k <> 'VARCHAR' THEN x::DOUBLE END AS num FROM t)
SELECT event_id, COALESCE(num = 5, false) AS is_five, COALESCE(k = 'VARCHAR' AND x = '5', false) AS is_text, COALESCE(num = 1, false) AS is_true, NOT COALESCE(num = 5, false) AS not_five FROM n""")
def filter_rules_typed(spark, sf_dir):
    cases = ['{"a": 5}', '{"a": "5"}', '{"a": true}', '{"a": 1.0}']
    json = F.lit("{}")
    for i, c in enumerate(cases):
        json = F.when(F.col("event_id") % 5 == i, c).otherwise(json)
    e = fx.table(spark, sf_dir, "events").select("event_id", json.alias("p"))
    value, number, kind = text.property_value(F.col("p"), "a"), text.property_value(F.col("p"), "a", "double"), text.property_kind(F.col("p"), "a")
    test = lambda **ops: text.rule(value, number, kind=kind, **ops)
    return e.select("event_id", test(eq=5).alias("is_five"), test(eq="5").alias("is_text"), test(eq=True).alias("is_true"), test(ne=5).alias("not_five"))


@query("json_path_lookup", "SELECT event_id, (props::JSON ->> 'k')::BIGINT AS k, NULL::BIGINT AS missing FROM events")
def json_path_lookup(spark, sf_dir):
    e = fx.table(spark, sf_dir, "events")
    return e.select("event_id", text.property_value(F.col("props"), "properties.k", "bigint").alias("k"), text.property_value(F.col("props"), "eo:cloud_cover", "bigint").alias("missing"))


@query("alias_normalize", r"SELECT p_partkey, regexp_replace(lower(p_brand || ' / ' || p_name), '[^\p{L}\p{N}]', '', 'g') AS alias FROM part")
def alias_normalize(spark, sf_dir):
    return fx.table(spark, sf_dir, "part").select("p_partkey", text.alias_key(F.concat_ws(" / ", "p_brand", "p_name")).alias("alias"))


@query("filename_sanitize", r"""SELECT page_id, COALESCE(nullif(regexp_replace(regexp_replace(url, '[^A-Za-z0-9_.-]+', '_', 'g'), '^_+|_+$', '', 'g'), ''), 'item') AS file_name FROM pages""")
def filename_sanitize(spark, sf_dir):
    return fx.table(spark, sf_dir, "pages").select("page_id", text.sanitize_filename(F.col("url")).alias("file_name"))


@query("asset_first_match", """WITH a AS (SELECT o_orderkey AS item_id, l_linenumber * 1000000 + l_partkey AS ord, l_returnflag AS key, l_linestatus AS title FROM orders JOIN lineitem ON l_orderkey = o_orderkey),
w(grp, ao, alias) AS (VALUES ('red', 0, 'R'), ('red', 1, 'A'), ('nir', 0, 'x'), ('nir', 1, 'f')),
h AS (SELECT a.*, w.*, key = alias AS exact FROM a, w WHERE key = alias OR lower(key) = lower(alias) OR contains(lower(title), lower(alias))),
k AS (SELECT *, row_number() OVER (PARTITION BY item_id, grp ORDER BY NOT exact, CASE WHEN exact THEN ao ELSE ord END, CASE WHEN exact THEN ord ELSE ao END, key) AS n FROM h)
SELECT item_id, grp AS "group", key, ord::VARCHAR AS href FROM k WHERE n = 1""")
def asset_first_match(spark, sf_dir):
    return _found_assets(spark, sf_dir)


def _found_assets(spark, sf_dir):
    li = fx.table(spark, sf_dir, "lineitem").join(fx.table(spark, sf_dir, "orders"), F.col("l_orderkey") == F.col("o_orderkey"))
    assets = li.select(
        F.col("o_orderkey").alias("item_id"), (F.col("l_linenumber") * 1000000 + F.col("l_partkey")).alias("ord"), F.col("l_returnflag").alias("key"), F.col("l_linestatus").alias("title"),
        F.lit(None).cast("array<string>").alias("bands"), (F.col("l_linenumber") * 1000000 + F.col("l_partkey")).cast("string").alias("href"),
    )
    return select_items.find_asset(assets, {"red": ["R", "A"], "nir": ["x", "f"]})


@query("relational_division_groups", """SELECT l_orderkey AS item_id FROM lineitem JOIN orders ON l_orderkey = o_orderkey GROUP BY 1
HAVING count(*) FILTER (WHERE l_returnflag IN ('R', 'A')) > 0 AND count(*) FILTER (WHERE l_linestatus = 'F') > 0""")
def relational_division_groups(spark, sf_dir):
    return select_items.with_all_groups(_found_assets(spark, sf_dir), 2)


for _how, _key in (("name", "'name::' || name"), ("category", "'category::' || COALESCE(category, '(uncategorized)')"), ("all", "'all'")):
    query(f"dissolve_{_how}", f"""WITH {fx.FEATURES} SELECT {_key} AS key, min(idx) AS first_idx, min_by(name, idx) AS name, min_by(category, idx) AS category, count(*) AS source_count, md5(string_agg(name, '|' ORDER BY idx)) AS names FROM feat GROUP BY 1""")(
        lambda spark, sf_dir, how=_how: select_items.dissolve(fx.features(spark, sf_dir), text.dissolve_key(how, F.col("name"), F.col("category"), F.col("idx"))).withColumn("names", F.md5(F.array_join("source_names", "|"))).drop("source_names")
    )


@query("category_include_exclude", f"WITH {fx.FEATURES} SELECT idx FROM feat WHERE lower(trim(category)) IN ('1-urgent', '2-high', '5-low') AND lower(trim(category)) NOT IN ('5-low')")
def category_include_exclude(spark, sf_dir):
    return fx.features(spark, sf_dir).where(text.category_allowed(F.col("category"), ["1-URGENT ", "2-high", "5-LOW"], ["5-low"])).select("idx")


@query("import_counts", f"WITH {fx.FEATURES} SELECT count(*) AS input_features, count(*) FILTER (WHERE lower(category) <> '5-low') AS kept_features, count(DISTINCT name) FILTER (WHERE lower(category) <> '5-low') AS output_features FROM feat")
def import_counts(spark, sf_dir):
    ok = text.category_allowed(F.col("category"), (), ["5-low"])
    return fx.features(spark, sf_dir).agg(F.count("*").alias("input_features"), F.count_if(ok).alias("kept_features"), F.count_distinct(F.when(ok, F.col("name"))).alias("output_features"))


@query("ndvi_join", f"WITH {fx.PATCHES} SELECT r.layer, r.row, r.col, CASE WHEN abs(n.value + r.value) > 1e-6 THEN round((n.value - r.value) / (n.value + r.value), 6) END AS ndvi FROM px r JOIN px n ON n.layer = r.layer + 1 AND n.row = r.row AND n.col = r.col WHERE r.layer % 2 = 0")
def ndvi_join(spark, sf_dir):
    p = fx.patches(spark, sf_dir)
    red = p.where("layer % 2 = 0").select("layer", "row", "col", F.col("value").alias("red"))
    nir = p.where("layer % 2 = 1").select((F.col("layer") - 1).alias("layer"), "row", "col", F.col("value").alias("nir"))
    return red.join(nir, ["layer", "row", "col"]).select("layer", "row", "col", F.round(raster.ndvi(F.col("red"), F.col("nir")), 6).alias("ndvi"))


@query("to_db", f"WITH {fx.PATCHES} SELECT layer, row, col, CASE WHEN value > 0 THEN round(10 * log10(value), 6) END AS db FROM px")
def to_db(spark, sf_dir):
    return fx.patches(spark, sf_dir).select("layer", "row", "col", F.round(raster.to_db(F.col("value")), 6).alias("db"))


@query("nanmean_mosaic", f"WITH {fx.SERIES} SELECT row, col, round(avg(value), 6) AS value FROM st GROUP BY ALL")
def nanmean_mosaic(spark, sf_dir):
    return raster.mosaic(fx.series(spark, sf_dir)).select("row", "col", F.round("value", 6).alias("value"))


@query("quality_context", f"WITH {fx.SERIES} SELECT row, col, CASE WHEN count(value) > 0 THEN round(count(value) / count(*), 6) END AS quality FROM st GROUP BY ALL")
def quality_context(spark, sf_dir):
    return raster.quality(fx.series(spark, sf_dir), True).withColumn("quality", F.round("quality", 6))


@query("quality_ingest", f"WITH {fx.SERIES} SELECT row, col, round(count(value) / count(*), 6) AS quality FROM st GROUP BY ALL")
def quality_ingest(spark, sf_dir):
    return raster.quality(fx.series(spark, sf_dir), False).withColumn("quality", F.round("quality", 6))


@query("zonal_quantiles", f"""WITH {fx.PATCHES} SELECT label, count(value) AS n, round(avg(value), 6) AS mean, round(stddev_pop(value), 6) AS std, round(quantile_cont(value, 0.05), 6) AS p5, round(quantile_cont(value, 0.5), 6) AS median,
  round(quantile_cont(value, 0.9), 6) AS p90, round(quantile_cont(value, 0.95), 6) AS p95, round(min(value), 6) AS least, round(max(value), 6) AS most FROM px GROUP BY 1""")
def zonal_quantiles(spark, sf_dir):
    z = raster.zonal(fx.patches(spark, sf_dir), "label")
    return z.select("label", "n", *[F.round(c, 6).alias(c) for c in ("mean", "std", "p5", "median", "p90", "p95", "least", "most")])


@query("robust_z_p95", f"""WITH {fx.PATCHES}, m AS (SELECT layer, quantile_cont(value, 0.5) AS med, stddev_pop(value) AS sd FROM px GROUP BY 1),
d AS (SELECT layer, sd, abs(value - med) AS dev FROM px JOIN m USING (layer)), s AS (SELECT layer, any_value(sd) AS sd, quantile_cont(dev, 0.5) AS mad, quantile_cont(dev, 0.95) AS p95 FROM d GROUP BY 1)
SELECT layer, round(greatest(0, least(1, p95 / greatest(CASE WHEN mad > 1e-6 THEN 1.4826 * mad ELSE sd + 1e-6 END, 1e-6) / 6)), 6) AS strength FROM s""")
def robust_z_p95(spark, sf_dir):
    return raster.robust_strength(fx.patches(spark, sf_dir), "layer").withColumn("strength", F.round("strength", 6))


@query("stretch_p5_p95", f"""WITH {fx.PATCHES}, m AS (SELECT layer, quantile_cont(value, 0.05) AS lo, quantile_cont(value, 0.95) AS hi FROM px GROUP BY 1)
SELECT layer, row, col, round(greatest(0, least(1, (value - lo) / (hi - lo))), 6) AS stretched FROM px JOIN m USING (layer)""")
def stretch_p5_p95(spark, sf_dir):
    return raster.stretch(fx.patches(spark, sf_dir), "layer").select("layer", "row", "col", F.round("stretched", 6).alias("stretched"))


@query("mean_probability_branch", f"""WITH {fx.PATCHES}, s AS (SELECT layer, CASE WHEN layer % 2 = 0 THEN abs(value) ELSE value END AS value FROM px),
m AS (SELECT layer, quantile_cont(value, 0.05) AS lo, quantile_cont(value, 0.95) AS hi, min(value) AS mn, max(value) AS mx FROM s GROUP BY 1)
SELECT layer, round(avg(CASE WHEN mn >= -0.05 AND mx <= 1.05 THEN greatest(0, least(1, value)) ELSE greatest(0, least(1, (value - lo) / (hi - lo))) END), 6) AS probability FROM s JOIN m USING (layer) GROUP BY 1""")
def mean_probability_branch(spark, sf_dir):
    p = fx.patches(spark, sf_dir).withColumn("value", F.when(F.col("layer") % 2 == 0, F.abs("value")).otherwise(F.col("value")))
    return raster.mean_probability(p, "layer").withColumn("probability", F.round("probability", 6))


@query("forest_fraction", f"WITH {fx.PATCHES} SELECT layer, avg(CASE WHEN value * 4 > 0.5 THEN 1.0::DOUBLE ELSE 0 END) AS forest FROM px GROUP BY 1")
def forest_fraction(spark, sf_dir):
    return raster.forest_fraction(fx.patches(spark, sf_dir).withColumn("value", F.col("value") * 4), "layer")


@query("temporal_persistence", f"""WITH {fx.PATCHES}, s AS (SELECT label, row, col, avg(CASE WHEN value > 0.1 THEN 1.0::DOUBLE ELSE 0 END) AS share FROM px GROUP BY ALL)
SELECT label, round(COALESCE(quantile_cont(CASE WHEN share > 0 THEN share END, 0.9), 0), 6) AS persistence FROM s GROUP BY 1""")
def temporal_persistence(spark, sf_dir):
    hits = fx.patches(spark, sf_dir).withColumn("hit", F.col("value") > 0.1)
    return raster.persistence(hits, "label").withColumn("persistence", F.round("persistence", 6))


@query("iou_history", f"""WITH {fx.PATCHES} SELECT a.layer, round(COALESCE(greatest(0, least(1, 2.0 * sum((a.value > 0.05 AND b.value > 0.05)::INTEGER) / nullif(sum((a.value > 0.05 OR b.value > 0.05)::INTEGER), 0))), 0), 6)::DOUBLE AS match
FROM px a JOIN px b ON b.layer = a.layer + 1 AND a.row = b.row AND a.col = b.col GROUP BY 1""")
def iou_history(spark, sf_dir):
    p = fx.patches(spark, sf_dir)
    later = p.select((F.col("layer") - 1).alias("layer"), "row", "col", F.col("value").alias("then"))
    return p.join(later, ["layer", "row", "col"]).groupBy("layer").agg(F.round(raster.iou_match(F.col("value") > 0.05, F.col("then") > 0.05), 6).alias("match"))


@query("slope_lag_lead", f"""WITH {fx.PATCHES}, g AS (SELECT *, lag(value) OVER r AS rb, lead(value) OVER r AS ra, lag(value) OVER c AS cb, lead(value) OVER c AS ca FROM px WINDOW r AS (PARTITION BY layer, col ORDER BY row), c AS (PARTITION BY layer, row ORDER BY col)),
d AS (SELECT layer, row, col, CASE WHEN rb IS NULL THEN ra - value WHEN ra IS NULL THEN value - rb ELSE (ra - rb) / 2 END AS gy, CASE WHEN cb IS NULL THEN ca - value WHEN ca IS NULL THEN value - cb ELSE (ca - cb) / 2 END AS gx FROM g)
SELECT layer, row, col, round(degrees(atan(sqrt(gx * gx + gy * gy))), 6) AS slope FROM d""")
def slope_lag_lead(spark, sf_dir):
    return raster.gradient(fx.patches(spark, sf_dir), "layer", 1.0, 1.0).select("layer", "row", "col", F.round("slope", 6).alias("slope"))


@query("residual_box_mean", f"WITH {fx.PATCHES} SELECT layer, row, col, round(value - avg(value) OVER (PARTITION BY layer, row ORDER BY col ROWS BETWEEN 1 PRECEDING AND 1 FOLLOWING), 6) AS residual FROM px")
def residual_box_mean(spark, sf_dir):
    return raster.box_residual(fx.patches(spark, sf_dir), "layer").select("layer", "row", "col", F.round("residual", 6).alias("residual"))


@query("edt_min_distance_join", f"""WITH {fx.PATCHES}, s AS (SELECT * FROM px WHERE value > 0.2) SELECT p.layer, p.row, p.col, round(exp(-min(sqrt((p.row - s.row) * (p.row - s.row) + (p.col - s.col) * (p.col - s.col))) / 4.0), 6) AS proximity FROM px p JOIN s USING (layer) GROUP BY ALL""")
def edt_min_distance_join(spark, sf_dir):
    p = fx.patches(spark, sf_dir)
    return raster.nearest_seed(p, p.where("value > 0.2"), "layer", 4.0).withColumn("proximity", F.round("proximity", 6))


@query("tile_features_kernel")
def tile_features_kernel(spark, sf_dir):
    return kernels.tile_features(fx.patches(spark, sf_dir), "layer", (8, 8))


@query("color_by_band", f"WITH {fx.SCORED} SELECT seq, CASE {fx.BAND} WHEN 'high' THEN 'darkred' WHEN 'medium' THEN 'orange' WHEN 'low' THEN 'blue' ELSE 'gray' END AS color FROM scored")
def color_by_band(spark, sf_dir):
    scored = rank.score(fx.candidates(spark, sf_dir))
    return scored.select("seq", scoring.band_color(scoring.confidence_band(F.col("adjusted"))).alias("color"))


@query("landscape_inference", f"""WITH {fx.CANDIDATES} SELECT seq, CASE WHEN optical_anomaly >= 0.9 THEN 'forest' WHEN sar_anomaly * 30 >= 18 OR microrelief >= 0.95 THEN 'mountain' WHEN contextual_fit >= 0.6 AND linearity * 20 <= 10 THEN 'valley' WHEN linearity * 20 <= 8 THEN 'steppe' ELSE 'unknown' END AS inferred FROM cand""")
def landscape_inference(spark, sf_dir):
    rugged = F.when(F.col("microrelief") >= 0.95, 1.0).otherwise(0.0)
    forest = F.when(F.col("optical_anomaly") >= 0.9, 1.0).otherwise(0.0)
    c = fx.candidates(spark, sf_dir)
    return c.select("seq", scoring.infer_landscape(forest, F.col("sar_anomaly") * 30, rugged, F.col("contextual_fit"), F.col("linearity") * 20).alias("inferred"))
