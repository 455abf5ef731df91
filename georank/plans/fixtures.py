"""The engine's inputs as views of the benchmark tables: candidates, tiles, patches, series, items, features."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from georank.functions.scoring import POSITIVES, clamp01


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def candidates(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A candidate for each part that was sold."""
    sold = table(spark, sf_dir, "lineitem").groupBy("l_partkey").agg(
        F.avg("l_discount").alias("d"), F.avg("l_tax").alias("t"), F.avg("l_quantity").alias("q"), F.count_distinct(F.year("l_shipdate")).alias("y"),
        F.avg((F.col("l_returnflag") == "R").cast("double")).alias("r"), F.avg((F.col("l_linestatus") == "O").cast("double")).alias("o"),
    )
    p = table(spark, sf_dir, "part").join(sold, F.col("p_partkey") == F.col("l_partkey"))
    k = F.col("p_partkey")
    kind = F.split("p_type", " ")[0]
    landscape = F.when(kind.isin("ECONOMY", "STANDARD"), "steppe").when(kind == "SMALL", "valley").when(kind == "MEDIUM", "mountain").when(kind == "LARGE", "forest").otherwise("unknown")
    sensitivity = F.when(k % 11 == 0, "sensitive").when(k % 5 == 0, "restricted").otherwise("normal")
    raw = [F.col("d") / 0.1 * 2 - 0.3, F.col("t") / 0.08 * 2 - 0.4, F.col("p_size") / 50.0, (F.col("p_retailprice") - 900) / 100, F.col("q") / 50, F.col("y") / 7.0, 1.5 * F.col("r"), F.col("o")]
    lattice = (k / 40).cast("long")
    return p.select(
        k.alias("seq"), F.concat(F.lit("tile-"), k.cast("string")).alias("candidate_id"), landscape.alias("landscape"), sensitivity.alias("sensitivity"),
        *[F.round(clamp01(x), 12).alias(n) for n, x in zip(POSITIVES, raw)],
        ((k * 7) % 100 / 100.0).alias("modern_disturbance"), ((k * 13) % 100 / 100.0).alias("natural_confounder_risk"), (1.0 - (k * 3) % 50 / 100.0).alias("data_quality"),
        (47 + (k % 40) * 0.0045).alias("lat"), (90 + lattice * 0.0066).alias("lon"), ((k % 40) * 250.0).alias("x"), (lattice * 250.0).alias("y"),
    )


CANDIDATES = """
sold AS (SELECT l_partkey, avg(l_discount) AS d, avg(l_tax) AS t, avg(l_quantity) AS q, count(DISTINCT year(l_shipdate)) AS y,
  avg(CASE WHEN l_returnflag = 'R' THEN 1.0::DOUBLE ELSE 0 END) AS r, avg(CASE WHEN l_linestatus = 'O' THEN 1.0::DOUBLE ELSE 0 END) AS o FROM lineitem GROUP BY 1),
cand AS (SELECT p_partkey AS seq, 'tile-' || p_partkey AS candidate_id,
  CASE split_part(p_type, ' ', 1) WHEN 'ECONOMY' THEN 'steppe' WHEN 'STANDARD' THEN 'steppe' WHEN 'SMALL' THEN 'valley' WHEN 'MEDIUM' THEN 'mountain' WHEN 'LARGE' THEN 'forest' ELSE 'unknown' END AS landscape,
  CASE WHEN p_partkey % 11 = 0 THEN 'sensitive' WHEN p_partkey % 5 = 0 THEN 'restricted' ELSE 'normal' END AS sensitivity,
  round(greatest(0, least(1, d / 0.1::DOUBLE * 2 - 0.3::DOUBLE)), 12) AS optical_anomaly, round(greatest(0, least(1, t / 0.08::DOUBLE * 2 - 0.4::DOUBLE)), 12) AS sar_anomaly,
  round(greatest(0, least(1, p_size / 50.0::DOUBLE)), 12) AS microrelief, round(greatest(0, least(1, (p_retailprice - 900) / 100)), 12) AS enclosure_shape,
  round(greatest(0, least(1, q / 50)), 12) AS linearity, round(greatest(0, least(1, y / 7.0::DOUBLE)), 12) AS temporal_persistence,
  round(greatest(0, least(1, 1.5::DOUBLE * r)), 12) AS historical_match, round(greatest(0, least(1, o)), 12) AS contextual_fit,
  (p_partkey * 7) % 100 / 100.0::DOUBLE AS modern_disturbance, (p_partkey * 13) % 100 / 100.0::DOUBLE AS natural_confounder_risk, 1.0::DOUBLE - (p_partkey * 3) % 50 / 100.0::DOUBLE AS data_quality,
  47 + (p_partkey % 40) * 0.0045::DOUBLE AS lat, 90 + (p_partkey // 40) * 0.0066::DOUBLE AS lon, (p_partkey % 40) * 250.0::DOUBLE AS x, (p_partkey // 40) * 250.0::DOUBLE AS y
  FROM part JOIN sold ON p_partkey = l_partkey)
"""

_W = {"steppe": (0.9, 0.6, 1.2, 1.1, 0.9, 1.0, 1.0, 0.8), "valley": (1.0, 0.7, 0.8, 0.7, 1.0, 1.0, 0.9, 1.1), "mountain": (0.6, 0.8, 1.0, 0.6, 0.7, 1.1, 0.8, 0.8), "forest": (0.3, 0.8, 0.7, 0.4, 0.5, 0.8, 0.5, 0.6)}
_VALUES = ", ".join("('{}', {})".format(k, ", ".join(f"{w}::DOUBLE" for w in ws)) for k, ws in _W.items())
_TOP = " + ".join(f"{p} * w{i}" for i, p in enumerate(POSITIVES))
_SUM = " + ".join(f"w{i}" for i in range(8))

SCORED = f"""
{CANDIDATES},
weights(wl, {", ".join(f"w{i}" for i in range(8))}) AS (VALUES {_VALUES}),
parts AS (SELECT c.*, (0.0 + {_TOP}) / (0.0 + {_SUM}) AS raw, 0.35::DOUBLE * (0.6::DOUBLE * modern_disturbance + 0.4::DOUBLE * natural_confounder_risk) AS penalty,
  0.25::DOUBLE * least(1.0::DOUBLE, (1.0::DOUBLE - data_quality) + 0.5::DOUBLE * natural_confounder_risk + CASE WHEN landscape IN ('mountain', 'forest', 'unknown') THEN 0.15::DOUBLE ELSE 0 END) AS uncertainty
  FROM cand c JOIN weights w ON w.wl = CASE WHEN c.landscape = 'unknown' THEN 'steppe' ELSE c.landscape END),
scored AS (SELECT *, greatest(0, least(1, raw - penalty - uncertainty)) AS adjusted FROM parts)
"""

BAND = "CASE WHEN adjusted >= 0.75 THEN 'high' WHEN adjusted >= 0.5 THEN 'medium' WHEN adjusted >= 0.25 THEN 'low' ELSE 'very-low' END"


def zone_boxes(spark: SparkSession) -> DataFrame:
    """Four literal boxes over the lattice."""
    rows = ", ".join(f"({i}, '{n}', {a}D, {b}D, {c}D, {d}D)" for i, n, a, b, c, d in ZONES)
    return spark.sql(f"SELECT * FROM VALUES {rows} AS z(zone_ord, name, min_lat, max_lat, min_lon, max_lon)")


#: Place, name, least and greatest latitude and longitude.
ZONES = ((0, "north-gate", 47.1211, 47.1621, 90.011, 90.081), (1, "old-wall", 47.0111, 47.0441, 90.101, 90.331), (2, "river-site", 47.0301, 47.1301, 90.151, 90.221), (3, "far-east", 47.0011, 47.1781, 91.001, 91.101))
ZONES_SQL = "zones(zone_ord, name, min_lat, max_lat, min_lon, max_lon) AS (VALUES " + ", ".join(f"({i}, '{n}', {a}::DOUBLE, {b}::DOUBLE, {c}::DOUBLE, {d}::DOUBLE)" for i, n, a, b, c, d in ZONES) + ")"


def patches(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every embedding as an 8 x 8 patch: layer, row, col, value."""
    e = table(spark, sf_dir, "embeddings").select(F.col("vec_id").alias("layer"), "label", F.posexplode("embedding").alias("i", "v"))
    return e.select("layer", "label", (F.col("i") / 8).cast("int").alias("row"), (F.col("i") % 8).alias("col"), F.col("v").cast("double").alias("value"))


PATCHES = "px AS (SELECT vec_id AS layer, label, (i // 8)::INTEGER AS row, (i % 8)::INTEGER AS col, v::DOUBLE AS value FROM (SELECT vec_id, label, unnest(range(len(embedding))) AS i, unnest(embedding) AS v FROM embeddings))"


def series(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Events as a sparse stack: row user, col hour, layer type; values below 1 count as missing."""
    e = table(spark, sf_dir, "events")
    return e.select(F.col("user_id").alias("row"), F.hour("ts").alias("col"), F.col("event_type").alias("layer"), F.when(F.col("value") >= 1, F.col("value")).alias("value"))


SERIES = "st AS (SELECT user_id AS row, hour(ts)::INTEGER AS col, event_type AS layer, CASE WHEN value >= 1 THEN value END AS value FROM events)"


def features(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Orders as zone features."""
    o = table(spark, sf_dir, "orders")
    return o.select((F.col("o_orderkey")).alias("idx"), F.col("o_orderstatus").alias("name"), F.col("o_orderpriority").alias("category"))


FEATURES = "feat AS (SELECT o_orderkey AS idx, o_orderstatus AS name, o_orderpriority AS category FROM orders)"
