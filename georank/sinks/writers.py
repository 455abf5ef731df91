"""Sinks: ranked JSON, GeoJSON features, summary row, Markdown and HTML reports."""

from __future__ import annotations

import json
from html import escape
from pathlib import Path

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from georank.functions.scoring import EVIDENCE, band_color
from georank.operators.cluster import members_of


def to_json_rows(df: DataFrame) -> DataFrame:
    """One JSON text a row, nulls kept."""
    return df.select(F.to_json(F.struct(*df.columns), {"ignoreNullFields": "false"}).alias("value"))


def write_ranked(ranked: DataFrame, path: str) -> None:
    """JSON lines, in rank order, from executors; for results of any size."""
    to_json_rows(ranked.orderBy(F.desc("adjusted_score"), "seq").drop("seq")).write.mode("overwrite").text(path)


def features(ranked: DataFrame) -> DataFrame:
    """GeoJSON features: the public place of each row as a point; rows without one are left out."""
    shown = ranked.where(F.col("public_location").isNotNull())
    point = F.struct(F.lit("Point").alias("type"), F.array(F.col("public_location.lon"), F.col("public_location.lat")).alias("coordinates"))
    names = [c for c in ("candidate_id", "cluster_id", "raw_score", "adjusted_score", "confidence", "reasons", "landscape", "sensitivity", "tags", "source_dates") if c in ranked.columns]
    return shown.select(F.to_json(F.struct(F.lit("Feature").alias("type"), point.alias("geometry"), F.struct(*names).alias("properties")), {"ignoreNullFields": "false"}).alias("feature"))


def popup(df: DataFrame) -> DataFrame:
    """df with an HTML snippet and colour; text is escaped."""
    safe = lambda c: F.replace(F.replace(F.replace(c, F.lit("&"), F.lit("&amp;")), F.lit("<"), F.lit("&lt;")), F.lit(">"), F.lit("&gt;"))
    parts = F.concat_ws("<br>", F.concat(F.lit("<b>"), safe(F.col("candidate_id")), F.lit("</b>")), F.format_string("score %.4f", "adjusted_score"), safe(F.col("confidence")))
    return df.withColumn("popup", parts).withColumn("color", band_color(F.col("confidence")))


def summary(mode: str, total_tiles: int, processed_tiles: int, ranked: DataFrame, clusters: DataFrame) -> DataFrame:
    """One row of run counts; the largest cluster counts 0 where there is none."""
    r = ranked.agg(F.count("*").alias("ranked_candidates"))
    best = F.min_by(F.struct("cluster_id", "cluster_score"), F.struct((-F.col("cluster_score")).alias("k"), "first_seq"))
    c = clusters.agg(F.count("*").alias("clusters"), F.coalesce(F.max("member_count"), F.lit(0)).alias("largest_cluster"), best.alias("b"))
    counts = r.join(F.broadcast(c))  # one row each
    return counts.select(
        F.lit(mode).alias("mode"), F.lit(total_tiles).alias("total_tiles"), F.lit(processed_tiles).alias("processed_tiles"), "ranked_candidates", "clusters", "largest_cluster",
        F.col("b.cluster_id").alias("top_cluster_id"), F.col("b.cluster_score").alias("top_cluster_score"),
    )


def placed_features(rows: DataFrame, mode: str, place: str, polygons: str, names: list[str]) -> DataFrame:
    """GeoJSON features: polygons (an array of corner rings) under authorized, else the place shown as a point; rows without one are left out."""
    if mode == "authorized":
        rings = F.transform(polygons, lambda t: F.array(F.concat(F.transform(t, lambda c: F.array(c["lon"], c["lat"])), F.array(F.array(t[0]["lon"], t[0]["lat"])))))
        geometry = F.struct(F.lit("MultiPolygon").alias("type"), rings.alias("coordinates"))
    else:
        geometry = F.struct(F.lit("Point").alias("type"), F.array(F.col(f"{place}.lon"), F.col(f"{place}.lat")).alias("coordinates"))
        rows = rows.where(F.col(place).isNotNull())
    feature = F.struct(F.lit("Feature").alias("type"), geometry.alias("geometry"), F.struct(*names).alias("properties"))
    return rows.select(*[c for c in ("seq", "first_seq", "adjusted_score", "cluster_score") if c in rows.columns], F.to_json(feature, {"ignoreNullFields": "false"}).alias("feature"))


def raw_candidates(result, shown: DataFrame) -> DataFrame:
    """Ranked rows with their evidence and metrics to 4 places, cluster and the place that the mode shows."""
    four = lambda c: F.round(c, 4).alias(c)
    return shown.select(
        "seq", "adjusted_score", "candidate_id", F.col("place.lat").alias("lat"), F.col("place.lon").alias("lon"), F.lit("exact" if result.mode == "authorized" else "redacted").alias("location_mode"),
        "landscape", "sensitivity", "cluster_id", "coverage_fraction", "tags", "source_dates", "red_zone_names", F.transform_values("metrics", lambda _, v: F.round(v, 4)).alias("metrics"), *map(four, EVIDENCE), "notes",
    )


#: Pixels of the map, and colours of the bands.
MAP_SIZE = 900
_COLORS = {"high": "darkred", "medium": "orange", "low": "blue"}


def review_map(mode: str, area, candidates: list[dict], clusters: list[dict], zones: list[dict]) -> str:
    """A self-contained page: the area's outline, clusters and candidates at their shown places, red zones where given."""
    spots = [(c["lon"], c["lat"]) for c in candidates + clusters if c["lat"] is not None]
    xs, ys = zip(*[p for r in area.rings for p in r], *spots)
    wide = max(max(xs) - min(xs), (max(ys) - min(ys)) * 1.4, 1e-6) * 1.1
    at = lambda x, y: (round((x - min(xs)) / wide * MAP_SIZE + 30, 1), round((max(ys) - y) * 1.4 / wide * MAP_SIZE + 30, 1))
    path = lambda ring: " ".join(f"{a},{b}" for a, b in (at(x, y) for x, y in ring))
    drawn = [f'<polygon points="{path(r)}" fill="none" stroke="black"/>' for r in area.rings]
    drawn += [f'<polygon points="{path([(z["min_lon"], z["min_lat"]), (z["max_lon"], z["min_lat"]), (z["max_lon"], z["max_lat"]), (z["min_lon"], z["max_lat"])])}" fill="red" fill-opacity="0.15" stroke="red"><title>{escape(z["name"])}</title></polygon>' for z in zones]
    for kind, rows, label in (("cluster", clusters, "cluster_id"), ("candidate", candidates, "candidate_id")):
        for r in rows:
            if r["lat"] is None:
                continue
            x, y = at(r["lon"], r["lat"])
            radius = max(7, 4 + r["member_count"]) if kind == "cluster" else 4
            text = escape("\n".join(str(v) for v in [r[label], f"score {r['cluster_score' if kind == 'cluster' else 'adjusted_score']:.4f} ({r['confidence']})", *r["reasons"]]))
            drawn.append(f'<circle class="{kind}" cx="{x}" cy="{y}" r="{radius}" fill="{_COLORS.get(r["confidence"], "gray")}" fill-opacity="{0.35 if kind == "cluster" else 0.9}" stroke="black"><title>{text}</title></circle>')
    return f'<!DOCTYPE html><meta charset="utf-8"><title>Review map ({escape(mode)})</title><svg xmlns="http://www.w3.org/2000/svg" width="{MAP_SIZE + 60}" height="{MAP_SIZE + 60}">{"".join(drawn)}</svg>\n'


def report(result, area, clusters: list[dict], n_ranked: int, n_clusters: int) -> str:
    """The run in Markdown: counts, then the ten best clusters."""
    lat, lon = area.centre()
    out = ["# Analysis report", "", f"- Permit mode: `{result.mode}`", f"- AOI centroid: `{lat:.5f}, {lon:.5f}`", f"- Tiles processed: `{result.processed_tiles}` / `{result.total_tiles}`",
           f"- Ranked candidate tiles: `{n_ranked}`", f"- Candidate clusters: `{n_clusters}`", "", "## Top clusters", ""]
    for c in clusters[:10]:
        facts = [("Location", f"`{c['lat']:.5f}, {c['lon']:.5f}` ({c['location_mode']})"), ("Cluster score", f"`{c['cluster_score']:.3f}` ({c['confidence']})"), ("Members", f"`{c['member_count']}`"),
                 ("Dominant landscape", f"`{c['dominant_landscape']}`"), ("Top candidate", f"`{c['top_candidate_id']}`"), ("Area", f"`{c['area_ha']:.2f}` ha"), ("Red zones", ", ".join(c["red_zone_names"])), ("Tags", ", ".join(c["tags"]))]
        out += [f"### {c['cluster_id']}", "", *[f"- {k}: {v}" for k, v in facts if v], "- Reasons:", *[f"  - {x}" for x in c["reasons"]], ""]
    return "\n".join(out + ([] if clusters else ["No clusters were exported.", ""]) + ["## Notes", "", "For non-invasive remote review only."]) + "\n"


def write_analysis(folder: str, result, area, zones: DataFrame | None = None) -> dict[str, str]:
    """The eight artefacts of a run in a local folder; paths by name.

    What reaches the driver is bounded by the run's max_candidates. No place is exact but under authorized, where red
    zones are drawn too.
    """
    lookup = members_of(result.clusters)
    own = result.records.select("seq", F.col("coverage").alias("coverage_fraction"), F.col("zone_names").alias("red_zone_names"), "corners", "metrics", *EVIDENCE, "notes").withColumn("coverage_fraction", F.round("coverage_fraction", 4))
    shown = result.ranked.join(own, "seq").join(lookup, "candidate_id", "left").withColumn("place", F.col("exact_location") if result.mode == "authorized" else F.col("public_location")).withColumn("footprint", F.array("corners"))
    best, first = [F.desc("adjusted_score"), "seq"], [F.desc("cluster_score"), "first_seq"]
    footprints = lookup.join(result.ranked.select("seq", "candidate_id"), "candidate_id").join(own.select("seq", "corners"), "seq").groupBy("cluster_id").agg(F.transform(F.array_sort(F.collect_list(F.struct("seq", "corners"))), lambda m: m["corners"]).alias("footprint"))
    groups = result.clusters.join(footprints, "cluster_id").withColumn("area_ha", F.round("area_ha", 3)).withColumn("place", F.struct("lat", "lon"))
    read = lambda df, column="value": [json.loads(r[column]) for r in df.collect()]
    named = ["candidate_id", "cluster_id", "raw_score", "adjusted_score", "confidence", "reasons", "landscape", "sensitivity", "tags", "source_dates", "red_zone_names", "coverage_fraction"]
    of_cluster = ["cluster_id", "member_ids", "member_count", "cluster_score", "max_adjusted_score", "mean_adjusted_score", "confidence", "dominant_landscape", "sensitivity", "top_candidate_id", "area_ha", "red_zone_names", "tags", "reasons", "source_dates"]
    raw = read(to_json_rows(raw_candidates(result, shown).orderBy(*best).drop("seq", "adjusted_score")))
    ranked = read(to_json_rows(result.ranked.orderBy(*best).drop("seq")))
    clusters = read(to_json_rows(groups.orderBy(*first).select(*of_cluster, "lat", "lon", "location_mode")))
    marks = [r | {"lat": (p or {}).get("lat"), "lon": (p or {}).get("lon")} for r in ranked for p in [r["exact_location"] if result.mode == "authorized" else r["public_location"]]]
    drawn = read(to_json_rows(zones.select("name", "min_lat", "max_lat", "min_lon", "max_lon"))) if zones is not None and result.mode == "authorized" else []
    counts = {
        "permit_mode": result.mode, "total_tiles": result.total_tiles, "processed_tiles": result.processed_tiles, "ranked_candidates": len(ranked), "clusters": len(clusters),
        "largest_cluster_member_count": max((c["member_count"] for c in clusters), default=0), "top_cluster_id": clusters[0]["cluster_id"] if clusters else None, "top_cluster_score": clusters[0]["cluster_score"] if clusters else None,
    }
    dump = lambda x: json.dumps(x, indent=2, ensure_ascii=False)
    collection = lambda rows: dump({"type": "FeatureCollection", "features": rows})
    texts = {
        "raw_candidates.json": dump(raw), "ranked_candidates.json": dump(ranked), "ranked_candidates.geojson": collection(read(placed_features(shown, result.mode, "place", "footprint", named).orderBy(*best), "feature")),
        "ranked_clusters.json": dump(clusters), "ranked_clusters.geojson": collection(read(placed_features(groups, result.mode, "place", "footprint", of_cluster).orderBy(*first), "feature")),
        "review_map.html": review_map(result.mode, area, marks, clusters, drawn), "analysis_summary.json": dump(counts), "analysis_report.md": report(result, area, clusters, len(ranked), len(clusters)),
    }
    out = Path(folder)
    out.mkdir(parents=True, exist_ok=True)
    for name, text in texts.items():
        (out / name).write_text(text, encoding="utf-8")
    return {name: str(out / name) for name in texts}


def write_bundle(folder: str, mode: str, ranked: DataFrame, clusters: DataFrame, total_tiles: int, processed_tiles: int, max_rows: int | None = None) -> dict[str, str]:
    """Ranked and cluster JSON, GeoJSON, summary, report and map in a local folder.

    All rows that the caller passes are written, by the driver; max_rows, where given, bounds ranked rows and clusters.
    """
    best = ranked.orderBy(F.desc("adjusted_score"), "seq")
    groups = clusters.orderBy(F.desc("cluster_score"), "first_seq")
    if max_rows is not None:
        best, groups = best.limit(max_rows), groups.limit(max_rows)
    out = Path(folder)
    out.mkdir(parents=True, exist_ok=True)
    rows = [json.loads(r["value"]) for r in to_json_rows(best.drop("seq")).collect()]
    groups = [json.loads(r["value"]) for r in to_json_rows(groups.drop("first_seq", "component")).collect()]
    shapes = [json.loads(r["feature"]) for r in features(best).collect()]
    counts = json.loads(to_json_rows(summary(mode, total_tiles, processed_tiles, ranked, clusters)).first()["value"])
    report = ["# Analysis report", "", f"- Permit mode: `{mode}`", f"- Tiles processed: `{processed_tiles}` / `{total_tiles}`", f"- Ranked candidates: `{counts['ranked_candidates']}`", f"- Clusters: `{counts['clusters']}`", "", "## Top clusters", ""]
    for g in groups[:10]:
        report += [f"### {g['cluster_id']}", "", f"- Score: `{g['cluster_score']:.3f}` ({g['confidence']})", f"- Members: `{g['member_count']}`", *[f"  - {x}" for x in g["reasons"]], ""]
    listed = "".join(f"<li>{escape(r['candidate_id'])}: {r['adjusted_score']:.4f} ({escape(r['confidence'])})</li>" for r in rows)
    files = {
        "ranked.json": json.dumps(rows, indent=2, ensure_ascii=False), "clusters.json": json.dumps(groups, indent=2, ensure_ascii=False),
        "ranked.geojson": json.dumps({"type": "FeatureCollection", "features": shapes}, ensure_ascii=False), "summary.json": json.dumps(counts, indent=2),
        "report.md": "\n".join(report).strip() + "\n", "map.html": f"<!DOCTYPE html><meta charset=utf-8><title>Review</title><ul>{listed}</ul>",
    }
    for name, text in files.items():
        (out / name).write_text(text, encoding="utf-8")
    return {name: str(out / name) for name in files}
