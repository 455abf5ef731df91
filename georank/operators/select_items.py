"""Catalog selection: rules, asset matching, items with all asset groups, newest or clearest first."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from georank.functions.text import alias_key, property_kind, property_value, rule
from georank.operators.cluster import per_group_top
from georank.recipe import Series


def find_asset(assets: DataFrame, aliases: dict[str, list[str]]) -> DataFrame:
    """(item_id, group, key, href): each group's asset of each item, from rows (item_id, ord, key, title, bands, href).

    First the exact key in alias order; else the first asset, then alias, that matches loosely: equal keys, a title
    that contains the alias, or a band of that name, all by letters and digits. Of assets of one place the least key, then href.
    """
    # Names are normalized once for each asset; groups are tested in place, and one aggregate an item finds all.
    named = assets.where(F.col("href").isNotNull()).select(
        "item_id", "ord", "key", "href", alias_key(F.col("key")).alias("k"), alias_key(F.col("title")).alias("t"), F.transform("bands", alias_key).alias("b")
    )
    first = []
    for i, (group, names) in enumerate(aliases.items()):
        known = F.array(*[F.lit(n) for n in names]) if names else F.array().cast("array<string>")
        listed = F.array(*[F.struct(F.lit(n).alias("alias_ord"), F.lit("".join(c for c in a.lower() if c.isalnum())).alias("a")) for n, a in enumerate(names)])
        matched = F.filter(listed, lambda w: (F.col("k") == w["a"]) | F.coalesce(F.contains(F.col("t"), w["a"]), F.lit(False)) | F.coalesce(F.array_contains("b", w["a"]), F.lit(False))) if names else F.array()
        exact = F.array_position(known, F.col("key"))
        order = F.when(exact > 0, F.struct(F.lit(0).alias("p"), exact.cast("long").alias("x"), F.col("ord").cast("long").alias("y"), "key", "href")).when(
            F.size(matched) > 0, F.struct(F.lit(1).alias("p"), F.col("ord").cast("long").alias("x"), F.get(matched, F.lit(0))["alias_ord"].cast("long").alias("y"), "key", "href")
        ) if names else F.lit(None).cast("struct<p:int,x:bigint,y:bigint,key:string,href:string>")
        first.append(F.struct(F.lit(group).alias("group"), F.min(order).alias("m")).alias(f"g{i}"))
    found = named.groupBy("item_id").agg(*first)
    return found.select("item_id", F.explode(F.array(*[f"g{i}" for i in range(len(first))])).alias("g")).where("g.m is not null").select("item_id", "g.group", "g.m.key", "g.m.href")


def with_all_groups(found: DataFrame, groups: int, items: DataFrame | None = None) -> DataFrame:
    """Items for which every group found an asset; with no groups all items (item_id) stay."""
    if groups == 0:
        if items is None:
            raise ValueError("without groups the items themselves are needed")
        return items.select("item_id").distinct()
    return found.groupBy("item_id").agg(F.count_distinct("group").alias("n")).where(F.col("n") == groups).select("item_id")


def pick(items: DataFrame, series: str, sort: Column, descending: bool, seq: str, k: int) -> DataFrame:
    """The first k items of each series; a null key comes last ascending and first descending, ties by seq."""
    key = sort.desc_nulls_first() if descending else sort.asc_nulls_last()
    return per_group_top(items, series, [key, F.col(seq)], k)


def _property(name: str, kind: str) -> Column:
    """A property of an item, the item's own time for datetime."""
    if name == "datetime":
        return F.col("datetime") if kind == "string" else F.lit(None).cast(kind)
    return property_value(F.col("properties"), name, kind)


def select_series(items: DataFrame, name: str, series: Series, box: tuple[float, float, float, float] | None = None) -> DataFrame:
    """A series' items with found (group, key, href): those of its collection, time and box that meet its rules and have all asset groups.

    At most max_items in its order: by time or a property, numbers as numbers, missing last ascending and first
    descending, ties in catalog order. A disabled series has none. datetime is a time, or start/end with .. for open.
    """
    rows = items.where(F.lit(series.enabled) & (F.col("collection") == series.collection))
    if series.datetime:
        start, _, stop = series.datetime.partition("/")
        at = F.try_to_timestamp("datetime")
        for bound, test in ((start, lambda b: at >= b), (stop or start, lambda b: at <= b)):
            if bound not in ("", ".."):
                rows = rows.where(F.coalesce(test(F.try_to_timestamp(F.lit(bound))), F.lit(False)))
    if box is not None:
        west, south, east, north = box
        rows = rows.where(F.coalesce((F.get("bbox", F.lit(0)) <= east) & (F.get("bbox", F.lit(2)) >= west) & (F.get("bbox", F.lit(1)) <= north) & (F.get("bbox", F.lit(3)) >= south), F.lit(True)))
    for r in series.filters:
        rows = rows.where(rule(_property(r.property, "string"), _property(r.property, "double"), r.eq, r.ne, r.lte, r.gte, r.contains, property_kind(F.col("properties"), r.property)))
    assets = rows.select("item_id", F.explode("assets").alias("a")).select("item_id", "a.*")
    groups = series.asset_groups
    if groups:
        found = find_asset(assets, groups)
        held = found.groupBy("item_id").agg(F.array_sort(F.collect_list(F.struct("group", "key", "href"))).alias("found")).where(F.size("found") == len(groups))
        rows = rows.join(held, "item_id")
    else:
        rows = rows.withColumn("found", F.array().cast("array<struct<group: string, key: string, href: string>>"))
    if series.sort_by == "datetime":
        key = F.struct(F.try_to_timestamp("datetime").alias("a"), F.lit(None).cast("string").alias("b"))
        missing = F.try_to_timestamp("datetime").isNull()
    else:
        number, text = _property(series.sort_by, "double"), _property(series.sort_by, "string")
        key, missing = F.struct(number.alias("a"), text.alias("b")), text.isNull()
    ordered = [missing.asc(), key.asc()] if series.sort_ascending else [missing.desc(), key.desc()]
    return rows.orderBy(*ordered, "seq").limit(series.max_items).withColumn("series", F.lit(name))


def dissolve(features: DataFrame, key: Column) -> DataFrame:
    """One row for each key, in order of its first feature: name and category of that one, count and names by idx."""
    return features.withColumn("key", key).groupBy("key").agg(
        F.min("idx").alias("first_idx"), F.min_by("name", "idx").alias("name"), F.min_by("category", "idx").alias("category"), F.count("*").alias("source_count"),
        F.transform(F.array_sort(F.collect_list(F.struct("idx", "name"))), lambda x: x["name"]).alias("source_names"),
    )
