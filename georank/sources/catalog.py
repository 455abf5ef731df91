"""Scene catalogs: pages of items as JSON, one page or item a line or a file."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

_BAND = "struct<name: string, common_name: string>"
_ASSET = f"struct<href: string, title: string, `eo:bands`: array<{_BAND}>, bands: array<{_BAND}>>"
_ITEM = f"struct<id: string, collection: string, bbox: array<double>, geometry: string, properties: string, assets: map<string, {_ASSET}>>"


def read_items(spark: SparkSession, path: str, whole_files: bool = False) -> DataFrame:
    """Items (seq, item_id, collection, datetime, bbox, geometry, properties as JSON, assets) of pages in file and line order.

    A line (or file) is a page with ``features`` or an item. An item that repeats an id within its collection counts once,
    the first one. assets are (ord, key, title, bands, href) in the order given, hrefs without file://.
    """
    lines = spark.read.text(path, wholetext=whole_files).where(F.length(F.trim("value")) > 0)
    return items_of(lines.select("value", F.input_file_name().alias("file"), F.monotonically_increasing_id().alias("line")))


def items_of(lines: DataFrame) -> DataFrame:
    """Items, as read_items gives them, of lines (value, file, line), each a page or an item, in order of file and line."""
    page = F.from_json("value", f"struct<features: array<{_ITEM}>>")["features"]
    items = lines.select("file", "line", F.posexplode(F.coalesce(page, F.array(F.from_json("value", _ITEM)))).alias("at", "i")).where("i.id is not null")
    order = F.struct("file", "line", "at")
    first = items.groupBy("i.id", "i.collection").agg(F.min(order).alias("o"), F.min_by("i", order).alias("i"))
    bands = lambda a: F.flatten(F.transform(F.concat(F.coalesce(a["eo:bands"], F.array().cast(f"array<{_BAND}>")), F.coalesce(a["bands"], F.array().cast(f"array<{_BAND}>"))), lambda b: F.array_compact(F.array(b["name"], b["common_name"]))))
    assets = F.transform(F.map_entries("i.assets"), lambda e, n: F.struct(
        n.alias("ord"), e["key"].alias("key"), e["value"]["title"].alias("title"), bands(e["value"]).alias("bands"), F.regexp_replace(e["value"]["href"], "^file://", "").alias("href")
    ))
    numbered = first.select(
        F.struct("o.file", "o.line", "o.at").alias("seq"), F.col("i.id").alias("item_id"), F.col("i.collection").alias("collection"), F.get_json_object("i.properties", "$.datetime").alias("datetime"),
        F.col("i.bbox").alias("bbox"), F.col("i.geometry").alias("geometry"), F.col("i.properties").alias("properties"), assets.alias("assets"),
    )
    return numbered
