"""Rasters as pixel tables (layer, row, col, value): cell statistics over time, zonal statistics, stretch, slope, masks."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window

from georank.functions.scoring import clamp01


def ndvi(red: Column, nir: Column) -> Column:
    """Null where the bands' sum is about 0."""
    return F.when(F.abs(nir + red) > 1e-6, F.try_divide(nir - red, nir + red))


def to_db(x: Column) -> Column:
    return F.when(x > 0, 10 * F.log10(x))


def mosaic(pixels: DataFrame) -> DataFrame:
    """Mean over layers by cell, nulls left out."""
    return pixels.groupBy("row", "col").agg(F.avg("value").alias("value"))


def quality(pixels: DataFrame, empty_is_null: bool) -> DataFrame:
    """Share of layers with a value by cell; a cell without any is null (context variant) or 0 (ingest variant)."""
    share = F.count("value") / F.count("*")
    return pixels.groupBy("row", "col").agg((F.when(F.count("value") > 0, share) if empty_is_null else share).alias("quality"))


def zonal(pixels: DataFrame, zone: str) -> DataFrame:
    """Exact statistics by zone."""
    p = lambda q: F.percentile("value", F.lit(q))
    return pixels.groupBy(zone).agg(
        F.count("value").alias("n"), F.avg("value").alias("mean"), F.stddev_pop("value").alias("std"), p(0.05).alias("p5"), p(0.5).alias("median"), p(0.9).alias("p90"), p(0.95).alias("p95"),
        F.min("value").alias("least"), F.max("value").alias("most"),
    )


def robust_strength(pixels: DataFrame, zone: str, z_cap: float = 6.0, min_pixels: int = 20) -> DataFrame:
    """p95 of |robust z| over its cap by zone; the scale is 1.4826 MAD, or the deviation where that is about 0."""
    med = pixels.groupBy(zone).agg(F.percentile("value", F.lit(0.5)).alias("med"), F.stddev_pop("value").alias("std"))
    centred = pixels.join(med, zone).withColumn("dev", F.abs(F.col("value") - F.col("med")))
    scale = centred.groupBy(zone).agg(F.percentile("dev", F.lit(0.5)).alias("mad"), F.percentile("dev", F.lit(0.95)).alias("p95"), F.first("std").alias("std"), F.count("value").alias("n"))
    s = F.greatest(F.when(F.col("mad") > 1e-6, 1.4826 * F.col("mad")).otherwise(F.col("std") + 1e-6), F.lit(1e-6))
    return scale.select(zone, F.when(F.col("n") < min_pixels, 0.0).otherwise(clamp01(F.col("p95") / s / z_cap)).alias("strength"))


def stretch(pixels: DataFrame, zone: str, min_pixels: int = 20) -> DataFrame:
    """Values stretched from p5..p95 to 0..1 by zone; zones of few pixels give 0, nulls the stretched median."""
    lim = pixels.groupBy(zone).agg(
        F.percentile("value", F.lit(0.05)).alias("lo"), F.percentile("value", F.lit(0.95)).alias("hi"), F.percentile("value", F.lit(0.5)).alias("med"), F.count("value").alias("n")
    )
    v = F.coalesce("value", "med")
    out = F.when((F.col("n") < min_pixels) | (F.col("hi") <= F.col("lo")), 0.0).otherwise(clamp01(F.try_divide(v - F.col("lo"), F.col("hi") - F.col("lo"))))
    return pixels.join(lim, zone).withColumn("stretched", out).drop("lo", "hi", "med", "n")


def mean_probability(pixels: DataFrame, zone: str) -> DataFrame:
    """Mean by zone: clipped to 0..1 where all values are near that range, else of the p5..p95 stretch; null below 10 pixels."""
    lim = pixels.groupBy(zone).agg(
        F.percentile("value", F.lit(0.05)).alias("lo"), F.percentile("value", F.lit(0.95)).alias("hi"), F.min("value").alias("mn"), F.max("value").alias("mx"), F.count("value").alias("n")
    )
    v = F.when((F.col("mn") >= -0.05) & (F.col("mx") <= 1.05), clamp01(F.col("value"))).otherwise(
        F.when(F.col("hi") <= F.col("lo"), 0.0).otherwise(clamp01(F.try_divide(F.col("value") - F.col("lo"), F.col("hi") - F.col("lo"))))
    )
    return pixels.join(lim, zone).groupBy(zone).agg(F.when(F.count("value") >= 10, F.avg(v)).alias("probability"))


def forest_fraction(pixels: DataFrame, zone: str) -> DataFrame:
    return pixels.groupBy(zone).agg(F.avg((F.col("value") > 0.5).cast("double")).alias("forest"))


def persistence(hits: DataFrame, zone: str) -> DataFrame:
    """p90 over cells of the share of dates that hit, cells without a hit left out; 0 without any. hits: zone, row, col, hit."""
    share = hits.groupBy(zone, "row", "col").agg(F.avg(F.col("hit").cast("double")).alias("share"))
    return share.groupBy(zone).agg(F.coalesce(F.percentile(F.when(F.col("share") > 0, F.col("share")), F.lit(0.9)), F.lit(0.0)).alias("persistence"))


def iou_match(a: Column, b: Column) -> Column:
    """Aggregate: twice the intersection over union of two boolean masks, at most 1."""
    both = F.sum((a & b).cast("long"))
    either = F.sum((a | b).cast("long"))
    return F.coalesce(clamp01(2.0 * F.try_divide(both, either)), F.lit(0.0))


def gradient(pixels: DataFrame, layer: str, dx: float, dy: float) -> DataFrame:
    """Slope in degrees by central differences, one-sided at edges; cells sit next to each other in row and col."""
    def diff(along: str, across: str, step: float) -> Column:
        w = Window.partitionBy(layer, across).orderBy(along)
        before, after = F.lag("value").over(w), F.lead("value").over(w)
        v = F.col("value")
        return F.when(before.isNull(), (after - v) / step).when(after.isNull(), (v - before) / step).otherwise((after - before) / (2 * step))

    return pixels.withColumn("gy", diff("row", "col", dy)).withColumn("gx", diff("col", "row", dx)).withColumn("slope", F.degrees(F.atan(F.hypot(F.col("gx"), F.col("gy")))))


def box_residual(pixels: DataFrame, layer: str, reach: int = 1) -> DataFrame:
    """Value minus the mean of its row neighbours within reach, the one-dimensional form of a local residual."""
    w = Window.partitionBy(layer, "row").orderBy("col").rowsBetween(-reach, reach)
    return pixels.withColumn("residual", F.col("value") - F.avg("value").over(w))


def nearest_seed(pixels: DataFrame, seeds: DataFrame, layer: str, scale: float) -> DataFrame:
    """exp(-distance / scale) to the nearest seed cell of the same layer, seeds being cells of pixels; layers without seeds are left out.

    Exact in two passes: the nearest seed of each cell's column, then the best column of each cell's row, so a cell meets
    its row and not all seeds.
    """
    marked = pixels.select(layer, "row", "col").join(seeds.select(layer, "row", "col", F.col("row").alias("at")), [layer, "row", "col"], "left")
    w = Window.partitionBy(layer, "col").orderBy("row")
    above = F.last("at", ignorenulls=True).over(w.rowsBetween(Window.unboundedPreceding, 0))
    below = F.first("at", ignorenulls=True).over(w.rowsBetween(0, Window.unboundedFollowing))
    gaps = marked.withColumn("gap", F.least(F.col("row") - above, below - F.col("row")))
    columns = gaps.where("gap is not null").select(layer, "row", F.col("col").alias("c"), "gap")
    square = F.pow(F.col("col") - F.col("c"), F.lit(2)) + F.pow("gap", F.lit(2))
    return gaps.select(layer, "row", "col").join(columns, [layer, "row"]).groupBy(layer, "row", "col").agg(F.exp(-F.sqrt(F.min(square)) / scale).alias("proximity"))
