"""Tiling: square tiles over bounds or a ring, half-open lattice, coverage, numbering of kept tiles."""

from __future__ import annotations

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import Window

from georank.functions.geo import rect_coverage
from georank.shipping import ship

Ring = list[tuple[float, float]]


def clip_area(ring: Ring, x0: float, y0: float, size: float) -> float:
    """Area of a ring inside a square, by clipping it on each side."""
    def cut(points: Ring, axis: int, bound: float, keep_above: bool) -> Ring:
        out: Ring = []
        for a, b in zip(points, points[1:] + points[:1]):
            ins_a, ins_b = ((p[axis] >= bound) == keep_above or p[axis] == bound for p in (a, b))
            if ins_a:
                out.append(a)
            if ins_a != ins_b:
                t = (bound - a[axis]) / (b[axis] - a[axis])
                out.append((a[0] + t * (b[0] - a[0]), a[1] + t * (b[1] - a[1])))
        return out

    points = list(ring)
    for axis, bound, above in ((0, x0, True), (0, x0 + size, False), (1, y0, True), (1, y0 + size, False)):
        points = cut(points, axis, bound, above)
        if not points:
            return 0.0
    return abs(sum(a[0] * b[1] - b[0] * a[1] for a, b in zip(points, points[1:] + points[:1]))) / 2


def lattice(spark: SparkSession, minx: float, miny: float, maxx: float, maxy: float, size: float, step: float | None = None) -> DataFrame:
    """(ix, iy, x0, y0) of all tiles that start inside the half-open bounds; the lattice is generated on executors."""
    step = step or size
    if size <= 0 or step <= 0:
        raise ValueError("tile size and step must be positive")
    nx, ny = (max(0, -int(-(b - a) // step)) for a, b in ((minx, maxx), (miny, maxy)))
    cells = spark.range(nx * ny)
    ix, iy = F.floor(F.col("id") / max(ny, 1)), F.col("id") % max(ny, 1)
    return cells.select(ix.alias("ix"), iy.alias("iy"), (F.lit(float(minx)) + ix * step).alias("x0"), (F.lit(float(miny)) + iy * step).alias("y0"))


def tile_aoi(spark: SparkSession, ring: Ring, size: float, step: float | None = None, min_coverage: float = 0.2, more: tuple[Ring, ...] = (), holes: tuple[Ring, ...] = ()) -> DataFrame:
    """Tiles over a ring in metres: tile_id, x0, y0, size, coverage. Ids number the kept tiles, x outer, y inner.

    more are further rings of the area, holes those that are cut out of it; rings of a kind don't overlap.
    """
    xs, ys = ([p[i] for r in (ring, *more) for p in r] for i in (0, 1))
    grid = lattice(spark, min(xs), min(ys), max(xs), max(ys), size, step)
    rectangle = not more and not holes and len(ring) == 4 and len(set(xs)) == 2 and len(set(ys)) == 2
    if rectangle:
        coverage = rect_coverage(F.col("x0"), F.col("y0"), size, min(xs), min(ys), max(xs), max(ys))
    else:
        ship(spark)

        @F.pandas_udf("double")
        def share(x0: pd.Series, y0: pd.Series) -> pd.Series:
            return pd.Series([(sum(clip_area(r, a, b, size) for r in (ring, *more)) - sum(clip_area(r, a, b, size) for r in holes)) / max(size * size, 1.0) for a, b in zip(x0, y0)], dtype=float)

        coverage = share.asNondeterministic()("x0", "y0")  # so that the filter doesn't run it a second time
    kept = grid.withColumn("coverage", coverage).where(F.col("coverage") >= min_coverage)
    # Kept tiles before a column come from counts by column; within a column tiles are numbered on their own.
    by_column = kept.groupBy("ix").agg(F.count("*").alias("n"))
    before = by_column.select("ix", (F.sum("n").over(Window.orderBy("ix")) - F.col("n")).alias("before"))
    number = F.row_number().over(Window.partitionBy("ix").orderBy("iy")) - 1
    return kept.join(before, "ix").withColumn("seq", F.col("before") + number).select("seq", F.format_string("tile-%05d", F.col("seq") + 1).alias("tile_id"), "x0", "y0", F.lit(float(size)).alias("size"), "coverage")
