"""Connected components of large graphs by alternating star contractions."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def star_round(edges: DataFrame) -> DataFrame:
    """One large-star and one small-star step over edges (hi, lo), hi > lo."""
    both = edges.select(F.col("hi").alias("u"), F.col("lo").alias("v")).union(
        edges.select(F.col("lo").alias("u"), F.col("hi").alias("v"))
    )
    least = both.groupBy("u").agg(F.min("v").alias("m"))
    # Large star: every larger neighbour of u points to the least of u and its neighbours.
    large = (
        edges.select(F.col("lo").alias("u"), F.col("hi").alias("v"))
        .join(least, "u")
        .select(F.col("v").alias("hi"), F.least("u", "m").alias("lo"))
        .distinct()
    )
    # Small star: u and its smaller neighbours point to the least of them.
    low = large.groupBy("hi").agg(F.min("lo").alias("m"))
    joined = large.join(low, "hi")
    return (
        joined.select(F.explode(F.array(F.struct(F.col("lo").alias("hi"), F.col("m").alias("lo")), F.struct("hi", F.col("m").alias("lo")))).alias("e"))
        .select("e.hi", "e.lo")
        .where("hi > lo")
        .distinct()
    )


def components(edges: DataFrame, keep: Callable[[DataFrame], DataFrame], drop: Callable[[DataFrame], None] = lambda _: None) -> DataFrame:
    """Connected components of edges (a bigint, b bigint): rows (node, component), component the least node.

    Only nodes with an edge to another node appear; component itself appears too. Rounds, each a few shuffles over at
    most as many edges as given, until nothing changes. keep writes a round's edges to storage that outlives executors
    and reads them back, drop deletes what the last round kept. Null ends and loops are ignored; repeated edges count once.
    """
    now = keep(edges.where("a <> b").select(F.greatest("a", "b").alias("hi"), F.least("a", "b").alias("lo")).distinct())
    seen = None
    while True:
        n, sign = now.agg(F.count("*"), F.bit_xor(F.xxhash64("hi", "lo"))).first()
        if not n or (n, sign) == seen:
            break
        seen = (n, sign)
        last, now = now, keep(star_round(now))
        drop(last)
    roots = now.select(F.col("lo").alias("node"), F.col("lo").alias("component")).distinct()
    return now.select(F.col("hi").alias("node"), F.col("lo").alias("component")).union(roots)
