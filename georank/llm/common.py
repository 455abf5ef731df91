"""Shared helpers: stage tables in the cluster's shared folder, dense global indexes, sized joins, components."""

from __future__ import annotations

import re
import tempfile
import uuid
from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import Window

from georank.operators import graph
from georank.shipping import ship as ship  # noqa: PLC0414  (for the queries and the pipeline)

#: A word, as the query contracts define it.
WORD = r"[^\x20\x09-\x0D]+"

#: Rows up to which a lookup table is broadcast; a larger one is joined by a shuffle.
BROADCAST_ROWS = 20_000

_MID_BITS = 33  # monotonically_increasing_id keeps the row number in the low 33 bits


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share: spark.checkpoint.dir, or one of our own where that is unset and all run in one process."""
    folder = spark.conf.get("spark.checkpoint.dir", None)
    if not folder:
        if not re.fullmatch(r"local(\[[^\]]*\])?", spark.sparkContext.master):
            raise RuntimeError("set spark.checkpoint.dir to a folder that driver and executors share")
        folder = tempfile.mkdtemp(prefix="georank-")
        spark.conf.set("spark.checkpoint.dir", folder)
    return folder.rstrip("/")


def materialize(df: DataFrame, name: str) -> DataFrame:
    """Write df as a table in the shared folder and read it back: lineage ends there and any executor may be lost.

    The path is drop_table()'s argument and is kept as the attribute ``stage_path``.
    """
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/georank/{name}-{uuid.uuid4().hex}"
    df.write.option("compression", "zstd").parquet(path)
    out = spark.read.schema(df.schema).parquet(path)
    out.stage_path = path
    return out


def drop_table(df: DataFrame) -> None:
    """Delete a table that materialize() wrote and that nothing reads any more."""
    spark = df.sparkSession
    path = spark._jvm.org.apache.hadoop.fs.Path(df.stage_path)
    path.getFileSystem(spark._jsc.hadoopConfiguration()).delete(path, True)


def partitions(spark: SparkSession) -> int:
    return int(spark.conf.get("spark.sql.shuffle.partitions"))


def global_index(df: DataFrame, order: Sequence[Column], out: str, name: str) -> DataFrame:
    """Add the row's dense position (from 0) in the given order, without gathering rows in one task.

    Rows are range-partitioned and sorted, written once, and numbered by partition offset plus place.
    Only one count for each partition reaches the driver. Ties are numbered in an arbitrary but fixed order.
    """
    spark = df.sparkSession
    placed = df.repartitionByRange(partitions(spark), *order).sortWithinPartitions(*order)
    table = materialize(placed.withColumn("__mid", F.monotonically_increasing_id()), name)
    part = F.shiftright("__mid", _MID_BITS)
    counts = {r["p"]: r["n"] for r in table.groupBy(part.alias("p")).agg(F.count("*").alias("n")).collect()}
    starts, total = [], 0
    for p in range(max(counts, default=-1) + 1):
        starts.append(total)
        total += counts.get(p, 0)
    offsets = F.split(F.lit(",".join(map(str, starts or [0]))), ",").cast("array<bigint>")
    place = F.col("__mid").bitwiseAND(F.lit((1 << _MID_BITS) - 1))
    return table.withColumn(out, F.get(offsets, part.cast("int")) + place).drop("__mid")


def lookup_join(big: DataFrame, small: DataFrame, on, rows: int, how: str = "inner") -> DataFrame:
    """Join a lookup table of a known row count: broadcast up to BROADCAST_ROWS rows, shuffled beyond."""
    return big.join(F.broadcast(small) if rows <= BROADCAST_ROWS else small, on, how)


def least_hashes(rows: DataFrame, by: str, n: int, name: str) -> DataFrame:
    """The n rows of each value of ``by`` (not null) with the least hash in column h; ties at the end are cut at will.

    Hashes are counted by their upper 16 bits first, so that only the rows up to the bucket of the n-th travel, not
    whole groups. What reaches one task is a count for each bucket, or n rows and a bucket's more.
    """
    bucket = F.shiftright("h", 48)
    counts = rows.groupBy(by, bucket.alias("__b")).agg(F.count("*").alias("__n"))
    before = F.sum("__n").over(Window.partitionBy(by).orderBy("__b")) - F.col("__n")
    last = materialize(counts.withColumn("__before", before).where(F.col("__before") < n).groupBy(by).agg(F.max("__b").alias("__last")), f"{name}-cutoffs")
    near = lookup_join(rows, last, by, last.count()).where(bucket <= F.col("__last"))
    placed = near.withColumn("__place", F.row_number().over(Window.partitionBy(by).orderBy("h")))
    return placed.where(F.col("__place") <= n).select(*rows.columns)


def components(edges: DataFrame, name: str = "components") -> DataFrame:
    """graph.components over tables in the shared folder; a round's table goes when the next is written."""
    return graph.components(edges, lambda df: materialize(df, name), drop_table)
