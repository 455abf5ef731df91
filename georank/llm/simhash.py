"""SimHash near-duplicates by meet-in-the-middle ball hashing: every fingerprint emits its half-radius ball.

near_duplicates links 64-bit fingerprints of word shingles within a radius. keep_first is for copies of a shingle
similarity of 0.8 or more: such pairs differ in about ten of 64 bits of shingle fingerprints, whose balls are far too large,
so it finds candidates by wide fingerprints of the texts' words, in which they are close, and verifies shingle sketches.
"""

from __future__ import annotations

import math
from itertools import combinations

import numpy as np
import pandas as pd
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from georank.llm.common import components, materialize, partitions

BITS = 64
HASH_SEED = 42
RADIUS = 2
#: Wide fingerprints: blocks of 32 bits, radius within a block, longs of a shingle sketch.
BLOCKS, BLOCK_BITS, BLOCK_RADIUS, SKETCH_LONGS = 4, 32, 2, 8
#: Classes of a centre that one row is held against.
CHUNK = 512


def shingle_hashes(text: str | None, size: int) -> np.ndarray:
    """XXH64 of each run of ``size`` words, repeats included; of all words if there are fewer; none without words.

    A-Z are lower-cased, other letters stay; words end at ASCII white space.
    """
    words = (text or "").encode("utf-8", "surrogatepass").lower().split()
    if not words:
        return np.empty(0, np.uint64)
    joined = b" ".join(words)
    if len(words) <= size:
        return np.array([xxhash.xxh64_intdigest(joined, HASH_SEED)], np.uint64)
    ends = np.cumsum([len(w) + 1 for w in words])
    starts = [0, *ends[:-size].tolist()]
    stops = (ends[size - 1 :] - 1).tolist()
    digest = xxhash.xxh64_intdigest
    return np.array([digest(joined[a:b], HASH_SEED) for a, b in zip(starts, stops)], np.uint64)


def simhash(hashes: np.ndarray) -> int:
    """The signed 64-bit fingerprint whose bit is 1 where over half of the hashes have it; 0 for none."""
    if not len(hashes):
        return 0
    ones = np.zeros(BITS, np.int64)
    for i in range(0, len(hashes), 1 << 16):  # bounded memory for very long texts
        part = hashes[i : i + (1 << 16)]
        ones += np.unpackbits(part.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(axis=0, dtype=np.int64)
    return int(np.packbits(ones * 2 > len(hashes), bitorder="little").view(np.int64)[0])


def fingerprints(docs: DataFrame, shingle: int, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Rows (doc_id, fp bigint) for every row; null, empty and word-free texts get 0; other columns are ignored."""

    @F.pandas_udf("bigint")
    def fp(texts: pd.Series) -> pd.Series:
        return pd.Series([simhash(shingle_hashes(t, shingle)) for t in texts], dtype="int64")

    return docs.select(F.col(id_col).alias("doc_id"), fp(F.col(text_col)).alias("fp"))


def ball_masks(radius: int) -> list[int]:
    """Signed XOR masks of all fingerprints within a radius, the centre first."""
    masks = [sum(1 << b for b in bits) for k in range(radius + 1) for bits in combinations(range(BITS), k)]
    return [m - (1 << BITS) if m >> (BITS - 1) else m for m in masks]


def fingerprint_links(fps: DataFrame, radius: int = RADIUS) -> DataFrame:
    """Edges (a, b) that connect exactly what distances <= radius connect, from distinct fingerprints (fp).

    Each fingerprint emits the centres within ceil(radius / 2) of it; two fingerprints within the radius share a
    centre. At a centre the least member of the inner ball is linked to each other member: both lie within
    floor + ceil = radius, and the distance is verified. So links grow with the members, not with their pairs,
    and a centre has at most one member for each mask, however many documents share a fingerprint.
    """
    inner, outer = radius // 2, (radius + 1) // 2
    masks = ball_masks(outer)
    n_inner = len(ball_masks(inner))
    ball = F.posexplode(F.from_json(F.lit(str(masks)), "array<bigint>"))
    variants = fps.select("fp", ball.alias("__k", "__mask")).select(
        "fp", F.col("fp").bitwiseXOR(F.col("__mask")).alias("centre"), (F.col("__k") < n_inner).alias("inner")
    )
    # One aggregate for each centre; most centres have a single member and end here.
    met = variants.groupBy("centre").agg(
        F.min(F.when(F.col("inner"), F.col("fp"))).alias("hub"), F.collect_list("fp").alias("members")
    ).where((F.size("members") > 1) & F.col("hub").isNotNull())
    pairs = met.select(F.col("hub").alias("a"), F.explode("members").alias("b")).where("a <> b")
    return pairs.where(F.bit_count(F.col("a").bitwiseXOR(F.col("b"))) <= radius).distinct()


def near_duplicates(docs: DataFrame, shingle: int = 3, radius: int = RADIUS, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row for each row of docs: doc_id, fp, component_id (smallest doc_id reachable over links, null ids last).

    Documents with equal fingerprints are linked, word-free ones with each other too. Copies share one fingerprint
    row, so a group of any size emits one ball. Rows that repeat an id give rows that repeat it.
    """
    rows = materialize(fingerprints(docs, shingle, id_col, text_col), "fingerprints")
    classes = materialize(rows.groupBy("fp").agg(F.min("doc_id").alias("first_id")), "fingerprint-classes")
    linked = components(fingerprint_links(classes.select("fp"), radius), "simhash-components")
    joined = classes.join(linked.withColumnRenamed("node", "fp"), "fp", "left").withColumn("component", F.coalesce("component", "fp"))
    least = joined.groupBy("component").agg(F.min("first_id").alias("component_id"))
    named = joined.join(least, "component").select("fp", "component_id")
    return rows.join(named, "fp").select("doc_id", "fp", "component_id")


def _more_bits(hashes: np.ndarray, longs: int) -> np.ndarray:
    """(hashes, longs): further 64-bit hashes of each hash, the first being itself."""
    out = [hashes]
    with np.errstate(over="ignore"):
        for k in range(1, longs):
            x = hashes + np.uint64(0x9E3779B97F4A7C15 * k & (1 << 64) - 1)
            x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
            x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
            out.append(x ^ (x >> np.uint64(31)))
    return np.stack(out, axis=1)


def wide_simhash(hashes: np.ndarray, longs: int) -> np.ndarray:
    """The simhash of a set of hashes in 64-bit parts (signed), of bits of several hashes each; zeros for none."""
    ones = np.zeros(BITS * longs, np.int64)
    for i in range(0, len(hashes), 1 << 12):  # bounded memory for very long texts
        part = np.ascontiguousarray(_more_bits(hashes[i : i + (1 << 12)], longs))
        ones += np.unpackbits(part.view(np.uint8).reshape(len(part), -1), axis=1, bitorder="little").sum(axis=0, dtype=np.uint16)
    return np.packbits(ones * 2 > len(hashes), bitorder="little").view(np.int64)


def wide_fingerprint(text: str | None, shingle: int) -> list[int]:
    """BLOCKS x 32 bits of the distinct words, then SKETCH_LONGS x 64 bits of the distinct shingles; A-Z lower-cased."""
    words = {w for w in (text or "").encode("utf-8", "surrogatepass").lower().split()}
    ones = np.fromiter((xxhash.xxh64_intdigest(w, HASH_SEED) for w in sorted(words)), np.uint64, len(words))
    longs = BLOCKS * BLOCK_BITS // BITS
    return [*wide_simhash(ones, longs).tolist(), *wide_simhash(np.unique(shingle_hashes(text, shingle)), SKETCH_LONGS).tolist()]


def sketch_distance(similarity: float) -> int:
    """Bits by which sketches of two sets of a Jaccard similarity differ: the mean and one deviation."""
    p = math.acos(2 * similarity / (1 + similarity)) / math.pi
    bits = SKETCH_LONGS * BITS
    return int(bits * p + math.sqrt(bits * p * (1 - p)))


def wide_radius() -> int:
    """Radius of the words' fingerprints: of two that differ in no more bits, some block differs in at most BLOCK_RADIUS."""
    return BLOCKS * (BLOCK_RADIUS + 1) - 1


def long_radius() -> int:
    """Of two within wide_radius(), some long differs in no more bits, and some block of it in at most BLOCK_RADIUS."""
    return wide_radius() // (BLOCKS * BLOCK_BITS // BITS)


def met_values(variants: DataFrame, beside: int) -> DataFrame:
    """Rows (centre, vs): of each centre's values (v, the lower bits of long p), those that may have another of the centre within long_radius().

    Above v, p has ``beside`` bits of the other block of the value's long. Where a value's classes differ in these, p is negative and near to all.
    """
    known = F.lit((1 << BITS - 1) - 1)

    def may_be_near(p: Column, q: Column) -> Column:
        return (p != q) & ((p < 0) | (q < 0) | (F.bit_count(p.bitwiseXOR(q).bitwiseAND(known)) <= long_radius()))

    # Nearly every centre has one value, so lists are not begun before the shuffle.
    met = variants.repartition("centre").groupBy("centre").agg(F.collect_list("p").alias("ps")).where(F.size("ps") > 1)
    low = F.lit((1 << BITS - 1 - beside) - 1)
    kept = met.select("centre", F.filter("ps", lambda p: F.exists("ps", lambda q: may_be_near(p, q))).alias("ps")).where(F.size("ps") > 1)
    return kept.select("centre", F.transform("ps", lambda p: p.bitwiseAND(low)).alias("vs"))


def wide_links(classes: DataFrame, similarity: float) -> DataFrame:
    """Edges (a, b) that connect exactly what direct links connect, from classes (cid, fp), fp by wide_fingerprint and distinct.

    Two are linked if their words' fingerprints differ in at most wide_radius() bits and their sketches in at most
    sketch_distance(similarity). By pigeonhole the former agree in a block up to BLOCK_RADIUS bits, so block values
    emit their balls of half that radius and meet at a centre, at most one value for each mask. Moderately similar texts meet
    so too, by the square of their number, so values carry bits of the other block of their long: by pigeonhole again,
    two near ones have a long in which they differ in at most long_radius() bits, and a block of it that meets. Values
    that no other at the centre is so near go. First each class is held
    against the least class of its values, and these against the least of each centre; that connects most. Then, where
    classes of different components meet at a centre, each is held against the others there, in chunks of CHUNK; a
    class gives the components that it links to, so a large group of near copies isn't expanded into its pairs.
    """
    longs = BLOCKS * BLOCK_BITS // BITS
    per_long = BITS // BLOCK_BITS
    block = lambda k: F.shiftrightunsigned(F.get("fp", F.lit(k // per_long)), BLOCK_BITS * (k % per_long)).bitwiseAND(F.lit((1 << BLOCK_BITS) - 1))
    value = lambda k: F.lit(k << BLOCK_BITS).cast("long").bitwiseOR(block(k))  # noqa: E731  (a block's number and its bits)
    beside = BITS - 1 - BLOCK_BITS - (BLOCKS - 1).bit_length()  # bits of a long that a value and the sign leave
    bits_beside = lambda k: block(k - k % per_long + (k + 1) % per_long).bitwiseAND(F.lit((1 << min(beside, BLOCK_BITS)) - 1))
    exploded = F.inline(F.array(*[F.struct(value(k).alias("v"), bits_beside(k).alias("beside")) for k in range(BLOCKS)]))
    members = materialize(classes.select("cid", exploded), "simhash-members")
    one_beside = F.when(F.min("beside") == F.max("beside"), F.shiftleft(F.min("beside"), BITS - 1 - beside)).otherwise(F.lit(-(1 << BITS - 1)))
    values = materialize(members.groupBy("v").agg(F.min("cid").alias("hub"), F.count("*").alias("n"), one_beside.bitwiseOR(F.col("v")).alias("p")), "simhash-values")
    members = members.select("cid", "v")
    masks = [sum(1 << b for b in bits) for n in range((BLOCK_RADIUS + 1) // 2 + 1) for bits in combinations(range(BLOCK_BITS), n)]
    ball = F.explode(F.from_json(F.lit(str(masks)), "array<bigint>")).alias("mask")
    variants = values.repartition(partitions(classes.sparkSession), "v").select("v", "p", ball).select(F.col("v").bitwiseXOR(F.col("mask")).alias("centre"), "p")
    met = met_values(variants, beside)
    # Balls have radius 1. Two values within 2 bits meet at two centres, of which they are held against each other at one: with the higher of
    # the bits that part them from it not set in it. A member is held if its bit isn't above the highest such bit of the centre's.
    apart_by = F.col("v").bitwiseXOR(F.col("centre"))
    members_of = met.select("centre", (F.array_max("vs") - F.col("centre")).alias("top"), F.explode("vs").alias("v"))
    centres = materialize(members_of.select("centre", "v", (apart_by <= F.col("top")).alias("held")), "simhash-centres")

    def apart(one: Column, two: Column, i: int, j: int) -> Column:
        return sum((F.bit_count(F.get(one, F.lit(n)).bitwiseXOR(F.get(two, F.lit(n)))) for n in range(i, j)), F.lit(0))

    def near(one: Column, two: Column) -> Column:
        return (apart(one, two, 0, longs) <= wide_radius()) & (apart(one, two, longs, longs + SKETCH_LONGS) <= sketch_distance(similarity))

    values = values.drop("p")
    own = members.join(values, "v").select(F.col("cid").alias("a"), F.col("hub").alias("b"))
    hubs = centres.join(values, "v").groupBy("centre").agg(F.collect_list("hub").alias("hubs"))
    across = hubs.select(F.explode("hubs").alias("a"), F.array_min("hubs").alias("b"))
    asked = own.union(across).where("a <> b").distinct()
    one, two = classes.select(F.col("cid").alias("a"), F.col("fp").alias("fa")), classes.select(F.col("cid").alias("b"), F.col("fp").alias("fb"))
    first = materialize(asked.join(one, "a").join(two, "b").where(near(F.col("fa"), F.col("fb"))).select("a", "b"), "simhash-links")

    named = components(first, "simhash-components-1").withColumnRenamed("node", "cid")
    placed = materialize(members.join(named, "cid", "left").withColumn("component", F.coalesce("component", "cid")), "simhash-placed")
    # A value's own classes meet as at a centre of that value alone.
    meet = centres.where("held").select("centre", "v").union(values.where("n > 1").select((-F.col("v") - 1).alias("centre"), "v")).join(placed, "v").select("centre", "cid", "component")
    mixed = meet.groupBy("centre").agg(F.min("component").alias("lo"), F.max("component").alias("hi"), F.count("*").alias("n")).where("lo <> hi").select("centre", "n")
    rows = materialize(meet.join(mixed, "centre").join(classes, "cid").select("centre", "n", "cid", "component", "fp"), "simhash-mixed")
    chunk = F.pmod(F.xxhash64("cid"), F.ceil(F.col("n") / CHUNK))
    chunks = rows.groupBy("centre", chunk.alias("chunk")).agg(F.collect_list(F.struct("component", "fp")).alias("others")).drop("chunk")
    other = F.filter("others", lambda o: (o["component"] < F.col("component")) & near(o["fp"], F.col("fp")))
    second = rows.join(chunks, "centre").select(F.col("component").alias("a"), F.explode(F.array_distinct(F.transform(other, lambda o: o["component"]))).alias("b"))
    return first.union(second.distinct())


def keep_first(docs: DataFrame, shingle: int = 5, similarity: float = 0.8, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row of docs for each group of near copies: that of the smallest id (null ids last); of rows with this id, the first in the table.

    docs must be a table in storage: rows are known by their place in it. Near copies are linked by wide_links; equal
    texts always are, word-free ones with each other too, and links chain. Columns stay as they are, whatever their names.
    """

    @F.pandas_udf("array<bigint>")
    def wide(texts: pd.Series) -> pd.Series:
        return pd.Series([wide_fingerprint(t, shingle) for t in texts])

    numbered = docs.select(F.struct(*[docs[c] for c in docs.columns]).alias("row"), F.monotonically_increasing_id().alias("uid"))
    # Of equal fingerprints the first row is known before links are looked for: one small row for each class.
    first = F.min(F.struct(F.col("id").isNull().alias("no_id"), "id", "uid")).alias("first")
    rows = docs.select(F.monotonically_increasing_id().alias("uid"), F.col(id_col).alias("id"), wide(F.col(text_col)).alias("fp"))
    classes = materialize(rows.groupBy("fp").agg(first, F.min("uid").alias("cid")), "simhash-classes")
    linked = components(wide_links(classes.select("cid", "fp"), similarity), "simhash-components")
    joined = classes.select("cid", "first").join(linked.withColumnRenamed("node", "cid"), "cid", "left")
    kept = joined.groupBy(F.coalesce("component", "cid").alias("c")).agg(F.min("first").alias("first")).select(F.col("first.uid").alias("uid"))
    return numbered.join(kept, "uid", "left_semi").select("row.*")
