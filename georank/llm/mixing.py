"""Mixing sources to target weights: per-source repetition rates, then floor(rate) copies plus one hashed Bernoulli copy."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from georank.llm.common import WORD, global_index, lookup_join, materialize

#: Fixed values of the production mix.
WEIGHTS = (5, 2, 1)
MAX_REPEAT = 3
SEED = 7


def word_count(text):
    """Words of a text; 0 for null."""
    return F.when(text.isNull(), 0).otherwise(F.regexp_count(text, F.lit(WORD))).cast("long")


def source_targets(sized: DataFrame, weights: Sequence[int] = WEIGHTS, share: float = 1.0, max_repeat: int = MAX_REPEAT):
    """Targets by source from rows (source, size): (DataFrame source, source_size, target, rate; its row count).

    Sources in code-point order, null last, take the weights in turn and share ``share`` of all sizes. A target
    stops at max_repeat times its source's size; what is cut is shared again by weight among the rest until no
    target is above. Each pass of that loop is one sum over the table of sources; the driver gets two numbers.
    An empty table gives no rows; a source without words gets target 0 and rate 0.
    """
    by_source = sized.groupBy("source").agg(F.sum("size").alias("source_size"))
    ranked = global_index(by_source, [F.col("source").asc_nulls_last()], "__rank", "sources")
    w = F.get(F.array(*[F.lit(int(x)) for x in weights]), F.pmod("__rank", F.lit(len(weights))).cast("int")).cast("long")
    table = ranked.withColumn("__w", w).withColumn("__cap", F.lit(max_repeat) * F.col("source_size"))
    n, total, weight = table.agg(F.count("*"), F.sum("source_size"), F.sum("__w")).first()
    if not n:
        return table.select("source", "source_size", F.lit(0.0).alias("target"), F.lit(0.0).alias("rate")), 0
    goal = total if share == 1.0 else share * total
    left, weight_left = goal, weight
    while True:
        # cap * W < left * w: this source's share is above its cap
        above = F.col("__cap") * F.lit(float(weight_left)) < F.lit(float(left)) * F.col("__w")
        cut, cut_w = table.where(above).agg(F.sum("__cap"), F.sum("__w")).first()
        left_now, weight_now = goal - (cut or 0), weight - (cut_w or 0)
        if (left_now, weight_now) == (left, weight_left) or weight_now <= 0:
            break
        left, weight_left = left_now, weight_now
    fill = F.lit(float(left)) * F.col("__w") / F.lit(float(weight_left))
    target = F.least(F.col("__cap").cast("double"), fill)
    rate = F.when(F.col("source_size") > 0, F.least(target / F.col("source_size"), F.lit(float(max_repeat)))).otherwise(0.0)
    return table.select("source", "source_size", target.alias("target"), rate.alias("rate")), n


def uniform(key, seed: int):
    """A number in [0, 1) from the key's text: 52 bits of an MD5, so that any engine gives the same."""
    text = F.concat(F.lit(f"{seed}:"), F.coalesce(key.cast("string"), F.lit("")))
    return F.conv(F.substring(F.md5(text), 1, 13), 16, 10).cast("double") / F.lit(float(1 << 52))


def copies(key, rate, seed: int = SEED):
    """floor(rate) plus one more with the fraction's probability; null rate gives 0."""
    whole = F.floor(rate)
    return F.coalesce(whole + F.when(uniform(key, seed) < rate - whole, 1).otherwise(0), F.lit(0)).cast("long")


def plan_mix(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source", **options) -> DataFrame:
    """One row for each document: doc_id, size, source_size, target, rate, copies, taken (size times copies).

    Null and empty texts have size 0; null is a source of its own; rows that repeat an id share its draw; other
    columns of docs are ignored, whatever their names.
    """
    seed = options.pop("seed", SEED)
    sized = materialize(
        docs.select(F.col(id_col).alias("doc_id"), F.col(source_col).alias("source"), word_count(F.col(text_col)).alias("size")), "sized"
    )
    targets, n = source_targets(sized, **options)
    t = targets.withColumnRenamed("source", "__source")
    joined = lookup_join(sized, t, sized["source"].eqNullSafe(t["__source"]), n)
    return joined.withColumn("copies", copies(F.col("doc_id"), F.col("rate"), seed)).select(
        "doc_id", "size", "source_size", "target", (F.col("size") * F.col("copies")).alias("taken"), "rate", "copies"
    )


def mix(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source", **options) -> DataFrame:
    """The mixed corpus: docs' own columns, each document as often as its source's rate says; documents drawn 0 times go."""
    seed = options.pop("seed", SEED)
    sized = docs.select(F.col(source_col).alias("source"), word_count(F.col(text_col)).alias("size"))
    targets, n = source_targets(sized, **options)
    t = targets.select(F.col("source").alias("__mix_source"), F.col("rate").alias("__mix_rate"))
    joined = lookup_join(docs, t, docs[source_col].eqNullSafe(t["__mix_source"]), n)
    times = copies(F.col(id_col), F.col("__mix_rate"), seed).cast("int")
    return (
        joined.withColumn("__mix_times", times).where("__mix_times > 0")
        .withColumn("__mix_copy", F.explode(F.sequence(F.lit(1), F.col("__mix_times")))).select(*docs.columns)
    )
