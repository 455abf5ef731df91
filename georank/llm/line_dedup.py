"""Line dedup: ranks of line sequences by distributed prefix doubling, longest earlier copies by descending powers; later copies go.

DataFrame operations only.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window

from georank.llm.common import WORD, drop_table, global_index, materialize

#: Least words of a maximal repeated run that is deleted.
MIN_WORDS = 8


def _place() -> Column:
    """A position in document order: by id, null last, then row and line."""
    return F.struct(F.col("id").isNull().alias("no_id"), "id", "rid", "seq")


def _ranked(rows: DataFrame, key: list[str], name: str) -> DataFrame:
    """rows (rid, seq, id, words, key columns) whose key occurs again, with the key's rank r in order.

    Ranks are found on distinct keys, pre-aggregated before the shuffle, and joined back.
    """
    classes = rows.groupBy(*key).agg(F.count("*").alias("n")).where("n > 1")
    ranks = global_index(classes, [F.col(k) for k in key], "r", f"{name}-classes")
    return materialize(rows.join(ranks.select(*key, "r"), key).select("rid", "seq", "id", "words", "r"), name)


def _suffix_ranks(lines: DataFrame) -> list[DataFrame]:
    """Tables (rid, seq, id, words, r) for runs of 1, 2, 4, ... lines that occur again, until none does.

    A run's rank is that of the pair of its halves' ranks, sorted over all repeated runs of its length, so equal
    ranks are one interval of the suffix array whose common prefix is at least that long.
    """
    ranks = [_ranked(lines, ["h1", "h2"], "lines-1")]
    while True:
        now, length = ranks[-1], 1 << (len(ranks) - 1)
        right = now.select("rid", (F.col("seq") - length).alias("seq"), F.col("r").alias("r2"), F.col("words").alias("words2"))
        pairs = now.join(right, ["rid", "seq"]).select("rid", "seq", "id", F.col("r").alias("r1"), "r2", (F.col("words") + F.col("words2")).alias("words"))
        longer = _ranked(pairs, ["r1", "r2"], f"lines-{2 * length}")
        if longer.isEmpty():
            drop_table(longer)
            return ranks
        ranks.append(longer)


def _lengthen(state: DataFrame | None, ranks: DataFrame, step: int) -> DataFrame:
    """state after trying ``step`` more lines; see repeated_runs."""
    start = ranks.select(
        "rid", "seq", "id", F.lit(0).alias("length"), F.lit(0).cast("long").alias("words"), F.lit(-1).cast("long").alias("node_rid"), F.lit(-1).alias("node_seq"), F.lit(False).alias("ghost"),
        "r", F.col("words").alias("more"),
    )
    if state is not None:
        start = start.join(state.where(~F.col("ghost")).select("rid", "seq"), ["rid", "seq"], "left_anti")
        ahead = ranks.select("rid", F.col("seq").alias("next"), "r", F.col("words").alias("more"))
        onward = state.withColumn("next", F.col("seq") + F.col("length")).join(ahead, ["rid", "next"], "left").drop("next")
        start = onward.unionByName(start)
    node = ["node_rid", "node_seq", "length", "r"]
    groups = start.where(F.col("r").isNotNull()).groupBy(*node).agg(F.min(_place()).alias("f"), F.count("*").alias("n")).where("n > 1")
    met = start.join(groups.select(*node, F.col("f.rid").alias("f_rid"), F.col("f.seq").alias("f_seq")), node, "left")
    first = (F.col("rid") == F.col("f_rid")) & (F.col("seq") == F.col("f_seq"))
    row = lambda *fields: F.struct("rid", "seq", "id", *[x.alias(n) for x, n in zip(fields, ("length", "words", "node_rid", "node_seq", "ghost"))])
    stays = row(F.col("length"), F.col("words"), F.col("node_rid"), F.col("node_seq"), F.col("ghost"))
    goes = row(F.col("length") + step, F.col("words") + F.col("more"), F.col("f_rid"), F.col("f_seq"), F.col("ghost") | first)
    rows = F.when(F.col("f_rid").isNull(), F.array(stays)).when(first, F.array(stays, goes)).otherwise(F.array(goes))
    return met.select(F.explode(rows).alias("s")).select("s.*").where("length > 0")


def repeated_runs(lines: DataFrame, min_words: int = MIN_WORDS) -> DataFrame:
    """Rows (rid, seq, reach): at each position the longest run, in lines, that an earlier position starts too, if it has min_words words.

    lines has rid, seq (place among the document's lines with words), id, h1, h2 (128 bits of the line) and words.
    From the ranks of runs of 2^j lines, the longest common prefix with any earlier position is found by descending
    powers. Positions that agree so far form a node. At each power, those of a node whose next 2^j lines agree form a
    group: all but its first lengthen their run and make a node of their own. The first has no earlier copy of that
    length, so it stays and stands for the group in the old node, and a ghost of it goes along, so that the others can
    be held against it further on. So every position keeps one row and a group adds one, never its pairs.
    """
    ranks = _suffix_ranks(lines)
    state = None
    for j in reversed(range(len(ranks))):
        longer = materialize(_lengthen(state, ranks[j], 1 << j), f"runs-{1 << j}")
        if state is not None:
            drop_table(state)
        state = longer
        drop_table(ranks[j])
    return state.where(~F.col("ghost") & (F.col("words") >= min_words)).select("rid", "seq", F.col("length").alias("reach"))


def dedup_lines(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", min_words: int = MIN_WORDS, details: bool = False) -> DataFrame:
    """docs with the later copies of maximal repeated line runs deleted from their texts; the columns of docs.

    At each line the longest run that also starts at an earlier place (by id, null last, then row and line) is
    looked for; if all its lines together have min_words words or more, they are deleted, within one document too. Runs
    may overlap their copies; the first copy of a line always stays. Lines are parted by line feeds and compared
    by two 64-bit hashes of other seeds; lines without a word are neither compared nor deleted, and runs pass over
    them. A row whose text lost lines and has no word left goes; with ``details`` it stays, and n_lines and
    n_deleted are added. Null and empty texts stay as they are, rows that repeat an id are documents of their own,
    and columns of docs may have any name.
    """
    others = [c for c in docs.columns if c != text_col]
    base = materialize(
        docs.select(F.monotonically_increasing_id().alias("rid"), F.split(text_col, "\n").alias("lines"), F.col(id_col).alias("id"), F.struct(F.lit(0).alias("none"), *[docs[c].alias(f"c{i}") for i, c in enumerate(others)]).alias("doc")),
        "line-documents",
    )
    each = F.transform("lines", lambda x, i: F.struct(i.alias("i"), x.alias("x"), F.regexp_count(x, F.lit(WORD)).alias("w")))
    spread = base.select("rid", "id", F.posexplode(F.filter(each, lambda s: s["w"] > 0)).alias("seq", "s"))
    lines = materialize(
        # The second hash starts from another seed: xxhash64 seeds each column's hash with the one before.
        spread.select("rid", "seq", "id", F.col("s.i").alias("i"), F.xxhash64("s.x").alias("h1"), F.xxhash64(F.lit(1), "s.x").alias("h2"), F.col("s.w").cast("long").alias("words")), "lines"
    )
    runs = repeated_runs(lines.drop("i"), min_words)
    before = Window.partitionBy("rid").orderBy("seq").rowsBetween(Window.unboundedPreceding, 0)
    reached = lines.select("rid", "seq", "i").join(runs, ["rid", "seq"], "left")
    covered = reached.withColumn("stop", F.max(F.col("seq") + F.col("reach")).over(before)).where("stop > seq")
    gone = covered.groupBy("rid").agg(F.collect_set("i").alias("gone"))
    joined = base.join(gone, "rid", "left")
    # A filter on a hash set of places: array_except is linear, and each kept line is fetched by its place.
    kept = F.array_except(F.sequence(F.lit(0), F.size("lines") - 1), F.col("gone"))
    text = F.when(F.col("gone").isNull(), F.array_join("lines", "\n")).otherwise(F.array_join(F.transform(kept, lambda i: F.get("lines", i)), "\n"))
    own = [(text if c == text_col else F.col(f"doc.c{others.index(c)}")).alias(c) for c in docs.columns]
    if details:
        own += [F.greatest(F.size("lines"), F.lit(0)).alias("n_lines"), F.greatest(F.coalesce(F.size("gone"), F.lit(0)), F.lit(0)).alias("n_deleted")]
        return joined.select(*own)
    return joined.where(F.col("gone").isNull() | text.rlike(WORD)).select(*own)
