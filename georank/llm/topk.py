"""Exact top-k inner-product search: exhaustive term-at-a-time accumulation over blocks of postings."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window

from georank.llm.common import materialize
from georank.llm.vectors import clean_rows

SCALE = 256
#: Rows of a block of candidates, of a block of queries, and of a tile of scores: bounds of one task's arrays.
BLOCK_ROWS, QUERY_ROWS, TILE_ROWS = 16384, 4096, 1024

_BLOCK = "dim int, blk bigint, n int, uids binary, ids binary, weights binary"


def _narrow(weights: np.ndarray) -> bytes:
    """Whole numbers as 32 bits where all fit, else as 64."""
    small = not weights.size or np.abs(weights).max() < 1 << 31
    return weights.astype("<i4" if small else "<i8").tobytes()


def _wide(raw: bytes, terms: int, rows: int) -> np.ndarray:
    """(terms, rows) of _narrow's bytes."""
    return np.frombuffer(raw, "<i8" if len(raw) == 8 * terms * rows else "<i4").reshape(terms, rows).astype(np.int64)


def _to_blocks(rows_per_block: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            uid, ids, vectors = batch.column(0), batch.column(1), batch.column(2)
            keep_ids = ids.is_valid().to_numpy(zero_copy_only=False)
            for dim, rows, matrix in clean_rows(vectors):
                ok = keep_ids[rows]
                rows, matrix = rows[ok], matrix[ok]
                terms = np.floor(SCALE * matrix).astype(np.int64)
                u = uid.to_numpy(zero_copy_only=False)[rows].astype(np.int64)
                v = ids.to_numpy(zero_copy_only=False)[rows].astype(np.int64)
                for i in range(0, len(rows), rows_per_block):
                    part = slice(i, i + rows_per_block)
                    yield pa.RecordBatch.from_pydict(
                        {"dim": pa.array([dim], pa.int32()), "blk": pa.array([int(u[part][0])], pa.int64()), "n": pa.array([len(u[part])], pa.int32()),
                         "uids": [u[part].tobytes()], "ids": [v[part].tobytes()], "weights": [_narrow(np.ascontiguousarray(terms[part].T))]}
                    )

    return run


def accumulate(query_terms: np.ndarray, postings: np.ndarray) -> np.ndarray:
    """Scores (queries, rows) of integer query rows against postings laid out by term: (terms, rows).

    Term at a time: a term's postings are the rows where it isn't zero; each query with a weight for that term
    adds weight times value to its dense array of scores at those rows.
    """
    scores = np.zeros((len(query_terms), postings.shape[1]), np.int64)
    for a in range(0, postings.shape[1], TILE_ROWS):  # a tile of scores stays in the cache while its terms go by
        tile = np.zeros((len(query_terms), min(TILE_ROWS, postings.shape[1] - a)), np.int64)
        product = np.empty_like(tile)
        for t, values in enumerate(postings[:, a : a + TILE_ROWS]):
            users, rows = np.flatnonzero(query_terms[:, t]), np.flatnonzero(values)
            if not len(users) or not len(rows):
                continue
            if 2 * len(rows) > len(values) and 2 * len(users) > len(query_terms):
                np.multiply(query_terms[:, t, None], values, out=product)
                tile += product
            else:
                tile[np.ix_(users, rows)] += np.multiply.outer(query_terms[users, t], values[rows])
        scores[:, a : a + TILE_ROWS] = tile
    return scores


def select(scores: np.ndarray, ids: np.ndarray, uids: np.ndarray, own: int, k: int) -> np.ndarray:
    """Places of the k highest scores but the query's own row, ties to smaller id, then row."""
    ok = np.flatnonzero(uids != own)
    if len(ok) > k:
        part = scores[ok]
        least = part[np.argpartition(-part, k - 1)[k - 1]]
        ok = ok[part >= least]
    return ok[np.lexsort((uids[ok], ids[ok], -scores[ok]))][:k]


def top_k(vectors: DataFrame, is_query: Column, k: int = 5, id_col: str = "vec_id", vector_col: str = "embedding") -> DataFrame:
    """Rows (query_id, rank from 1, vec_id, score bigint): each query's k highest integer inner products.

    Components become floor(256 x). Rows with a null id, a null vector or a null or non-finite component take no
    part; only vectors of one length are compared; an empty vector scores 0 with others. A row that repeats an id
    is a row of its own: as a query it gives its own k rows, as a candidate it counts, but never against itself.
    Scores are 64-bit and wrap beyond. Queries are cut in blocks, and each block meets each block of candidates
    once, under an equal join key; a pair gives at most k rows a query, and those are merged by query.
    """
    rows = vectors.select(F.monotonically_increasing_id().alias("uid"), F.col(id_col).alias("id"), F.col(vector_col).alias("v"), is_query.alias("q"))
    rows = materialize(rows, "search-rows")
    wide = rows.select("uid", "id", "v")
    blocks = materialize(wide.mapInArrow(_to_blocks(BLOCK_ROWS), _BLOCK), "search-blocks")
    n_queries = rows.where("q").count()
    n_blocks = blocks.count()
    q_parts, b_parts = max(1, -(-n_queries // QUERY_ROWS)), max(1, n_blocks)
    queries = rows.where("q").select("uid", "id", "v").repartition(q_parts, "uid").mapInArrow(_to_blocks(QUERY_ROWS), _BLOCK)
    q = queries.select(
        "dim", F.pmod(F.xxhash64("blk"), F.lit(q_parts)).alias("qk"), F.explode(F.sequence(F.lit(0).cast("long"), F.lit(b_parts - 1).cast("long"))).alias("bk"),
        F.col("uids").alias("q_uids"), F.col("ids").alias("q_ids"), F.col("weights").alias("q_weights"),
    )
    b = blocks.select(
        "dim", F.explode(F.sequence(F.lit(0).cast("long"), F.lit(q_parts - 1).cast("long"))).alias("qk"), F.pmod(F.xxhash64("blk"), F.lit(b_parts)).alias("bk"), "uids", "ids", "weights",
    )
    met = b.join(q, ["dim", "qk", "bk"]).select("dim", "uids", "ids", "weights", "q_uids", "q_ids", "q_weights")

    def score(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i in range(batch.num_rows):  # one row is one pair of blocks
                dim, uids, ids, weights, q_uids, q_ids, q_weights = (c[i].as_py() for c in batch.columns)
                uids, ids, q_uids, q_ids = (np.frombuffer(x, np.int64) for x in (uids, ids, q_uids, q_ids))
                postings = _wide(weights, dim, len(ids))
                terms = _wide(q_weights, dim, len(q_ids)).T
                out = {"query_uid": [], "query_id": [], "uid": [], "vec_id": [], "score": []}
                for a in range(0, len(q_ids), 64):  # dense score arrays of 64 queries at a time
                    scores = accumulate(terms[a : a + 64], postings)
                    for j, row in enumerate(scores):
                        best = select(row, ids, uids, q_uids[a + j], k)
                        out["query_uid"].append(np.full(len(best), q_uids[a + j]))
                        out["query_id"].append(np.full(len(best), q_ids[a + j]))
                        out["uid"].append(uids[best])
                        out["vec_id"].append(ids[best])
                        out["score"].append(row[best])
                yield pa.RecordBatch.from_pydict({n: pa.array(np.concatenate(x).astype(np.int64)) for n, x in out.items()})

    found = met.mapInArrow(score, "query_uid bigint, query_id bigint, uid bigint, vec_id bigint, score bigint")
    order = Window.partitionBy("query_uid").orderBy(F.desc("score"), "vec_id", "uid")
    return found.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")
