"""LM scoring: stupid-backoff scores from n-gram count tables partitioned by hash, joined to each block's n-grams."""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from georank.llm.common import WORD

#: Production parameters: weight of a backoff step, words of the longest n-grams.
BACKOFF, ORDER = 0.4, 3
#: Bytes of text of a block of documents, and n-grams of a partition of the count table: bounds of one task's arrays.
BLOCK_BYTES, BUCKET_GRAMS = 4_000_000, 2_000_000
#: Bits of an n-gram's hash beyond those that number the corpus's n-grams: about one n-gram in 2^24 shares its hash, at any size.
_SPARE = 24

_MIX = (np.uint64(0x9E3779B97F4A7C15), np.uint64(0xBF58476D1CE4E5B9), np.uint64(31))


class Block:
    """The words of a block of texts as hashes, and its n-grams of 1 to ``order`` words."""

    def __init__(self, texts: list[bytes], order: int = 2):
        seen: dict[bytes, int] = {}
        ids: list[int] = []
        ends = []
        for t in texts:
            ids += [seen.setdefault(w, len(seen)) for w in t.lower().split()]
            ends.append(len(ids))
        hashes = np.fromiter((xxhash.xxh64_intdigest(w) for w in seen), np.uint64, len(seen))
        self.doc = np.repeat(np.arange(len(texts)), np.diff([0, *ends]))
        self.one = hashes[np.array(ids, np.int64)] if ids else np.empty(0, np.uint64)
        self.ends = [np.arange(len(ids))]  # by length, the last words of the n-grams; none spans two documents
        self.hashes = [self.one]
        at = self.one
        for n in range(1, order):
            ends = np.arange(n, len(ids))
            ends = ends[self.doc[ends] == self.doc[ends - n]]
            longer = np.zeros(len(ids), np.uint64)
            with np.errstate(over="ignore"):
                mixed = (at[ends - 1] * _MIX[0]) ^ self.one[ends]
                mixed = (mixed ^ (mixed >> _MIX[2])) * _MIX[1]
                longer[ends] = mixed ^ (mixed >> _MIX[2])
            at = longer
            self.ends.append(ends)
            self.hashes.append(at[ends])

    def grams(self) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(distinct hashes in order, place of each n-gram among them, counts): words first, then ever longer ones."""
        every = np.concatenate(self.hashes)
        return np.unique(every, return_inverse=True, return_counts=True)


def _pack(numbers: np.ndarray) -> bytes:
    """64-bit numbers as byte planes, low bytes first, without planes of zeros at the end; what varies little then compresses well."""
    planes = np.ascontiguousarray(numbers.astype("<u8").view(np.uint8).reshape(-1, 8).T)
    used = np.flatnonzero(planes.any(axis=1))
    return planes[: used[-1] + 1 if len(used) else 1].tobytes()


def _unpack(raw: bytes, n: int) -> np.ndarray:
    out = np.zeros((8, n), np.uint8)
    out[: len(raw) // n] = np.frombuffer(raw, np.uint8).reshape(-1, n)
    return np.ascontiguousarray(out.T).view("<u8").ravel()


def _per_document(doc: np.ndarray, place: np.ndarray) -> np.ndarray:
    """For each n-gram, how often its document has it."""
    _, back, n = np.unique(doc.astype(np.int64) << 40 | place.astype(np.int64), return_inverse=True, return_counts=True)
    return n[back]


def blocks(batches: Iterator[pd.DataFrame]) -> Iterator[tuple[int, pd.DataFrame]]:
    """(uid of the first row, rows uid, id, text) of consecutive rows of a partition with BLOCK_BYTES of text or a longer row's."""
    held: list[pd.DataFrame] = []
    size = 0
    for pdf in batches:
        sizes = np.array([len(t or "") for t in pdf["text"]], np.int64)
        a = 0
        while a < len(pdf):
            b = a + int(np.searchsorted(np.cumsum(sizes[a:]), BLOCK_BYTES - size, side="right"))
            if b == a and not held:
                b = a + 1
            if b > a:
                held.append(pdf.iloc[a:b])
                size += int(sizes[a:b].sum())
                a = b
            if a < len(pdf) or size >= BLOCK_BYTES:
                whole = pd.concat(held)
                yield int(whole["uid"].iloc[0]), whole
                held, size = [], 0
    if held:
        whole = pd.concat(held)
        yield int(whole["uid"].iloc[0]), whole


def _bytes(texts) -> list[bytes]:
    return [(t or "").encode("utf-8", "surrogatepass") for t in texts]


def backoff_scores(block: Block, place: np.ndarray, totals: np.ndarray, n_words: int, n_docs: int) -> tuple[np.ndarray, np.ndarray]:
    """(tokens, mean log score) by document, each against the corpus without that document itself."""
    n_one = len(block.one)
    tokens = np.bincount(block.doc, minlength=n_docs)
    rest = (n_words - tokens)[block.doc].astype(float)
    places = np.split(place, np.cumsum([len(e) for e in block.ends])[:-1])
    context = totals[places[0]] - _per_document(block.doc, places[0])
    # an unseen word counts as one half of an occurrence, so that scores are finite
    score = np.log(np.maximum(context, 0.5)) - np.log(np.maximum(rest, 1.0))
    for ends, at in zip(block.ends[1:], places[1:]):  # words with a shorter context keep the score of that
        here = totals[at] - _per_document(block.doc[ends], at)
        before = context[ends - 1]
        seen = (here > 0) & (before > 0)
        score[ends] += np.log(BACKOFF)
        score[ends[seen]] = np.log(here[seen] / before[seen])
        context = np.zeros(n_one, totals.dtype)
        context[ends] = here
    return tokens, np.bincount(block.doc, score, n_docs) / np.maximum(tokens, 1)


def score(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", order: int = ORDER) -> DataFrame:
    """Rows (doc_id, n_tokens, log_score) for every row of docs, a table in storage: mean log stupid-backoff score.

    Words are lower-cased (A-Z) and end at white space; whole texts; all n-grams of 1 to ``order`` words of all rows are
    counted, none is pruned. A document is scored by the counts of the rest of the corpus: count of the longest n-gram
    over count of all its words but the last where both are there, else BACKOFF times the score with one word of
    context less; a word without context scores its share. Null, empty and word-free texts give
    0 tokens and a null score; rows that repeat an id are documents of their own. A text is one task's as a whole.

    The count table is partitioned by hash. A block of consecutive rows, bounded by its text, sends each partition its
    distinct n-grams with their counts (so a frequent one is pre-aggregated), the partition adds them up and answers
    each block in the order asked with the counts elsewhere, and a block's answers meet its packed texts to be summed by
    document. Hashes travel sorted, as differences.
    """
    rows = docs.select(F.monotonically_increasing_id().alias("uid"), F.col(id_col).cast("long").alias("id"), F.col(text_col).cast("string").alias("text"))
    n_words = int(rows.agg(F.sum(F.when(F.col("text").isNull(), 0).otherwise(F.regexp_count("text", F.lit(WORD))))).first()[0] or 0)
    bits = max(0, int(np.ceil(np.log2(max(1, order * n_words / BUCKET_GRAMS)))))
    kept = min(64, _SPARE + max(8, int(np.ceil(np.log2(max(2, order * n_words))))))
    drop, low = np.uint64(64 - kept), np.uint64(kept - bits)

    def ask(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for blk, pdf in blocks(batches):
            hashes, _, counts = Block(_bytes(pdf["text"]), order).grams()
            hashes = hashes >> drop
            bucket = (hashes >> low).astype(np.int64)
            rest = hashes & np.uint64((1 << int(low)) - 1)
            keys, first = np.unique(bucket, return_index=True)
            cut = [*first.tolist(), len(hashes)]
            out = [(blk, int(b), z - a, _pack(np.diff(rest[a:z], prepend=np.uint64(0))), _pack(counts[a:z])) for b, a, z in zip(keys, cut, cut[1:])]
            yield pd.DataFrame(out, columns=["blk", "bucket", "n", "grams", "counts"])

    def answer(pdf: pd.DataFrame) -> pd.DataFrame:
        asked = [np.cumsum(_unpack(x, n), dtype=np.uint64) for x, n in zip(pdf["grams"], pdf["n"])]
        own = np.concatenate([_unpack(x, n) for x, n in zip(pdf["counts"], pdf["n"])])
        _, back = np.unique(np.concatenate(asked), return_inverse=True)
        others = np.bincount(back, own).astype("<u8")[back] - own
        ends = np.cumsum([0, *pdf["n"]])
        pdf = pdf[["blk", "bucket", "n"]].copy()
        pdf["others"] = [_pack(others[a:z]) for a, z in zip(ends, ends[1:])]
        return pdf

    def keep(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for blk, pdf in blocks(batches):
            texts = _bytes(pdf["text"])
            sizes = np.array([len(t) for t in texts], "<i8").tobytes()
            ids = [None if pd.isna(x) else int(x) for x in pdf["id"]]
            yield pd.DataFrame({"blk": [blk], "ids": [ids], "sizes": [sizes], "texts": [zlib.compress(b"".join(texts), 1)]})

    def finish(pdf: pd.DataFrame, got: pd.DataFrame) -> pd.DataFrame:
        ends = np.cumsum([0, *np.frombuffer(pdf["sizes"].iloc[0], "<i8").tolist()])
        raw = zlib.decompress(pdf["texts"].iloc[0])
        block = Block([raw[a:z] for a, z in zip(ends, ends[1:])], order)
        _, place, own = block.grams()
        got = got.sort_values("bucket")
        others = np.concatenate([_unpack(x, n) for x, n in zip(got["others"], got["n"])] or [np.empty(0, "<u8")]).astype(np.int64)
        tokens, scores = backoff_scores(block, place, others + own, n_words, len(ends) - 1)
        ids = pd.array(pdf["ids"].iloc[0], dtype="Int64")
        return pd.DataFrame({"doc_id": ids, "n_tokens": tokens, "log_score": np.where(tokens > 0, scores, np.nan)})

    requests = rows.select("uid", "text").mapInPandas(ask, "blk bigint, bucket bigint, n bigint, grams binary, counts binary")
    answers = requests.groupBy("bucket").applyInPandas(answer, "blk bigint, bucket bigint, n bigint, others binary")
    texts = rows.mapInPandas(keep, "blk bigint, ids array<bigint>, sizes binary, texts binary")
    met = texts.groupBy("blk").cogroup(answers.groupBy("blk")).applyInPandas(finish, "doc_id bigint, n_tokens bigint, log_score double")
    return met.withColumn("log_score", F.nanvl("log_score", F.lit(None).cast("double")))
