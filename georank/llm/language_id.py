"""Language ID by rank-order profiles: out-of-place distance of a text's most frequent n-grams to each language's."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window

from georank.llm.common import least_hashes

UND = "und"
#: Production parameters: n-grams of a profile, letters of an n-gram, labelled documents a language is learned from.
PROFILE, MAX_N, FIT_DOCS = 300, 3, 2000
#: A document whose best score is not above this is rejected by keep_known(): it shares next to nothing with any language.
MIN_SCORE = 0.02
#: Characters of a text whose n-grams are counted at once.
CHUNK = 1 << 20

_BITS = 21  # of a code point


def letters(text: str) -> np.ndarray:
    """Code points of the lower-cased text, each run of other characters than letters as one 0, one 0 at either end.

    Four bytes a letter; what else is held is bounded by CHUNK.
    """
    low = text.lower()
    out, last = [np.zeros(1, np.int32)], 0
    for a in range(0, len(low), CHUNK):
        points = np.frombuffer(low[a : a + CHUNK].encode("utf-32-le", "surrogatepass"), "<i4")
        kinds, back = np.unique(points, return_inverse=True)
        alpha = np.array([chr(c).isalpha() for c in kinds.tolist()], bool)
        points = np.where(alpha[back], points, 0).astype(np.int32)
        before = np.concatenate([[last], points[:-1]])
        last = int(points[-1])
        out.append(points[(points != 0) | (before != 0)])
    if last:
        out.append(np.zeros(1, np.int32))
    return np.concatenate(out)


def ngram_counts(text: str | None, max_n: int = MAX_N) -> tuple[np.ndarray, np.ndarray]:
    """(codes, counts) of a text's n-grams of 1 to max_n signs with a letter among them; empty without letters.

    An n-gram's code has 21 bits a sign, 1 between words and a letter's code point plus 1. Beside the letters, a piece of CHUNK signs and the distinct n-grams are held.
    """
    codes, counts = np.empty(0, np.int64), np.empty(0, np.int64)
    signs = letters(text or "")
    if not signs.any():
        return codes, counts
    for a in range(0, len(signs), CHUNK):
        part = signs[a : a + CHUNK + max_n - 1].astype(np.int64)
        grams = []
        code, lettered = np.zeros(len(part), np.int64), np.zeros(len(part), bool)
        for n in range(1, min(max_n, len(part)) + 1):
            size = len(part) - n + 1
            code = (code[:size] << _BITS) | (part[n - 1 :] + 1)
            lettered = lettered[:size] | (part[n - 1 :] != 0)
            grams.append(code[:CHUNK][lettered[:CHUNK]])
        new, n_new = np.unique(np.concatenate(grams), return_counts=True)
        merged, back = np.unique(np.concatenate([codes, new]), return_inverse=True)
        counts = np.bincount(back, np.concatenate([counts, n_new])).astype(np.int64)
        codes = merged
    return codes, counts


def top(codes: np.ndarray, counts: np.ndarray, size: int = PROFILE) -> np.ndarray:
    """The most frequent n-grams, most frequent first, ties by code."""
    return codes[np.lexsort((codes, -counts))[:size]]


class Profiles:
    """Languages' profiles, ready to measure documents against."""

    def __init__(self, profiles: dict[str, list[int]], size: int = PROFILE):
        self.size = size
        self.names = sorted(profiles)
        self.codes = np.unique(np.concatenate([np.array(p, np.int64) for p in profiles.values()] or [np.empty(0, np.int64)]))
        self.ranks = np.full((len(self.names), len(self.codes)), -1, np.int64)
        for i, name in enumerate(self.names):
            self.ranks[i, np.searchsorted(self.codes, profiles[name])] = np.arange(len(profiles[name]))

    def predict(self, text: str | None) -> tuple[str, float]:
        """(language, score): least out-of-place distance, ties by name; score is 1 minus its share of the largest possible."""
        grams = top(*ngram_counts(text), self.size)
        if not len(grams) or not self.names:
            return UND, 0.0
        at = np.searchsorted(self.codes, grams)
        known = (at < len(self.codes)) & (self.codes[np.minimum(at, len(self.codes) - 1)] == grams) if len(self.codes) else np.zeros(len(grams), bool)
        place = np.flatnonzero(known)
        ranks = self.ranks[:, at[place]]
        out_of_place = np.where(ranks >= 0, np.abs(ranks - place), self.size).sum(axis=1) + self.size * (len(grams) - len(place))
        best = int(np.argmin(out_of_place))
        return self.names[best], 1.0 - float(out_of_place[best]) / (self.size * len(grams))


def held_out(doc_id, modulus: int = 4, fold: int = 2):
    """Whether a row is kept from learning, by the CRC-32 of its id's text; null ids count as empty text."""
    return F.crc32(F.coalesce(doc_id.cast("string"), F.lit("")).cast("binary")) % modulus == fold


def learn(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang", size: int = PROFILE, fit_docs: int = FIT_DOCS) -> Profiles:
    """Profiles from the rows of docs with a label and a text, at most fit_docs a language (least hashes of id and text).

    That bound is the only sample: n-grams of these texts are counted whole, added up by language, and the
    ``size`` most frequent of each reach the driver.
    """
    picked = docs.select(F.col(lang_col).alias("lang"), F.col(text_col).alias("text"), F.xxhash64(id_col, text_col).alias("h")).where("lang is not null and text is not null")
    sample = least_hashes(picked, "lang", fit_docs, "languages").select("lang", "text")

    def count(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            for lang, texts in pdf.groupby("lang")["text"]:
                for i in range(0, len(texts), 64):
                    got = [ngram_counts(t) for t in texts.iloc[i : i + 64]]
                    codes, back = np.unique(np.concatenate([c for c, _ in got]), return_inverse=True)
                    n = np.bincount(back, np.concatenate([k for _, k in got]), len(codes)).astype(np.int64)
                    yield pd.DataFrame({"lang": lang, "gram": codes, "n": n})

    grams = sample.mapInPandas(count, "lang string, gram bigint, n bigint").groupBy("lang", "gram").agg(F.sum("n").alias("n"))
    ranked = grams.withColumn("rank", F.row_number().over(Window.partitionBy("lang").orderBy(F.desc("n"), "gram"))).where(F.col("rank") <= size)
    profiles: dict[str, list[int]] = {}
    for r in sorted(ranked.select("lang", "rank", "gram").collect()):
        profiles.setdefault(r["lang"], []).append(r["gram"])
    return Profiles(profiles, size)


def identify(docs: DataFrame, profiles: Profiles, text_col: str = "text", lang_out: str = "lang_pred", score_out: str = "score") -> DataFrame:
    """docs with lang_pred and score; a column of such a name is replaced. ``und`` and 0 without a letter or for null."""

    @F.pandas_udf("lang string, score double")
    def predict(texts: pd.Series) -> pd.DataFrame:
        return pd.DataFrame([profiles.predict(t) for t in texts], columns=["lang", "score"])

    found = docs.withColumn("__lid", predict(F.col(text_col)))
    return found.withColumn(lang_out, F.col("__lid.lang")).withColumn(score_out, F.col("__lid.score")).drop("__lid")


def keep_known(docs: DataFrame, profiles: Profiles, text_col: str = "text", min_score: float = MIN_SCORE) -> DataFrame:
    """docs without those that have no letter or that score no more than min_score for every language; same columns."""
    found = identify(docs, profiles, text_col, "__lang", "__score")
    return found.where((F.col("__lang") != UND) & (F.col("__score") > min_score)).select(*docs.columns)
