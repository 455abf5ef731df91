"""Toxicity by nearest labelled examples: exact cosine of whole texts over a block-max inverted index, distance-weighted votes.

A word weighs TF-IDF times 1 + the root of its chi-square against the label; words that say nothing of the label, and
words outside the examples, keep their TF-IDF weight. No word is left out.
"""

from __future__ import annotations

import math
import re
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark import Broadcast
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from georank.llm.common import least_hashes, materialize

#: Production parameters: examples of each class, neighbours, examples of an index block, decision threshold.
FIT_DOCS, K, BLOCK, THRESHOLD = 3000, 15, 64, 0.7
#: Texts searched for at once.
BATCH = 128

_WORD = re.compile(r"[^\W\d_]+")


def text_terms(text: str | None) -> Counter:
    """Frequencies of a whole text's lower-cased words."""
    return Counter(_WORD.findall((text or "").lower()))


def vector(at: np.ndarray, n: np.ndarray, weight: np.ndarray) -> tuple[np.ndarray, np.ndarray, float]:
    """(term numbers in order, unit weights, length before), a weight being one plus the log of the frequency, times the term's."""
    order = np.argsort(at)
    at = at[order]
    w = (1 + np.log(n[order])) * weight[at]
    norm = float(np.sqrt((w * w).sum()))
    return (at, w / norm, norm) if norm > 0 else (at[:0], w[:0], 0.0)


def _ranges(first: np.ndarray, stop: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(all places of the ranges one after the other, the ranges' sizes)."""
    sizes = stop - first
    ends = np.cumsum(sizes)
    return np.repeat(first - ends + sizes, sizes) + np.arange(ends[-1] if len(ends) else 0), sizes


class BlockMaxIndex:
    """Postings by term, cut in blocks of examples, with each block's largest weight as its bound.

    A term that at least one example in 16 has keeps its postings and its bounds as dense rows, so that a batch of
    queries accumulates them as one matrix product; other terms keep lists.
    """

    def __init__(self, vectors: list[tuple], labels: list[int], ids: list, n_terms: int, block: int = BLOCK):
        # examples alike in their heaviest word share blocks
        order = sorted(range(len(vectors)), key=lambda i: (int(vectors[i][0][np.argmax(vectors[i][1])]) if len(vectors[i][0]) else -1, i))
        self.order = order
        self.n = len(order)
        self.block = block
        self.labels = np.array([labels[i] for i in order], float)
        self.ids = [ids[i] for i in order]
        self.n_blocks = -(-self.n // block)
        # Postings are most of the memory: 32-bit numbers, and one array of weights at a time.
        terms = np.concatenate([np.empty(0, np.int32), *[vectors[i][0] for i in order]], dtype=np.int32, casting="same_kind")
        by = np.argsort(terms, kind="stable")  # by term, then place
        self.starts = np.concatenate([[0], np.cumsum(np.bincount(terms, minlength=n_terms))])
        del terms
        self.docs = np.repeat(np.arange(self.n, dtype=np.int32), [len(vectors[i][0]) for i in order])[by]
        self.weights = np.concatenate([np.empty(0), *[vectors[i][1] for i in order]])[by]
        self.column = np.full(n_terms, -1, np.int64)  # of a dense term
        dense = np.flatnonzero(np.diff(self.starts) * 16 >= max(self.n, 1))
        self.column[dense] = np.arange(len(dense))
        self.rows = None

    def __getstate__(self) -> dict:
        return self.__dict__ | {"rows": None}  # dense rows are laid out anew where they are used

    def vectors(self) -> list[tuple[np.ndarray, np.ndarray]]:
        """(terms, weights) of each example by place, as nearest() takes them."""
        by = np.argsort(self.docs, kind="stable")
        terms = np.repeat(np.arange(len(self.starts) - 1), np.diff(self.starts))[by]
        cuts = np.cumsum(np.bincount(self.docs, minlength=self.n))[:-1]
        return list(zip(np.split(terms, cuts), np.split(self.weights[by], cuts))) if self.n else []

    def _dense(self) -> tuple[np.ndarray, np.ndarray]:
        """(weights, block bounds) of the dense terms."""
        if self.rows is None:
            dense = np.flatnonzero(self.column >= 0)
            rows = np.zeros((len(dense), self.n_blocks * self.block))
            at, sizes = _ranges(self.starts[dense], self.starts[dense + 1])
            rows[np.repeat(np.arange(len(dense)), sizes), self.docs[at]] = self.weights[at]
            self.rows = rows, rows.reshape(len(dense), self.n_blocks, self.block).max(axis=2)
        return self.rows

    def nearest(self, queries: list[tuple[np.ndarray, np.ndarray]], k: int, skip: list[int] | None = None) -> list[tuple[np.ndarray, np.ndarray]]:
        """For each (terms, weights): (places, cosines) of the k nearest examples with cosine above 0, ties to the lower place; exact.

        Lists are accumulated first, which gives each example a part of its cosine. Blocks then go by falling bound,
        and a query passes over those whose bound is below its k-th cosine so far.
        """
        if not self.n or not queries:
            return [(np.empty(0, np.int64), np.empty(0))] * len(queries)
        rows, bounds = self._dense()
        width = self.n_blocks * self.block
        q = np.repeat(np.arange(len(queries)), [len(t) for t, _ in queries])
        terms = np.concatenate([t for t, _ in queries]).astype(np.int64)
        weights = np.concatenate([w for _, w in queries])
        column = self.column[terms]
        heavy = np.zeros((len(queries), len(rows)))
        heavy[q[column >= 0], column[column >= 0]] = weights[column >= 0]
        q, terms, weights = q[column < 0], terms[column < 0], weights[column < 0]
        at, sizes = _ranges(self.starts[terms], self.starts[terms + 1])
        part = np.bincount(np.repeat(q, sizes) * width + self.docs[at], np.repeat(weights, sizes) * self.weights[at], minlength=len(queries) * width).astype(float).reshape(len(queries), width)
        upper = heavy @ bounds + part.reshape(len(queries), self.n_blocks, self.block).max(axis=2) + 1e-12
        if skip is not None:
            part[np.arange(len(queries)), skip] = -np.inf
        least = np.full(len(queries), 1e-300)  # a cosine that the next must reach
        known = [np.empty(0)] * len(queries)
        done = np.zeros((len(queries), self.n_blocks), bool)
        order, step, first = np.argsort(-upper.max(axis=0), kind="stable"), 16, 0
        while first < self.n_blocks:
            blocks = order[first : first + step]
            need = np.flatnonzero((upper[:, blocks] >= least[:, None]).any(axis=1))
            if len(need):
                places = (blocks[:, None] * self.block + np.arange(self.block)).ravel()
                got = part[np.ix_(need, places)] + heavy[need] @ rows[:, places]
                part[np.ix_(need, places)] = got
                done[np.ix_(need, blocks)] = True
                for j, x in zip(need.tolist(), got):
                    best = np.concatenate([known[j], x])
                    known[j] = np.partition(best, len(best) - k)[len(best) - k :] if len(best) > k else best
                    if len(known[j]) == k:
                        least[j] = max(least[j], known[j].min())
            first += step
        out = []
        for j in range(len(queries)):
            places = np.flatnonzero((part[j] >= least[j]) & np.repeat(done[j], self.block))
            best = places[np.lexsort((places, -part[j][places]))[:k]]
            out.append((best, part[j][best]))
        return out


def pool_adjacent(x: np.ndarray, y: np.ndarray, w: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Weighted isotonic regression: knots x and their non-decreasing values."""
    groups: list[list[float]] = []
    for a, b, c in sorted(zip(x.tolist(), y.tolist(), w.tolist())):
        if groups and groups[-1][0] == a:
            groups[-1][1] += b * c
            groups[-1][2] += c
        else:
            groups.append([a, b * c, c])
    merged: list[list[float]] = []  # lowest x, highest x, sum, weight
    for a, s, c in groups:
        merged.append([a, a, s, c])
        while len(merged) > 1 and merged[-2][2] * merged[-1][3] >= merged[-1][2] * merged[-2][3]:
            last = merged.pop()
            merged[-1] = [merged[-1][0], last[1], merged[-1][2] + last[2], merged[-1][3] + last[3]]
    return np.array([v for m in merged for v in m[:2]]), np.array([m[2] / m[3] for m in merged for _ in (0, 1)])


class Scorer:
    """Index and term weights, as the executors get them; their size is bounded by the number of examples and their texts.

    examples are (id, label, term numbers, frequencies).
    """

    def __init__(self, weight: np.ndarray, examples: list[tuple[object, int, np.ndarray, np.ndarray]], prior: dict[int, float]):
        self.weight = weight
        vectors = [vector(at, n, weight) for _, _, at, n in examples]
        labels = [y for _, y, *_ in examples]
        n = Counter(labels)
        share = {y: prior.get(y, 0.0) / max(n[y], 1) for y in (0, 1)}  # of an example, so that classes weigh as labelled
        empty = [share[y] * np.array([1, y]) for y, v in zip(labels, vectors) if not len(v[0])]
        self.empty_score = float(np.sum([e[1] for e in empty]) / np.sum([e[0] for e in empty])) if empty else 0.0
        full = [i for i, v in enumerate(vectors) if len(v[0])]
        self.index = BlockMaxIndex([vectors[i] for i in full], [labels[i] for i in full], [examples[i][0] for i in full], len(weight))
        self.example_weight = np.where(self.index.labels > 0, share[1], share[0])

    def example_votes(self, batches: Iterator[int]) -> Iterator[tuple[int, float]]:
        """(place, vote by the other examples) of the examples of each batch."""
        vectors = self.index.vectors()
        for b in batches:
            chosen = range(b * BATCH, min((b + 1) * BATCH, self.index.n))
            found = self.index.nearest([vectors[p] for p in chosen], K, skip=list(chosen))
            yield from ((p, self.vote(*x)) for p, x in zip(chosen, found))

    def vote(self, places: np.ndarray, cosines: np.ndarray) -> float:
        """Toxic share of the neighbours' votes; one votes with its cosine times its class's weight."""
        votes = cosines * self.example_weight[places]
        total = float(votes.sum())
        return float(votes @ self.index.labels[places]) / total if total > 0 else 0.0

    def score(self, terms: list[np.ndarray], n: list[np.ndarray], knots: tuple[np.ndarray, np.ndarray]) -> list[tuple[float, float, list]]:
        """(score, length over the examples' words, evidence) of texts given as term numbers and frequencies; knots calibrate votes.

        Other words add to a text's length only, so the votes, which don't depend on it, need no weight of theirs.
        """
        vectors = [vector(a, b, self.weight) for a, b in zip(terms, n)]
        out = []
        for a in range(0, len(vectors), BATCH):
            part = vectors[a : a + BATCH]
            for v, (places, cosines) in zip(part, self.index.nearest([x[:2] for x in part], K)):
                if not len(v[0]) or not self.index.n:
                    out.append((self.empty_score, v[2], []))
                    continue
                evidence = [{"example_id": self.index.ids[p], "cosine": c, "label": int(self.index.labels[p])} for p, c in zip(places.tolist(), cosines.tolist())]
                out.append((float(np.clip(np.interp(self.vote(places, cosines), *knots), 0, 1)), v[2], evidence))
        return out


class Model:
    """A fitted scorer with its calibration; scorer and numbers of words are broadcasts, of which the driver keeps no copy.

    rest is a table (term, weight) of the words that no example has; it stays in storage and isn't shipped.
    """

    def __init__(self, numbers: Broadcast, scorer: Broadcast, knots: tuple[np.ndarray, np.ndarray], rest: DataFrame, unseen: float, id_type: str):
        self.numbers, self.scorer, self.knots = numbers, scorer, knots
        self.rest, self.unseen, self.id_type = rest, unseen, id_type
        self.fitted: tuple[DataFrame, DataFrame] | None = None  # docs and their numbered words

    @property
    def kept(self) -> dict[str, int]:
        return self.numbers.value

    @property
    def index(self) -> BlockMaxIndex:
        return self.scorer.value.index


def held_out(doc_id, modulus: int = 3, fold: int = 1):
    """Whether a row is kept from learning, by the CRC-32 of its id's text; null ids count as empty text."""
    return F.crc32(F.coalesce(doc_id.cast("string"), F.lit("")).cast("binary")) % modulus == fold


def chi_square(clean: np.ndarray, toxic: np.ndarray, n_clean: float, n_toxic: float) -> np.ndarray:
    """By term: chi-square of its presence against the label."""
    total, seen = n_clean + n_toxic, clean + toxic
    spread = n_clean * n_toxic * seen * (total - seen)
    return np.divide(total * (toxic * (n_clean - clean) - clean * (n_toxic - toxic)) ** 2, spread, out=np.zeros(len(seen)), where=spread > 0)


def number_terms(docs: DataFrame, numbers: Broadcast, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """A stage table (doc_id, uid, at, n, others, tf): a text's known words by number with frequencies (32-bit), the others by name."""

    @F.pandas_udf("at binary, n binary, others array<string>, tf array<double>")
    def run(texts: pd.Series) -> pd.DataFrame:
        number, out = numbers.value, []
        for t in texts:
            words = text_terms(t)
            at = np.array([number.get(w, -1) for w in words], "<i4")
            n = np.array(list(words.values()), "<i4")
            other = at < 0
            out.append((at[~other].tobytes(), n[~other].tobytes(), [w for w, o in zip(words, other.tolist()) if o], (1 + np.log(n[other])).tolist()))
        return pd.DataFrame(out, columns=["at", "n", "others", "tf"])

    rows = docs.select(F.col(id_col).alias("doc_id"), F.monotonically_increasing_id().alias("uid"), run(F.col(text_col)).alias("t"))
    return materialize(rows.select("doc_id", "uid", "t.*"), "toxicity-terms")


def fit(docs: DataFrame, labels: DataFrame, usable, id_col: str = "doc_id", text_col: str = "text", label_col: str = "toxic", fit_docs: int = FIT_DOCS) -> Model:
    """A model from the labelled rows of docs for which ``usable`` (a column of docs) holds.

    At most fit_docs examples of each class (least hashes of id and text; equal rows count once) are the index, with
    all words of their whole texts; the number of examples is the only bound. Document frequencies for idf are
    counted over all rows of docs, whole texts and all words; those that no example has stay in a table. A
    document with several labels has the highest. Rows without an id, a label of 0 or 1 or a text teach nothing.
    Examples are in order of id, then hash, so reruns agree.
    """
    known = labels.select(F.col(id_col).alias("id"), F.col(label_col).cast("int").alias("y")).where("y in (0, 1) and id is not null")
    known = known.groupBy("id").agg(F.max("y").alias("y"))
    texts = docs.where(usable & F.col(text_col).isNotNull()).select(F.col(id_col).alias("id"), F.xxhash64(id_col, text_col).alias("h"), F.col(text_col).alias("text"))
    # Only ids and hashes meet the labels; the chosen few, at most fit_docs a class, then fetch their texts.
    slim = materialize(texts.select("id", "h").join(known, "id"), "toxicity-labelled")
    prior = {r["y"]: r["n"] for r in slim.groupBy("y").agg(F.count("*").alias("n")).collect()}
    chosen = least_hashes(slim, "y", fit_docs, "toxicity").distinct()
    sample = texts.join(F.broadcast(chosen), ["id", "h"]).dropDuplicates(["id", "h"]).select("id", "h", "y", "text")
    id_type = dict(sample.dtypes)["id"]
    spark = docs.sparkSession

    def terms_of(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            tf = [text_terms(t) for t in pdf["text"]]
            yield pd.DataFrame({"id": pdf["id"], "h": pdf["h"], "y": pdf["y"], "terms": [list(x.keys()) for x in tf], "n": [np.array(list(x.values()), "<i4").tobytes() for x in tf]})

    # The driver sees each word once, and the examples by number.
    told = materialize(sample.mapInPandas(terms_of, f"id {id_type}, h bigint, y int, terms array<string>, n binary"), "toxicity-sample")
    words = sorted(told.select(F.explode("terms").alias("term")).distinct().toArrow()["term"].to_pylist())
    n_terms = len(words)
    numbers = spark.sparkContext.broadcast({t: i for i, t in enumerate(words)})
    del words

    def by_number(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        number = numbers.value
        for pdf in batches:
            yield pdf[["id", "h", "y", "n"]].assign(at=[np.array([number[t] for t in ts], "<i4").tobytes() for ts in pdf["terms"]])

    examples = told.mapInPandas(by_number, f"id {id_type}, h bigint, y int, n binary, at binary").orderBy("id", "h").toArrow()
    ids, y = examples["id"].to_pylist(), examples["y"].to_numpy().astype(np.int64)
    at, n = ([np.frombuffer(x.as_buffer() or b"", "<i4") for x in examples[c]] for c in ("at", "n"))
    del examples

    def df_of(label: int) -> np.ndarray:
        return np.bincount(np.concatenate([np.empty(0, np.int32), *[a for a, l in zip(at, y) if l == label]], dtype=np.int32, casting="same_kind"), minlength=n_terms).astype(float)

    chi2 = chi_square(df_of(0), df_of(1), float((y == 0).sum()), float((y == 1).sum()))

    # Words are numbered once; document frequencies and scores read the numbers.
    numbered = number_terms(docs, numbers, id_col, text_col)

    def frequencies(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        df, rows = np.zeros(n_terms, np.int64), 0
        for pdf in batches:
            rows += len(pdf)
            for raw in pdf["at"]:
                df[np.frombuffer(raw, "<i4")] += 1
        seen = np.flatnonzero(df)
        yield pd.DataFrame({"place": np.append(seen, -1), "df": np.append(df[seen], rows)})

    counted = numbered.select("at").mapInPandas(frequencies, "place int, df bigint").groupBy("place").agg(F.sum("df").alias("df")).toArrow()
    place, found = counted["place"].to_numpy(), counted["df"].to_numpy()
    n_docs = int(found[place < 0].sum())
    df = np.zeros(n_terms)
    df[place[place >= 0]] = found[place >= 0]
    rare = numbered.select(F.explode("others").alias("term")).groupBy("term").agg(F.count("*").alias("df"))
    rest = materialize(rare.select("term", (F.log(F.lit(1.0 + n_docs) / (1 + F.col("df"))) + 1).alias("weight")), "toxicity-rest")
    idf = np.log((1 + n_docs) / (1 + df)) + 1
    built = Scorer(idf * (1 + np.sqrt(chi2)), list(zip(ids, y.tolist(), at, n)), prior)
    labelled, weights, empty_score = built.index.labels, built.example_weight, built.empty_score
    scorer = spark.sparkContext.broadcast(built)
    del built, at, n
    pa.default_memory_pool().release_unused()

    def votes(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            yield pd.DataFrame(list(scorer.value.example_votes(pdf["id"])), columns=["place", "vote"])

    knots = np.array([0.0]), np.array([empty_score])
    if len(labelled):
        n_batches = -(-len(labelled) // BATCH)
        batches = spark.range(0, n_batches, 1, min(n_batches, spark.sparkContext.defaultParallelism))
        found = batches.mapInPandas(votes, "place int, vote double").toArrow()
        knots = pool_adjacent(found["vote"].to_numpy()[np.argsort(found["place"].to_numpy())], labelled, weights)
    model = Model(numbers, scorer, knots, rest, math.log(1 + n_docs) + 1, id_type)
    model.fitted = docs, numbered
    return model


def score(docs: DataFrame, model: Model, id_col: str = "doc_id", text_col: str = "text", threshold: float = THRESHOLD) -> DataFrame:
    """Rows (doc_id, score, predicted, evidence) for every row, whole texts; evidence lists the neighbours by cosine.

    A text without a word of the examples, an empty or null one too, scores as the labelled examples without words
    do. Cosines are of whole texts: words that no example has meet their weights in storage and lengthen the text.
    Neighbours of equal cosine come in order of their block, then id and text hash.
    """

    if model.fitted is not None and model.fitted[0] is docs:
        numbered = model.fitted[1]
    else:
        numbered = number_terms(docs, model.numbers, id_col, text_col)

    scorer, knots = model.scorer, model.knots

    @F.pandas_udf(f"score double, length double, evidence array<struct<example_id: {model.id_type}, cosine: double, label: int>>")
    def run(at: pd.Series, n: pd.Series) -> pd.DataFrame:
        found = scorer.value.score([np.frombuffer(x, "<i4") for x in at], [np.frombuffer(x, "<i4").astype(float) for x in n], knots)
        return pd.DataFrame(found, columns=["score", "length", "evidence"])

    found = materialize(numbered.select("doc_id", "uid", run("at", "n").alias("t")).select("doc_id", "uid", "t.*"), "toxicity-scored")
    others = numbered.select("uid", F.explode(F.arrays_zip("others", "tf")).alias("o")).select("uid", F.col("o.others").alias("term"), "o.tf")
    weight = F.coalesce("weight", F.lit(model.unseen))
    lengths = others.join(model.rest, "term", "left").groupBy("uid").agg(F.sum(F.pow(F.col("tf") * weight, F.lit(2.0))).alias("more"))
    share = F.col("length") / F.sqrt(F.col("length") * F.col("length") + F.coalesce("more", F.lit(0.0)))
    whole = F.transform("evidence", lambda e: F.struct(e["example_id"].alias("example_id"), (e["cosine"] * share).alias("cosine"), e["label"].alias("label")))
    out = found.join(lengths, "uid", "left")
    return out.select("doc_id", "score", (F.col("score") >= threshold).cast("int").alias("predicted"), whole.alias("evidence"))
