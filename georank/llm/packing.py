"""Best-fit packing by sum of squares: each piece goes where the squared counts of open bins per residual gap stay least."""

from __future__ import annotations

import string
from array import array
from collections import defaultdict
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from georank.llm.common import materialize

CAPACITY = 4096
END_ID = 1
#: Tokens and pieces of one packing task: the whole input is dealt over as many groups as either needs.
GROUP_TOKENS, GROUP_PIECES = 1 << 25, 1 << 20
#: Words that a worker remembers, about 200 bytes each; the memory of a task's cache is bounded by it.
CACHE_WORDS = 600_000

#: Texts of these characters only are split by white space without changing any token: no combining marks
#: and no context-dependent case below U+0250, and every other white space or control is left out.
_PLAIN = r"[^ -~\t\n\r\x{a1}-\x{24f}]"

#: Neither letters nor digits: a run of them after letters is a token run of its own.
_MARKS = string.punctuation


class WordEncoder:
    """A tokenizers file's ids for whole texts, by way of a bounded cache of word ids.

    For tokenizers that lower-case and never join across white space (which the tests hold against the tokenizer
    itself), a plain text's ids are its words' ids in turn. Other texts go to the tokenizer as a whole. A block's words
    are told apart by Arrow, so Python sees each distinct word of a block once.
    """

    def __init__(self, path: str, cache_words: int = CACHE_WORDS):
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        # Texts with an added token's name in them are the tokenizer's own: it finds such tokens before it splits.
        self.added = [t.content.lower() for t in self.tokenizer.get_added_tokens_decoder().values()]
        self.cache: dict[str, bytes] = {"": b""}  # little-endian 32-bit ids
        self.cache_words = cache_words
        suffix = getattr(self.tokenizer.model, "end_of_word_suffix", None)
        self.ends = None  # by id: whether a token ends a word
        self.direct = False  # whether the model alone, without what goes before it, gives the ids of a word of a-z
        if suffix:
            vocab = self.tokenizer.get_vocab()
            self.ends = np.zeros(max(vocab.values()) + 1, bool)
            self.ends[[i for t, i in vocab.items() if t.endswith(suffix)]] = True
            known = [w for t in vocab if (w := t.removesuffix(suffix)).isascii() and w.isalpha() and w.islower()]
            probe = [u + v for u, v in zip(known[::97], known[::-89])]
            self.direct = b"".join(map(self._model_ids, probe)) == np.array(self.tokenizer.encode(" ".join(probe), add_special_tokens=False).ids, "<u4").tobytes()
        self.met_again: set[str] = set()  # words of the cache that a later block of texts had too

    def _model_ids(self, word: str) -> bytes:
        return array("I", [t.id for t in self.tokenizer.model.tokenize(word)]).tobytes()

    def _learn(self, words: list[str]) -> None:
        """Encode new words: those of a-z by the model, other letters as texts of 2048 words, whose last tokens tell their ends."""
        letters, others = [], []
        for w in words:
            if self.direct and w.isascii() and w.isalpha():
                self.cache[w] = self._model_ids(w)
            elif self.ends is not None and w.isalpha():
                letters.append(w)
            else:
                others.append(w)
        parts = [letters[i : i + 2048] for i in range(0, len(letters), 2048)]
        for part, got in zip(parts, self.tokenizer.encode_batch_fast([" ".join(p) for p in parts], add_special_tokens=False)):
            ids = np.array(got.ids, "<u4")
            stops = np.flatnonzero(self.ends[ids]) + 1
            if len(stops) == len(part):
                self._remember(part, ids, [0, *stops.tolist()])
            else:
                self._learn_by_offsets(part)
        for i in range(0, len(others), 2048):
            self._learn_by_offsets(others[i : i + 2048])

    def _learn_by_offsets(self, words: list[str]) -> None:
        """Encode new words as one text; a token belongs to the word in which it starts."""
        got = self.tokenizer.encode(" ".join(words), add_special_tokens=False)
        begins = np.cumsum([0, *[len(w) + 1 for w in words]])
        self._remember(words, np.array(got.ids, "<u4"), np.searchsorted([o[0] for o in got.offsets], begins).tolist())

    def _remember(self, words: list[str], ids: np.ndarray, bounds: list[int]) -> None:
        raw = ids.tobytes()
        self.cache.update((w, raw[4 * a : 4 * b]) for w, a, b in zip(words, bounds, bounds[1:]))

    def _know(self, words: list[str]) -> None:
        """Bring a block's distinct words into the cache."""
        missing = [w for w in words if w not in self.cache]
        if len(self.cache) + len(missing) > self.cache_words:  # words met in one block only go
            new = set(words)
            keep = new.union(self.met_again) if len(new) + len(self.met_again) <= self.cache_words // 2 else new
            self.cache = {"": b""} | {w: self.cache[w] for w in keep.intersection(self.cache)}
            self.met_again = set()
        self.met_again.update(words)
        self.met_again.difference_update(missing)
        # A word of letters and then marks is its letters' ids and the marks': the tokenizer parts them.
        bare = [w.rstrip(_MARKS) for w in missing]
        marked = [(w, c, w[len(c) :]) for w, c in zip(missing, bare) if len(c) < len(w) and c.isalpha()]
        plain = {w for w, c in zip(missing, bare) if len(c) == len(w) or not c.isalpha()}
        plain.update(x for _, *parts in marked for x in parts)
        self._learn(list(plain.difference(self.cache)))
        self.cache.update((w, self.cache[c] + self.cache[m]) for w, c, m in marked)

    def encode_all(self, texts: list[str]) -> list[np.ndarray]:
        low = [t.lower() for t in texts]
        odd = pc.match_substring_regex(pa.array(texts, pa.large_string()), _PLAIN).to_numpy(zero_copy_only=False)
        own = [i for i, t in enumerate(low) if not odd[i] and not any(a in t for a in self.added)]
        split = pc.ascii_split_whitespace(pa.array([low[i] for i in own], pa.large_string()))
        coded = split.flatten().dictionary_encode()
        words, codes = coded.dictionary.to_numpy(zero_copy_only=False).tolist(), coded.indices.to_numpy()
        self._know(words)
        raw = list(map(self.cache.__getitem__, words))
        sizes = np.fromiter(map(len, raw), np.int64, len(raw)) // 4
        each = sizes[codes]
        stops = np.append(0, np.cumsum(each))
        shift = (np.cumsum(sizes) - sizes)[codes] - stops[:-1]  # from a token's place in the block to that in the distinct words
        ids = np.frombuffer(b"".join(raw), "<u4")[np.repeat(shift, each) + np.arange(stops[-1])]
        bounds = stops[split.offsets.to_numpy() - split.offsets[0].as_py()] if own else []
        out: dict[int, np.ndarray] = {i: ids[a:b] for i, a, b in zip(own, bounds, bounds[1:])}
        return [out[i] if i in out else np.array(self.tokenizer.encode_batch_fast([t], add_special_tokens=False)[0].ids, "<u4") for i, t in enumerate(texts)]


_ENCODERS: dict[str, WordEncoder] = {}


def encoder(path: str) -> WordEncoder:
    """A worker's encoder of a file; it and its cache serve all tasks of the worker."""
    if path not in _ENCODERS:
        _ENCODERS[path] = WordEncoder(path)
    return _ENCODERS[path]


def tokenize(docs: DataFrame, tokenizer_path: str, capacity: int = CAPACITY, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Pieces (doc_id, piece, start, length, ids): a text's ids and the end id, cut where longer than capacity.

    ids is binary: little-endian unsigned 32-bit. A null text is empty and gives the end id alone. Rows that repeat
    an id are documents of their own. Other columns are ignored. The file's path must be readable on executors.
    """
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encode_all = encoder(tokenizer_path).encode_all
        end = np.array([END_ID], "<u4")
        for batch in batches:
            doc_ids = batch.column(0).to_pylist()
            sizes = np.cumsum(pc.fill_null(pc.binary_length(batch.column(1)), 0).to_numpy(zero_copy_only=False))
            a = 0
            while a < batch.num_rows:  # about 4 MB of text at a time
                b = max(a + 1, int(np.searchsorted(sizes, (sizes[a - 1] if a else 0) + (1 << 22))))
                rows = []
                for doc, ids in zip(doc_ids[a:b], encode_all([t or "" for t in batch.column(1).slice(a, b - a).to_pylist()])):
                    ids = np.concatenate([ids, end])
                    rows += [(doc, k, i, len(p := ids[i : i + capacity]), p.tobytes()) for k, i in enumerate(range(0, len(ids), capacity))]
                doc, piece, start, length, raw = zip(*rows)
                yield pa.RecordBatch.from_arrays(
                    [pa.array(doc, pa.int64()), pa.array(piece, pa.int32()), pa.array(start, pa.int64()), pa.array(length, pa.int64()), pa.array(raw, pa.binary())],
                    names=["doc_id", "piece", "start", "length", "ids"],
                )
                a = b

    picked = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text"))
    return picked.mapInArrow(run, "doc_id bigint, piece int, start bigint, length bigint, ids binary")


def sum_of_squares(lengths: np.ndarray, capacity: int = CAPACITY) -> tuple[np.ndarray, np.ndarray]:
    """(bin, offset) of each length, 1 to capacity, placed from long to short; equal lengths in the given order.

    With N(g) open bins of gap g, an item of length s moves a bin from g to g - s, or opens one at capacity - s; full
    bins don't count. The move with the least sum of N(g)^2 is made, ties to the smallest gap. Memory is a count for
    each gap and the open bins.
    """
    order = np.argsort(-lengths, kind="stable")
    counts = np.zeros(capacity + 1, np.int64)  # by gap; gap 0 stays 0, a new bin has gap capacity and count 0
    open_bins: dict[int, list[int]] = defaultdict(list)
    bins, offsets = np.zeros(len(lengths), np.int64), np.zeros(len(lengths), np.int64)
    made = 0
    for i in order.tolist():
        s = int(lengths[i])
        # change of the sum: the bin left (1 - 2 N(g), nothing for a new bin) and the bin made (1 + 2 N(g - s), nothing if full)
        left = 1 - 2 * counts[s:]
        left[counts[s:] == 0] = np.iinfo(np.int64).max // 4
        left[-1] = 0
        made_at = 1 + 2 * counts[: capacity + 1 - s]
        made_at[0] = 0
        gap = s + int(np.argmin(left + made_at))
        if gap == capacity:
            b = made
            made += 1
        else:
            b = open_bins[gap].pop()
            counts[gap] -= 1
        bins[i], offsets[i] = b, capacity - gap
        if gap > s:
            open_bins[gap - s].append(b)
            counts[gap - s] += 1
    return bins, offsets


def pack(pieces: DataFrame, capacity: int = CAPACITY, group_tokens: int = GROUP_TOKENS) -> DataFrame:
    """pieces, a table written to storage, with sequence_id and offset (place in the sequence, gapless from 0).

    Rows are dealt evenly by a hash of their place in the table over as many groups as their tokens need, so equal
    rows spread too, and as their number needs; each group is packed by sum_of_squares in one task that holds a few numbers a row. The other
    columns, ids among them, meet their places in a join that can spill. A group leaves at most a few sequences
    partly filled. Columns of pieces named sequence_id or offset are replaced.
    """
    pieces = pieces.drop("sequence_id", "offset").withColumn("__uid", F.monotonically_increasing_id())
    total, n = pieces.agg(F.sum("length"), F.count("*")).first()
    groups = max(1, -(-(total or 0) // group_tokens), -(-n // GROUP_PIECES))
    dealt = pieces.select("__uid", "length", F.pmod(F.xxhash64("__uid"), F.lit(groups)).alias("__group"))

    def place(pdf: pd.DataFrame) -> pd.DataFrame:
        bins, offsets = sum_of_squares(pdf["length"].to_numpy(np.int64), capacity)
        return pd.DataFrame({"__uid": pdf["__uid"], "sequence_id": pdf["__group"].to_numpy(np.int64) * (1 << 32) + bins, "offset": offsets})

    places = dealt.groupBy("__group").applyInPandas(place, "__uid bigint, sequence_id bigint, offset bigint")
    return pieces.join(places, "__uid").drop("__uid")


def pack_documents(docs: DataFrame, tokenizer_path: str, capacity: int = CAPACITY, id_col: str = "doc_id", text_col: str = "text", keep_ids: bool = True) -> DataFrame:
    """Pieces with their sequence and offset, and ids (keep_ids) or ids_crc32 (their CRC-32, unsigned)."""
    pieces = tokenize(docs, tokenizer_path, capacity, id_col, text_col)
    if not keep_ids:
        pieces = pieces.withColumn("ids_crc32", F.crc32("ids")).drop("ids")
    return pack(materialize(pieces, "pieces"), capacity)


def sequences(packed: DataFrame) -> DataFrame:
    """The training sequences (sequence_id, length, ids) of a packing that kept its ids."""
    parts = F.array_sort(F.collect_list(F.struct("offset", "ids")))
    return packed.groupBy("sequence_id").agg(F.sum("length").alias("length"), parts.alias("parts")).select(
        "sequence_id", "length", F.aggregate("parts", F.lit(b"").cast("binary"), lambda a, x: F.concat(a, x["ids"])).alias("ids")
    )
