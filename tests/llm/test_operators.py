"""The training-data operators against brute force, their SQL, held-out labels and odd inputs."""

import math
import re
import tracemalloc
import zlib
from collections import Counter, defaultdict
from pathlib import Path

import duckdb
import numpy as np
import pytest
import xxhash
from pyspark.sql import functions as F

from georank.llm import embedding_dedup, language_id, language_model, license_scan, line_dedup, mixing, packing, simhash, topk, toxicity
from georank.llm.common import components
from georank.llm.queries import ORACLE_SQL, QUERIES, tokenizer_path

DATA = "/root/testdata/sf0.001"
SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, size long, score double, uid long, __extra int"
LONG = " ".join(f"Word{i % 977}" for i in range(60_000))
#: Nulls in every column, empty and very long texts, repeated rows, ties, columns whose names the operators use too.
ODD = [
    (1, "the same line of more than eight words stands here\nown a", "en", "s0", 1, 5, 0.5, 9, 1),
    (2, "the same line of more than eight words stands here\nown b", "en", "s0", 1, 5, 0.5, 9, 1),
    (2, "the same line of more than eight words stands here\nown b", "en", "s0", 1, 5, 0.5, 9, 1),
    (3, None, None, None, None, None, None, None, None),
    (4, "", "en", "s1", 0, 0, 0.0, 0, 0),
    (5, " \n\t ", "de", "s1", 0, 0, 0.0, 0, 0),
    (None, "a text without any id at all", "en", None, 1, 1, 1.0, 1, 1),
    (6, LONG, "en", "s2", 1, 1, 1.0, 1, 1),
    (7, "日本語 Größe İ <|endoftext|> don't x ½", None, "s2", 1, 1, 1.0, 1, 1),
    (8, "12 34 -- !!", "fr", "s\U0001f600", 1, 1, 1.0, 1, 1),
]


@pytest.fixture(scope="module")
def odd(spark, tmp_path_factory):
    path = str(tmp_path_factory.mktemp("odd") / "docs")
    spark.createDataFrame(ODD, SCHEMA).coalesce(2).write.parquet(path)
    return spark.read.parquet(path)


@pytest.fixture(scope="module")
def none(odd, tmp_path_factory):
    path = str(tmp_path_factory.mktemp("none") / "docs")
    odd.limit(0).write.parquet(path)
    return odd.sparkSession.read.parquet(path)


@pytest.mark.parametrize("name", sorted(ORACLE_SQL))
def test_query_equals_its_sql(spark, name):
    con = duckdb.connect()
    for t in ("documents", "embeddings"):
        con.execute(f"create view {t} as select * from '{DATA}/{t}.parquet'")
    result = con.execute(ORACLE_SQL[name])
    cols = [c[0] for c in result.description]
    df = QUERIES[name](spark, DATA)
    assert sorted(cols) == sorted(df.columns)
    assert sorted(map(tuple, df.select(*cols).collect()), key=repr) == sorted(result.fetchall(), key=repr)


def test_components(spark):
    rng = np.random.default_rng(1)
    edges = [tuple(map(int, e)) for e in rng.integers(0, 300, (150, 2))] + [(i, i + 1) for i in range(1000, 1060)] + [(5, 5), (None, 4)]
    got = {r["node"]: r["component"] for r in components(spark.createDataFrame(edges, "a long, b long")).collect()}
    root = {x: x for e in edges for x in e if None not in e and e[0] != e[1]}
    for _ in root:
        for a, b in edges:
            if a in root and b in root:
                root[a] = root[b] = min(root[a], root[b])
    assert got == root
    assert components(spark.createDataFrame([], "a long, b long")).count() == 0


def test_mixing(spark, odd, none):
    got = {(r["doc_id"], r["source_size"]): r for r in mixing.plan_mix(odd).collect()}
    assert sum(r["taken"] for r in mixing.plan_mix(odd).collect()) > 0 and mixing.plan_mix(none).count() == 0
    assert got[(3, 7)]["size"] == 0 and got[(None, 7)]["target"] <= 21
    assert all(r["taken"] <= 3 * r["size"] for r in got.values())
    mixed = mixing.mix(odd)
    assert mixed.columns == odd.columns and mixing.mix(none).count() == 0
    taken = Counter(r["doc_id"] for r in mixed.collect())
    want = Counter()
    for r in mixing.plan_mix(odd).collect():
        want[r["doc_id"]] += r["copies"]
    assert taken == +want


def test_mixing_targets_are_met(spark):
    docs = spark.range(30_000).select(F.col("id").alias("doc_id"), F.concat(F.lit("s"), (F.col("id") % 7 * (F.col("id") % 3)).cast("string")).alias("source"), F.repeat(F.lit("w "), (F.col("id") % 50).cast("int")).alias("text"))
    plan = mixing.plan_mix(docs)
    by = plan.withColumn("s", (F.col("doc_id") % 7) * (F.col("doc_id") % 3)).groupBy("s").agg(F.sum("taken").alias("taken"), F.first("target").alias("target")).collect()
    assert all(abs(r["taken"] - r["target"]) <= 0.06 * r["target"] for r in by)
    assert sum(r["target"] for r in by) == pytest.approx(plan.agg(F.sum("size")).first()[0])


def test_language_id_held_out(spark, odd, none):
    rows = QUERIES["op2_language_id"](spark, "/root/testdata/sf0.01").join(spark.read.parquet("/root/testdata/sf0.01/documents.parquet").select("doc_id", "lang"), "doc_id").collect()
    held = [r for r in rows if r["held_out"]]
    assert all(r["held_out"] == (zlib.crc32(str(r["doc_id"]).encode()) % 4 == 2) for r in rows)
    assert np.mean([r["lang"] == r["lang_pred"] for r in held]) > 0.97
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    profiles = language_id.learn(docs)
    got = {r["doc_id"]: (r["lang_pred"], r["score"]) for r in language_id.identify(odd, profiles).collect()}
    assert got[3] == got[4] == got[5] == got[8] == ("und", 0.0) and got[1][0] == "en" and 0 <= got[6][1] <= 1
    kept = language_id.keep_known(odd, profiles)
    assert kept.columns == odd.columns and {r["doc_id"] for r in kept.collect()} == {1, 2, 6, 7, None}
    empty = language_id.learn(none)
    assert {r["lang_pred"] for r in language_id.identify(odd, empty).collect()} == {"und"}


def test_ngram_counts_in_pieces(monkeypatch):
    text = "Ab c äb. " * 50
    want = language_id.ngram_counts(text)
    monkeypatch.setattr(language_id, "CHUNK", 17)
    got = language_id.ngram_counts(text)
    assert got[0].tolist() == want[0].tolist() and got[1].tolist() == want[1].tolist()
    signs = language_id.letters(text).tolist()
    grams = Counter(tuple(signs[i : i + n]) for n in (1, 2, 3) for i in range(len(signs) - n + 1) if any(signs[i : i + n]))
    assert sorted(grams.values()) == sorted(want[1].tolist())


def _plain_grams(text):
    signs = [0]
    for c in (text or "").lower():
        if c.isalpha() or signs[-1]:
            signs.append(ord(c) if c.isalpha() else 0)
    signs += [0] if signs[-1] else []
    grams = Counter()
    for n in (1, 2, 3):
        for i in range(len(signs) - n + 1):
            g = signs[i : i + n]
            if any(g):
                grams[sum((s + 1) << 21 * (n - 1 - k) for k, s in enumerate(g))] += 1
    return grams


def _plain_language(text, profiles, size=300):
    grams = [g for g, _ in sorted(_plain_grams(text).items(), key=lambda x: (-x[1], x[0]))[:size]]
    if not grams or not profiles:
        return "und", 0.0
    far = {name: sum(abs(p.index(g) - i) if g in p else size for i, g in enumerate(grams)) for name, p in profiles.items()}
    best = min(far, key=lambda name: (far[name], name))
    return best, 1 - far[best] / (size * len(grams))


def _plain_profiles(rows, size=300):
    """From (text, lang) rows."""
    counts = defaultdict(Counter)
    for text, lang in rows:
        if lang is not None and text is not None:
            counts[lang].update(_plain_grams(text))
    return {lang: [g for g, _ in sorted(c.items(), key=lambda x: (-x[1], x[0]))[:size]] for lang, c in counts.items() if c}


def test_language_id_by_brute_force(spark, odd):
    docs = spark.read.parquet(f"{DATA}/documents.parquet")
    rows = [(r["doc_id"], r["text"], r["lang"]) for r in docs.collect()]
    held = lambda d: zlib.crc32(str(d).encode()) % 4 == 2
    want = _plain_profiles([(t, lang) for d, t, lang in rows if not held(d)])
    got = {r["doc_id"]: r for r in QUERIES["op2_language_id"](spark, DATA).collect()}
    for d, t, _ in rows:
        lang, score = _plain_language(t, want)
        assert (got[d]["lang_pred"], got[d]["held_out"]) == (lang, held(d)) and got[d]["score"] == pytest.approx(score)
    # equal profiles tie: the first name; a text beyond CHUNK; a language without letters teaches nothing
    tied = spark.createDataFrame([(1, "aaa bbb", "y"), (2, "aaa bbb", "x"), (3, "12", "w"), (4, "bbb " * 5, None)], "doc_id long, text string, lang string")
    profiles = language_id.learn(tied)
    assert {r["lang_pred"] for r in language_id.identify(tied.where("doc_id <> 3"), profiles).collect()} == {"x"}


def test_letters_of_a_long_text(monkeypatch):
    text = "Zwei Ärzte -- 12 größere, Σίσυφος? " * 40
    whole = language_id.letters(text).tolist()
    monkeypatch.setattr(language_id, "CHUNK", 7)
    assert language_id.letters(text).tolist() == whole and whole[0] == whole[-1] == 0 and 0 not in [a + b for a, b in zip(whole, whole[1:])]
    assert language_id.letters("").tolist() == [0] and language_id.letters("--").tolist() == [0]


def test_toxicity(spark, odd, none):
    labels = spark.read.parquet("/root/testdata/sf0.1/labels.parquet")
    docs = spark.read.parquet("/root/testdata/sf0.1/documents.parquet")
    model = toxicity.fit(docs, labels, ~toxicity.held_out(F.col("doc_id")))
    m = toxicity.score(docs, model).join(labels, "doc_id").where(toxicity.held_out(F.col("doc_id"))).select("score", "predicted", "toxic").collect()
    toxic = [r for r in m if r["toxic"] == 1]
    assert np.mean([r["predicted"] for r in toxic]) > 0.8 and np.mean([r["toxic"] for r in m if r["predicted"]]) > 0.9
    got = toxicity.score(odd, model).collect()
    assert len(got) == len(ODD) and all(0 <= r["score"] <= 1 for r in got)
    assert toxicity.score(none, model).count() == 0
    bare = toxicity.fit(none, labels, F.lit(True))
    assert {r["score"] for r in toxicity.score(odd, bare).collect()} == {0.0}


def test_toxicity_by_brute_force(spark, tmp_path):
    rng = np.random.default_rng(3)
    rows = [(i, " ".join([f"w{'abcdefghijklmnopqrst'[k]}" for k in rng.integers(0, 20, 12)] + (["vile"] if i % 4 == 0 else []) + ["own" + "abcdefghij"[i // 10] + "abcdefghij"[i % 10]])) for i in range(60)]
    spark.createDataFrame(rows, "doc_id long, text string").coalesce(2).write.parquet(str(tmp_path / "d"))
    docs = spark.read.parquet(str(tmp_path / "d"))
    y = {i: int(i % 4 == 0) for i in range(40)}
    model = toxicity.fit(docs, spark.createDataFrame(list(y.items()), "doc_id long, toxic int"), F.lit(True))
    tf = {i: Counter(t.split()) for i, t in rows}
    assert set(model.kept) == {w for i in y for w in tf[i]}

    def weight(w):
        df = sum(w in x for x in tf.values())
        a, b, n1 = sum(w in tf[i] for i in y if y[i]), sum(w in tf[i] for i in y if not y[i]), sum(y.values())
        below = n1 * (40 - n1) * (a + b) * (40 - a - b)
        return (math.log(61 / (1 + df)) + 1) * (1 + math.sqrt(40 * (a * (40 - n1 - b) - b * (n1 - a)) ** 2 / below if below else 0))

    vec = {i: {w: (1 + math.log(n)) * weight(w) for w, n in x.items()} for i, x in tf.items()}
    size = {i: math.sqrt(sum(x * x for x in v.values())) for i, v in vec.items()}
    by_id = {r["doc_id"]: r for r in toxicity.score(docs, model).collect()}
    near = {q: sorted(((sum(x * vec[i].get(w, 0) for w, x in vec[q].items()) / size[q] / size[i], i) for i in y if i != q or q >= 40), key=lambda c: (-c[0], c[1])) for q in vec}
    share = {q: sum(c * y[i] for c, i in near[q][: toxicity.K]) / sum(c for c, _ in near[q][: toxicity.K]) for q in vec}  # both classes weigh as labelled
    knots = sorted((share[q], y[q]) for q in y)
    fitted = [max(min(np.mean([b for _, b in knots[i : j + 1]]) for j in range(k, len(knots))) for i in range(k + 1)) for k in range(len(knots))]  # isotonic by minimax
    for q, r in by_id.items():
        want = sorted((sum(x * vec[i].get(w, 0) for w, x in vec[q].items()) / size[q] / size[i] for i in y), reverse=True)[: toxicity.K]
        assert [e["cosine"] for e in r["evidence"]] == pytest.approx([c for c in want if c > 0])
        if q >= 40:  # calibrated score of an unlabelled text
            assert r["score"] == pytest.approx(np.interp(share[q], [a for a, _ in knots], fitted), abs=1e-6) and r["predicted"] == int(r["score"] >= 0.7)


def test_toxicity_ties_and_repeats(spark, tmp_path):
    """Equal texts under other ids, rows that repeat, conflicting labels: the same result on each run, the higher label."""
    rows = [(i, "one vile word" if i % 3 == 0 else "quite clean words here") for i in range(30)] * 2
    spark.createDataFrame(rows, "doc_id long, text string").repartition(4).write.parquet(str(tmp_path / "d"))
    docs = spark.read.parquet(str(tmp_path / "d"))
    labels = spark.createDataFrame([(i, int(i % 3 == 0)) for i in range(30)] + [(0, 0), (3, None)], "doc_id long, toxic int")
    runs = []
    for n in (1, 5):
        model = toxicity.fit(docs.repartition(n), labels, F.lit(True))  # score() numbers the words anew, for other docs
        assert model.index.n == 30
        runs.append(sorted((r["doc_id"], r["score"], tuple(e["example_id"] for e in r["evidence"])) for r in toxicity.score(docs, model).collect()))
    assert runs[0] == runs[1] and all((s >= 0.7) == (d % 3 == 0) for d, s, _ in runs[0])


def test_toxicity_leaves_the_driver_little(spark, tmp_path):
    """The driver holds the examples' postings while it builds the index, no dense rows, and nothing of it afterwards."""
    rng = np.random.default_rng(8)
    names = ["".join("abcdefghijklm"[d] for d in (k // 169, k // 13 % 13, k % 13)) for k in range(2000)]
    rows = [(i, " ".join(names[k] for k in rng.choice(2000, 150, replace=False))) for i in range(1500)]
    spark.createDataFrame(rows, "doc_id long, text string").coalesce(2).write.parquet(str(tmp_path / "d"))
    docs = spark.read.parquet(str(tmp_path / "d"))
    labels = spark.range(1500).selectExpr("id AS doc_id", "CAST(id % 3 = 0 AS INT) AS toxic")
    tracemalloc.start()
    model = toxicity.fit(docs, labels, F.lit(True))
    left, most = tracemalloc.get_traced_memory()
    tracemalloc.stop()
    assert most < 64 * 1500 * 150 and left < 8 * 1500 * 150
    assert model.index.n == 1500 and (model.index.column >= 0).sum() > 1000  # whose rows take 12 kB each


def test_block_max_index_is_exact():
    rng = np.random.default_rng(0)
    vectors = []
    for _ in range(300):
        t = np.sort(rng.choice(40, rng.integers(1, 9), replace=False))
        w = rng.random(len(t))
        vectors.append((t, w / np.sqrt((w * w).sum()), 1.0))
    for block in (16, 64):
        index = toxicity.BlockMaxIndex(vectors, [0] * 300, list(range(300)), 40, block=block)
        index.column[::2] = -1  # half of the terms keep lists
        index.column[index.column >= 0] = np.arange((index.column >= 0).sum())
        for skip in (None, [7] * 60):
            got = index.nearest([(t, w) for t, w, _ in vectors[:60]], 15, skip)
            for (t, w, _), (places, cosines) in zip(vectors[:60], got):
                want = []
                for p, i in enumerate(index.order):
                    if skip is None or p != 7:
                        u, v, _ = vectors[i]
                        want.append((float(sum(a * b for x, a in zip(t, w) for y, b in zip(u, v) if x == y)), p))
                want = sorted((c for c in want if c[0] > 0), key=lambda c: (-c[0], c[1]))[:15]
                assert cosines == pytest.approx([c for c, _ in want])


def test_packing(spark, odd, none):
    from tokenizers import Tokenizer

    whole = Tokenizer.from_file(tokenizer_path())
    packed = packing.pack_documents(odd, tokenizer_path(), capacity=512)
    rows = packed.collect()
    by_doc = defaultdict(list)
    for r in rows:
        by_doc[r["doc_id"]].append(r)
    for doc, text, *_ in ODD:
        want = np.array(whole.encode(text or "", add_special_tokens=False).ids + [1], "<u4")
        pieces = sorted(by_doc[doc], key=lambda r: r["piece"])
        times = sum(1 for d, *_ in ODD if d == doc)
        got = [np.frombuffer(r["ids"], "<u4") for r in pieces[:: times]]
        assert np.concatenate(got).tolist() == want.tolist()
        assert all(len(x) == 512 for x in got[:-1]) and [r["start"] for r in pieces[::times]] == [512 * i for i in range(len(got))]
    bins = defaultdict(list)
    for r in rows:
        bins[r["sequence_id"]].append((r["offset"], r["length"]))
    for parts in bins.values():
        end = 0
        for a, n in sorted(parts):
            assert a == end
            end += n
        assert end <= 512
    assert len(bins) <= math.ceil(sum(r["length"] for r in rows) / 512) + 1
    assert sorted(len(bytes(r["ids"])) // 4 for r in packing.sequences(packed).collect()) == sorted(sum(n for _, n in p) for p in bins.values())
    assert packing.pack_documents(none, tokenizer_path()).count() == 0


def test_word_ids_equal_the_tokenizer():
    """Whole texts: given documents, special tokens in any case and place, marks after letters, Latin letters, other scripts."""
    from tokenizers import Tokenizer

    texts = [t or "" for (t,) in duckdb.connect().execute(f"select text from '{DATA}/documents.parquet'").fetchall()]
    texts += ["a <|endoftext|> b", "x<|endoftext|>y", "A <|ENDOFTEXT|> b", "<|startoftext|> one, two; three: four! five? six.", "well... really?! (yes), \"no\"; it's don't can't won't", "Größe naïve café ÀÉÎ ß ſ øre", "Ωmega İstanbul 日本語 текст", "a\u00a0b\u2028c\x85d\x1ce", "e\u0301 n\u0303.", "12 34.5 x½ ² 3rd", "word.word word., ,word"]
    rng = np.random.default_rng(0)
    signs = list("abcXYZéß.,;:!?'\"-_()<|>0 9\n\t ") + ["<|endoftext|>"]
    texts += ["".join(signs[k] for k in rng.integers(0, len(signs), 60)) for _ in range(300)]
    whole = Tokenizer.from_file(tokenizer_path())
    for encoder in (packing.WordEncoder(tokenizer_path()), packing.WordEncoder(tokenizer_path(), cache_words=50)):
        for i in range(0, len(texts), 64):
            for t, ids in zip(texts[i : i + 64], encoder.encode_all(texts[i : i + 64])):
                assert ids.tolist() == whole.encode(t, add_special_tokens=False).ids, t


def test_packing_deals_by_pieces(spark, monkeypatch):
    monkeypatch.setattr(packing, "GROUP_PIECES", 50)
    docs = spark.range(400).select(F.col("id").alias("doc_id"), F.lit("a b").alias("text"))
    packed = packing.pack_documents(docs, tokenizer_path(), capacity=30).collect()
    assert len(packed) == 400 and len({r["sequence_id"] >> 32 for r in packed}) == 8 and len({r["sequence_id"] for r in packed}) <= 48


def test_sum_of_squares_rule():
    """Each placement against the plain definition."""
    rng = np.random.default_rng(2)
    lengths = rng.integers(1, 21, 200)
    bins, offsets = packing.sum_of_squares(lengths, 20)
    gaps: dict[int, int] = {}
    for i in np.argsort(-lengths, kind="stable"):
        s = int(lengths[i])
        count = Counter(g for g in gaps.values() if g)
        options = []
        for g in sorted({g for g in gaps.values() if g >= s} | {20}):
            after = count.copy()
            if g != 20 or g in count:
                after[g] -= 1 if g != 20 else 0
            if g > s:
                after[g - s] += 1
            options.append((sum(n * n for n in after.values()), g))
        assert 20 - offsets[i] == min(options)[1]
        gaps[bins[i]] = int(20 - offsets[i] - s)


VECTORS = "vec_id long, embedding array<float>, label int, score double, n int"


def _vectors(seed: int, n: int = 400, dim: int = 16):
    rng = np.random.default_rng(seed)
    base = rng.standard_normal((n, dim))
    for i in range(n // 3, n):
        base[i] = base[rng.integers(0, n // 3)] + rng.normal(0, 0.06, dim)
    rows = [(i, [float(np.float32(x)) for x in v], int(rng.integers(0, 3)), 0.0, 1) for i, v in enumerate(base)]
    return rows + [(n, None, 1, 0.0, 1), (n + 1, [0.0] * dim, 1, 0.0, 1), (n + 2, [1.0, None] + [0.0] * (dim - 2), 1, 0.0, 1), (n + 3, [float("nan")] * dim, 1, 0.0, 1),
                   (n + 4, rows[0][1], None, 0.0, 1), (7, rows[7][1], rows[7][2], 0.0, 1), (n + 5, [1.0, 2.0], 1, 0.0, 1), (None, rows[3][1], rows[3][2], 0.0, 1)]


def test_embedding_dedup_by_brute_force(spark, tmp_path, monkeypatch):
    rows = _vectors(5)
    spark.createDataFrame(rows, VECTORS).coalesce(3).write.parquet(str(tmp_path / "v"))
    df = spark.read.parquet(str(tmp_path / "v"))
    ok = [i for i, (_, v, label, *_) in enumerate(rows) if label is not None and v and all(x is not None and math.isfinite(x) for x in v) and any(v)]
    links, root = Counter(), list(range(len(rows)))
    edges = []
    for a in ok:
        for b in ok:
            if a < b and rows[a][2] == rows[b][2] and len(rows[a][1]) == len(rows[b][1]):
                u, v = np.array(rows[a][1]), np.array(rows[b][1])
                if u @ v / math.sqrt((u @ u) * (v @ v)) >= 0.98:
                    links[a] += 1
                    links[b] += 1
                    edges.append((a, b))
    for _ in range(50):
        for a, b in edges:
            root[a] = root[b] = min(root[a], root[b])
    least = defaultdict(list)
    for i, r in enumerate(root):
        least[r].append(rows[i][0])
    least = {r: min((x for x in ids if x is not None), default=None) for r, ids in least.items()}
    want = sorted(((rows[i][0], links[i], least[root[i]], rows[i][0] == least[root[i]]) for i in range(len(rows))), key=repr)
    for tile in (4096, 64):
        monkeypatch.setattr(embedding_dedup, "TILE_ROWS", tile)
        assert sorted(map(tuple, embedding_dedup.near_duplicates(df).collect()), key=repr) == want
    assert len(edges) > 100
    assert embedding_dedup.near_duplicates(df.limit(0)).count() == 0


def test_embedding_join_shuffles_no_vector(spark, tmp_path, monkeypatch):
    spark.createDataFrame(_vectors(9), VECTORS).coalesce(3).write.parquet(str(tmp_path / "v"))
    plans, write = [], embedding_dedup.materialize

    def recorded(df, name):
        if name == "vector-links":
            plans.append(df._jdf.queryExecution().executedPlan().toString())
        return write(df, name)

    monkeypatch.setattr(embedding_dedup, "materialize", recorded)
    monkeypatch.setattr(embedding_dedup, "TILE_ROWS", 150)
    assert embedding_dedup.near_duplicates(spark.read.parquet(str(tmp_path / "v"))).count() == 408
    assert len(plans) == 3 and not any("Exchange hashpartitioning" in p for p in plans)


def test_embedding_labels_of_any_type(spark, tmp_path):
    v = [[1.0, 2.0, 3.0], [1.0, 2.0, 3.001]]
    for i, (kind, labels, linked) in enumerate([("string", ["a", "a"], True), ("string", ["a", "b"], False), ("double", [1.2, 1.7], False), ("double", [0.5, 0.5], True), ("string", [None, None], False)]):
        spark.createDataFrame(list(zip([1, 2], v, labels)), f"vec_id long, embedding array<double>, label {kind}").write.parquet(str(tmp_path / str(i)))
        got = embedding_dedup.near_duplicates(spark.read.parquet(str(tmp_path / str(i)))).collect()
        assert all((r["n_links"] == 1) == linked for r in got)


def test_top_k_by_brute_force(spark, tmp_path, monkeypatch):
    monkeypatch.setattr(topk, "BLOCK_ROWS", 37)
    rows = _vectors(6, 200)
    spark.createDataFrame(rows, VECTORS).coalesce(3).write.parquet(str(tmp_path / "v"))
    ok = [(i, r[0], [math.floor(256 * x) for x in r[1]]) for i, r in enumerate(rows) if r[0] is not None and r[1] and all(x is not None and math.isfinite(x) for x in r[1])]
    want = []
    for i, q, u in ok:
        if q % 50 == 0:
            near = sorted((-sum(a * b for a, b in zip(u, v)), c) for j, c, v in ok if j != i and len(v) == len(u))[:5]
            want += [(q, k, c, -s) for k, (s, c) in enumerate(near, 1)]
    got = topk.top_k(spark.read.parquet(str(tmp_path / "v")), F.col("vec_id") % 50 == 0)
    assert sorted(map(tuple, got.collect())) == sorted(want)
    assert topk.top_k(spark.read.parquet(str(tmp_path / "v")).limit(0), F.col("vec_id") % 50 == 0).count() == 0


def _plain_fp(text, size):
    words = re.findall(r"[^\x20\x09-\x0D]+", re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))
    if not words:
        return 0
    shingles = [" ".join(words[i : i + size]) for i in range(max(1, len(words) - size + 1))]
    h = [xxhash.xxh64_intdigest(s.encode(), 42) for s in shingles]
    return sum(1 << b for b in range(64) if 2 * sum(x >> b & 1 for x in h) > len(h))


@pytest.mark.parametrize("source", ["odd", "data"])
def test_simhash_by_brute_force(spark, odd, source):
    docs = odd if source == "odd" else spark.read.parquet(f"{DATA}/documents.parquet")
    rows = [(r["doc_id"], _plain_fp(r["text"], 3)) for r in docs.collect()]
    fps = sorted({f for _, f in rows})
    root = {f: f for f in fps}
    for _ in range(6):
        for a in fps:
            for b in fps:
                if (a ^ b).bit_count() <= 2:
                    root[a] = root[b] = min(root[a], root[b])
    least = defaultdict(list)
    for d, f in rows:
        least[root[f]].append(d)
    want = sorted(((d, f, min((x for x in least[root[f]] if x is not None), default=None)) for d, f in rows), key=repr)
    got = simhash.near_duplicates(docs, shingle=3)
    assert sorted(((r["doc_id"], r["fp"] % 2**64, r["component_id"]) for r in got.collect()), key=repr) == want


def _near(f, g, similarity=0.8):
    bits = [(a ^ b) % 2**64 for a, b in zip(f, g)]
    words = sum(b.bit_count() for b in bits[:2])
    return words <= simhash.wide_radius() and sum(b.bit_count() for b in bits[2:]) <= simhash.sketch_distance(similarity)


def _plain_keep_first(rows):
    """Places of the rows that stay, by links between all pairs of texts."""
    texts = sorted({r[1] or "" for r in rows})
    fps = {t: tuple(simhash.wide_fingerprint(t, 5)) for t in texts}
    root = {t: t for t in texts}

    def find(t):
        while root[t] != t:
            t = root[t]
        return t

    for a in texts:
        for b in texts:
            if a < b and _near(fps[a], fps[b]):
                root[max(find(a), find(b))] = min(find(a), find(b))
    best = {}
    for i, r in enumerate(rows):
        key = (r[0] is None, r[0] or 0, i)
        best[find(r[1] or "")] = min(best.get(find(r[1] or ""), key), key)
    return sorted(i for _, _, i in best.values())


@pytest.mark.parametrize("source", ["odd", "data", "edited"])
def test_keep_first_by_brute_force(spark, odd, tmp_path, source):
    rng = np.random.default_rng(8)
    if source == "edited":  # chains and stars of edited copies, so that least members of values are not near to all
        rows = []
        for g in range(12):
            words = [f"w{k}" for k in rng.integers(0, 4000, int(rng.integers(60, 300)))]
            for c in range(14):
                edited = list(words)
                for k in rng.integers(0, len(words), int(len(words) * rng.choice([0.0, 0.004, 0.01, 0.02, 0.05]))):
                    edited[k] = f"x{rng.integers(0, 10**6)}"
                if c % 3 == 0:
                    words = edited
                rows.append((len(rows) * 7 % 1000 if rng.random() > 0.05 else None, " ".join(edited)))
        spark.createDataFrame(rows, "doc_id long, text string").coalesce(1).write.parquet(str(tmp_path / "d"))
        docs = spark.read.parquet(str(tmp_path / "d"))
    else:
        docs = odd if source == "odd" else spark.read.parquet(f"{DATA}/documents.parquet")
    rows = [tuple(r) for r in docs.select("doc_id", "text").withColumn("u", F.monotonically_increasing_id()).orderBy("u").collect()]
    kept = simhash.keep_first(docs)
    assert kept.columns == docs.columns
    want = [rows[i][:2] for i in _plain_keep_first(rows)]
    assert sorted(map(tuple, kept.select("doc_id", "text").collect()), key=repr) == sorted(want, key=repr)


def test_wide_links_of_moderately_similar_texts(spark):
    """Fingerprints whose blocks meet but whose longs are far apart make no rows at centres; near ones there are linked all the same."""
    rng = np.random.default_rng(5)
    flip = lambda x, k: x ^ sum(1 << int(b) for b in rng.choice(32, k, replace=False))
    base, fps = [int(b) for b in rng.integers(0, 1 << 32, 4)], {}
    for i in range(128):  # one block a bit from the base's, the others at random
        blocks = [int(b) for b in rng.integers(0, 1 << 32, 4)]
        blocks[i % 4] = base[i % 4] ^ 1 << i // 4
        fps[i] = blocks
    for i in range(0, 128, 8):  # a copy within 11 bits: 5, 0 in one long and 3, 3 in the other, or 2, 3 and 3, 3
        fps[1000 + i] = [flip(b, k) for b, k in zip(fps[i], [(5, 0, 3, 3), (2, 3, 3, 3), (3, 3, 3, 2)][i // 8 % 3])]
    signed = lambda x: x - (1 << 64) if x >> 63 else x
    wide = {i: [signed(b[0] | b[1] << 32), signed(b[2] | b[3] << 32), *[0] * simhash.SKETCH_LONGS] for i, b in fps.items()}
    stage = lambda name: set(Path(spark.conf.get("spark.checkpoint.dir")).glob(f"georank/simhash-{name}-*"))
    before = stage("centres")
    got = {(min(r), max(r)) for r in components(simhash.wide_links(spark.createDataFrame(list(wide.items()), "cid long, fp array<long>"), 0.8)).collect() if r[0] != r[1]}
    (centres,) = stage("centres") - before
    assert got == {(i, 1000 + i) for i in range(0, 128, 8)}
    assert 20 < spark.read.parquet(str(centres)).count() < 200


def test_wide_fingerprints_find_near_copies():
    """Recall over given texts and copies with random words substituted, of a five-word shingle similarity of 0.8 or more; few far below it."""
    rng = np.random.default_rng(4)
    texts = [t for (t,) in duckdb.connect().execute("select text from '/root/testdata/sf0.01/documents.parquet' where text is not null order by doc_id").fetchall()]
    texts = [w for w in (t.lower().split() for t in texts) if 100 <= len(w) <= 5000]
    vocabulary = sorted({w for t in texts for w in t})
    found, wrong = [], []
    shingles = lambda w: {tuple(w[i : i + 5]) for i in range(len(w) - 4)}
    for words in texts:
        edited = list(words)
        for k in rng.integers(0, len(words), 1 + int(len(words) * rng.choice([0.0, 0.005, 0.01, 0.02, 0.08]))):
            edited[k] = vocabulary[rng.integers(0, len(vocabulary))]
        a, b = shingles(words), shingles(edited)
        j = len(a & b) / len(a | b)
        near = _near(simhash.wide_fingerprint(" ".join(words), 5), simhash.wide_fingerprint(" ".join(edited), 5))
        if j >= 0.8:
            found.append(near)
        elif j < 0.65:
            wrong.append(near)
    assert len(found) > 300 and np.mean(found) >= 0.9 and len(wrong) > 50 and np.mean(wrong) <= 0.05


@pytest.mark.parametrize("radius", [0, 1, 2, 3])
def test_ball_links_any_radius(spark, radius):
    rng = np.random.default_rng(radius)
    base = [int(x) for x in rng.integers(0, 2**62, 6)]
    fps = sorted({b ^ sum(1 << int(k) for k in rng.choice(62, rng.integers(0, 5), replace=False)) for b in base for _ in range(8)})
    got = components(simhash.fingerprint_links(spark.createDataFrame([(f,) for f in fps], "fp long"), radius))
    root = {f: f for f in fps}
    for _ in fps:
        for a in fps:
            for b in fps:
                if (a ^ b).bit_count() <= radius:
                    root[a] = root[b] = min(root[a], root[b])
    found = {f: f for f in fps} | {r["node"]: r["component"] for r in got.collect()}
    assert found == root


def test_line_dedup_odd(odd, none):
    got = {(r["doc_id"], i): r for i, r in enumerate(line_dedup.dedup_lines(odd, details=True).orderBy("doc_id").collect())}
    texts = defaultdict(list)
    for (d, _), r in got.items():
        texts[d].append(r["text"])
    assert texts[1][0].startswith("the same line") and sorted(texts[2]) == ["", "own b"]
    assert texts[3] == [None] and texts[4] == [""] and texts[5] == [" \n\t "] and texts[6] == [LONG]
    kept = line_dedup.dedup_lines(odd)
    assert kept.columns == odd.columns and line_dedup.dedup_lines(none).count() == 0


def _plain_line_dedup(rows, least):
    """Every line's longest earlier copy by comparing it with every earlier line."""
    order = sorted(range(len(rows)), key=lambda i: (rows[i][0] is None, rows[i][0] or 0, i))
    lines = {i: [(j, x, len(re.findall(r"[^\x20\x09-\x0D]+", x))) for j, x in enumerate((rows[i][1] or "").split("\n"))] for i in order}
    wordy = {i: [s for s in lines[i] if s[2]] for i in order}
    gone = {i: set() for i in order}
    earlier = []
    for i in order:
        for p in range(len(wordy[i])):
            best = 0
            for d, q in earlier:
                n = 0
                while p + n < len(wordy[i]) and q + n < len(wordy[d]) and wordy[i][p + n][1] == wordy[d][q + n][1]:
                    n += 1
                best = max(best, n)
            if sum(s[2] for s in wordy[i][p : p + best]) >= least:
                gone[i] |= {s[0] for s in wordy[i][p : p + best]}
            earlier.append((i, p))
    return [(rows[i][0], None if rows[i][1] is None else "\n".join(x for j, x, _ in lines[i] if j not in gone[i]), len(gone[i])) for i in range(len(rows))]


@pytest.mark.parametrize("seed", range(4))
def test_line_dedup_by_brute_force(spark, seed, tmp_path):
    """Few kinds of lines, so runs of all lengths repeat, overlap themselves and cross repeated and null ids."""
    rng = np.random.default_rng(seed)
    kinds = ["a b c", "d e f", "g h i", "", "j", "k l m n", "  "][: 4 + seed]
    rows = [(int(i % 17) if i % 9 else None, "\n".join(kinds[k] for k in rng.integers(0, len(kinds), rng.integers(0, 14)))) for i in range(40)]
    rows += [(50, "x y z\nu v w\nr s t"), (51, "before\nx y z\nu v w\nr s t\nafter"), (52, None)]
    rows = [(d, t + "\n" + "\n".join(f"own {i} {k}" for k in range(int(rng.integers(0, 3)))) if t is not None else t) for i, (d, t) in enumerate(rows)]
    spark.createDataFrame(rows, "doc_id long, text string").coalesce(1).write.parquet(str(tmp_path / "d"))
    df = spark.read.parquet(str(tmp_path / "d"))
    rows = [tuple(r) for r in df.collect()]
    got = sorted(((r["doc_id"], r["text"], r["n_deleted"]) for r in line_dedup.dedup_lines(df, details=True).collect()), key=repr)
    assert got == sorted(_plain_line_dedup(rows, 8), key=repr)
    assert next(n for d, _, n in got if d == 51) == 3


def test_line_dedup_clashing_columns(spark, tmp_path):
    rows = [(1, "one two three four five six seven eight", 5, "k", 9, 7), (2, "one two three four five six seven eight\nown", 6, "l", 8, 6)]
    spark.createDataFrame(rows, "doc_id long, text string, rid long, lines string, gone int, __rid long").coalesce(1).write.parquet(str(tmp_path / "d"))
    got = sorted(tuple(r) for r in line_dedup.dedup_lines(spark.read.parquet(str(tmp_path / "d"))).collect())
    assert got == [rows[0], (2, "own", 6, "l", 8, 6)]


def test_license_scan(spark, odd, none):
    short = {n: t for n, t in reversed(license_scan.TEMPLATES)}
    mit, gpl = short["MIT"], short["GPL-3.0"]
    filler = [(100 + i, f"some words of a usual file number {i} and others", f"r/z/{i}.txt") for i in range(60)]
    files = [(1, mit, "r/LICENSE"), (2, "code here\nmore", "r/a/b/x.py"), (3, f"{' '.join(f'first{i}' for i in range(40))}\n{gpl}\nlast line", "r/a/y.py"), (4, gpl, "r/a/c/COPYING"), (5, "z", "r/a/c/d/z.py"),
             (6, "z", "q/z.py"), (7, None, None), (8, mit.replace("Released", "released"), None), (8, "", "r/e.txt")]
    df = spark.createDataFrame(files + filler, "doc_id long, text string, p string")
    got = defaultdict(list)
    for r in license_scan.scan(df, F.col("p")).collect():
        got[r["doc_id"]].append((r["license"], r["found"], r["license_dir"]))
    assert got[1] == [("MIT", "file", None)] and got[2] == [("MIT", "inherited", "r")] and got[3] == [("GPL-3.0", "header", None)]
    assert got[4] == [("GPL-3.0", "file", None)] and got[5] == [("GPL-3.0", "inherited", "r/a/c")] and got[6] == [(None, None, None)]
    assert got[7] == [(None, None, None)] and sorted(got[8], key=repr) == sorted([("MIT", "file", None), ("MIT", "inherited", "r")], key=repr)
    assert license_scan.scan(odd, F.col("source")).count() == len(ODD) and license_scan.scan(none, F.col("source")).count() == 0


def _plain_licenses(rows, templates, least):
    """(own licence, whether the whole text is one) by plain cosines of whole texts and of the windows at heavy terms."""
    tokens = [re.findall(r"[^\W_]+", (t or "").lower()) for _, t, _ in rows]
    df = Counter(w for ws in tokens for w in set(ws))

    def vector(words):
        return {w: (1 + math.log(n)) * (math.log((1 + len(rows)) / (1 + df[w])) + 1) for w, n in Counter(words).items()}

    def cosine(u, v):
        size = math.sqrt(sum(x * x for x in u.values()) * sum(x * x for x in v.values()))
        return round(sum(x * v.get(w, 0) for w, x in u.items()) / size, 9) if size else 0.0

    known = [(n, ws, vector(ws)) for n, ws in ((n, re.findall(r"[^\W_]+", t.lower())) for n, t in templates)]
    out = []
    for words in tokens:
        whole = min(((-c, n) for n, _, v in known if (c := cosine(vector(words), v)) >= least), default=None)
        header = None
        for _, ws, v in known:
            left, total = sum(x * x for x in v.values()), sum(x * x for x in v.values())
            for term, x in sorted(v.items(), key=lambda i: (-i[1], i[0])):
                if math.sqrt(max(left, 0) / total) < least:
                    break
                left -= x * x
                for i in (i for i, w in enumerate(words) if w == term):
                    start = max(0, i - ws.index(term))
                    part = vector(words[start : start + len(ws)])
                    scored = [(-cosine(part, u), n) for n, _, u in known]
                    header = min([h for h in scored if -h[0] >= least] + [header] * (header is not None), default=None)
        out.append((whole, header))
    return out


def test_license_scan_by_brute_force(spark):
    """Full texts, notices wrapped at any width with comment marks, statements amid words, edited and cut ones, ties between templates."""
    import textwrap

    rng = np.random.default_rng(3)
    templates = [*license_scan.TEMPLATES, ("Zz-Copy", license_scan.TEMPLATES[0][1])]
    filler = lambda n: " ".join(f"word{k}" for k in rng.integers(0, 400, n))
    rows = []
    for i, (_, t) in enumerate(templates):
        rows += [(len(rows), t, f"p{i}/LICENSE"), (len(rows) + 1, "Copyright (c) 2021 Jane Doe\n" + t, f"p{i}/src/COPYING"), (len(rows) + 2, filler(30), f"p{i}/src/a/b.py")]
        rows.append((len(rows), "\n".join(f" * {line}" for line in textwrap.wrap(t, 40)) + "\n" + filler(200), f"q{i}/c.py"))
        rows.append((len(rows), f"{filler(40)} {t} {filler(40)}", None))
        words = t.split()
        rows.append((len(rows), filler(20) + " " + " ".join(w for k, w in enumerate(words) if k % 9) + " " + filler(20), f"r{i}/d.py"))
        rows.append((len(rows), " ".join(words[: len(words) // 3]), f"s{i}/e.py"))
    rows += [(len(rows), "Copyright 2021 Jane Doe. Released under the MIT License. All rights reserved. " + filler(60), "t/f.py"), (len(rows) + 1, None, "t/g.py"), (len(rows) + 2, "", None)]
    rows += [(len(rows) + i, filler(50), f"u/{i}.txt") for i in range(150)]
    got = {r["doc_id"]: r for r in license_scan.scan(spark.createDataFrame(rows, "doc_id long, text string, p string"), F.col("p"), templates=templates).collect()}
    own = _plain_licenses(rows, templates, 0.8)
    for (d, _, path), (whole, header) in zip(rows, own):
        want = whole or header
        if want:
            assert (got[d]["license"], got[d]["found"], got[d]["cosine"]) == (want[1], "file" if whole else "header", -want[0])
        else:
            above = [] if path is None else [path.rsplit("/", k)[0] for k in range(1, path.count("/") + 1)] + [""]
            held = [(p.rpartition("/")[0], p, w[1]) for (_, _, p), (w, _) in zip(rows, own) if w and p]
            near = next((min((p, n) for a, p, n in held if a == folder)[1] for folder in above if any(a == folder for a, _, _ in held)), None)
            assert (got[d]["license"], got[d]["found"]) == (near, "inherited" if near else None)
    assert sum(w is not None for w, _ in own) >= 2 * len(templates) and sum(w is None and h is not None for w, h in own) >= 2 * len(templates)
    assert got[next(d for d, t, _ in rows if t and t.startswith("Copyright 2021"))]["license"] == "MIT"


def test_language_model_by_brute_force(spark, odd, none, monkeypatch):
    monkeypatch.setattr(language_model, "BUCKET_GRAMS", 5000)
    monkeypatch.setattr(language_model, "BLOCK_BYTES", 60_000)
    for docs in (odd, spark.read.parquet(f"{DATA}/documents.parquet")):
        texts = [(r["doc_id"], (r["text"] or "").encode().lower().split()) for r in docs.collect()]
        one, two = Counter(), Counter()
        for _, w in texts:
            one.update(w)
            two.update(zip(w, w[1:]))
        want = []
        for d, w in texts:
            own1, own2 = Counter(w), Counter(zip(w, w[1:]))
            rest, s = sum(one.values()) - len(w), 0.0
            for i, x in enumerate(w):
                if i and two[w[i - 1], x] - own2[w[i - 1], x] > 0:
                    s += math.log((two[w[i - 1], x] - own2[w[i - 1], x]) / (one[w[i - 1]] - own1[w[i - 1]]))
                else:
                    s += math.log(max(one[x] - own1[x], 0.5) / max(rest, 1)) + (math.log(0.4) if i else 0)
            want.append((d, len(w), round(s / len(w), 6) if w else None))
        got = [(r["doc_id"], r["n_tokens"], None if r["log_score"] is None else round(r["log_score"], 6)) for r in language_model.score(docs, order=2).collect()]
        assert sorted(got, key=repr) == sorted(want, key=repr)
    assert language_model.score(none).count() == 0


@pytest.mark.parametrize("order", [1, 3, 4])
def test_language_model_of_any_order(spark, odd, monkeypatch, order):
    monkeypatch.setattr(language_model, "BLOCK_BYTES", 100)
    rng = np.random.default_rng(4)
    short = spark.createDataFrame([(100 + i, " ".join("abc"[k] for k in rng.integers(0, 3, i))) for i in range(12)], "doc_id long, text string")
    texts = [(r["doc_id"], (r["text"] or "").encode().lower().split()) for r in odd.select("doc_id", "text").union(short).collect()]
    grams = lambda w: Counter(tuple(w[i : i + n]) for n in range(1, order + 1) for i in range(len(w) - n + 1))
    every = sum((grams(w) for _, w in texts), Counter())
    n_words = sum(len(w) for _, w in texts)
    want = []
    for d, w in texts:
        own, s = grams(w), 0.0

        def plain(g, own=own, w=w):
            if len(g) == 1:
                return math.log(max(every[g] - own[g], 0.5) / max(n_words - len(w), 1))
            here, before = every[g] - own[g], every[g[:-1]] - own[g[:-1]]
            return math.log(here / before) if here > 0 and before > 0 else math.log(0.4) + plain(g[1:])

        s = sum(plain(tuple(w[max(0, i - order + 1) : i + 1])) for i in range(len(w)))
        want.append((d, len(w), round(s / len(w), 6) if w else None))
    got = language_model.score(odd.select("doc_id", "text").union(short), order=order).collect()
    assert sorted(((r["doc_id"], r["n_tokens"], None if r["log_score"] is None else round(r["log_score"], 6)) for r in got), key=repr) == sorted(want, key=repr)
    assert language_model.ORDER >= 3


def test_packed_numbers():
    for numbers in ([0], [0, 0, 0], [5, 2**63, 255, 256], list(range(1000))):
        a = np.array(numbers, np.uint64)
        assert language_model._unpack(language_model._pack(a), len(a)).tolist() == numbers


def _plain_rates(rows):
    """Rate by source of (source, size) rows: weights 5, 2, 1 in turn, targets up to 3 times a source's size, the rest shared again."""
    size = Counter()
    for s, n in rows:
        size[s] += n
    order = sorted(size, key=lambda s: (s is None, (s or "").encode()))
    weight = {s: (5, 2, 1)[i % 3] for i, s in enumerate(order)}
    free, target, left = set(order), {}, sum(size.values())
    while True:
        share = left / sum(weight[s] for s in free) if free else 0
        over = {s for s in free if weight[s] * share > 3 * size[s]}
        if not over:
            break
        for s in over:
            target[s] = 3 * size[s]
            left -= target[s]
        free -= over
    target |= {s: weight[s] * share for s in free}
    return {s: min(target[s] / size[s], 3.0) if size[s] else 0.0 for s in order}


def test_pipeline_by_brute_force(spark, tmp_path):
    """run() against the five stages in plain Python, with nulls, empty texts, repeated rows, near copies and an extra column."""
    import corpus_pipeline as p
    from tokenizers import Tokenizer

    rows = [tuple(r) for r in spark.read.parquet(f"{DATA}/documents.parquet").select("doc_id", "text", "lang", "source").orderBy("doc_id").collect()][:110]
    rng = np.random.default_rng(5)
    long = [r for r in rows if r[1] and 100 < len(r[1].split()) < 800]
    for i, r in enumerate(long[:10]):  # near copies, exact copies under another id, repeated rows
        words = r[1].split(" ")
        words[int(rng.integers(0, len(words)))] = "changed"
        rows += [(10_000 + i, " ".join(words), r[2], r[3]), (20_000 + i, r[1], r[2], r[3]), r]
    rows += [(30_000, None, "en", "s"), (30_001, "", None, None), (30_002, "12 34 --", "en", "s"), (None, long[0][1] + " and more of the kind here", "en", None)]
    columns = "doc_id long, text string, lang string, source string, n_chars long, uid long"
    spark.createDataFrame([(*r, 0, i) for i, r in enumerate(rows)], columns).coalesce(1).write.parquet(str(tmp_path / "documents.parquet"))
    rows = [tuple(r)[:4] for r in spark.read.parquet(str(tmp_path / "documents.parquet")).orderBy("uid").collect()]

    profiles = _plain_profiles([(t, lang) for d, t, lang, _ in rows if zlib.crc32(str("" if d is None else d).encode()) % 4 != 2])
    known = [r for r in rows if (lambda lang, score: lang != "und" and score > 0.02)(*_plain_language(r[1], profiles))]
    lined = [(d, text, lang, s) for (d, _, lang, s), (_, text, gone) in zip(known, _plain_line_dedup(known, 8)) if not gone or text.split()]
    unique = [lined[i] for i in _plain_keep_first(lined)]
    rates = _plain_rates([(s, len(t.split())) for _, t, _, s in unique])
    tokenizer = Tokenizer.from_file(tokenizer_path())
    want = []
    for d, t, _, s in unique:
        u = int(__import__("hashlib").md5(f"7:{'' if d is None else d}".encode()).hexdigest()[:13], 16) / 2**52
        ids = [*tokenizer.encode(t, add_special_tokens=False).ids, 1]
        for _ in range(int(rates[s]) + (u < rates[s] - int(rates[s]))):
            want += [(d, k, k * 4096, np.array(ids[k * 4096 : (k + 1) * 4096], "<u4").tobytes()) for k in range(-(-len(ids) // 4096))]
    packed = p.run(spark, str(tmp_path)).collect()
    assert sorted(((r["doc_id"], r["piece"], r["start"], bytes(r["ids"])) for r in packed), key=repr) == sorted(want, key=repr)
    assert len(unique) < len(lined) < len(known) + 1 < len(rows)
    bins = defaultdict(list)
    for r in packed:
        bins[r["sequence_id"]].append((r["offset"], r["length"]))
    assert all([a for a, _ in sorted(b)] == [sum(n for _, n in sorted(b)[:i]) for i in range(len(b))] and sum(n for _, n in b) <= 4096 for b in bins.values())


def test_pipeline_of_an_empty_table(spark, none, tmp_path):
    import corpus_pipeline as p

    none.write.parquet(str(tmp_path / "documents.parquet"))
    assert p.run(spark, str(tmp_path)).count() == 0


def test_pipeline(spark):
    import corpus_pipeline as p

    docs = spark.read.parquet(f"{DATA}/documents.parquet")
    for _, stage in p.STAGES[:-1]:
        out = p.materialize(stage(spark, docs, DATA), "test-stage")
        assert out.columns == docs.columns and 0 < out.count()
        docs = out
    packed = p.STAGES[-1][1](spark, docs, DATA)
    whole = p.run(spark, DATA)
    key = lambda df: sorted((r["doc_id"], r["piece"], bytes(r["ids"])) for r in df.collect())
    assert key(packed) == key(whole)
