"""The operators' queries over whole tables, and their SQL where SQL can express them."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from georank.llm import embedding_dedup, language_id, language_model, license_scan, line_dedup, mixing, packing, simhash, topk, toxicity
from georank.llm.common import ship


def _read(spark: SparkSession, sf_dir: str, table: str) -> DataFrame:
    ship(spark)
    return spark.read.parquet(f"{sf_dir}/{table}.parquet")


def op1_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = _read(spark, sf_dir, "documents")
    return mixing.plan_mix(docs).select("doc_id", "size", "source_size", "target", "taken")


def op2_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = _read(spark, sf_dir, "documents")
    profiles = language_id.learn(docs.where(~language_id.held_out(F.col("doc_id"))))
    found = language_id.identify(docs.select("doc_id", "text"), profiles)
    return found.select("doc_id", language_id.held_out(F.col("doc_id")).alias("held_out"), "lang_pred", "score")


def op3_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = _read(spark, sf_dir, "documents")
    model = toxicity.fit(docs, _read(spark, sf_dir, "labels"), ~toxicity.held_out(F.col("doc_id")))
    found = toxicity.score(docs, model)
    return found.select("doc_id", toxicity.held_out(F.col("doc_id")).alias("held_out"), "score", "predicted", "evidence")


def tokenizer_path() -> str:
    """The vocabulary file of the packing contract."""
    import public_tokenizers

    return str(public_tokenizers.path("word_bpe_49k.json"))


def op4_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    packed = packing.pack_documents(_read(spark, sf_dir, "documents"), tokenizer_path(), capacity=4096, keep_ids=False)
    return packed.select("doc_id", "piece", "start", "length", "ids_crc32", "sequence_id", "offset")


def op5_topk(spark: SparkSession, sf_dir: str) -> DataFrame:
    vectors = _read(spark, sf_dir, "embeddings")
    return topk.top_k(vectors, F.col("vec_id") % 50 == 0, k=5)


def op6_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = _read(spark, sf_dir, "documents").select("doc_id", "text")
    return line_dedup.dedup_lines(docs, details=True).select("doc_id", "n_lines", "n_deleted", "text")


def op10_language_model(spark: SparkSession, sf_dir: str) -> DataFrame:
    return language_model.score(_read(spark, sf_dir, "documents"), order=language_model.ORDER)


def op7_license_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = _read(spark, sf_dir, "documents")
    # The table has no paths: a document lies in its source's folder for each hundred ids.
    path = F.concat_ws("/", F.coalesce("source", F.lit("none")), F.expr("cast(doc_id div 100 as string)"), F.concat(F.col("doc_id").cast("string"), F.lit(".txt")))
    return license_scan.scan(docs, path)


def op8_embedding_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return embedding_dedup.near_duplicates(_read(spark, sf_dir, "embeddings"))


def op9_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = simhash.near_duplicates(_read(spark, sf_dir, "documents"), shingle=3, radius=2)
    digits = F.lpad(F.lower(F.hex("fp")), 16, "0")
    return found.select("doc_id", digits.alias("fingerprint"), "component_id")


_OP1 = r"""
WITH sized AS (
  SELECT doc_id, source, CASE WHEN text IS NULL THEN 0 ELSE len(regexp_extract_all(text, '[^\x20\x09-\x0D]+')) END::BIGINT AS size FROM documents),
src AS (SELECT source, SUM(size)::BIGINT AS source_size FROM sized GROUP BY source),
ranked AS (SELECT *, CASE (row_number() OVER (ORDER BY source ASC NULLS LAST) - 1) % 3 WHEN 0 THEN 5 WHEN 1 THEN 2 ELSE 1 END AS w, 3 * source_size AS cap FROM src),
run AS (SELECT *, COALESCE(SUM(cap) OVER o, 0)::BIGINT AS cap_before, COALESCE(SUM(w) OVER o, 0)::BIGINT AS w_before,
  (SELECT SUM(source_size) FROM src)::BIGINT AS total, (SELECT SUM(w) FROM ranked)::BIGINT AS w_all
  FROM ranked WINDOW o AS (ORDER BY cap::DOUBLE / w, source ASC NULLS LAST ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)),
lvl AS (SELECT total - cap_before AS part, w_all - w_before AS weight FROM run
  WHERE (total - cap_before) * w <= cap * (w_all - w_before) ORDER BY cap::DOUBLE / w, source ASC NULLS LAST LIMIT 1),
targets AS (SELECT source, source_size, LEAST(cap::DOUBLE, part::DOUBLE * w / weight::DOUBLE) AS target FROM ranked, lvl),
rates AS (SELECT *, CASE WHEN source_size > 0 THEN LEAST(target / source_size, 3.0) ELSE 0.0 END AS rate FROM targets),
drawn AS (SELECT d.doc_id, d.size, r.source_size, r.target, r.rate,
  ('0x' || substr(md5('7:' || COALESCE(d.doc_id::VARCHAR, '')), 1, 13))::BIGINT::DOUBLE / 4503599627370496.0 AS u
  FROM sized d JOIN rates r ON d.source IS NOT DISTINCT FROM r.source)
SELECT doc_id, size, source_size, target, (size * (floor(rate) + CASE WHEN u < rate - floor(rate) THEN 1 ELSE 0 END))::BIGINT AS taken FROM drawn
"""

_OP5 = """
WITH v AS (SELECT vec_id, list_transform(embedding, lambda x: floor(256 * x::DOUBLE)) AS e FROM embeddings
  WHERE vec_id IS NOT NULL AND embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
s AS (SELECT q.vec_id AS query_id, c.vec_id, list_dot_product(q.e, c.e)::BIGINT AS score
  FROM v q JOIN v c ON q.vec_id % 50 = 0 AND q.vec_id <> c.vec_id AND len(q.e) = len(c.e)),
r AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id)::INTEGER AS rank FROM s)
SELECT query_id, rank, vec_id, score FROM r WHERE rank <= 5
"""

_OP8 = """
WITH RECURSIVE v AS (SELECT vec_id, label, list_transform(embedding, lambda x: x::DOUBLE) AS e FROM embeddings
  WHERE label IS NOT NULL AND embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0
  AND len(list_filter(embedding, lambda x: x <> 0)) > 0),
links AS (SELECT a.vec_id AS a, b.vec_id AS b FROM v a JOIN v b ON a.label = b.label AND a.vec_id <> b.vec_id AND len(a.e) = len(b.e)
  WHERE list_cosine_similarity(a.e, b.e) >= 0.98),
reach AS (SELECT a AS x, b AS y FROM links UNION SELECT r.x, l.b FROM reach r JOIN links l ON r.y = l.a),
least AS (SELECT x, MIN(y) AS m FROM reach GROUP BY x),
deg AS (SELECT a, COUNT(*) AS n FROM links GROUP BY a)
SELECT e.vec_id, COALESCE(d.n, 0)::BIGINT AS n_links, LEAST(e.vec_id, COALESCE(l.m, e.vec_id)) AS component_id,
  e.vec_id = LEAST(e.vec_id, COALESCE(l.m, e.vec_id)) AS kept
FROM embeddings e LEFT JOIN deg d ON d.a = e.vec_id LEFT JOIN least l ON l.x = e.vec_id
"""

# The longest earlier copy at each line, from all pairs of equal lines: on a diagonal (equal distance between two
# documents' lines) pairs that follow one another are a common run, so no power of two occurs here.
_OP6 = r"""
WITH doc AS (SELECT row_number() OVER (ORDER BY doc_id) AS rid, doc_id, text, string_split(text, chr(10)) AS lines FROM documents),
each AS (SELECT rid, unnest(range(len(lines))) AS i, unnest(lines) AS x FROM doc),
wordy AS (SELECT *, len(regexp_extract_all(x, '[^\x20\x09-\x0D]+')) AS w FROM each),
ln AS (SELECT rid, i, x, row_number() OVER d - 1 AS seq, sum(w) OVER d AS cum, w FROM wordy WHERE w > 0 WINDOW d AS (PARTITION BY rid ORDER BY i)),
pairs AS (SELECT p.rid AS rid, p.seq AS seq, q.rid AS o_rid, p.seq - q.seq AS gap FROM ln p JOIN ln q ON p.x = q.x AND (q.rid < p.rid OR (q.rid = p.rid AND q.seq < p.seq))),
island AS (SELECT *, seq - row_number() OVER (PARTITION BY rid, o_rid, gap ORDER BY seq) AS k FROM pairs),
longest AS (SELECT rid, seq, max(stop) AS stop FROM (SELECT rid, seq, max(seq) OVER (PARTITION BY rid, o_rid, gap, k) + 1 AS stop FROM island) GROUP BY ALL),
marks AS (SELECT l.rid, l.seq, l.stop FROM longest l JOIN ln a ON a.rid = l.rid AND a.seq = l.seq JOIN ln z ON z.rid = l.rid AND z.seq = l.stop - 1 WHERE z.cum - a.cum + a.w >= 8),
cover AS (SELECT n.rid, n.i, n.seq, max(m.stop) OVER (PARTITION BY n.rid ORDER BY n.seq) AS stop FROM ln n LEFT JOIN marks m ON m.rid = n.rid AND m.seq = n.seq),
gone AS (SELECT rid, i FROM cover WHERE stop > seq),
kept AS (SELECT e.rid, string_agg(e.x, chr(10) ORDER BY e.i) AS text, count(*) AS n FROM each e ANTI JOIN gone g ON g.rid = e.rid AND g.i = e.i GROUP BY e.rid)
SELECT d.doc_id, COALESCE(len(d.lines), 0)::INTEGER AS n_lines, (COALESCE(len(d.lines), 0) - COALESCE(k.n, 0))::INTEGER AS n_deleted,
  CASE WHEN d.text IS NULL THEN NULL ELSE COALESCE(k.text, '') END AS text
FROM doc d LEFT JOIN kept k ON k.rid = d.rid
"""

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "op1_mixing": op1_mixing,
    "op2_language_id": op2_language_id,
    "op3_toxicity": op3_toxicity,
    "op4_packing": op4_packing,
    "op5_topk": op5_topk,
    "op6_line_dedup": op6_line_dedup,
    "op7_license_scan": op7_license_scan,
    "op8_embedding_dedup": op8_embedding_dedup,
    "op9_simhash": op9_simhash,
    "op10_language_model": op10_language_model,
}

ORACLE_SQL: dict[str, str] = {"op1_mixing": _OP1, "op5_topk": _OP5, "op6_line_dedup": _OP6, "op8_embedding_dedup": _OP8}
