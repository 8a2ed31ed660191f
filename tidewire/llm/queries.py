"""Registered queries of the corpus operators: one thin query for each."""

from __future__ import annotations

import os

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import decontaminate, dialogue, html_extract, licenses, line_dedup, lm_score, media, near_dup, pieces, repeats, spelling, toxicity, training_order


def _table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def op1_html_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    pages = _table(spark, sf_dir, "pages").select("page_id", "url", "html")
    return html_extract.extract(pages).select("page_id", "url", "text", "n_chars")


def op2_lm_score(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = lm_score.lm_scores(_table(spark, sf_dir, "documents"))
    return out.select("doc_id", "n_words", F.round("score", 4).alias("score"))


def lm_held_out(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents whose id's hash begins with 0, 1 or 2, scored under the bigrams of all others."""
    docs = _table(spark, sf_dir, "documents").select("doc_id", "text")
    held = F.coalesce(F.md5(F.col("doc_id").cast("string").cast("binary")) < "3", F.lit(False))
    out = lm_score.ngram_scores(docs.filter(held), order=2, corpus=docs.filter(~held))
    return out.select("doc_id", "n_words", "n_backed", F.round("score", 4).alias("score"))


def op3_decontaminate(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = _table(spark, sf_dir, "documents").select("doc_id", "text")
    out = decontaminate.decontaminate(docs, _table(spark, sf_dir, "benchmark"))
    return out.select("doc_id", "n_words", "n_hit", "n_items", "items_sha256", "contaminated")


def op4_near_duplicates(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = near_dup.near_duplicates(_table(spark, sf_dir, "documents"))
    return out.select("doc_id", "n_shingles", "component_id", "kept")


def op5_license_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = licenses.scan(_table(spark, sf_dir, "documents"))
    return out.select("doc_id", "n_words", "n_base", "first_word", "last_word", "base_labels", "labels", "score")


#: The tokenizer files' folder, a parameter of the installation.
TOKENIZERS = os.environ.get("TOKENIZER_DIR", "/opt/tokenizers")
PIECE_MODEL = "piece_bpe_32k.model"


def op6_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = _table(spark, sf_dir, "documents").select("doc_id", "text")
    out = toxicity.score(docs, docs, _table(spark, sf_dir, "labels"))
    return out.select("doc_id", "held_out", "score", "predicted")


def op7_repeats(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = repeats.remove_repeats(_table(spark, sf_dir, "documents").select("doc_id", "text"))
    return out.select("doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256")


RANKS = "byte_bpe_50k.tiktoken"
ORDER_KEY = 20240229


def op8_training_order(spark: SparkSession, sf_dir: str) -> DataFrame:
    ranks = pieces.read_model(f"{TOKENIZERS}/{RANKS}")
    return training_order.materialise(_table(spark, sf_dir, "documents"), ranks, ORDER_KEY)


def round_trip(docs: DataFrame) -> DataFrame:
    """Encode, decode and sum up ``docs`` (doc_id, text)."""
    proto = pieces.read_model(f"{TOKENIZERS}/{PIECE_MODEL}")
    out = pieces.decode(pieces.encode(docs.select("doc_id", "text"), proto), proto)
    return out.select(
        "doc_id", F.size("ids").cast("long").alias("n_tokens"), "score",
        F.sha2(F.array_join("ids", ",").cast("binary"), 256).alias("ids_sha256"),
        F.sha2(F.col("decoded").cast("binary"), 256).alias("decoded_sha256"),
        (F.col("decoded") == F.replace(F.coalesce("text", F.lit("")), F.lit(pieces.MARK), F.lit(" "))).alias("round_trip"),
    )


def op9_sentencepiece(spark: SparkSession, sf_dir: str) -> DataFrame:
    return round_trip(_table(spark, sf_dir, "documents"))


def op10_media_columns(spark: SparkSession, sf_dir: str) -> DataFrame:
    return media.media_features(_table(spark, sf_dir, "documents"))


def op11_spelling_variants(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spelling.variants(_table(spark, sf_dir, "documents"))


def op12_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = line_dedup.dedup_lines(_table(spark, sf_dir, "documents"))
    return out.select("doc_id", "n_lines", "n_dropped", F.sha2(F.col("text").cast("binary"), 256).alias("kept_sha256"))


def op13_conversation_repair(spark: SparkSession, sf_dir: str) -> DataFrame:
    return dialogue.repair(_table(spark, sf_dir, "conversations"), damage=True)


QUERIES = {
    "op1_html_text": op1_html_text,
    "op2_lm_score": op2_lm_score,
    "lm_held_out": lm_held_out,
    "op3_decontaminate": op3_decontaminate,
    "op4_near_duplicates": op4_near_duplicates,
    "op5_license_scan": op5_license_scan,
    "op6_toxicity": op6_toxicity,
    "op7_repeats": op7_repeats,
    "op8_training_order": op8_training_order,
    "op9_sentencepiece": op9_sentencepiece,
    "op10_media_columns": op10_media_columns,
    "op11_spelling_variants": op11_spelling_variants,
    "op12_line_dedup": op12_line_dedup,
    "op13_conversation_repair": op13_conversation_repair,
}
LM_SQL = """
WITH w AS (
  SELECT doc_id, unnest(words) AS word, generate_subscripts(words, 1) AS i FROM (
    SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+') AS words FROM documents)),
g AS (SELECT doc_id, i, word, lag(word) OVER (PARTITION BY doc_id ORDER BY i) AS before FROM w),
u AS (SELECT word, count(*) AS f FROM w GROUP BY word),
b AS (SELECT before, word, count(*) AS f FROM g WHERE before IS NOT NULL GROUP BY before, word),
n AS (SELECT count(*)::DOUBLE AS n FROM w),
s AS (
  SELECT g.doc_id, count(*) AS n_words,
    sum(CASE WHEN g.before IS NULL THEN ln(u.f / n.n) ELSE ln(b.f::DOUBLE / x.f) END) AS score
  FROM g JOIN u ON u.word = g.word LEFT JOIN b ON b.before = g.before AND b.word = g.word LEFT JOIN u x ON x.word = g.before, n GROUP BY g.doc_id)
SELECT d.doc_id, coalesce(s.n_words, 0) AS n_words, round(coalesce(s.score, 0.0), 4) AS score FROM documents d LEFT JOIN s USING (doc_id)
"""

HELD_OUT_SQL = """
WITH w AS (
  SELECT doc_id, held, unnest(words) AS word, generate_subscripts(words, 1) AS i FROM (
    SELECT doc_id, coalesce(md5(CAST(doc_id AS VARCHAR)) < '3', FALSE) AS held, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+') AS words FROM documents)),
g AS (SELECT doc_id, held, i, word, lag(word) OVER (PARTITION BY doc_id ORDER BY i) AS before FROM w),
u AS (SELECT word, count(*) AS f FROM w WHERE NOT held GROUP BY word),
b AS (SELECT before, word, count(*) AS f FROM g WHERE NOT held AND before IS NOT NULL GROUP BY before, word),
n AS (SELECT greatest(count(*), 1)::DOUBLE AS n FROM w WHERE NOT held),
s AS (
  SELECT g.doc_id, count(*) AS n_words, count(*) FILTER (u.f IS NULL OR (g.before IS NOT NULL AND b.f IS NULL)) AS n_backed,
    sum(CASE WHEN b.f IS NOT NULL THEN ln(b.f::DOUBLE / x.f)
      ELSE CASE WHEN g.before IS NULL THEN 0 ELSE ln(0.4::DOUBLE) END + CASE WHEN u.f IS NULL THEN ln(0.4::DOUBLE / n.n) ELSE ln(u.f / n.n) END END) AS score
  FROM g LEFT JOIN u ON u.word = g.word LEFT JOIN b ON b.before = g.before AND b.word = g.word LEFT JOIN u x ON x.word = g.before, n WHERE g.held GROUP BY g.doc_id)
SELECT d.doc_id, coalesce(s.n_words, 0) AS n_words, coalesce(s.n_backed, 0) AS n_backed, round(coalesce(s.score, 0.0), 4) AS score
FROM documents d LEFT JOIN s USING (doc_id) WHERE md5(CAST(d.doc_id AS VARCHAR)) < '3'
"""

LINES_SQL = """
WITH l AS (
  SELECT doc_id, line, i, translate(trim(line, chr(32) || chr(9) || chr(10) || chr(11) || chr(12) || chr(13)), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS key FROM (
    SELECT doc_id, unnest(lines) AS line, generate_subscripts(lines, 1) AS i FROM (SELECT doc_id, string_split(coalesce(text, ''), chr(10)) AS lines FROM documents))),
f AS (SELECT key, max(doc_id) AS last FROM l WHERE length(key) >= 20 GROUP BY key HAVING count(DISTINCT doc_id) >= 3),
m AS (SELECT l.*, coalesce(l.doc_id < f.last, FALSE) AS gone FROM l LEFT JOIN f ON f.key = l.key)
SELECT doc_id, count(*) AS n_lines, count(*) FILTER (gone) AS n_dropped, sha256(coalesce(string_agg(line, chr(10) ORDER BY i) FILTER (NOT gone), '')) AS kept_sha256
FROM m GROUP BY doc_id
"""

ORACLE_SQL: dict[str, str] = {"op2_lm_score": LM_SQL, "lm_held_out": HELD_OUT_SQL, "op12_line_dedup": LINES_SQL}
