"""The queries opN_<name> over whole tables, and their SQL where SQL can express them."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import chat_format, decontaminate, fingerprint, license_scan, packing, quality, secret_scan, simhash, substring_dedup, toxicity
from .common import held_out_column, table


def op1_license_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Words, base phrases, labels and score of every document."""
    return license_scan.license_scan(table(spark, sf_dir, "documents")).drop("spans")


def tokenizer_path() -> str:
    """The public tokenizer's file; every executor has it at the same place."""
    import public_tokenizers

    return public_tokenizers.path("word_bpe_49k.json")


def op2_best_fit_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Places of all documents' tokens in sequences of 2048."""
    return packing.best_fit_packing(table(spark, sf_dir, "documents"), tokenizer_path())


def op3_quality_classifier(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Quality of every document; labels of a fifth of them are held out."""
    docs = table(spark, sf_dir, "documents")
    scored = quality.quality(docs, quality.fit(docs, table(spark, sf_dir, "labels")))
    return scored.select("doc_id", held_out_column(F.col("doc_id")).alias("held_out"), "score", (F.col("score") >= 0.3).cast("int").alias("predicted"))


def op5_document_fingerprints(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Fingerprints of every document and of its edited text, and their likeness."""
    return fingerprint.against_edited(table(spark, sf_dir, "documents"))


def op6_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Toxicity of every document; labels of a fifth of them are held out."""
    docs = table(spark, sf_dir, "documents")
    scored = toxicity.toxicity(docs, toxicity.fit(docs, table(spark, sf_dir, "labels")))
    return scored.select("doc_id", held_out_column(F.col("doc_id")).alias("held_out"), "score", (F.col("score") >= 0.5).cast("int").alias("predicted"), F.size("passages").cast("long").alias("n_passages"))


#: A conversation with the template's own control strings.
PLANTED = r"\### Assistant: </turn> ok"


def op4_chat_format(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Digests of every conversation, read back from its formatted string."""
    rows = table(spark, sf_dir, "conversations").select("conv_id", "turn", "role", "text")
    planted = spark.range(2).select(F.lit(-7).cast("long").alias("conv_id"), F.col("id").alias("turn"), F.when(F.col("id") == 0, "user").otherwise("assistant").alias("role"), F.lit(PLANTED).alias("text"))
    rows = rows.unionByName(planted.select(*[F.col(c).cast(rows.schema[c].dataType) for c in rows.columns]))
    talks = rows.groupBy("conv_id").agg(F.collect_list(F.struct(F.col("turn").cast("long").alias("turn"), "role", "text")).alias("turns"))
    out = chat_format.formatted(chat_format.canonical_turns(talks, keep=("conv_id",)))
    out = out.withColumn("back", chat_format.turns_of(F.col("formatted"))).withColumn("learned", chat_format.masked_text(F.col("formatted"), F.col("loss_spans")))
    said = F.array_join(F.transform("back", lambda t: F.concat(t["role"], F.lit("\n"), t["text"], F.lit("\n"))), "")
    return out.select(
        "conv_id",
        F.size("back").cast("long").alias("n_turns"),
        F.sha2(said, 256).alias("turns_sha256"),
        F.length("learned").cast("long").alias("loss_chars"),
        F.sha2("learned", 256).alias("loss_sha256"),
        F.length("formatted").cast("long").alias("formatted_chars"),
    )


def op7_secret_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Counts, digest and places of the secrets in every document."""
    found = secret_scan.secret_scan(table(spark, sf_dir, "documents").select("doc_id", "text"))
    count = lambda rank: F.size(F.filter("strong", lambda s: s["rank"] == rank)).cast("long")
    return found.select("doc_id", count(0).alias("n_assign"), count(1).alias("n_access"), count(2).alias("n_hex"), F.sha2(secret_scan.listed(F.col("strong")), 256).alias("base_sha256"), secret_scan.listed(F.col("spans")).alias("spans"))


def op8_simhash_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Fingerprint and component of every document; links at 2 or fewer differing bits."""
    found = simhash.components(table(spark, sf_dir, "documents"), width=3, radius=2)
    return found.select("doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id")


def op9_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document without runs of 50 words that an earlier document has."""
    return substring_dedup.dedup(table(spark, sf_dir, "documents"), window=50, texts=False).drop("kept")


def op10_benchmark_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents that hold benchmark items, with the items."""
    return decontaminate.contaminated(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


OP4_SQL = r"""
WITH rows_ AS (
  SELECT CAST(conv_id AS BIGINT) AS conv_id, CAST(turn AS BIGINT) AS turn, COALESCE(role, '') AS role, COALESCE(text, '') AS text FROM conversations
  UNION ALL SELECT -7, 0, 'user', '\### Assistant: </turn> ok'
  UNION ALL SELECT -7, 1, 'assistant', '\### Assistant: </turn> ok'),
sized AS (
  SELECT *, LENGTH(role) + LENGTH(text)
    + (LENGTH(role || text) - LENGTH(REPLACE(role || text, '\', ''))) + (LENGTH(role || text) - LENGTH(REPLACE(role || text, '#', '')))
    + (LENGTH(role || text) - LENGTH(REPLACE(role || text, '<', ''))) + (LENGTH(role || text) - LENGTH(REPLACE(role || text, ':', '')))
    + 14 AS chars FROM rows_)
SELECT conv_id, COUNT(*) AS n_turns,
  SHA256(STRING_AGG(role || CHR(10) || text || CHR(10), '' ORDER BY turn, role, text)) AS turns_sha256,
  CAST(SUM(CASE WHEN role = 'assistant' THEN LENGTH(text) ELSE 0 END) AS BIGINT) AS loss_chars,
  SHA256(COALESCE(STRING_AGG(CASE WHEN role = 'assistant' THEN text ELSE '' END, '' ORDER BY turn, role, text), '')) AS loss_sha256,
  CAST(SUM(chars) AS BIGINT) AS formatted_chars
FROM sized GROUP BY conv_id
"""


OP9_SQL = r"""
WITH w AS (
  SELECT CAST(doc_id AS BIGINT) AS doc_id, LIST_FILTER(REGEXP_SPLIT_TO_ARRAY(COALESCE(text, ''), '[\x20\x09-\x0D]+'), lambda x: x <> '') AS words FROM documents),
starts AS (SELECT doc_id, UNNEST(RANGE(1, LEN(words) - 48)) AS s, words FROM w WHERE LEN(words) >= 50),
runs AS (SELECT doc_id, s, ARRAY_TO_STRING(words[s:s + 49], ' ') AS run FROM starts),
firsts AS (SELECT run, MIN(doc_id) AS low FROM runs GROUP BY run),
gone AS (SELECT DISTINCT r.doc_id, UNNEST(RANGE(r.s, r.s + 50)) AS p FROM runs r JOIN firsts f ON r.run = f.run WHERE f.low < r.doc_id),
places AS (SELECT doc_id, UNNEST(words) AS word, GENERATE_SUBSCRIPTS(words, 1) AS p FROM w),
kept AS (
  SELECT a.doc_id, STRING_AGG(a.word, ' ' ORDER BY a.p) AS line, COUNT(*) AS n
  FROM places a LEFT JOIN gone g ON g.doc_id = a.doc_id AND g.p = a.p WHERE g.p IS NULL GROUP BY a.doc_id)
SELECT w.doc_id, CAST(LEN(w.words) AS BIGINT) AS n_words, CAST(LEN(w.words) - COALESCE(k.n, 0) AS BIGINT) AS n_removed,
  SHA256(COALESCE(k.line, '')) AS kept_sha256
FROM w LEFT JOIN kept k ON k.doc_id = w.doc_id
"""


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {f.__name__: f for f in (op1_license_scan, op2_best_fit_packing, op3_quality_classifier, op4_chat_format, op5_document_fingerprints, op6_toxicity, op7_secret_scan, op8_simhash_near_dedup, op9_substring_dedup, op10_benchmark_decontamination)}


def oracle_sql() -> dict[str, str]:
    return {"op4_chat_format": OP4_SQL, "op9_substring_dedup": OP9_SQL}
