"""The numbered queries over the training-data tables, and their SQL where SQL can say them."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import chat, dedup, language, manifest, neighbours, quality, similarity, simhash, tokens, variants
from .common import shared_dir


def tokenizer_path(name: str) -> str:
    import public_tokenizers

    return public_tokenizers.path(name)


def _table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def op1_best_fit_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return tokens.pack_documents(_table(spark, sf_dir, "documents"), tokenizer_path("byte_bpe_50k.json"), size=2048, end_id=0)


def op2_byte_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers

    coded = tokens.recode_documents(_table(spark, sf_dir, "documents"), tokenizer_path("byte_bpe_50k.tiktoken"), public_tokenizers.PATTERN)
    n = (F.octet_length("ids") / 4).cast("long")
    return coded.select("doc_id", n.alias("n_tokens"), F.sha2("ids", 256).alias("ids_sha256"), F.sha2("decoded", 256).alias("decoded_sha256"))


def op3_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality.score_documents(_table(spark, sf_dir, "documents"), _table(spark, sf_dir, "labels"))


def op4_nearest_neighbours(spark: SparkSession, sf_dir: str) -> DataFrame:
    return neighbours.nearest(_table(spark, sf_dir, "embeddings"), every=20, k=20)


def op5_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return dedup.duplicate_report(_table(spark, sf_dir, "documents"))


def op6_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    return language.identify_languages(_table(spark, sf_dir, "documents"))


def op7_token_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    path, model = shared_dir(spark, "tokens"), tokenizer_path("word_bpe_49k.json")
    tokens.write_token_files(_table(spark, sf_dir, "documents"), lambda: tokens.library_words(model), path, end_id=1)
    # counts and checksums are taken from the tokens that the files give back, not from the columns beside them
    return tokens.checked_token_files(spark, path)


def op8_chat_formatting(spark: SparkSession, sf_dir: str) -> DataFrame:
    planted = r"\### Assistant: </turn> ok"
    turns = _table(spark, sf_dir, "conversations").select("conv_id", "turn", "role", "text")
    extra = spark.createDataFrame([(-7, 0, "user", planted), (-7, 1, "assistant", planted)], turns.schema)
    back = chat.read_conversations(chat.format_conversations(turns.unionByName(extra)))
    said = F.array_join(F.transform("turns", lambda t: F.concat(t["role"], F.lit("\n"), t["text"], F.lit("\n"))), "")
    loss = F.array_join("loss_texts", "")
    return back.select(
        "conv_id",
        F.size("turns").cast("long").alias("n_turns"),
        F.sha2(said.cast("binary"), 256).alias("turns_sha256"),
        F.char_length(loss).cast("long").alias("loss_chars"),
        F.sha2(loss.cast("binary"), 256).alias("loss_sha256"),
        F.char_length("formatted").cast("long").alias("formatted_chars"),
    )


def op9_jaccard_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return similarity.similar_documents(_table(spark, sf_dir, "documents"))


def op10_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return tokens.count_tokens(_table(spark, sf_dir, "documents"), tokenizer_path("piece_bpe_32k.model"))


def op11_spelling_variants(spark: SparkSession, sf_dir: str) -> DataFrame:
    return variants.spelling_variants(_table(spark, sf_dir, "documents"), shortest=7, least=2, ratio=10, every=31)


def op12_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    return simhash.near_duplicates(_table(spark, sf_dir, "documents"), most=2)


def op13_merkle_manifest(spark: SparkSession, sf_dir: str) -> DataFrame:
    # deletes line feeds in the texts of every second document, by the checksum of its id
    chosen = F.crc32(F.col("doc_id").cast("string").cast("binary")) % 2 == 0
    rows = manifest.document_manifest(_table(spark, sf_dir, "documents"), F.when(chosen, F.translate("text", "\n", "")))
    folded = rows.withColumn("folded_root", manifest.fold(F.col("shown"), F.col("proof")))
    proof = F.sha2(manifest.siblings(F.col("proof")).cast("binary"), 256)
    return folded.select("doc_id", "leaf", "subroot", "root", proof.alias("proof_sha256"), "folded_root", (F.col("folded_root") == F.col("root")).alias("verified"))


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {name: f for name, f in globals().items() if name.startswith("op") and name[2].isdigit()}


OP5_SQL = r"""
WITH d AS (
  SELECT doc_id, length(coalesce(text, '')) AS n_points,
         sha256(regexp_replace(coalesce(text, ''), '[\x20\x09-\x0D]', '', 'g')) AS text_sha256
  FROM documents),
w AS (
  SELECT *, count(*) OVER (PARTITION BY text_sha256) AS group_size,
         first_value(doc_id) OVER (PARTITION BY text_sha256 ORDER BY n_points DESC, doc_id) AS keep_id,
         row_number() OVER (PARTITION BY text_sha256 ORDER BY n_points DESC, doc_id) AS nth
  FROM d)
SELECT doc_id, keep_id, group_size, nth = 1 AS kept, text_sha256 FROM w
"""

#: The template's markers and escapes only show in formatted_chars.
OP8_SQL = r"""
WITH t AS (
  SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations
  UNION ALL SELECT -7, 0, 'user', '\### Assistant: </turn> ok'
  UNION ALL SELECT -7, 1, 'assistant', '\### Assistant: </turn> ok'),
p AS (
  SELECT *, role = lag(role) OVER (PARTITION BY conv_id ORDER BY turn, role, text) AS same FROM t)
SELECT conv_id, count(*) AS n_turns,
       sha256(string_agg(role || chr(10) || text || chr(10), '' ORDER BY turn, role, text)) AS turns_sha256,
       coalesce(sum(length(text)) FILTER (role = 'assistant'), 0)::BIGINT AS loss_chars,
       sha256(coalesce(string_agg(text, '' ORDER BY turn, role, text) FILTER (role = 'assistant'), '')) AS loss_sha256,
       sum(length(text) + (length(text) - length(replace(replace(replace(text, '\', ''), '<', ''), '#', '')))
           + CASE WHEN coalesce(same, false) THEN 7
                  ELSE 14 + length(role) + length(role) - length(replace(replace(replace(replace(role, '\', ''), '<', ''), '#', ''), ':', '')) END)::BIGINT AS formatted_chars
FROM p GROUP BY conv_id
"""


def oracle_sql() -> dict[str, str]:
    return {"op5_exact_dedup": OP5_SQL, "op8_chat_formatting": OP8_SQL}
