"""Queries over the whole synthetic tables, one for each corpus operator."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def _table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def tokenizer_path(name: str) -> str:
    import public_tokenizers

    return public_tokenizers.path(name)


def op1_viterbi_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    from parchmint.llm.toxicity import score, train

    docs = _table(spark, sf_dir, "documents")
    return score(docs, train(docs, _table(spark, sf_dir, "labels")))


def op2_temporal_url_lists(spark: SparkSession, sf_dir: str) -> DataFrame:
    from parchmint.llm.urllists import dated, filter_captures

    return filter_captures(*dated(_table(spark, sf_dir, "pages")))


def op3_simhash_trie_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    from parchmint.llm.simhash import near_duplicates

    return near_duplicates(_table(spark, sf_dir, "documents"))


def op4_benchmark_wand(spark: SparkSession, sf_dir: str) -> DataFrame:
    from parchmint.llm.decontam import contaminated

    return contaminated(_table(spark, sf_dir, "documents"), _table(spark, sf_dir, "benchmark"))


def op5_masked_likelihood(spark: SparkSession, sf_dir: str) -> DataFrame:
    from parchmint.llm.masked_lm import model_and_score

    return model_and_score(_table(spark, sf_dir, "documents"))


def op6_cost_balanced_packing(spark: SparkSession, sf_dir: str, tokenizer: str | None = None) -> DataFrame:
    from parchmint.llm.packing import pack

    pieces = pack(_table(spark, sf_dir, "documents"), tokenizer or tokenizer_path("word_bpe_49k.json"))
    return pieces.select("doc_id", "start", "length", F.crc32("ids").alias("ids_crc32"), "doc_tokens", "sequence_id", "offset")


def op7_typed_chat_parts(spark: SparkSession, sf_dir: str) -> DataFrame:
    from parchmint.llm.chat import digests, format_conversations, parts_of_text

    turns = _table(spark, sf_dir, "conversations").select(F.col("conv_id").cast("long"), F.col("turn").cast("long"), "role", "text")
    tricky = spark.range(2).select(F.lit(-7).cast("long").alias("conv_id"), F.col("id").alias("turn"), F.when(F.col("id") == 0, "user").otherwise("assistant").alias("role"), F.lit("\\### Assistant: </turn> ok").alias("text"))
    return digests(format_conversations(turns.unionByName(tricky).withColumn("parts", parts_of_text(F.col("text")))))


def op8_spotsigs(spark: SparkSession, sf_dir: str) -> DataFrame:
    from parchmint.llm.spotsigs import near_duplicates

    return near_duplicates(_table(spark, sf_dir, "documents"))


def op9_cotraining_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    from parchmint.llm.cotrain import score, train

    docs = _table(spark, sf_dir, "documents")
    return score(docs, train(docs, _table(spark, sf_dir, "labels")))


def op10_line_windows(spark: SparkSession, sf_dir: str) -> DataFrame:
    from parchmint.llm.linededup import dedup_lines

    return dedup_lines(_table(spark, sf_dir, "documents")).select("doc_id", "text", "n_lines", "n_removed")


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {f.__name__: f for f in (op1_viterbi_toxicity, op2_temporal_url_lists, op3_simhash_trie_join, op4_benchmark_wand, op5_masked_likelihood, op6_cost_balanced_packing, op7_typed_chat_parts, op8_spotsigs, op9_cotraining_quality, op10_line_windows)}


def oracle_sql() -> dict[str, str]:
    from parchmint.llm.chat import CHAT_SQL
    from parchmint.llm.linededup import LINE_DEDUP_SQL
    from parchmint.llm.urllists import URL_LISTS_SQL

    return {
        "op2_temporal_url_lists": URL_LISTS_SQL,
        "op7_typed_chat_parts": CHAT_SQL,
        "op10_line_windows": LINE_DEDUP_SQL.format(documents="documents")
        + "SELECT d.doc_id, CASE WHEN d.text IS NULL THEN NULL ELSE c.text END AS text, coalesce(c.n_lines, 0) AS n_lines, coalesce(c.n_removed, 0) AS n_removed FROM documents d LEFT JOIN counted c USING (doc_id)",
    }
