"""The corpus pipeline: quality, line dedup, near-dedup, decontamination, packing.

Each stage takes (spark, docs, sf_dir); ``docs`` is what the stage before it
left, and every stage but the last returns the columns of ``documents``. Other
columns, whatever their names, are left out; empty tables give empty results.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from parchmint.llm import cotrain, decontam, linededup, packing, simhash
from parchmint.llm.common import written
from parchmint.llm.queries import tokenizer_path

COLUMNS = ("doc_id", "text", "lang", "source", "n_chars")


def quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drops the documents that the co-trained classifier rejects.

    Null texts, languages and sources count as empty and are judged like any
    other; repeated rows share a fate; null doc_ids have no label. Without labels
    of both classes nothing is dropped; no rows in, none out.
    """
    docs = docs.select(*COLUMNS)
    return cotrain.keep_good(docs, cotrain.train(docs, spark.read.parquet(f"{sf_dir}/labels.parquet")))


def line_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Cuts repeated three-line windows; a document may become empty, none is dropped.

    Null texts stay null, texts of under three filled lines stay as they are, rows
    that repeat a doc_id and text are one document and get one result each. Ties
    go to the smaller doc_id, then line; a null doc_id comes last.
    """
    return linededup.dedup_lines(docs.select(*COLUMNS)).select(*COLUMNS)


def near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keeps the document with the smallest doc_id of each SimHash component.

    Null and blank texts are one component. Of rows that share the smallest
    doc_id the one with the smallest hash of its text stays, once; a component
    without any doc_id keeps one row.
    """
    return simhash.keep_one(docs.select(*COLUMNS))


def decontaminate(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drops the documents that hold a benchmark item.

    Null and blank texts hold none, repeated rows share a fate, doc_ids play no
    part; an empty benchmark drops nothing.
    """
    return decontam.clean(docs.select(*COLUMNS), spark.read.parquet(f"{sf_dir}/benchmark.parquet"))


def pack(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Packs the documents' tokens into training sequences.

    A null or blank text is its end token alone, very long texts fill several
    sequences, repeated rows are packed each, and a null doc_id stays null.
    """
    return packing.pack(docs.select(*COLUMNS), tokenizer_path("word_bpe_49k.json"))


STAGES = [("quality", quality), ("line_dedup", line_dedup), ("near_dedup", near_dedup), ("decontaminate", decontaminate), ("pack", pack)]

#: The classifier, SimHash components and tokeniser have no SQL form.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over ``documents``, each written and read again before the next."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for k, (_, stage) in enumerate(STAGES):
        docs = stage(spark, docs, sf_dir)
        if k < len(STAGES) - 1:
            docs = written(docs)
    return docs
