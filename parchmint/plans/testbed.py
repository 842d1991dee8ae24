"""Transcribed lines derived from the synthetic ``documents``, the same in Spark and SQL.

``reference`` writes some syllables with abbreviation marks, ``prediction`` and
``prediction2`` are noisy copies of it, all by a hash of the line's id.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from parchmint.functions import text as T
from parchmint.sources.lines import document_lines


def hash32(x: Column) -> Column:
    return F.conv(F.substring(F.md5(x), 1, 8), 16, 10).cast("long")


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def _chain(c: Column, pairs: tuple[tuple[str, str], ...]) -> Column:
    for a, b in pairs:
        c = F.replace(c, F.lit(a), F.lit(b))
    return c


ABBREVIATE = (("con", "ꝯ"), ("per", "ꝑ"), (" et ", " ⁊ "), ("que", "ꝙ"))


def lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    """doc_id, ordinal, manuscript, image_id, line_id, text, h, reference, prediction, prediction2, confidence, has_abbreviation."""
    rows = document_lines(table(spark, sf_dir, "documents")).withColumn("h", hash32(F.col("line_id")))
    base = _chain(F.col("text"), ABBREVIATE)
    rows = rows.withColumn("reference", F.when(F.col("h") % 7 == 0, F.replace(base, F.lit("an"), F.lit("ã"))).otherwise(base))
    ref = F.col("reference")
    return rows.withColumns(
        {
            "prediction": F.when(F.col("h") % 5 < 2, F.replace(F.translate(ref, "aeo", "eoa"), F.lit("ou"), F.lit(""))).otherwise(ref),
            "prediction2": F.when(F.floor(F.col("h") / 5) % 4 == 0, F.replace(ref, F.lit("s"), F.lit("f"))).otherwise(ref),
            "confidence": (F.col("h") % 1000) / 1000.0,
            "has_abbreviation": T.has_abbreviation(ref),
        }
    )


MARKS_SQL = r"[\x{0303}\x{0305}\x{033E}\x{0360}\x{0361}\x{0363}-\x{036F}\x{A720}-\x{A7FF}]"

#: The same lines for DuckDB, as common table expressions that end in ``lines``.
LINES_SQL = f"""
cut AS (
  SELECT doc_id, source, unnest(string_split(text, chr(10))) AS line, generate_subscripts(string_split(text, chr(10)), 1) - 1 AS pos FROM documents
), worded AS (
  SELECT *, list_filter(string_split(line, ' '), lambda w: w <> '') AS w FROM cut
), runs AS (
  SELECT doc_id, source, pos, w, unnest(range(0, (len(w) + 15) // 16)) AS k FROM worded WHERE len(w) > 0
), numbered AS (
  SELECT doc_id, source AS manuscript, pos * 2147483648 + k AS line_no, array_to_string(list_slice(w, k * 16 + 1, k * 16 + 16), ' ') AS text FROM runs
), named AS (
  SELECT *, doc_id::HUGEINT * 4611686018427387904 + line_no AS ordinal, manuscript || '_' || doc_id AS image_id, 'd' || doc_id || '_l' || line_no AS line_id FROM numbered
), hashed AS (
  SELECT *, ('0x' || substr(md5(line_id), 1, 8))::BIGINT AS h, replace(replace(replace(replace(text, 'con', 'ꝯ'), 'per', 'ꝑ'), ' et ', ' ⁊ '), 'que', 'ꝙ') AS base FROM named
), referenced AS (
  SELECT *, CASE WHEN h % 7 = 0 THEN replace(base, 'an', 'a' || chr(771)) ELSE base END AS reference FROM hashed
), lines AS (
  SELECT * EXCLUDE (base),
    CASE WHEN h % 5 < 2 THEN replace(translate(reference, 'aeo', 'eoa'), 'ou', '') ELSE reference END AS prediction,
    CASE WHEN (h // 5) % 4 = 0 THEN replace(reference, 's', 'f') ELSE reference END AS prediction2,
    (h % 1000) / 1000.0::DOUBLE AS confidence, regexp_matches(reference, '{MARKS_SQL}') AS has_abbreviation
  FROM referenced
)
"""
