"""Removal of repeated passages by overlapping three-line windows."""

from __future__ import annotations

from decimal import Decimal

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from parchmint.llm.common import boxed, dealt_anew, unboxed, written

WINDOW = 3
BLANKS = " \t\r"


def _lines(text: Column) -> Column:
    return F.split(text, "\n", -1)


def _filled(lines: Column) -> Column:
    """Positions of the lines that aren't blank."""
    return F.filter(F.transform(lines, lambda x, i: F.when(F.btrim(x, F.lit(BLANKS)) != "", i)), lambda i: i.isNotNull())


def windows(docs: DataFrame, size: int = WINDOW) -> DataFrame:
    """(doc_id, version, at, h1, h2): every run of ``size`` lines that aren't blank.

    ``at`` counts those lines from zero; h1 and h2 are two independent 64-bit
    hashes of the run, lines trimmed; version tells apart rows of one doc_id
    whose texts differ.
    """
    line = lambda x: F.btrim(x, F.lit(BLANKS))
    hashed = F.filter(
        F.transform(_lines(F.col("text")), lambda x: F.when(line(x) != "", F.struct(F.xxhash64(line(x)).alias("a"), F.xxhash64(F.lit(7), line(x)).alias("b")))),
        lambda x: x.isNotNull(),
    )
    runs = F.transform(
        F.sequence(F.lit(0), F.size("hs") - size),
        lambda i: F.struct(
            i.alias("at"),
            F.xxhash64(*[F.element_at("hs", i + 1 + k)["a"] for k in range(size)]).alias("h1"),
            F.xxhash64(*[F.element_at("hs", i + 1 + k)["b"] for k in range(size)]).alias("h2"),
        ),
    )
    return (
        docs.select("doc_id", F.xxhash64("text").alias("version"), hashed.alias("hs"))
        .where(F.size("hs") >= size)
        .select("doc_id", "version", F.explode(runs).alias("w"))
        .select("doc_id", "version", "w.at", "w.h1", "w.h2")
    )


def dedup_lines(docs: DataFrame, size: int = WINDOW) -> DataFrame:
    """``docs`` with repeated passages cut from ``text``, and n_lines, n_removed.

    Lines are cut at newlines, compared without blanks at their ends; blank
    lines take no part and stay. Every run of three consecutive other lines is
    hashed. Of all places where a run occurs in the corpus, the first by
    (doc_id, line) stays; the lines covered by any other place go, overlapping
    places merged. Texts of fewer lines have no run and stay as they are. A null
    text stays null with n_lines 0; a text that loses all lines becomes empty.
    Rows that repeat a doc_id and text are one document and get one result each;
    rows that share a doc_id only are told apart, the smaller hash of the text first
    at one line. A null doc_id comes last. n_chars, if there, is
    counted anew; other columns are kept; columns n_lines and n_removed are
    replaced. No rows in, none out.
    """
    runs = written(windows(docs.select(F.col("doc_id").cast("long"), F.col("text").cast("string")), size))
    # A null doc_id is beyond all others; the version tells apart rows of one doc_id.
    key = F.coalesce(F.col("doc_id").cast("decimal(20,0)"), F.lit(Decimal(1 << 63)).cast("decimal(20,0)"))
    place = ((key * F.lit(Decimal(1 << 62)).cast("decimal(19,0)")).cast("decimal(38,0)") + F.col("at").cast("long") * (1 << 31) + F.col("version").bitwiseAND((1 << 31) - 1)).cast("decimal(38,0)")
    runs = runs.withColumn("place", place)
    repeated = runs.groupBy("h1", "h2").agg(F.count(F.lit(1)).alias("n"), F.min("place").alias("first")).where("n > 1").select("h1", "h2", "first")
    later = runs.join(dealt_anew(repeated, "first"), ["h1", "h2"]).where("place <> first")
    covered = later.groupBy("doc_id", "version").agg(F.collect_set("at").alias("starts"))
    covered = covered.select(F.col("doc_id").alias("id"), "version", "starts")

    text = F.col("row.text").cast("string")
    rows = boxed(docs).withColumns({"id": F.col("row.doc_id").cast("long"), "version": F.xxhash64(text)}).alias("d")
    same = F.col("d.id").eqNullSafe(F.col("c.id")) & (F.col("d.version") == F.col("c.version"))
    rows = rows.join(covered.alias("c"), same, "left").select("row", "starts")
    rows = rows.withColumn("lines", _lines(text)).withColumn("filled", F.when(F.col("starts").isNotNull(), _filled(F.col("lines"))))
    gone = F.flatten(F.transform("starts", lambda s: F.transform(F.sequence(s, s + (size - 1)), lambda k: F.element_at("filled", k + 1))))
    rows = rows.withColumn("stay", F.array_except(F.sequence(F.lit(0), F.size("lines") - 1), gone))
    cut = F.array_join(F.transform("stay", lambda i: F.element_at("lines", i + 1)), "\n")
    rows = rows.withColumn("text", F.when(F.col("starts").isNull(), text).otherwise(cut))
    kept = [c for c in docs.columns if c not in ("n_lines", "n_removed")]
    fresh = {"text": F.col("text"), "n_chars": F.length("text").cast("long").alias("n_chars")}
    return rows.select(
        *[fresh.get(c, column) for c, column in zip(kept, unboxed(kept), strict=True)],
        F.when(text.isNull(), 0).otherwise(F.size("lines")).cast("long").alias("n_lines"),
        F.when(F.col("starts").isNull(), 0).otherwise(F.size("lines") - F.size("stay")).cast("long").alias("n_removed"),
    )


#: Rows of ``dedup_lines`` over ``documents`` for DuckDB.
LINE_DEDUP_SQL = """
WITH cut AS (
  SELECT doc_id, unnest(string_split(text, chr(10))) AS raw, generate_subscripts(string_split(text, chr(10)), 1) AS pos FROM {documents}
), lines AS (
  SELECT doc_id, pos, raw, trim(raw, ' ' || chr(9) || chr(13)) AS line FROM cut
), filled AS (
  SELECT doc_id, pos, line, row_number() OVER (PARTITION BY doc_id ORDER BY pos) AS nr FROM lines WHERE line <> ''
), runs AS (
  SELECT doc_id, nr, pos, lead(pos, 1) OVER w AS pos1, lead(pos, 2) OVER w AS pos2,
         line || chr(10) || lead(line, 1) OVER w || chr(10) || lead(line, 2) OVER w AS run
  FROM filled WINDOW w AS (PARTITION BY doc_id ORDER BY pos)
), later AS (
  SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY md5(run), length(run) ORDER BY doc_id, nr) AS nth FROM runs WHERE run IS NOT NULL) WHERE nth > 1
), covered AS (
  SELECT doc_id, pos FROM later UNION SELECT doc_id, pos1 FROM later UNION SELECT doc_id, pos2 FROM later
), counted AS (
  SELECT l.doc_id, count(*) AS n_lines, count(c.pos) AS n_removed,
         coalesce(string_agg(l.raw, chr(10) ORDER BY l.pos) FILTER (WHERE c.pos IS NULL), '') AS text
  FROM lines l LEFT JOIN covered c ON c.doc_id = l.doc_id AND c.pos = l.pos GROUP BY l.doc_id
)
"""
