"""Transcribed lines from documents, layout XML, JSON and rule tables."""

from __future__ import annotations

import re
import xml.etree.ElementTree as ET
from collections.abc import Iterator
from decimal import Decimal

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from parchmint.functions import text as T

WORDS_PER_LINE = 16
ALTO = "http://www.loc.gov/standards/alto/ns-v4#"
PAGE = "http://schema.primaresearch.org/PAGE/gts/pagecontent/2013-07-15"

LINE_SCHEMA = "image_id string, line_id string, transcription string, confidence double, needs_review boolean, has_abbreviation boolean, polygon array<array<double>>, page_xml_ref string"


def document_lines(docs: DataFrame, words: int = WORDS_PER_LINE) -> DataFrame:
    """(doc_id, line_no, ordinal, manuscript, image_id, line_id, text): whole texts as lines.

    Each text line is cut into runs of ``words`` words, so that no line is too
    long to align. line_no is the text line's number times 2**31, and the run's;
    ordinal, a decimal, is the doc_id times 2**62, and line_no: both are distinct
    for any text and any doc_id, and keep the order of the source.
    """
    cut = docs.select("doc_id", "source", F.posexplode(F.split("text", "\n", -1)).alias("at", "line"))
    cut = cut.withColumn("w", F.filter(F.split("line", " ", -1), lambda w: w != "")).where(F.size("w") > 0)
    runs = F.transform(F.sequence(F.lit(0), F.floor((F.size("w") - 1) / words).cast("int")), lambda k: F.array_join(F.slice("w", k * words + 1, F.lit(words)), " "))
    lines = cut.select("doc_id", "source", "at", F.posexplode(runs).alias("k", "text"))
    number = F.col("at").cast("long") * (1 << 31) + F.col("k")
    ordinal = (F.col("doc_id").cast("decimal(19,0)") * F.lit(Decimal(1 << 62)).cast("decimal(19,0)")).cast("decimal(38,0)") + number
    return lines.select(
        "doc_id", number.alias("line_no"), ordinal.cast("decimal(38,0)").alias("ordinal"), F.col("source").alias("manuscript"),
        F.concat("source", F.lit("_"), "doc_id").alias("image_id"), F.concat(F.lit("d"), "doc_id", F.lit("_l"), number).alias("line_id"), "text",
    )


def json_lines(spark: SparkSession, path: str, schema: str = LINE_SCHEMA) -> DataFrame:
    """A JSON file that is one array of lines, with their ``ordinal`` in it; see ``lines_of_json``."""
    return lines_of_json(spark.read.text(path, wholetext=True), "value", schema)


def lines_of_json(texts: DataFrame, column: str, schema: str = LINE_SCHEMA) -> DataFrame:
    """The lines in texts that are JSON arrays of them: ordinal (the position) and the fields of ``schema``.

    A missing ``line_id`` is ``line_`` and the position. A text that isn't such an
    array has no lines; fields that ``schema`` lacks are ignored. Other columns
    are kept before them.
    """
    others = [c for c in texts.columns if c != column]
    rows = texts.select(*others, F.posexplode(F.from_json(column, f"array<struct<{_as_struct(schema)}>>")).alias("ordinal", "x"))
    out = rows.where("x IS NOT NULL").select(*others, F.col("ordinal").cast("long"), "x.*")
    return out.withColumn("line_id", F.coalesce("line_id", F.format_string("line_%04d", "ordinal"))) if "line_id" in out.columns else out


def _as_struct(schema: str) -> str:
    return ", ".join(f"{f.name}: {f.dataType.simpleString()}" for f in StructType.fromDDL(schema))


def manuscripts(spark: SparkSession, root: str) -> DataFrame:
    """Sorted names of the folders of a corpus that hold XML files."""
    files = spark.read.format("binaryFile").option("pathGlobFilter", "*.xml").option("recursiveFileLookup", True).load(root).select("path")
    return files.select(folder_of(F.col("path")).alias("manuscript")).distinct().orderBy("manuscript")


def folder_of(path: Column) -> Column:
    return F.element_at(F.split(path, "/"), -2)


def stem_of(path: Column) -> Column:
    return F.regexp_replace(F.element_at(F.split(path, "/"), -1), r"\.[^.]*$", "")


def _root(content: bytes) -> ET.Element | None:
    try:
        return ET.fromstring(content)
    except ET.ParseError:
        return None


def page_texts(content: bytes) -> list[str]:
    """Line texts of one ALTO or PAGE file, trimmed, empty ones left out; none of a broken file."""
    root = _root(content)
    if root is None:
        return []
    if "loc.gov/standards/alto" in root.tag:
        found = (s.get("CONTENT", "") for s in root.iterfind(f".//{{{ALTO}}}TextLine/{{{ALTO}}}String"))
    else:
        found = (u.text or "" for u in root.iterfind(f".//{{{PAGE}}}TextLine/{{{PAGE}}}TextEquiv/{{{PAGE}}}Unicode"))
    return [t for t in map(str.strip, found) if t]


def page_boxes(content: bytes) -> list[tuple[str, str, int, int, int, int]]:
    """(id, text, x, y, width, height) of ALTO lines with whole-number boxes; the first String counts."""
    root = _root(content)
    out: list[tuple[str, str, int, int, int, int]] = []
    for line in root.iterfind(f".//{{{ALTO}}}TextLine") if root is not None else ():
        try:
            x, y, w, h = (int(line.get(k, 0)) for k in ("HPOS", "VPOS", "WIDTH", "HEIGHT"))
        except ValueError:
            continue
        first = line.find(f"{{{ALTO}}}String")
        text = first.get("CONTENT", "").strip() if first is not None else ""
        if text and w > 0 and h > 0:
            out.append((line.get("ID", ""), text, x, y, w, h))
    return out


def _files(spark: SparkSession, root: str, glob: str) -> DataFrame:
    files = spark.read.format("binaryFile").option("pathGlobFilter", glob).option("recursiveFileLookup", True).load(root)
    return files.where(~F.col("path").contains(".chocomufin"))


def xml_lines(spark: SparkSession, root: str) -> DataFrame:
    """(manuscript, source_xml, line_no, text) of all layout XML files below ``root``."""
    return lines_of_xml(_files(spark, root, "*.xml"))


def lines_of_xml(files: DataFrame) -> DataFrame:
    """``xml_lines`` of files (path, content)."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            rows = [(p, i, t) for p, c in zip(pdf.path, pdf.content, strict=True) for i, t in enumerate(page_texts(c))]
            yield pd.DataFrame(rows, columns=["path", "line_no", "text"])

    lines = files.select("path", "content").mapInPandas(run, "path string, line_no long, text string")
    return lines.select(folder_of(F.col("path")).alias("manuscript"), F.element_at(F.split("path", "/"), -1).alias("source_xml"), "line_no", "text")


def line_crops(spark: SparkSession, root: str, sizes: DataFrame) -> DataFrame:
    """Crop boxes of ALTO lines, clipped to their image.

    ``sizes`` has (manuscript, stem, width, height) of the images; files without
    an image are left out, as are boxes outside of it.
    """
    return crops_of_xml(_files(spark, root, "*.xml"), sizes)


def crops_of_xml(files: DataFrame, sizes: DataFrame) -> DataFrame:
    """``line_crops`` of files (path, content)."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            rows = [(p, i, *b) for p, c in zip(pdf.path, pdf.content, strict=True) for i, b in enumerate(page_boxes(c))]
            yield pd.DataFrame(rows, columns=["path", "line_no", "line_id", "text", "x", "y", "w", "h"])

    boxes = files.select("path", "content").mapInPandas(run, "path string, line_no long, line_id string, text string, x long, y long, w long, h long")
    boxes = boxes.withColumns({"manuscript": folder_of(F.col("path")), "stem": stem_of(F.col("path")), "source_xml": F.element_at(F.split("path", "/"), -1)})
    x1, y1 = F.greatest(F.lit(0), "x"), F.greatest(F.lit(0), "y")
    x2, y2 = F.least(F.col("width"), F.col("x") + F.col("w")), F.least(F.col("height"), F.col("y") + F.col("h"))
    out = boxes.join(sizes, ["manuscript", "stem"]).withColumns({"x1": x1, "y1": y1, "x2": x2, "y2": y2}).where("x2 > x1 AND y2 > y1")
    return out.select(
        "manuscript", "source_xml", "line_no", "line_id", "text", "x1", "y1", "x2", "y2",
        T.has_abbreviation(F.col("text")).alias("has_abbreviation"), T.abbreviations(F.col("text")).alias("abbreviations"),
    )


def rule_table(spark: SparkSession, path: str) -> DataFrame:
    """(ordinal, pattern, replacement, mode) of a CSV rule table; regex, empty and identity rows are skipped.

    A rule is diplomatic if its pattern holds an abbreviation mark.
    """
    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        import csv
        import io

        for pdf in batches:
            for content in pdf.content:
                rows = [((r.get("char") or "").strip(), (r.get("ontographe") or "").strip()) for r in csv.DictReader(io.StringIO(bytes(content).decode("utf-8"), newline=""))]
                yield pd.DataFrame([(i, a, b) for i, (a, b) in enumerate(rows)], columns=["ordinal", "pattern", "replacement"])

    rows = spark.read.format("binaryFile").load(path).select("content").mapInPandas(run, "ordinal long, pattern string, replacement string")
    rows = rows.where("pattern <> '' AND replacement <> '' AND pattern <> replacement AND NOT startswith(pattern, '#r#')")
    return rows.withColumn("mode", F.when(T.has_abbreviation(F.col("pattern")), "diplomatic").otherwise("normalized"))


def dictionary(spark: SparkSession, path: str) -> DataFrame:
    """Distinct lower-case forms: ``forms`` of a JSON object, or the first word of each text line."""
    if re.search(r"\.json$", path):
        forms = spark.read.schema("source string, formes array<string>, forms array<string>").option("multiLine", True).json(path)
        forms = forms.select(F.explode(F.coalesce("forms", "formes")).alias("form"))
    else:
        forms = spark.read.text(path).where("trim(value) <> '' AND NOT startswith(ltrim(value), '#')").select(F.element_at(T.words(F.col("value")), 1).alias("form"))
    return forms.select(F.lower("form").alias("form")).where("form <> ''").distinct()
