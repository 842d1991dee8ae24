"""Writers of reports, word lists, journals and layout XML."""

from __future__ import annotations

import xml.etree.ElementTree as ET
from collections.abc import Iterator
from typing import Any

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from parchmint.sources.lines import PAGE

JOURNAL_SCHEMA = "timestamp string, run_name string, hyperparams map<string,string>, metrics map<string,double>, checkpoint string, notes string"


def write_report(report: DataFrame, path: str) -> None:
    """A report as JSON, one object a row."""
    report.write.mode("overwrite").json(path)


def write_forms(lexicon: DataFrame, path: str) -> None:
    """``form<TAB>freq``, most frequent first."""
    lexicon.orderBy(F.desc("freq"), "first_ordinal").select("form", "freq").write.mode("overwrite").option("sep", "\t").option("quote", "\u0000").csv(path)


def log_run(spark: SparkSession, path: str, run_name: str, hyperparams: dict[str, Any], metrics: dict[str, float], checkpoint: str | None = None, notes: str = "") -> None:
    """Appends one run to a journal of JSON lines, with its time in UTC."""
    row = (run_name, {k: str(v) for k, v in hyperparams.items()}, {k: float(v) for k, v in metrics.items() if v is not None}, checkpoint, notes)
    schema = "run_name string, hyperparams map<string,string>, metrics map<string,double>, checkpoint string, notes string"
    stamp = F.date_format(F.to_utc_timestamp(F.current_timestamp(), F.current_timezone()), "yyyy-MM-dd'T'HH:mm:ss.SSSSSS'+00:00'")
    spark.createDataFrame([row], schema).select(stamp.alias("timestamp"), "*").coalesce(1).write.mode("append").option("ignoreNullFields", False).json(path)


def journal(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.schema(JOURNAL_SCHEMA).json(path)


def points(polygon: Column) -> Column:
    """``x1,y1 x2,y2 ...`` with coordinates cut to whole numbers."""
    return F.array_join(F.transform(polygon, lambda p: F.concat(p["x"].cast("int").cast("string"), F.lit(","), p["y"].cast("int").cast("string"))), " ")


def page_xml(pages: DataFrame) -> DataFrame:
    """(image, xml) of rows (image, width, height, regions, lines).

    ``regions`` has (id, type, points), ``lines`` (id, coords, baseline), points
    as text. Without regions one covers the page; all lines are in the last.
    """
    ET.register_namespace("", PAGE)

    def one(image: str, width: int, height: int, regions, lines) -> str:
        root = ET.Element(f"{{{PAGE}}}PcGts")
        meta = ET.SubElement(root, f"{{{PAGE}}}Metadata")
        ET.SubElement(meta, f"{{{PAGE}}}Creator").text = "parchmint"
        page = ET.SubElement(root, f"{{{PAGE}}}Page", imageFilename=image, imageWidth=str(width), imageHeight=str(height))
        regions = list(regions if regions is not None else []) or [{"id": "region_main", "type": "paragraph", "points": f"0,0 {width},0 {width},{height} 0,{height}"}]
        for r in regions:
            region = ET.SubElement(page, f"{{{PAGE}}}TextRegion", id=r["id"], type=r["type"] or "paragraph")
            ET.SubElement(region, f"{{{PAGE}}}Coords", points=r["points"])
        for x in lines if lines is not None else []:
            line = ET.SubElement(region, f"{{{PAGE}}}TextLine", id=x["id"])
            for tag, key in (("Coords", "coords"), ("Baseline", "baseline")):
                if x[key]:
                    ET.SubElement(line, f"{{{PAGE}}}{tag}", points=x[key])
        ET.indent(root)
        return ET.tostring(root, encoding="unicode", xml_declaration=True)

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            yield pd.DataFrame({"image": pdf.image, "xml": [one(*r) for r in pdf[["image", "width", "height", "regions", "lines"]].itertuples(index=False)]})

    return pages.select("image", "width", "height", "regions", "lines").mapInPandas(run, "image string, xml string")
