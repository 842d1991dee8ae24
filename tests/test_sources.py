import json

import numpy as np
import pytest
from pyspark.sql import functions as F

from parchmint.operators import image
from parchmint.sources import lines as S
from parchmint.sources import sinks
from parchmint.streaming import review

ALTO = """<alto xmlns="http://www.loc.gov/standards/alto/ns-v4#"><Layout><Page><PrintSpace><TextBlock>
<TextLine ID="l1" HPOS="10" VPOS="20" WIDTH="200" HEIGHT="30"><String CONTENT=" Ci ꝯmence "/><String CONTENT="suite"/></TextLine>
<TextLine ID="l2" HPOS="x" VPOS="0" WIDTH="9" HEIGHT="9"><String CONTENT="bad box"/></TextLine>
<TextLine ID="l3" HPOS="290" VPOS="-5" WIDTH="100" HEIGHT="30"><String CONTENT="edge"/></TextLine>
<TextLine ID="l4" HPOS="400" VPOS="0" WIDTH="10" HEIGHT="10"><String CONTENT="outside"/></TextLine>
<TextLine ID="l5" HPOS="1" VPOS="1" WIDTH="0" HEIGHT="9"><String CONTENT="flat"/></TextLine>
<TextLine ID="l6" HPOS="1" VPOS="1" WIDTH="5" HEIGHT="9"><String CONTENT="  "/></TextLine>
</TextBlock></PrintSpace></Page></Layout></alto>"""
PAGE = f"""<PcGts xmlns="{S.PAGE}"><Page><TextRegion><TextLine><TextEquiv><Unicode> un </Unicode></TextEquiv></TextLine>
<TextLine><TextEquiv><Unicode></Unicode></TextEquiv></TextLine><TextLine><TextEquiv><Unicode>deux</Unicode></TextEquiv></TextLine></TextRegion></Page></PcGts>"""


@pytest.fixture
def corpus(tmp_path):
    for name, content in {"m1/a.xml": ALTO, "m1/c.chocomufin.xml": ALTO, "m2/b.xml": PAGE, "m2/broken.xml": "<alto><a>"}.items():
        (tmp_path / name).parent.mkdir(exist_ok=True)
        (tmp_path / name).write_text(content, encoding="utf-8")
    return str(tmp_path)


def test_xml_lines(spark, corpus):
    got = sorted((r.manuscript, r.source_xml, r.line_no, r.text) for r in S.xml_lines(spark, corpus).collect())
    assert got == [("m1", "a.xml", k, t) for k, t in enumerate(["Ci ꝯmence", "suite", "bad box", "edge", "outside", "flat"])] + [("m2", "b.xml", 0, "un"), ("m2", "b.xml", 1, "deux")]
    assert [r.manuscript for r in S.manuscripts(spark, corpus).collect()] == ["m1", "m2"]


def test_line_crops(spark, corpus):
    sizes = spark.createDataFrame([("m1", "a", 300, 100)], "manuscript string, stem string, width long, height long")
    got = sorted((r.line_id, r.text, r.x1, r.y1, r.x2, r.y2, r.has_abbreviation, r.abbreviations) for r in S.line_crops(spark, corpus, sizes).collect())
    assert got == [("l1", "Ci ꝯmence", 10, 20, 210, 50, True, ["ꝯ"]), ("l3", "edge", 290, 0, 300, 25, False, [])]
    assert S.line_crops(spark, corpus, sizes.limit(0)).count() == 0


def test_document_lines(spark):
    docs = spark.createDataFrame([(3, " ".join(f"w{i}" for i in range(40)) + "\n\n  x  y ", "s"), (4, None, "s"), (5, "", "s")], "doc_id long, text string, source string")
    rows = S.document_lines(docs).orderBy("ordinal").collect()
    assert [(r.line_no, len(r.text.split())) for r in rows] == [(0, 16), (1, 16), (2, 8), (2 << 31, 2)]
    assert rows[-1].text == "x y" and rows[-1].line_id == "d3_l4294967296" and rows[0].image_id == "s_3"


def test_tables(spark, tmp_path):
    (tmp_path / "rules.csv").write_text('char,ontographe\nꝯ,con\n#r#x,y\nv,u\na,a\n,b\n"ꝑ ",per\n', encoding="utf-8")
    got = [(r.pattern, r.replacement, r.mode) for r in S.rule_table(spark, f"{tmp_path}/rules.csv").orderBy("ordinal").collect()]
    assert got == [("ꝯ", "con", "diplomatic"), ("v", "u", "normalized"), ("ꝑ", "per", "diplomatic")]
    (tmp_path / "d.txt").write_text("# note\nRoi 12\nle\n\nle\n")
    assert {r.form for r in S.dictionary(spark, f"{tmp_path}/d.txt").collect()} == {"roi", "le"}
    (tmp_path / "d.json").write_text(json.dumps({"source": "x", "formes": ["Roi", "le"]}))
    assert {r.form for r in S.dictionary(spark, f"{tmp_path}/d.json").collect()} == {"roi", "le"}
    (tmp_path / "lines.json").write_text(json.dumps([{"line_id": "a", "transcription": "t", "confidence": 0.5, "polygon": [[0, 1]]}, {"line_id": "b"}, {"transcription": "no id"}]))
    assert [(r.ordinal, r.line_id) for r in S.json_lines(spark, f"{tmp_path}/lines.json").collect()] == [(0, "a"), (1, "b"), (2, "line_0002")]
    far = spark.createDataFrame([(9_000_000_000_000_000_000, "a\n" * 100_002, "s"), (8_999_999_999_999_999_999, "b", "s"), (-5, "c", "s")], "doc_id long, text string, source string")
    rows = S.document_lines(far)
    assert rows.count() == rows.select("ordinal").distinct().count() == 100_004
    assert [r.text for r in rows.orderBy("ordinal").limit(3).collect()] == ["c", "b", "a"]


def test_journal(spark, tmp_path):
    path = f"{tmp_path}/journal"
    sinks.log_run(spark, path, "one", {"lr": 5e-5}, {"cer": 0.5, "wer": None}, notes="é")
    sinks.log_run(spark, path, "two", {}, {"cer": 0.4}, checkpoint="c")
    got = {r.run_name: r for r in sinks.journal(spark, path).collect()}
    assert got["one"].metrics == {"cer": 0.5} and got["one"].hyperparams == {"lr": "5e-05"} and got["one"].checkpoint is None and got["two"].checkpoint == "c"
    assert got["one"].timestamp.endswith("+00:00")


def test_forms_and_report(spark, tmp_path):
    lexicon = spark.createDataFrame([("le", 3, 0), ("roi", 5, 1)], "form string, freq long, first_ordinal long")
    sinks.write_forms(lexicon, f"{tmp_path}/forms")
    assert [r.value for r in spark.read.text(f"{tmp_path}/forms").collect()] == ["roi\t5", "le\t3"]
    sinks.write_report(lexicon.select(F.struct("form", "freq").alias("x")), f"{tmp_path}/report")
    assert spark.read.json(f"{tmp_path}/report").count() == 2


def test_page_xml_round_trip(spark):
    import xml.etree.ElementTree as ET

    schema = "image string, width int, height int, regions array<struct<id:string,type:string,points:string>>, lines array<struct<id:string,coords:string,baseline:string>>"
    rows = [("p.jpg", 100, 50, None, [("l1", "1,2 3,4", "1,4 3,4"), ("l2", None, "0,0 1,1")]), ("q.jpg", 10, 10, [("r1", None, "0,0 1,0 1,1"), ("r2", "heading", "5,5 6,5 6,6")], [("l<3>", "1,1 2,2", None)])]
    got = {r.image: ET.fromstring(r.xml.encode()) for r in sinks.page_xml(spark.createDataFrame(rows, schema)).collect()}
    ns = f"{{{S.PAGE}}}"
    page = got["p.jpg"].find(f"{ns}Page")
    assert page.get("imageWidth") == "100" and page.find(f"{ns}TextRegion").get("id") == "region_main"
    assert [len(x) for x in page.iter(f"{ns}TextLine")] == [2, 1]
    regions = got["q.jpg"].findall(f".//{ns}TextRegion")
    assert [(r.get("id"), r.get("type"), len(r.findall(f"{ns}TextLine"))) for r in regions] == [("r1", "paragraph", 0), ("r2", "heading", 1)]
    pts = spark.createDataFrame([([(1.9, -2.5), (3.0, 4.0)],)], "p array<struct<x:double,y:double>>").select(sinks.points(F.col("p")))
    assert pts.first()[0] == "1,-2 3,4"


def stripes(angle=0.0):
    img = np.full((300, 600), 255, np.uint8)
    for k in range(15):
        img[k * 20 + 5 : k * 20 + 11, 20:580] = 0
    return image.rotate(img, angle, 255) if angle else img


def test_deskew():
    tilted = stripes(5)
    assert abs(image.skew_angle(tilted, step=1.0) + 5) <= 1
    assert abs(image.skew_angle(image.deskew(tilted), step=0.5)) < 1.5
    assert image.skew_angle(stripes(), reach=3) == 0


def test_binarise_and_mask():
    out = image.sauvola(stripes())
    assert set(np.unique(out)) <= {0, 255} and out[8, 300] == 255 and out[1, 300] == 0
    color = np.full((80, 80, 3), 200, np.uint8)
    color[30:40, 30:40] = (0, 0, 255)
    masked = image.mask_color(color, np.zeros((80, 80), np.uint8), radius=5)
    assert masked[35, 35] == 255 and masked[35, 26] == 255 and masked[35, 20] == 0 and masked[26, 26] == 0
    assert (image.mask_color(color, np.zeros((80, 80), np.uint8), radius=0) == 255).sum() == 100


def test_enhance():
    rng = np.random.default_rng(1)
    low = (rng.integers(110, 130, (64, 64, 1)) + np.array([0, 5, 10])).astype(np.uint8)
    out = image.enhance(low)
    assert out.shape == low.shape and image.grey(out).std() > image.grey(low).std()
    back = image._from_lab(image._to_lab(low))
    assert np.abs(back.astype(int) - low).max() <= 1


def test_prepare_files(spark, tmp_path):
    img = stripes()[:60, :80]
    (tmp_path / "a.pgm").write_bytes(b"P5 80 60 255\n" + img.tobytes())
    files = spark.read.format("binaryFile").load(f"{tmp_path}/*.pgm")
    r = image.prepare_files(files, image.decode_pgm, straighten=False, contrast=False, mask=False).first()
    assert (r.height, r.width) == (60, 80) and bytes(r.pixels) == image.sauvola(img).tobytes()
    assert image.prepare_files(files, image.decode_pgm).first().height == 60
    (tmp_path / "b.pgm").write_bytes(b"nothing")
    with pytest.raises(Exception, match="can't decode"):
        image.prepare_files(spark.read.format("binaryFile").load(f"{tmp_path}/*.pgm"), image.decode_pgm).count()


def test_streams(spark, tmp_path):
    rows = [("i", f"l{k}", "long enough" if k % 2 else "x", 0.9, None, None, [[0.0, 0.0]] * 3, "p", f"2024-01-01T0{k}:30:00") for k in range(4)]
    schema = f"{S.LINE_SCHEMA}, ts string"
    spark.createDataFrame(rows, schema).coalesce(1).write.json(f"{tmp_path}/in")
    stream = review.line_stream(spark, f"{tmp_path}/in")
    query = review.flagged(stream).writeStream.format("memory").queryName("flags").outputMode("append").start()
    query.processAllAvailable()
    query.stop()
    assert {r.line_id: r.needs_review for r in spark.table("flags").collect()} == {"l0": True, "l1": False, "l2": True, "l3": False}
    query = review.review_rate(stream).writeStream.format("memory").queryName("rates").outputMode("complete").start()
    query.processAllAvailable()
    query.stop()
    assert sorted(r.review_rate for r in spark.table("rates").collect()) == [0.0, 0.0, 1.0, 1.0]
