import hashlib
import random

import pytest
from pyspark.sql import functions as F

from parchmint.functions import normalize as N
from parchmint.operators import align, contract, layout, lexicon, metrics, models, ner, profile, report, split

LINE = "ordinal long, manuscript string, image_id string, text string, has_abbreviation boolean"


@pytest.fixture
def lines(spark):
    rows = [(0, "bnf_1", "bnf_1_a", "Ci ꝯmence le liure", True), (1, "bnf_1", "bnf_1_a", "le roi de france . le", False), (2, "bod_2", "bod_2_b", "roi Ꝑ le ꝯ", True)]
    return spark.createDataFrame(rows, LINE)


def test_profile(lines, spark):
    got = {r.manuscript: r for r in profile.manuscript_profile(lines).collect()}
    assert (got["bnf_1"].pages, got["bnf_1"].lines, got["bnf_1"].min_length) == (1, 2, 18)
    assert profile.corpus_totals(lines).first().asDict() == {"manuscripts": 2, "pages": 2, "lines": 3}
    assert profile.corpus_totals(lines.limit(0)).first().lines == 0
    top = {(r.manuscript, r["mark"]): (r.n, r["rank"]) for r in profile.top_abbreviations(lines, 1).collect()}
    assert top == {(None, "ꝯ"): (2, 1), ("bnf_1", "ꝯ"): (1, 1), ("bod_2", "Ꝑ"): (1, 1)}
    rates = {r.manuscript: r.rate for r in profile.abbreviation_rates(lines).collect()}
    assert rates == {"bnf_1": 0.5, "bod_2": 1.0}


def test_alphabet(spark):
    frame = lambda t: spark.createDataFrame([(t,)], "text string")
    charset = spark.createDataFrame([("b",)], "char string")
    rows = profile.alphabet_order(profile.alphabet(frame("aab"), frame("abꝯꝯ"), charset)).collect()
    assert [(r["char"], r.freq_predictions, r.freq_references, r.missing, r.in_charset) for r in rows] == [("ꝯ", 0, 2, True, False), ("a", 2, 1, False, False), ("b", 1, 1, False, True)]
    assert profile.alphabet_summary(profile.alphabet(frame("aab"), frame("abꝯꝯ"))).first().asDict() == {"in_predictions": 2, "in_references": 3, "total": 3, "missing": 1}
    assert [r["char"] for r in profile.missing_characters(frame("aab"), frame("abꝯꝯ")).collect()] == ["ꝯ"]


def test_lexicon(lines):
    clean = lines.withColumn("clean", N.normalize_text(F.col("text")))
    got = {r.form: r for r in lexicon.lexicon(clean, clean.where("ordinal = 2")).collect()}
    assert (got["le"].freq, got["le"].manuscripts, got["le"].has_abbreviation, got["le"].hapax) == (5, ["bnf", "bod"], True, False)
    assert got["roi"].has_abbreviation is False and got["france"].hapax
    assert lexicon.hapax_rate(lexicon.lexicon(clean)).first().forms == 9


def test_coverage(spark):
    forms = [("roi", 5, False), ("ꝯte", 3, True), ("de", 2, False), ("rare", 3, False), ("often", 9, False), ("été", 2, True), ("one", 1, False)]
    lex = spark.createDataFrame([(f, n, h, i, ["m"]) for i, (f, n, h) in enumerate(forms)], "form string, freq long, has_abbreviation boolean, first_ordinal long, manuscripts array<string>")
    looked = lexicon.dictionary_lookup(lex, spark.createDataFrame([("roi",), ("ete",), ("roi",)], "form string"))
    assert {r.form: r.known for r in looked.collect()} == {"roi": True, "ꝯte": False, "de": False, "rare": False, "often": False, "été": True}
    c = lexicon.coverage(looked).first()
    assert (c.forms, c.known, c.rate, c.rate_plain, c.rate_plain_exact, c.rate_abbr) == (6, 2, 2 / 6, 1 / 5, 1 / 4, 1 / 2)
    unknown = lexicon.unknown_forms(looked)
    assert {r.form: r.reason for r in unknown.collect()} == {"ꝯte": "unexpanded_abbreviation", "de": "fragment", "rare": "probable_error", "often": "rare_or_dialectal"}
    assert [r.form for r in lexicon.top_unknown(unknown, 3).collect()] == ["often", "ꝯte", "rare"]
    assert lexicon.coverage(looked.limit(0)).first().rate == 0.0


def pairs(spark, rows):
    return spark.createDataFrame([(i, i, *r) for i, r in enumerate(rows)], "ordinal long, position long, prediction string, reference string, has_abbreviation boolean")


def test_stratified(spark):
    rates = metrics.line_rates(pairs(spark, [("ab", "ab", True), ("ax", "ab", True), ("", "abcd", False)]))
    s = metrics.stratified(rates).first()
    assert (s.overall, s.abbreviated, s.plain, s.delta, s.n_abbreviated, s.n_plain) == (0.5, 0.25, 1.0, -0.75, 2, 1)
    assert metrics.stratified(rates.where("not has_abbreviation")).first().abbreviated is None
    assert metrics.stratified(rates.limit(0)).first().overall == 0.0
    r = metrics.line_rates(pairs(spark, [("ꝯꝯx", "ꝯꝯy", True), ("ꝑ", "ꝑ", True)]))
    assert {x["mark"]: (x.mean_cer, x.n) for x in metrics.errors_by_character(r).collect()} == {"ꝯ": (1 / 3, 2), "ꝑ": (0.0, 1)}


def test_mcnemar(spark):
    frame = lambda rows: spark.createDataFrame(rows, "e1 boolean, e2 boolean")
    assert metrics.mcnemar(frame([(True, True)] * 5)) == {"b": 0, "c": 0, "chi2": 0.0, "p_value": 1.0, "significant": False}
    m = metrics.mcnemar(frame([(False, True)] * 20))
    assert m == {"b": 0, "c": 20, "chi2": 18.05, "p_value": 0.0, "significant": True}


def test_token_scores(spark):
    rows = [("le roi", "le roi", True), ("a", "b", False), (" . ", "-", False), ("", "x", False), ("a a b", "a b b c", True)]
    got = {r.ordinal: (r.precision, r.recall, r.f1) for r in metrics.token_scores(pairs(spark, rows)).collect()}
    assert got == {0: (1, 1, 1), 1: (0, 0, 0), 3: (0, 0, 0), 4: (2 / 3, 0.5, pytest.approx(4 / 7))}
    summary = {r.stratum: r.lines for r in metrics.token_summary(metrics.token_scores(pairs(spark, rows))).collect()}
    assert summary == {"all": 4, "abbreviated": 2, "plain": 2}
    assert [r.ordinal for r in metrics.worst_lines(metrics.token_scores(pairs(spark, rows))).collect()] == [1, 3]


def test_pair_lines(spark):
    schema = "position long, line_id string, text string"
    p = spark.createDataFrame([(0, "a", "p0"), (1, None, "p1"), (2, "zz", "p2"), (9, "yy", "p9")], schema)
    r = spark.createDataFrame([(0, "a", "r0"), (1, None, "r1"), (2, "a", "r2")], schema)
    assert {x.text: x.reference for x in metrics.pair_lines(p, r).collect()} == {"p0": "r2", "p1": "r1", "p2": "r2"}


def test_bootstrap(spark):
    rng = random.Random(1)
    rows = [("x" * rng.randrange(1, 5), "xx", rng.random() < 0.3) for _ in range(200)]
    rates = metrics.line_rates(pairs(spark, rows))
    mean = metrics.stratified(rates).first()
    for got in (metrics.bootstrap(rates, 400), metrics.bootstrap_exact(rates, 400)):
        by = {r.measure: r for r in got.collect()}
        for m in ("overall", "abbreviated", "plain", "delta"):
            assert by[m].lower < by[m].mean < by[m].upper
            assert by[m].mean == pytest.approx(mean[m], abs=0.03)
    spread = [(r.upper - r.lower) for got in (metrics.bootstrap(rates, 400), metrics.bootstrap_exact(rates, 400)) for r in got.where("measure = 'overall'").collect()]
    assert spread[0] == pytest.approx(spread[1], rel=0.25)
    perfect = metrics.line_rates(pairs(spark, [("a", "a", False)] * 5))
    by = {r.measure: r for r in metrics.bootstrap(perfect, 50).collect()}
    assert by["overall"].mean == 0 and by["abbreviated"].mean is None and by["delta"].lower is None


def test_report(spark):
    rates = metrics.line_rates(pairs(spark, [("aꝯ", "bꝯ", True), ("a", "a", False), ("ab", "ab", False)]))
    r = report.evaluation(rates, 50).first()
    assert r.cer.abbreviated == 0.5 and r.share == pytest.approx(1 / 3) and r.characters[0]["mark"] == "ꝯ"
    assert "higher (0.500) than on others (0.000)" in r.conclusion and "clearly degrade" in r.conclusion
    assert report.evaluation(rates.where("not has_abbreviation"), 20).first().conclusion == "No abbreviated lines: nothing to conclude."


def brute_align(a, b):
    n, m = len(a), len(b)
    s = [[-2 * (i + j) if not i or not j else 0 for j in range(m + 1)] for i in range(n + 1)]
    for i in range(1, n + 1):
        for j in range(1, m + 1):
            s[i][j] = max(s[i - 1][j - 1] + (2 if a[i - 1] == b[j - 1] else -1), s[i - 1][j] - 2, s[i][j - 1] - 2)
    return s[n][m]


def test_align():
    assert align.align("ATCG", "ACG") == ("ATCG", "A-CG")
    rng = random.Random(1)
    for _ in range(200):
        a, b = ("".join(rng.choices("abé", k=rng.randrange(9))) for _ in (0, 1))
        x, y = align.align(a, b)
        assert len(x) == len(y) and x.replace("-", "") == a and y.replace("-", "") == b
        assert sum(2 if p == q else -2 if "-" in (p, q) else -1 for p, q in zip(x, y, strict=True)) == brute_align(a, b)


def test_align_many_at_once(monkeypatch):
    rng = random.Random(2)
    many = [tuple("".join(rng.choices("abé😀", k=rng.randrange(14))) for _ in (0, 1)) for _ in range(120)]
    one_by_one = [align.align(a, b) for a, b in many]
    assert align.align_all(many) == one_by_one
    monkeypatch.setattr(align, "CELLS", 500)
    assert align.align_all(many) == one_by_one and align.align_all([]) == []


def test_fuse(spark):
    assert align.fuse("bonjour", 0.9, "bonjur", 0.7) == ("bonjour", 0.8)
    assert align.fuse("", 0.1, "x", 0.9) == ("x", 0.9) and align.fuse("x", 0.1, "", 0.9) == ("x", 0.1)
    assert align.fuse("abc", 0.4, "ab", 0.9)[0] == "ab" and align.fuse("axc", 0.6, "ayc", 0.6)[0] == "axc"
    got = spark.createDataFrame([("bonjour", 0.9, "bonjur", 0.8), (None, 0.1, "a", 0.5)], "a string, x double, b string, y double").select(align.fused(F.col("a"), F.col("x"), F.col("b"), F.col("y")).alias("f")).select("f.*")
    assert [tuple(r) for r in got.collect()] == [("bonjour", 0.85), ("a", 0.5)]


def test_review(spark):
    rows = [("ab", 0.9, False, None, True), ("long enough", 0.3, False, None, True), ("long enough", 0.65, True, None, True), ("long enough", 0.65, False, None, False), ("long enough", 0.85, True, None, False), ("long enough", 0.9, False, "another thing", True)]
    got = spark.createDataFrame(rows, "t string, c double, a boolean, s string, want boolean").withColumn("got", contract.needs_review(F.col("t"), F.col("c"), F.col("a"), F.col("s")))
    assert all(r.got == r.want for r in got.collect())


GOOD = {"image_id": "i", "line_id": "l", "transcription": "t", "confidence": 0.5, "needs_review": False, "has_abbreviation": None, "polygon": [[0.0, 1.0]] * 3, "page_xml_ref": "p"}


@pytest.mark.parametrize(
    ("change", "error"),
    [({}, None), ({"image_id": None}, "image_id is missing"), ({"line_id": ""}, "line_id is empty"), ({"confidence": 1.01}, "confidence is outside [0, 1]"), ({"confidence": -0.1}, "confidence is outside [0, 1]"),
     ({"polygon": [[0.0, 1.0]] * 2}, "polygon has fewer than 3 points"), ({"polygon": [[0.0, 1.0], [1.0], [2.0, 2.0]]}, "polygon point is not a pair of numbers"), ({"needs_review": None}, "needs_review is missing"), ({"transcription": None}, "transcription is missing"), ({"page_xml_ref": ""}, "page_xml_ref is empty")],
)
def test_contract(spark, change, error):
    from parchmint.sources.lines import LINE_SCHEMA

    checked = contract.with_errors(spark.createDataFrame([GOOD | change], LINE_SCHEMA))
    assert checked.first().errors == ([error] if error else [])
    ok, bad = contract.split_valid(checked)
    assert (ok.count(), bad.count()) == ((0, 1) if error else (1, 0))
    assert contract.error_summary(checked).first().error == (error or "valid")


def test_contract_json(spark):
    import json

    raw = spark.createDataFrame([(json.dumps(GOOD | {"more": 1}),), (json.dumps(GOOD | {"confidence": "high"}),), ("{",)], "value string")
    got = [r.errors for r in contract.parse(raw).collect()]
    assert got[0] == [] and got[1][0] == "not_json" and got[2][0] == "not_json"


def test_deliverables(spark):
    lines = spark.createDataFrame([(0, 0, "ms", "p1", "", "ꝯmence bien"), (1, 1, "ms", "p1", "x", "autre ligne")], "ordinal long, line_no long, manuscript string, source string, line_id string, text string")
    rows = {r.ordinal: r for r in contract.deliverables(lines).collect()}
    assert (rows[0].image_id, rows[0].line_id, rows[0].confidence, rows[0].needs_review, rows[0].page_xml_ref, len(rows[0].polygon)) == ("ms_p1", "line_0000", 1.0, False, "segmentations/p1.xml", 4)
    preds = spark.createDataFrame([(1, "autre lgne", 0.59999, None, None)], "ordinal long, text string, confidence double, polygon array<array<double>>, second string")
    r = {r.ordinal: r for r in contract.deliverables(lines, preds).collect()}[1]
    assert (r.transcription, r.confidence, r.needs_review, r.line_id) == ("autre lgne", 0.6, True, "x")
    assert contract.leaks(lines, lines.where("ordinal = 0"), "source").count() == 1


def test_ner(spark):
    lines = spark.createDataFrame([(0, "bnf_ms", "Arthur vint a Paris"), (1, "bod_ms", "arthur et sire"), (2, None, ""), (3, "bnf_ms", "boom")], "ordinal long, manuscript string, text string")

    def annotator():
        kinds = {"arthur": "B-PER", "paris": "loc", "sire": "PER", "et": "PER", "vint": "XXX"}

        def find(text):
            if text == "boom":
                raise RuntimeError(text)
            return [{"entity_group": kinds[w.lower()], "word": f" {w}", "score": 0.812345 if w != "vint" else 0.9, "start": 0, "end": 1} for w in text.split() if w.lower() in kinds]

        return find

    rows = ner.entity_rows(ner.annotate(lines, annotator))
    assert sorted((r.ordinal, r.manuscript, r.word, r.type) for r in rows.collect()) == [(0, "bnf", "Arthur", "PER"), (0, "bnf", "Paris", "LOC"), (1, "bod", "arthur", "PER")]
    assert {r.type: (r.total, r.distinct_forms) for r in ner.entities_by_type(rows).collect()} == {"PER": (2, 1), "LOC": (1, 1), "ORG": (0, 0), "MISC": (0, 0)}
    assert {r.manuscript: (r.PER, r.LOC, r.ORG) for r in ner.entities_by_manuscript(rows).collect()} == {"bnf": (1, 1, 0), "bod": (1, 0, 0)}
    assert [(r.form, r.n) for r in ner.top_entities(rows).where("type = 'PER'").collect()] == [("arthur", 2)]
    listed = ner.annotate_by_gazetteer(lines, spark.createDataFrame([("paris", "LOC"), ("paris", "LOC"), ("et", "PER")], "form string, type string"))
    assert [(r.ordinal, r.word, r.type) for r in listed.collect()] == [(0, "Paris", "LOC")]


def square(x, y, n):
    return [[float(x), float(y)], [float(x + n), float(y)], [float(x + n), float(y + n)], [float(x), float(y + n)]]


def test_iou(spark):
    assert layout.iou(square(0, 0, 100), square(0, 0, 100)) == 1 and layout.iou(square(0, 0, 10), square(500, 500, 10)) == 0
    assert layout.iou([], square(0, 0, 5)) == 0 and layout.iou(square(2000, 0, 5), square(2000, 0, 5)) == 0
    rng = random.Random(1)
    rows = []
    for _ in range(30):
        x, y, n, dx, dy = (rng.randrange(1, 60) for _ in range(5))
        rows.append((square(x, y, n), square(x + dx, y + dy, n), x, y, n, dx, dy))
    c = F.col
    a, b = [c("x"), c("y"), c("x") + c("n"), c("y") + c("n")], [c("x") + c("dx"), c("y") + c("dy"), c("x") + c("dx") + c("n"), c("y") + c("dy") + c("n")]
    got = spark.createDataFrame(rows, "p array<array<double>>, q array<array<double>>, x int, y int, n int, dx int, dy int").select(layout.polygon_iou(c("p"), c("q"), 200, 200).alias("pixels"), layout.rectangle_iou(a, b).alias("iou"))
    assert all(r.pixels == pytest.approx(r.iou) for r in got.collect())
    assert layout.iou_summary(got).first().pairs == 30 and layout.iou_summary(got.limit(0)).first().mean_iou is None
    triangle = layout.raster([[0, 0], [40, 0], [0, 40]], 50, 50)
    assert triangle[0, :41].all() and triangle.sum() == 41 * 42 // 2


def test_split(spark):
    names = [f"m{i}" for i in range(14)]
    parts = split.split_manuscripts(names)
    assert sorted(sum(parts.values(), [])) == sorted(names) and (len(parts["val"]), len(parts["test"])) == (2, 2)
    assert split.split_manuscripts(names) == parts
    rows = spark.createDataFrame([(n,) for n in (f"k{i}" for i in range(2000))], "k string").withColumn("s", split.split_of(F.col("k")))
    n = {r.s: r["count"] for r in rows.groupBy("s").count().collect()}
    assert abs(n["test"] / 2000 - 0.15) < 0.03 and abs(n["val"] / 2000 - 0.15) < 0.03


def test_folder_hash(spark):
    files = [("/a/m1/x.xml", b"one"), ("/a/m1/b.xml", b"two"), ("/a/m1/y.chocomufin.xml", b"no"), ("/a/m2/z.xml", b"")]
    rows = spark.createDataFrame(files, "path string, content binary").withColumn("m", F.element_at(F.split("path", "/"), 3))
    got = {r.m: (r.sha256, r.files) for r in split.folder_hash(split.with_file_hash(rows), "m").collect()}
    want = hashlib.sha256()
    for name, content in (("b.xml", b"two"), ("x.xml", b"one")):
        want.update(name.encode() + hashlib.sha256(content).hexdigest().encode())
    assert got["m1"] == (want.hexdigest(), 2)


@pytest.mark.parametrize(("values", "best", "stopped"), [((3, 2, 1), 1, 3), ((1, 1, 1, 1, 0), 1, 4), ((5, 4, 6, 6, 3, 7, 7, 7, 1), 3, 8), ((2,), 2, 1)])
def test_early_stop(spark, values, best, stopped):
    log = spark.createDataFrame([("r", i + 1, float(x)) for i, x in enumerate(values)], "run string, epoch int, metric double")
    assert tuple(split.early_stop(log).first())[1:] == (best, stopped)


def test_models(spark):
    lines = spark.createDataFrame([(i, bytearray(t.encode()), t, False) for i, t in enumerate(["ab", "cd", "ef"])], "ordinal long, image binary, text string, has_abbreviation boolean")
    model = lambda: lambda images: [b.decode().replace("d", "x") for b in images]
    assert models.baseline(lines, model).first().overall == pytest.approx(0.5 / 3)
    assert models.baseline(lines, model, limit=1).first().overall == 0
