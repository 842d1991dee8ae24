import random
import unicodedata

import pytest
from pyspark.sql import functions as F

from parchmint.functions import normalize as N
from parchmint.functions import text as T


def column(spark, rows, schema, *columns):
    return [tuple(r) for r in spark.createDataFrame(rows, schema).select(*columns).collect()]


def test_abbreviations(spark):
    rows = [("Ci ꝯm̃ce le liure",), ("",), (None,), ("ꝑꝑ⁊",)]
    assert column(spark, rows, "t string", T.has_abbreviation(F.col("t")), T.abbreviations(F.col("t"))) == [(True, ["ꝯ", "̃"]), (False, []), (False, None), (True, ["ꝑ", "ꝑ"])]


def test_char_class(spark):
    want = {
        "latin": "aZéß", "abbreviation": "ꝯꝑꝰ", "combining_mark": "̃̅ͣͤ́", "special_punctuation": "⁊¶÷.-+", "other": "0 \n",
    }
    rows = [(c, k) for k, cs in want.items() for c in cs]
    assert all(a == b for a, b in column(spark, rows, "c string, k string", T.char_class(F.col("c")), "k"))


def test_codepoint(spark):
    assert [r[0] for r in column(spark, [("a",), ("ꝯ",), ("😀",)], "c string", T.codepoint(F.col("c")))] == ["U+0061", "U+A76F", "U+1F600"]


@pytest.mark.parametrize(("text", "want"), [("  ", []), ("bone . est", ["bone", "est"]), ("a\x1cb c\xa0_ --", ["a", "b", "c", "_"]), ("", [])])
def test_tokens(spark, text, want):
    assert column(spark, [(text,)], "t string", T.tokens(F.col("t"))) == [(want,)]


def levenshtein(a, b):
    row = list(range(len(b) + 1))
    for i, x in enumerate(a, 1):
        last, row[0] = row[0], i
        for j, y in enumerate(b, 1):
            last, row[j] = row[j], min(row[j] + 1, row[j - 1] + 1, last + (x != y))
    return row[-1]


def test_error_rates(spark):
    known = [("a", "a", 0, 0), ("bbbb", "aaaa", 1, 1), ("", "", 0, 0), ("texte", "", 1, 1), ("bnjour", "bonjour", 1 / 7, 1), ("le roi France", "le roi de France", 3 / 16, 0.25), ("", "mot", 1, 1)]
    rng = random.Random(1)
    words = ["le", "roi", "é", "ꝯ", "😀x", "fu", "fut"]
    for _ in range(60):
        p, r = (" ".join(rng.choices(words, k=rng.randrange(9))) for _ in (0, 1))
        known.append((p, r, levenshtein(p, r) / len(r) if r else float(bool(p)), levenshtein(p.split(), r.split()) / len(r.split()) if r else float(bool(p))))
    rows = spark.createDataFrame([(p, r, float(c), float(w)) for p, r, c, w in known], "p string, r string, c double, w double")
    for x in rows.withColumns({"cer": T.cer(F.col("p"), F.col("r")), "wer": T.wer(F.col("p"), F.col("r"))}).collect():
        assert x.cer == pytest.approx(x.c) and x.wer == pytest.approx(x.w), x


def test_wer_of_a_long_pair(spark):
    """More distinct words than any fixed small alphabet."""
    a = [f"w{i}" for i in range(3000)]
    b = [*a[:1000], "x", *a[1001:], "y"]
    assert column(spark, [(" ".join(a), " ".join(b))], "p string, r string", T.wer(F.col("p"), F.col("r"))) == [(2 / 3001,)]


CLEAN = [
    ("ꝯmence", "diplomatic", "conmence"), ("venir", "normalized", "uenir"), ("venir", "diplomatic", "venir"), ("a [---] b [ill.] c[mot?] [?][TC]d [...2 mots...]", "diplomatic", "a b c d"),
    ("﻿a​b", "diplomatic", "ab"), ("ȷ", "normalized", "j"), ("j", "normalized", "i"), ("ñ", "diplomatic", "ñ"), ("ꝯm̃ce", "diplomatic", "conm̃ce"),
    ("⁊", "diplomatic", "⁊"), ("⁊", "normalized", "et"), ("[...]", "diplomatic", "[...]"), ("’;", "normalized", "re:"), ("a\t b", "diplomatic", "a\t b"), ("ꝯmence [---] le liure", "diplomatic", "conmence le liure"),
]


@pytest.mark.parametrize("mode", N.MODES)
def test_normalize(spark, mode):
    rows = [(t, w) for t, m, w in CLEAN if m == mode]
    assert [(a, b) for a, b in column(spark, rows, "t string, w string", N.normalize_text(F.col("t"), mode), "w") if a != b] == []
    composed = [(unicodedata.normalize("NFC", t), w) for t, w in rows]
    assert [(a, b) for a, b in column(spark, composed, "t string, w string", N.normalize_composed(F.col("t"), mode), "w") if a != b] == []
    assert column(spark, [(None,)], "t string", N.normalize_text(F.col("t"), mode)) == [(None,)]


def test_rule_counts():
    assert (len(N.DIPLOMATIC), len(N.GRAPHIC), len(N.EDITORIAL)) == (20, 85, 6)
    with pytest.raises(ValueError):
        N.rules_for("other")


def test_unicode_helpers(spark):
    assert column(spark, [("é",), ("ꝯ",)], "t string", N.without_accents(F.col("t")), N.unicode_name(F.col("t"))) == [("e", "LATIN SMALL LETTER E WITH ACUTE"), ("ꝯ", "LATIN SMALL LETTER CON")]


def test_multiset(spark):
    assert column(spark, [(["a", "a", "b"], ["a", "b", "b", "c"])], "a array<string>, b array<string>", T.multiset_overlap(F.col("a"), F.col("b"))) == [(2,)]
