"""Characters, tokens and edit distance as Column expressions."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F

# Code points that count as abbreviation marks.
ABBREVIATION = r"[\x{0303}\x{0305}\x{033E}\x{0360}\x{0361}\x{0363}-\x{036F}\x{A720}-\x{A7FF}]"
MARKS = r"[\x{0303}\x{0305}\x{033E}\x{0360}\x{0361}\x{0363}-\x{036F}]"
SPECIAL_PUNCTUATION = r"[\x{204A}\x{00B6}\x{00F7}\x{204B}\x{2E19}]"
CLASSES = ("abbreviation", "combining_mark", "special_punctuation", "latin", "other")

#: White space as Python's ``str.split`` has it.
SPACE = r"(?U)[\s\x1c-\x1f]+"


def has_abbreviation(text: Column) -> Column:
    return F.coalesce(text.rlike(ABBREVIATION), F.lit(False))


def abbreviations(text: Column) -> Column:
    """Abbreviation marks in order, repeats kept."""
    return F.regexp_extract_all(text, F.lit(f"({ABBREVIATION})"), F.lit(1))


def characters(text: Column) -> Column:
    """Code points of the text; none for an empty one."""
    return F.filter(F.split(text, ""), lambda c: c != "")


def char_class(c: Column) -> Column:
    return (
        F.when(c.rlike(MARKS) | c.rlike(r"\p{M}"), "combining_mark")
        .when(c.rlike(r"[\x{A720}-\x{A7FF}]"), "abbreviation")
        .when(c.rlike(SPECIAL_PUNCTUATION), "special_punctuation")
        .when(c.rlike(r"\p{L}"), "latin")
        .when(c.rlike(r"[\p{P}\p{S}]"), "special_punctuation")
        .otherwise("other")
    )


def codepoint(c: Column) -> Column:
    """``U+`` and at least four hexadecimal digits."""
    digits = F.hex(F.ascii(c))
    return F.concat(F.lit("U+"), F.when(F.length(digits) < 4, F.lpad(digits, 4, "0")).otherwise(digits))


def words(text: Column) -> Column:
    """Words between white space."""
    return F.filter(F.split(text, SPACE), lambda w: w != "")


def tokens(text: Column) -> Column:
    """Words that hold a letter, digit or underscore."""
    return F.filter(F.split(text, SPACE), lambda w: w.rlike(r"[\p{L}\p{N}_]"))


#: All characters that count as white space.
WHITE = "\t\n\x0b\x0c\r\x1c\x1d\x1e\x1f \x85\xa0\u1680\u2000\u2001\u2002\u2003\u2004\u2005\u2006\u2007\u2008\u2009\u200a\u2028\u2029\u202f\u205f\u3000"


def strip(text: Column) -> Column:
    """The text without white space of any kind at its ends."""
    return F.btrim(text, F.lit(WHITE))


def manuscript_of(name: Column) -> Column:
    """A manuscript's name up to its first underscore."""
    return F.substring_index(name, "_", 1)


def error_rate(distance: Column, length: Column, empty_prediction: Column) -> Column:
    return F.when(length == 0, F.when(empty_prediction, 0.0).otherwise(1.0)).otherwise(distance / length)


def cer(prediction: Column, reference: Column) -> Column:
    """Character edits over the reference's length; may exceed one. Equal texts need no alignment."""
    return F.when(prediction == reference, 0.0).otherwise(error_rate(F.levenshtein(prediction, reference), F.length(reference), F.length(prediction) == 0))


def let(value: Column, body: Callable[[Column], Column]) -> Column:
    """``body`` over ``value`` evaluated once; an expression named in Python is evaluated wherever it is used, also within lambdas."""
    return F.element_at(F.transform(F.array(value), body), 1)


def wer(prediction: Column, reference: Column) -> Column:
    """Word edits over the reference's words.

    Each distinct word of a pair becomes one character, so that the built-in
    edit distance works on words. There are 50,000 characters for it; a pair with
    more distinct words raises an error rather than a wrong rate.
    """

    def rate(x: Column) -> Column:
        symbol = lambda w: F.decode(F.unhex(F.lpad(F.hex(F.array_position(x["v"], w) + 0x100), 4, "0")), "UTF-16BE")
        encoded = lambda ws: F.array_join(F.transform(ws, symbol), "")
        edits = F.when(F.size(x["v"]) > 50_000, F.raise_error(F.lit("more than 50,000 distinct words in a pair")).cast("int")).otherwise(F.levenshtein(encoded(x["a"]), encoded(x["b"])))
        return error_rate(edits, F.size(x["b"]), F.size(x["a"]) == 0)

    pair = F.struct(words(prediction).alias("a"), words(reference).alias("b"))
    with_words = lambda x: let(F.struct(x["a"].alias("a"), x["b"].alias("b"), F.array_distinct(F.concat(x["a"], x["b"])).alias("v")), rate)
    # Equal texts need no alignment.
    return F.when(prediction == reference, 0.0).otherwise(let(pair, with_words))


def multiset_overlap(a: Column, b: Column) -> Column:
    """Size of the multiset intersection of two arrays; quadratic in a line's words."""
    return F.aggregate(
        F.array_distinct(a),
        F.lit(0),
        lambda n, w: n + F.least(F.size(F.filter(a, lambda x: x == w)), F.size(F.filter(b, lambda x: x == w))),
    )
