"""Normalisation of transcribed lines by ordered literal rules."""

from __future__ import annotations

import re
import unicodedata
from collections.abc import Sequence

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql.types import StringType

Rules = Sequence[tuple[str, str]]

# Expansions of abbreviation marks, in order of application.
DIPLOMATIC: Rules = (
    ("̾", "er"), ("◌ͮ", "v"), ("ͣ", "a"), ("ͨ", "c"), ("ꝺ", "d"), ("ͤ", "e"), ("ͥ", "i"), ("ͫ", "m"), ("ͦ", "o"),
    ("ꝑ", "p"), ("Ꝑ", "p"), ("ꝓ", "p"), ("Ꝓ", "p"), ("ꝙ", "q"), ("ͬ", "r"), ("ꝛ", "r"), ("ͭ", "t"), ("ͧ", "u"), ("ꝯ", "con"), ("ꝰ", "us"),
)

# Graphic normalisation, in order of application.
GRAPHIC: Rules = (
    ("Á", "A"), ("V", "U"), ("v", "u"), ("J", "I"), ("j", "i"), ("ê", "e"), ("í", "i"), ("ŧ", "t"), ("ẏ", "y"), ("ⸯ", "er"), ("\ue8e5", "io"),
    ("̊", "o"), ("᷑", "ur"), ("͛", "er"), ("̉", "er"), ("_", "-"), ("–", "-"), (";", ":"), ("·", "."), ("’", "re"), ("“", '"'), ("”", '"'),
    ("«", '"'), ("»", '"'), ("⁋", "¶"), ("⁊", "et"), ("•", "."), ("°", "o"), ("÷", "est"), ("¬", "-"), ("∻", "est"), ("⋅", "."), ("◌̧", "¸"),
    ("◌ᷠ", "n"), ("⁹", "us"), ("ᵃ", "a"), ("ᷓ", "a"), ("ɑ", "a"), ("ḍ", "d"), ("đ", "d"), ("ᵉ", "e"), ("ﬀ", "ff"), ("ﬂ", "fl"), ("ħ", "h"),
    ("ⁱ", "i"), ("î", "i"), ("ı", "i"), ("ȷ", "j"), ("ł", "l"), ("ᵒ", "o"), ("ô", "o"), ("ᷣ", "r"), ("ʳ", "r"), ("ɼ", "r"), ("ˢ", "s"), ("ᷤ", "s"),
    ("ſ", "s"), ("ẜ", "s"), ("ũ", "u"), ("̽", "x"), ("ỹ", "y"), ("ʑ", "z"), ("ƺ", "z"), ("᷒", "us"), ("α", "a"), ("β", "b"), ("δ", "d"), ("ζ", "z"),
    ("ι", "i"), ("κ", "k"), ("Λ", "L"), ("τ", "t"), ("ք", "p"), ("\ue5dc", "n"), ("\ue665", "p"), ("\ue681", "q"), ("\uf038", "ar"), ("\uf127", "s"),
    ("\uf128", "s"), ("\uf158", "et"), ("\uf1a6", "us"), ("\uf1a7", "ET"), ("\uf217", "E"), ("\uf143", "est"), ("̶", "-"),
)

# Editorial tags that are deleted, and characters of no width.
EDITORIAL = (r"\[---+\]", r"\[ill\.\]", r"\[mot\?\]", r"\[\?\]", r"\[TC\]", r"\[\.{3}[^\]]*mots?[^\]]*\]")
NO_WIDTH = "[\\ufeff\\u200b\\u200c\\u200d\\u2060]"
EDITORIAL_KINDS = ("gap", "illegible", "uncertain", "uncertain", "running_title", "estimated_gap")

MODES = ("diplomatic", "normalized")


def rules_for(mode: str, diplomatic: Rules = DIPLOMATIC, graphic: Rules = GRAPHIC) -> Rules:
    if mode not in MODES:
        raise ValueError(f"mode is one of {MODES}")
    return (*diplomatic, *graphic) if mode == "normalized" else tuple(diplomatic)


def normalizer(mode: str, diplomatic: Rules = DIPLOMATIC, graphic: Rules = GRAPHIC):
    """Column function: no-width characters out, NFC, editorial tags out, rules in order, blanks collapsed.

    One vectorised UDF for the whole chain: NFC has no built-in, and a chain of
    a hundred nested replacements is some twenty times slower than this.
    """
    rules = rules_for(mode, diplomatic, graphic)
    no_width, tags, blanks = re.compile(NO_WIDTH), [re.compile(t) for t in EDITORIAL], re.compile(" {2,}")

    def one(text: str | None) -> str | None:
        if text is None:
            return None
        text = unicodedata.normalize("NFC", no_width.sub("", text))
        if "[" in text:
            for tag in tags:
                text = tag.sub("", text)
        for pattern, to in rules:
            text = text.replace(pattern, to)
        return blanks.sub(" ", text).strip()

    @F.pandas_udf(StringType())
    def apply(texts: pd.Series) -> pd.Series:
        return texts.map(one)

    return apply


def normalize_text(text: Column, mode: str = "diplomatic") -> Column:
    return normalizer(mode)(text)


def normalize_composed(text: Column, mode: str = "diplomatic") -> Column:
    """The same for text that is in NFC, by built-in expressions; for small data and checks."""
    text = F.regexp_replace(text, NO_WIDTH, "")
    for tag in EDITORIAL:
        text = F.regexp_replace(text, tag, "")
    for pattern, to in rules_for(mode):
        text = F.replace(text, F.lit(pattern), F.lit(to))
    return F.btrim(F.regexp_replace(text, " {2,}", " "))


@F.pandas_udf(StringType())
def without_accents(texts: pd.Series) -> pd.Series:
    """Decomposed, without marks that take no space. Use on distinct forms."""
    return texts.map(lambda t: None if t is None else "".join(c for c in unicodedata.normalize("NFD", t) if unicodedata.category(c) != "Mn"))


@F.pandas_udf(StringType())
def unicode_name(chars: pd.Series) -> pd.Series:
    """Unicode names, ``UNKNOWN`` without one. Use on distinct characters."""
    return chars.map(lambda c: None if c is None else unicodedata.name(c, "UNKNOWN"))
