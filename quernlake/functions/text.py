"""Text functions: orthographic folding, variants, estimates, scripts."""

from __future__ import annotations

import html
import re
import unicodedata
from urllib.parse import urljoin

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql.types import StringType

ZWNJ = "\u200c"
#: Letters that read as another one, marks that carry no meaning, and digits of two scripts.
FOLD = {"ي": "ی", "ى": "ی", "ك": "ک", "ة": "ه", "ە": "ه", "ۀ": "ه", "ۂ": "ه", "ہ": "ه", "أ": "ا", "إ": "ا", "آ": "ا", "ؤ": "و", "ئ": "ی"}
DROPPED = "".join(map(chr, range(0x064B, 0x0653))) + "\u0640\u200e\u200f"
DIGITS_FROM = "۰۱۲۳۴۵۶۷۸۹٠١٢٣٤٥٦٧٨٩"
DIGITS_TO = "01234567890123456789"
#: Estimated tokens per word.
TOKENS_PER_WORD = 3.45


@F.pandas_udf(StringType())
def nfkc(texts: pd.Series) -> pd.Series:
    """Compatibility composition; Spark has no such function."""
    return texts.map(lambda t: unicodedata.normalize("NFKC", t), na_action="ignore")


def normalize(text: Column, strip_zwnj: bool = True) -> Column:
    """The canonical form of a text: composed, folded, with ASCII digits and single spaces.

    Only texts beyond ASCII go through Python.
    """
    plain = text.rlike(r"\A\p{ASCII}*\z")
    composed = F.coalesce(nfkc(F.when(~plain, text)), text)
    # translate() drops what has no counterpart, so dropped characters stand last
    kept = "".join(FOLD) + DIGITS_FROM
    source = kept + DROPPED + (ZWNJ if strip_zwnj else "")
    folded = F.translate(composed, source, "".join(FOLD.values()) + DIGITS_TO)
    return F.regexp_replace(F.regexp_replace(folded, r"(?U)\s+", " "), r"\A | \z", "")


def query_variants(text: Column) -> Column:
    """The readings without and with zero-width non-joiners, in order, without blanks or repeats."""
    return F.array_distinct(F.filter(F.array(normalize(text), normalize(text, False)), lambda v: v != ""))


def word_count(text: Column) -> Column:
    return F.regexp_count(text, F.lit(r"(?U)\S+"))


def estimate_tokens(text: Column) -> Column:
    return F.greatest(F.lit(1), F.ceil(word_count(text) * F.lit(TOKENS_PER_WORD))).cast("int")


def has_arabic_script(text: Column) -> Column:
    return text.rlike("[\\u0600-\\u06ff]")


def direction(text: Column) -> Column:
    """``rtl`` or ``ltr`` by the first strong character; ``ltr`` without one."""
    strong = F.regexp_extract(text, "([\\u0600-\\u06ffA-Za-z])", 1)
    return F.when(strong.rlike("[\\u0600-\\u06ff]"), "rtl").otherwise("ltr")


def latin_tokens(text: Column) -> Column:
    """Runs of Latin letters, digits and joining punctuation, in order."""
    return F.regexp_extract_all(text, F.lit(r"([A-Za-z][A-Za-z0-9_./:@+-]*)"), F.lit(1))


def display_path(chunk_id: Column) -> Column:
    """The chunk id without its ordinal."""
    return F.regexp_replace(chunk_id, ":[^:]*$", "")


def without_fragment(url: Column) -> Column:
    return F.regexp_replace(url, "#.*$", "")


@F.pandas_udf(StringType())
def html_unescape(texts: pd.Series) -> pd.Series:
    return texts.map(html.unescape, na_action="ignore")


#: Markdown targets, reference definitions, HTML attributes.
TARGETS = (re.compile(r"(\]\()([^)]+)(\))"), re.compile(r"^(\s*\[[^\]]+\]:\s*)(\S+)(.*)$", re.M), re.compile(r"(\b(?:href|src)=[\"'])([^\"']+)([\"'])"))
ABSOLUTE = ("http://", "https://", "mailto:", "tel:", "data:")


def absolute_links(text: str, base: str) -> str:
    """Relative link targets of Markdown or HTML joined to the base; others stay."""

    def joined(match: re.Match[str]) -> str:
        target = match[2]
        try:
            return match[1] + (target if target.startswith(ABSOLUTE) else urljoin(base, target)) + match[3]
        except ValueError:  # no valid URL
            return match[0]

    for pattern in TARGETS:
        text = pattern.sub(joined, text)
    return text


@F.pandas_udf(StringType())
def rewrite_links(texts: pd.Series, bases: pd.Series) -> pd.Series:
    return pd.Series([None if t is None or b is None else absolute_links(t, b) for t, b in zip(texts, bases, strict=True)], dtype=object)
