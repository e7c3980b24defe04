"""String functions of receipts, as Column expressions.  Only nfkc and ratio leave the JVM."""

from __future__ import annotations

import difflib
import unicodedata

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .. import fixed
from .vectors import let


@F.pandas_udf(T.StringType())
def nfkc(texts: pd.Series) -> pd.Series:
    """NFKC form: Spark has no built-in for it."""
    return texts.map(lambda t: None if t is None else unicodedata.normalize("NFKC", t))


# So that a filter on what is made from it isn't pushed into it: the planner can't run a Python step within a lambda.
nfkc = nfkc.asNondeterministic()


def normalised(text: Column) -> Column:
    """NFKC form; texts of nothing but letters that it leaves alone don't go through Python."""
    other = text.rlike(r"[^\x00-\x7F¥ぁ-ゖァ-ヾ一-\u9FFF々、。「」]")
    return F.coalesce(nfkc(F.when(other, text)), text)


@F.pandas_udf(T.DoubleType())
def ratio(a: pd.Series, b: pd.Series) -> pd.Series:
    """Matching-block similarity 2M / T of two strings; the order of the arguments counts."""
    return pd.Series([None if x is None or y is None else difflib.SequenceMatcher(None, x, y).ratio() for x, y in zip(a, b, strict=True)])


def found(text: Column, pattern: str, group: int = 0) -> Column:
    """A group of the first match, null if there is none (or the group took no part)."""
    return let(F.regexp_extract(text, f"(?Ud){pattern}", group), lambda x: F.when(x != "", x))


def repaired(text: Column) -> Column:
    """Misread glyphs put right: sequences in order, then simplified forms."""
    for wrong, right in fixed.REPAIRS:
        text = F.replace(text, F.lit(wrong), F.lit(right))
    return F.translate(text, fixed.SIMPLIFIED, fixed.JAPANESE)


#: What COMPACT matches, as letters: Unicode's white space and the marks.  Letters are taken out faster than a pattern is searched.
_SPACE = "\t\n\x0b\x0c\r \x85\xa0\u1680\u2000\u2001\u2002\u2003\u2004\u2005\u2006\u2007\u2008\u2009\u200a\u2028\u2029\u202f\u205f\u3000"
_MARKS = _SPACE + "-‐‑–—―ー・."


def compact(text: Column) -> Column:
    """Without white space, hyphens, long marks, middle dots and periods."""
    return F.translate(text, _MARKS, "")


def loose(text: Column) -> Column:
    """compact, and semi-voiced kana as voiced ones."""
    return F.translate(text, fixed.SEMI_VOICED + _MARKS, fixed.VOICED)


def unspaced(text: Column) -> Column:
    return F.regexp_replace(text, r"(?Ud)\s", "")


def plain_digits(text: Column) -> Column:
    """Without white space, commas and periods: how values are looked up in lines."""
    return F.regexp_replace(text, r"(?Ud)[,，.\s]", "")


def digit_mask(text: Column) -> Column:
    """Every digit as 0; for other forms of digits, of normalised() text."""
    return F.regexp_replace(text, r"(?Ud)\d", "0")


def long_mark(text: Column) -> Column:
    """A hyphen between katakana is a long mark."""
    return F.regexp_replace(text, "(?<=[ァ-ヶ])-(?=[ァ-ヶ])", "ー")


def amount(text: Column) -> Column:
    """The whole number that digits with separators stand for; null for none or one beyond a long."""
    return plain_digits(text).try_cast("bigint")


def yen(n: Column, comma: bool = True) -> Column:
    return F.concat(F.lit("¥"), F.format_number(n, 0) if comma else n.cast("string"))


def letter_spaced(text: Column) -> Column:
    return F.array_join(F.filter(F.split(text, ""), lambda c: c != ""), " ")


def lines(text: Column) -> Column:
    """The lines that aren't blank."""
    return F.filter(F.split(text, f"(?Ud)(?:{fixed.LINE_ENDS})"), lambda x: unspaced(x) != "")


def base_name(path: Column) -> Column:
    return F.element_at(F.split(path, "/"), -1)


def stem(path: Column) -> Column:
    return F.regexp_replace(base_name(path), r"(?<=.)\.[^.]*$", "")


def percent(share: Column) -> Column:
    """A share as a whole per cent; halves go to even."""
    return F.concat(F.bround(share * 100, 0).cast("bigint"), F.lit("%"))
