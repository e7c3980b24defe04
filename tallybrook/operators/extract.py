"""Fields of a receipt's text.  Everything is first match wins, in the order that each function states."""

from __future__ import annotations

import difflib
import functools
import re
from collections import Counter

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .. import fixed
from ..functions import text as t
from ..functions.vectors import let

MONEY_FIELDS = ("total", "deposit", "change")

#: What a label cannot do without: texts that lack it are not searched.
_NEEDS = {"total": ["合"], "deposit": ["預", "現"], "change": ["お"]}
#: What a match begins with, looked at before the rest of its pattern is tried at a place.
_FIRST = {"total": "(?=合)", "deposit": "(?=[お現])", "change": "(?=お)", "tax": r"(?=[\d内消])"}


def _any(text: Column, parts: list[str]) -> Column:
    out = F.contains(text, F.lit(parts[0]))
    for p in parts[1:]:
        out = out | F.contains(text, F.lit(p))
    return out


def date_of(text: Column, tail: bool = True) -> Column:
    """yyyy-mm-dd by the first pattern whose first match has a month of 1-12 and a day of 1-31.

    tail: dates with separators must end at a non-digit or a time.  A match is searched once; its numbers come from the match.
    """

    def checked(numbers: Column) -> Column:
        year, month, day = (F.get(numbers, F.lit(k)).try_cast("int") for k in range(3))
        shown = F.format_string("%d-%02d-%02d", F.when(year < 100, year + 2000).otherwise(year), month, day)
        return F.when(month.between(1, 12) & day.between(1, 31), shown)

    out = []
    for pattern, needed in zip(fixed.DATES, (["年"], ["/", ".", "-"], ["."]), strict=True):
        pattern = pattern if tail else re.sub(r"\(\?=\\D.*$", "", pattern)
        numbers = F.regexp_extract_all(F.regexp_extract(text, rf"(?Ud)(?=\d){pattern}", 0), F.lit(r"(?Ud)(\d+)"), F.lit(1))
        out.append(F.when(_any(text, needed), let(numbers, checked)))
    return F.coalesce(*out)


def time_of(text: Column, check: bool = False) -> Column:
    """hh:mm with a colon, else with hour and minute signs.  check: null from hour 24 on, without another try."""

    def shown(numbers: Column) -> Column:
        hour, minute = (F.get(numbers, F.lit(k)).try_cast("int") for k in (0, 1))
        out = F.when(hour.isNotNull(), F.format_string("%02d:%02d", hour, minute))
        return F.when(hour < 24, out) if check else out

    first, second = (F.regexp_extract(text, f"(?Ud){p}", 0) for p in fixed.TIMES)
    match = let(F.when(_any(text, [":", "："]), first).otherwise(""), lambda m: F.when((m == "") & F.contains(text, F.lit("時")), second).otherwise(m))
    return let(F.regexp_extract_all(match, F.lit(r"(?Ud)(\d+)"), F.lit(1)), shown)


def registration_of(text: Column) -> Column:
    """As found in the text without white space; only what is found loses it."""
    return F.when(F.contains(text, F.lit("T")), t.unspaced(t.found(text, fixed.REGISTRATION.replace(r"\d", r"(?:\s*\d)"))))


def money_of(text: Column, field: str) -> Column:
    """The amount after a field's label, on its line; else one line break may stand between."""
    near, far = (F.regexp_extract(text, f"(?Ud){_FIRST[field]}{fixed.LABELS[field]}{gap}{fixed.MONEY}", 1) for gap in (fixed.GAP, fixed.GAP_OR_LINE))
    whole = let(near, lambda x: F.when(x != "", t.amount(x)))
    return F.when(_any(text, _NEEDS[field]), F.coalesce(whole, t.amount(far)))


#: Stand between the parts of a tax line while it is taken apart; a text that holds one goes another way.
_CUT, _PART, _END = "\uf8f0", "\uf8f1", "\uf8f2"


def tax_matches(text: Column) -> Column:
    """All tax amounts in order, as structs of rate (null: none stated) and amt.

    One search marks every match with its parts, and cutting at the marks gives them.
    """
    rate = lambda before, after: F.coalesce(F.nullif(after, F.lit("")), F.nullif(before, F.lit(""))).try_cast("double")
    entry = lambda before, after, amount: F.struct(rate(before, after).alias("rate"), t.amount(amount).alias("amt"))
    pattern = f"(?Ud){_FIRST['tax']}{fixed.TAX}"
    marked = F.regexp_replace(text, pattern, f"{_CUT}$1{_PART}$2{_PART}$3{_END}")
    parts = F.transform(F.slice(F.split(marked, _CUT), F.lit(2), F.lit(2**31 - 2)), lambda x: F.split(F.substring_index(x, _END, 1), _PART))
    fast = F.transform(parts, lambda p: entry(p[0], p[1], p[2]))
    before, after, amount = (F.regexp_extract_all(text, F.lit(pattern), F.lit(k)) for k in (1, 2, 3))
    slow = F.transform(F.arrays_zip(before.alias("before"), after.alias("after"), amount.alias("amt")), lambda x: entry(x["before"], x["after"], x["amt"]))
    return F.when(~F.contains(text, F.lit("税")), F.slice(slow, F.lit(1), F.lit(0))).when(_any(text, [_CUT, _PART, _END]), slow).otherwise(fast)


def tax_sum(matches: Column) -> Column:
    """The first amount without a rate; else the first of each rate, added up."""
    free = F.filter(matches, lambda x: x["rate"].isNull())
    # A rate's first amount: no earlier match has the rate.
    firsts = F.filter(matches, lambda x, i: ~F.exists(F.slice(matches, F.lit(1), i), lambda y: y["rate"] == x["rate"]))
    total = F.aggregate(firsts, F.lit(0).cast("bigint"), lambda a, x: a + x["amt"])
    return F.when(F.size(free) > 0, F.get(free, F.lit(0))["amt"]).when(F.size(matches) > 0, total)


def tax_of(text: Column) -> Column:
    return let(tax_matches(text), tax_sum)


#: What COMPACT matches in Python's dialect: no mark or white space lies beyond.
_COMPACT = {i: None for i in range(0x3100) if re.match(fixed.COMPACT.removeprefix("(?Ud)"), chr(i))}
_LOOSE = _COMPACT | str.maketrans(fixed.SEMI_VOICED, fixed.VOICED)


def _py_compact(s: str) -> str:
    return s.translate(_COMPACT)


def _py_loose(s: str) -> str:
    return s.translate(_LOOSE)


def brand_exact(loose_text: Column, brands: list[str]) -> Column:
    """The first brand of the list that the text holds, both loosely spelt."""
    return F.coalesce(*(F.when(F.contains(loose_text, F.lit(_py_loose(b))), F.lit(b)) for b in brands))


@functools.lru_cache(1 << 16)
def _likeness(form: str, part: str) -> float:
    return difflib.SequenceMatcher(None, form, part).ratio()


def _shared(form: str, letters: list[str] | str, size: int) -> list[int]:
    """For each window of a size: how many letters it has in common with form, at most what can match."""
    need, have, out, both = Counter(form), Counter(), [], 0
    for i, c in enumerate(letters):
        have[c] += 1
        both += have[c] <= need[c]
        if i >= size:
            d = letters[i - size]
            both -= have[d] <= need[d]
            have[d] -= 1
        if i >= size - 1:
            out.append(both)
    return out or [both]


def likest_brand(whole: str, forms: list[tuple[str, str]]) -> str | None:
    """The brand most like a window of its size (FUZZY at least; ties: earlier brand).  Letters in common bound a likeness from above."""
    best, top, letters = None, 0.0, set(whole)
    for b, f in forms:
        size = min(len(f), len(whole))
        if size == 0 or 2 * sum(map(letters.__contains__, f)) < fixed.FUZZY * (len(f) + size):
            continue
        for i in _places(f, whole, size):
            part = whole[i : i + size]
            bound = 2 * _shared(f, part, size)[0] / (len(f) + size)
            if bound >= fixed.FUZZY and bound > top:
                r = _likeness(f, part)
                if r >= fixed.FUZZY and r > top:
                    best, top = b, r
    return best


@functools.lru_cache(1 << 12)
def _letters(form: str) -> re.Pattern:
    return re.compile("[" + re.escape("".join(sorted(set(form)))) + "]")


def _places(form: str, whole: str, size: int) -> list[int]:
    """Where windows begin that hold so many letters of form that their likeness can be FUZZY, in order."""
    need = next(n for n in range(1, len(form) + 2) if 2 * n / (len(form) + size) >= fixed.FUZZY)
    at = [m.start() for m in _letters(form).finditer(whole)]
    out, last = [], len(whole) - size
    for first, nth in zip(at, at[need - 1 :], strict=False):
        # A window with these letters begins no later than the first and ends no earlier than the last of them.
        low, high = max(nth - size + 1, out[-1] + 1 if out else 0), min(first, last)
        out.extend(range(low, high + 1))
    return out


def brand_fuzzy(brands: list[str]):
    """A column function: the brand most like a window of the text; null texts cost nothing."""
    forms = [(b, _py_loose(b)) for b in brands]

    @F.pandas_udf(T.StringType())
    def fuzzy(texts: pd.Series) -> pd.Series:
        return texts.map(lambda x: None if x is None else likest_brand(_py_loose(x), forms))

    return fuzzy


def _brand_pattern(brand: str) -> str:
    gap = fixed.COMPACT.removeprefix("(?Ud)") + "*"
    both = dict(zip(fixed.SEMI_VOICED + fixed.VOICED, fixed.VOICED + fixed.SEMI_VOICED, strict=True))
    return gap.join(f"[{c}{both[c]}]" if c in both else re.escape(c) for c in _py_compact(brand))


def strip_brand(line: Column, brand: Column, brands: list[str]) -> Column:
    """A line without its brand's first occurrence, marks between letters and voicing marks disregarded."""
    out = F.when(brand.isNull(), line)
    for b in dict.fromkeys(brands):  # a pattern that stays is compiled once, not for each row
        out = out.when(brand == b, F.regexp_replace(line, f"(?Uds){_brand_pattern(b)}(.*)$", "$1"))
    return out


@functools.lru_cache(1 << 16)
def without_likest(line: str, brand: str) -> str:
    """A line without the window that is most like its brand, if it is FUZZY at least and the brand has four letters."""
    form = _py_loose(brand)
    if len(form) < 4:
        return line
    sizes = range(max(3, len(form) - 2), len(form) + 3)
    letters = [_py_loose(c) for c in line]  # a mark has none
    best, top = None, 0.0
    for n in sizes:
        if n > len(line):
            break
        for i, both in enumerate(_shared(form, letters, n)):
            bound = 2 * both / (len(form) + both)  # a window has as many letters as it shares, at least
            if bound >= fixed.FUZZY and bound > top:
                r = _likeness(form, "".join(letters[i : i + n]))
                if r > top:
                    best, top = (i, i + n), r
    return line if top < fixed.FUZZY else line[: best[0]] + line[best[1] :]


@F.pandas_udf(T.ArrayType(T.StringType()))
def strip_brand_fuzzy(lines: pd.Series, stripped: pd.Series, brand: pd.Series) -> pd.Series:
    """stripped, and where that is the line as it was, the line without what is most like the brand.  Null lines cost nothing."""
    each = lambda a, b, name: [y if x != y else without_likest(x, name) for x, y in zip(a, b, strict=True)]
    return pd.Series([None if a is None or name is None else each(a, b, name) for a, b, name in zip(lines, stripped, brand, strict=True)])


def line_forms(text: Column) -> Column:
    """The lines with a shop sign, without white space: no other line names a branch."""
    return F.transform(F.filter(F.split(text, "\n"), lambda x: F.contains(x, F.lit("店"))), t.unspaced)


def branch_of(stripped: Column) -> Column:
    """The first line's word that ends in the shop sign, without a leading town.  stripped: lines without white space and brand."""

    def one(line: Column) -> Column:
        whole = F.regexp_replace(line, f"(?Ud){fixed.TOWN_FIRST}", "")
        return F.when(F.contains(line, F.lit("店")) & ~F.contains(line, F.lit("対象")), let(F.regexp_extract(whole, f"(?Ud){fixed.BRANCH}", 1), lambda x: F.when(x != "", t.long_mark(x))))

    return F.get(F.filter(F.transform(stripped, one), lambda x: x.isNotNull()), F.lit(0))


def plain_fields(text: Column) -> dict[str, Column]:
    """The fields that need no brand."""
    total, deposit, change = (money_of(text, f) for f in MONEY_FIELDS)
    return {
        "registration_number": registration_of(text), "date": date_of(text), "time": time_of(text), "total": total, "tax": tax_of(text), "deposit": deposit, "change": change,
    }


def derived_total(total: Column, deposit: Column, change: Column) -> Column:
    """A total that isn't printed follows from what was paid and given back."""
    return F.coalesce(total, F.when(deposit - change > 0, deposit - change))


def _unused(df: DataFrame, *names: str) -> list[str]:
    """Names for columns on the way that df doesn't have."""
    mark = "_"
    while any(c.startswith(mark) for c in df.columns):
        mark += "_"
    return [mark + n for n in names]


def with_fields(df: DataFrame, text: str, brands: list[str], fuzzy: bool = False, keep: list[str] | None = None) -> DataFrame:
    """df with a column a field, from normalised text.  Columns of df that are named like a field are replaced by it.

    The brand is a column of its own before other fields use it.  Python steps get the texts that need them; for
    all other rows they get nulls.  keep: the columns of df to keep (all).
    """
    keep = [c for c in (df.columns if keep is None else keep) if c not in fixed.FIELDS]
    loose, exact, brand, lines, stripped, whole = _unused(df, "loose", "exact", "brand", "lines", "stripped", "text")
    d = df.withColumn(whole, F.col(text)).select(*keep, whole)
    d = d.withColumn(loose, t.loose(F.col(whole))).withColumn(exact, brand_exact(F.col(loose), brands)).drop(loose)
    if fuzzy:
        d = d.withColumn(brand, brand_fuzzy(brands)(F.when(F.col(exact).isNull(), F.col(whole)))).withColumn(brand, F.coalesce(exact, brand))
    else:
        d = d.withColumnRenamed(exact, brand)
    d = d.withColumn(lines, line_forms(F.col(whole)))
    d = d.withColumn(stripped, F.transform(lines, lambda x: strip_brand(x, F.col(brand), brands)))
    if fuzzy:
        same = F.exists(F.zip_with(lines, stripped, lambda a, b: a == b), lambda x: x)
        again = F.when(F.col(brand).isNotNull() & same, F.col(lines))
        d = d.withColumn(stripped, F.coalesce(strip_brand_fuzzy(again, stripped, brand), stripped))
    d = d.select(*keep, whole, brand, *(c.alias(f) for f, c in plain_fields(F.col(whole)).items()), branch_of(F.col(stripped)).alias("store_branch"), F.when(F.col(brand).isNull(), t.found(F.col(whole), fixed.CAPITALS)).alias("store_brand"))
    named = {"store_brand": F.coalesce(brand, "store_brand").alias("store_brand"), "total": derived_total(F.col("total"), F.col("deposit"), F.col("change")).alias("total")}
    return d.select(*keep, *(named.get(f, F.col(f)) for f in fixed.FIELDS))


def extract_fields(df: DataFrame, text: str = "text", extra_brands: list[str] | None = None, normalise: bool = True, fuzzy: bool = True) -> DataFrame:
    """df with a column a field.  normalise: NFKC first; fuzzy: look for misread brands where none is exact."""
    (whole,) = _unused(df, "whole")
    d = df.withColumn(whole, t.repaired(t.normalised(F.col(text)) if normalise else F.col(text)))
    return with_fields(d, whole, [*fixed.BRANDS, *(extra_brands or [])], fuzzy, df.columns)


def legacy_fields(text: Column) -> Column:
    """The first generation's fields, kept for comparison: nested amounts, kanji dates only, stricter labels."""
    p = fixed.LEGACY
    year, month, day = (t.found(text, fixed.DATES[0], k) for k in (1, 2, 3))
    amounts = {k: F.regexp_replace(t.found(text, p[k], 1), ",", "").try_cast("bigint") for k in ("total", "deposit", "change", "tax")}
    return F.struct(
        t.found(text, fixed.CAPITALS).alias("store_brand"), t.found(text, p["store_branch"]).alias("store_branch"),
        t.found(F.replace(text, F.lit(" "), F.lit("")), fixed.REGISTRATION).alias("registration_number"),
        F.when(year.isNotNull(), F.concat_ws("-", year, F.lpad(month, 2, "0"), F.lpad(day, 2, "0"))).alias("date"),
        t.found(text, p["time"]).alias("time"), F.struct(*(v.alias(k) for k, v in amounts.items())).alias("amounts"),
    )


# Fields of a single line


def line_amount(line: Column) -> Column:
    """The last amount with a yen sign, else the last of all."""
    sign, digits = (F.regexp_extract_all(line, F.lit(f"(?Ud){fixed.LINE_AMOUNT}"), F.lit(k)) for k in (1, 2))
    rows = F.arrays_zip(sign.alias("sign"), digits.alias("n"))
    marked = F.filter(rows, lambda x: x["sign"] != "")
    last = F.when(F.size(marked) > 0, F.try_element_at(marked, F.lit(-1))["n"]).otherwise(F.try_element_at(rows, F.lit(-1))["n"])
    return t.amount(last)


def line_date(line: Column) -> Column:
    return date_of(line, tail=False)


def line_time(line: Column) -> Column:
    return time_of(line, check=True)


def line_branch(line: Column) -> Column:
    whole = t.unspaced(line)
    return F.when(~F.contains(whole, F.lit("対象")), t.long_mark(F.coalesce(*(t.found(whole, p) for p in fixed.LINE_BRANCH))))


def line_rate(line: Column) -> Column:
    return t.found(line, fixed.LINE_RATE, 1).try_cast("double")
