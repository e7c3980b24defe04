"""Scores of predictions against truth: one long table of facts, and groupings of it."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .. import fixed
from ..functions import text as t


def long_form(df: DataFrame, keys: list[str], fields: list[str], value: str) -> DataFrame:
    """keys, field, value (as text) of the fields that are present: absent ones are null, and have no row."""
    pairs = ", ".join(f"'{f}', CAST(`{f}` AS STRING)" for f in fields)
    return df.select(*keys, F.expr(f"stack({len(fields)}, {pairs}) AS (field, {value})")).where(F.col(value).isNotNull())


def is_match(field: Column, got: Column, expected: Column, accepted: Column | None = None) -> Column:
    """Taxes may be any accepted one, branches may be longer in front; anything else must be equal.  Nothing got: no match."""
    tax = F.array_contains(accepted, got) if accepted is not None else got == expected
    return F.coalesce(F.when(field == "tax", tax).when(field == "store_branch", F.endswith(got, expected)).otherwise(got == expected), F.lit(False))


def is_lenient_match(field: Column, got: Column, expected: Column) -> Column:
    """As is_match, with branches that may be longer on either side."""
    return F.coalesce(F.when(field == "store_branch", F.endswith(got, expected) | F.endswith(expected, got)).otherwise(got == expected), F.lit(False))


def _same(year: Column, month: Column, day: Column):
    return lambda r: (r["y"] == year) & (r["m"] == month) & (r["d"] == day)


def value_in_line(field: Column, value: Column, line: Column) -> Column:
    """Whether a line holds a value: amounts as whole numbers, dates and times in any spelling, else as text."""
    plain, close = t.plain_digits(line), t.unspaced(line)
    number = lambda x: F.array_contains(F.regexp_extract_all(x, F.lit(r"(\d+)"), F.lit(1)), value)
    part = lambda k: F.split_part(value, F.lit("-"), F.lit(k)).try_cast("int").cast("string")
    year, month, day = F.split_part(value, F.lit("-"), F.lit(1)), part(2), part(3)
    date = F.lit(False)
    for pattern, y_ in ((r"(\d{4})年0?(\d+)月0?(\d+)日", year), (r"(\d{4})[/.\-]0?(\d{1,2})[/.\-]0?(\d{1,2})", year), (r"(\d{2})\.0?(\d{1,2})\.0?(\d{1,2})", F.substring(year, 3, 2))):
        groups = [F.regexp_extract_all(close, F.lit(pattern), F.lit(k)) for k in (1, 2, 3)]
        rows = F.arrays_zip(*(g.alias(n) for g, n in zip(groups, "ymd", strict=True)))
        date = date | F.exists(rows, _same(y_, month, day))
    hour, minute = F.split_part(value, F.lit(":"), F.lit(1)).try_cast("int").cast("string"), F.split_part(value, F.lit(":"), F.lit(2))
    clock = lambda p: F.arrays_zip(F.regexp_extract_all(close, F.lit(p), F.lit(1)).alias("h"), F.regexp_extract_all(close, F.lit(p), F.lit(2)).alias("m"))
    time = F.exists(clock(r"0?(\d{1,2})[:：](\d{2})(?!\d)"), lambda r: (r["h"] == hour) & (r["m"] == minute))
    time = time | F.exists(clock(r"0?(\d{1,2})時0?(\d{1,2})分"), lambda r: (r["h"] == hour) & (r["m"] == minute.try_cast("int").cast("string")))
    out = F.when(field.isin("total", "deposit", "change", "tax"), number(plain)).when(field == "date", date).when(field == "time", time)
    return F.coalesce(out.when(field.isin("store_branch", "registration_number"), F.contains(plain, t.plain_digits(value))), F.lit(False))


def facts(truth: DataFrame, predicted: DataFrame, keys: list[str], fields: list[str] | None = None) -> DataFrame:
    """keys, field, expected, got, ok: a row for every field that truth has; other predictions don't count.

    Both are joined as they are, a row a key, and become rows of fields after that.
    """
    fields = fields or fixed.FIELDS
    want, have = truth.select(*keys, F.struct(*fields).alias("_want")), predicted.select(*keys, F.struct(*fields).alias("_have"))
    return facts_in_row(want.join(have, keys, "left"), keys, "_want", "_have", fields)


def facts_in_row(rows: DataFrame, keys: list[str], want: str, have: str, fields: list[str] | None = None) -> DataFrame:
    """As facts(), of rows that have both as structs: no join."""
    fields = fields or fixed.FIELDS
    cells = F.array(*(F.struct(F.lit(f).alias("field"), F.col(f"{want}.{f}").cast("string").alias("expected"), F.col(f"{have}.{f}").cast("string").alias("got")) for f in fields))
    d = rows.select(*keys, F.inline(cells)).where(F.col("expected").isNotNull())
    return d.withColumn("ok", is_match(F.col("field"), F.col("got"), F.col("expected")))


def in_field_order(rows: DataFrame, fields: list[str] | None = None) -> DataFrame:
    """rows with ordinal, the place of their field, in that order."""
    place = F.create_map(*(F.lit(x) for i, f in enumerate(fields or fixed.FIELDS) for x in (f, i)))
    return rows.withColumn("ordinal", F.try_element_at(place, F.col("field"))).orderBy("ordinal")


def wrong_fields(rows: DataFrame, *keys: str) -> DataFrame:
    """keys and wrong: "field: expected -> got" of all fields that aren't right, by name."""
    entry = F.concat(F.col("field"), F.lit(": "), F.col("expected"), F.lit(" -> "), F.coalesce("got", F.lit("-")))
    return rows.where(~F.col("ok")).groupBy(*keys).agg(F.array_join(F.array_sort(F.collect_list(entry)), "; ").alias("wrong"))


def by_condition(cases: DataFrame, degraded: DataFrame, case: str = "case_id") -> DataFrame:
    """cases: case, image.  degraded: case, strength, output.  case, cond, image: clean ones and degraded ones side by side."""
    clean = cases.select(case, F.lit("clean").alias("cond"), "image")
    return clean.unionByName(degraded.join(cases.select(case), case, "left_semi").select(case, F.col("strength").alias("cond"), F.col("output").alias("image")))


def field_by_condition(rows: DataFrame, conditions: list[str], case: str, fields: list[str] | None = None) -> DataFrame:
    """field, n (cases whose truth has it, under whatever condition), and for each condition how many are right.

    fields: those that may occur.  A case's are bits of one number, so that a task keeps a number a case, not a row a case and field.
    """
    fields = fields or fixed.FIELDS
    bit = {f: F.lit(1 << i).cast("bigint") for i, f in enumerate(fields)}
    mask = F.try_element_at(F.create_map(*(x for f in fields for x in (F.lit(f), bit[f]))), F.col("field"))
    have = rows.where(F.col(case).isNotNull()).groupBy(case).agg(F.bit_or(mask).alias("_have"))
    cells = F.array(*(F.struct(F.lit(f).alias("field"), F.col(f"_{i}").alias("n")) for i, f in enumerate(fields)))
    n = have.agg(*(F.count_if(F.col("_have").bitwiseAND(bit[f]) != 0).alias(f"_{i}") for i, f in enumerate(fields))).select(F.inline(cells))
    return n.join(score_pivot(rows, "field", "cond", conditions), "field")


def stage_counts(receipts: DataFrame, key: str, text: str = "text", added: str | None = None) -> DataFrame:
    """key, ocr_lines, fields_count, fallback_added of extracted receipts."""
    found = sum((F.col(f).isNotNull().cast("int") for f in fixed.FIELDS), F.lit(0))
    return receipts.select(key, F.coalesce(F.size(t.lines(F.col(text))), F.lit(0)).alias("ocr_lines"), found.alias("fields_count"), (F.size(added) if added else F.lit(0)).alias("fallback_added"))


def confidence(chances: Column) -> Column:
    """The mean of the emitted letters' chances; 0 without any."""
    return F.when(F.size(chances) > 0, F.aggregate(chances, F.lit(0.0), lambda a, x: a + x) / F.size(chances)).otherwise(0.0)


def score_by(rows: DataFrame, *keys: str) -> DataFrame:
    """keys, n_ok, n."""
    return rows.groupBy(*keys).agg(F.count_if("ok").alias("n_ok"), F.count("*").alias("n"))


def score_rollup(rows: DataFrame, key: str) -> DataFrame:
    """score_by with a row TOTAL over all."""
    d = rows.rollup(key).agg(F.count_if("ok").alias("n_ok"), F.count("*").alias("n"), F.grouping(key).alias("g"))
    return d.select(F.when(F.col("g") == 1, "TOTAL").otherwise(F.col(key)).alias(key), "n_ok", "n")


def score_pivot(rows: DataFrame, row: str, column: str, values: list[str]) -> DataFrame:
    """row, and the number that is right for each value of column (0 if it has none)."""
    d = rows.groupBy(row).pivot(column, values).agg(F.count_if("ok"))
    return d.select(row, *(F.coalesce(F.col(f"`{c}`"), F.lit(0)).alias(c) for c in values))


def condition_totals(rows: DataFrame, truth_fields: int, condition: str = "cond") -> DataFrame:
    """The denominator is every field of the truth, even where a condition lacks a case."""
    return rows.groupBy(condition).agg(F.count_if("ok").alias("n_ok")).withColumn("n", F.lit(truth_fields).cast("bigint"))


def labelled_lines(rows: DataFrame, suite: str = "suite") -> DataFrame:
    """rows: suite, item, field, has_value, hit, a line each.  Fields whose value some line has, and where such a line has the label."""
    by = rows.groupBy(suite, "item", "field").agg(F.bool_or("has_value").alias("eligible"), F.bool_or(F.col("has_value") & F.col("hit")).alias("ok"))
    return by.groupBy(suite).agg(F.count_if("eligible").alias("eligible"), F.count_if("ok").alias("ok"), F.count_if(~F.col("eligible")).alias("absent"))


def recovery(rows: DataFrame, suite: str = "suite") -> DataFrame:
    """rows: suite, expected, current, current_ok, labeler, labeler_ok.  What the labeller recovers, and what it would break."""
    wrong, missing = ~F.col("current_ok"), F.col("current").isNull()
    lost, back = F.col("current_ok") & ~F.col("labeler_ok"), ~F.col("current_ok") & F.col("labeler_ok")
    return rows.groupBy(suite).agg(
        F.count_if("current_ok").alias("c_ok"), F.count_if(lost & F.col("labeler").isNull()).alias("broken_missing"), F.count_if(lost & F.col("labeler").isNotNull()).alias("broken_wrong"),
        F.count_if(wrong).alias("ng"), F.count_if(wrong & missing).alias("ng_missing"), F.count_if(wrong & ~missing).alias("ng_wrong"),
        F.count_if(back).alias("recovered"), F.count_if(back & missing).alias("recovered_missing"), F.count_if(back & ~missing).alias("recovered_wrong"),
    )


def first_seen(rows: DataFrame, key: str, order: str) -> DataFrame:
    """key and the order of its first row: groups in the order in which they appear."""
    return rows.groupBy(key).agg(F.min(order).alias("first"))


def comparison_table(rows: DataFrame, engines: list[str]) -> DataFrame:
    """rows: field, expected, engine, got.  A Markdown row a field; the last row counts what is right out of all field names."""
    ok = F.coalesce(F.col("got") == F.col("expected"), F.lit(False))
    cell = F.when(F.col("got").isNull(), "❌ (未検出)").when(ok, F.concat(F.lit("✅ "), F.col("got"))).otherwise(F.concat(F.lit("❌ "), F.col("got")))
    d = rows.groupBy("field").pivot("engine", engines).agg(F.max(F.struct("expected", cell.alias("cell"))))
    first = F.coalesce(*(F.col(f"`{e}`.expected") for e in engines))
    cells = d.select("field", F.concat(F.lit("| "), F.concat_ws(" | ", F.col("field"), first, *(F.col(f"`{e}`.cell") for e in engines)), F.lit(" |")).alias("line"))
    total = rows.groupBy().pivot("engine", engines).agg(F.count_if(ok))
    last = total.select(F.lit("~").alias("field"), F.concat(F.lit("| **正解数** | - | "), F.concat_ws(" | ", *(F.format_string(f"**%d/{len(fixed.FIELDS)}**", F.coalesce(F.col(f"`{e}`"), F.lit(0))) for e in engines)), F.lit(" |")).alias("line"))
    return cells.unionByName(last)
