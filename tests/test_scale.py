"""Work that must not grow faster than the input, told by plans and counts."""

from pyspark.sql import functions as F

from tallybrook import fixed
from tallybrook.functions import text as t
from tallybrook.operators import evaluate, extract, labeling
from tallybrook.plans import base
from tallybrook.plans.queries import QUERIES

SF = "/root/testdata/sf0.001"


def plan(df):
    return df._jdf.queryExecution().optimizedPlan().toString()


def test_receipts_are_dealt_before_they_are_made(spark):
    assert f"], {4 * spark.sparkContext.defaultParallelism}" in next(x for x in plan(QUERIES["q_generated_receipts"](spark, SF)).splitlines() if "RepartitionByExpression" in x)


def test_marks_are_those_of_the_pattern(spark):
    d = spark.range(0x3200).where("id not between 55296 and 57343").select(F.concat(F.lit("a"), F.expr("decode(encode(char(0), 'UTF-8'), 'UTF-8')").substr(1, 0), F.decode(F.unhex(F.lpad(F.hex("id"), 4, "0")), "UTF-16BE"), F.lit("b")).alias("x"))
    assert d.where(t.compact(F.col("x")) != F.regexp_replace("x", fixed.COMPACT, "")).count() == 0
    assert "regexp_replace" not in plan(d.select(t.loose(F.col("x"))))


def test_a_misread_brand_is_sought_in_few_windows():
    form = "ミナトコンビニ"
    whole = "あ" * 500 + "ミ◇トコンビニ" + "い" * 500
    assert 500 in (places := extract._places(form, whole, len(form))) and len(places) <= 4
    extract._likeness.cache_clear()
    for _ in range(3):
        assert extract.likest_brand(whole, [(form, form)]) == form
    assert extract._likeness.cache_info().misses == len({whole[i : i + len(form)] for i in places if extract._shared(form, whole[i : i + len(form)], len(form))[0] >= 6})


def test_by_condition_keeps_a_number_a_case(spark):
    rows = [(1, "clean", "total", True), (1, "heavy", "total", False), (1, "heavy", "total", True), (2, "clean", "tax", False), (None, "clean", "tax", True)]
    d = spark.createDataFrame(rows, "k int, cond string, field string, ok boolean")
    out = evaluate.field_by_condition(d, ["clean", "heavy"], "k")
    assert {tuple(r) for r in out.collect()} == {("total", 1, 1, 1), ("tax", 1, 1, 0)}
    assert "distinct" not in plan(out)


def test_receipts_meet_their_amounts_last(spark):
    first = next(x for x in plan(base.rendered(spark, SF)).splitlines() if "Join Inner" in x)  # the outermost
    assert first.split("Join Inner, ")[1].count("k#") == 2 and "nationkey" not in first and "custkey" not in first


def test_labelled_lines_are_grouped_once(spark):
    d = spark.createDataFrame([(1, "合計 ¥5", "total", 0.9), (1, "合計", "total", 0.95), (1, "消費税 8% ¥3", "tax", 0.9), (1, "26.06.01", "datetime", 0.9), (2, "x", "other", 0.9)], "image_id int, line string, label string, score double")
    out = labeling.fields_from_labels(d)
    assert [(r.image_id, r.total, r.tax, r.date, r.time) for r in out.collect()] == [(1, 5, 3, "2026-06-01", None)]
    assert plan(out).count("Aggregate") == 1
