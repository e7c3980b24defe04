import datetime
import random
import re

import pytest
from pyspark.sql import functions as F

from tallybrook import fixed
from tallybrook.functions import text as t
from tallybrook.operators import extract

CASES = [
    ("合 計 ¥1,800", {"total": 1800}), ("合計金額 ¥2,503", {"total": 2503}), ("<合 計> ¥1,800", {"total": 1800}), ("合計 ¥3, 150", {"total": 3150}), ("合計 ¥1.299", {"total": 1299}),
    ("お預り合計 ¥10,000", {"deposit": 10000}), ("現金\n0120-00", {"deposit": 120}), ("おつり ¥0", {"change": 0}), ("消費税等(8%) ¥21\n消費税等(10%) ¥32", {"tax": 53}),
    ("(内税) ¥388\n消費税等(8%) ¥21", {"tax": 388}), ("内税10%対象額 ¥1,000", {}), ("10%対象内消費税 ¥290", {"tax": 290}), ("消費税等(8%) ¥21\n内税 8.0% ¥7", {"tax": 21}),
    ("お預り ¥1,000\nお釣り ¥506", {"deposit": 1000, "change": 506, "total": 494}), ("2026/06/1511:14", {"date": "2026-06-15", "time": "11:14"}), ("26.07.07", {"date": "2026-07-07"}), ("26-07-07", {}),
    ("2026年13月1日\n2026/2/31 ", {"date": "2026-02-31"}), ("99:99", {"time": "99:99"}), ("9時5分", {"time": "09:05"}), ("代々木店", {"store_branch": "木店"}), ("新宿東口店東京都新宿区", {"store_branch": "新宿東口店"}),
    ("T 1234 5678 90123", {"registration_number": "T1234567890123"}), ("お預り 合計 ¥10,000", {"deposit": 10000, "total": 10000}), ("８％対象店\n本店", {"store_branch": "本店"}), ("ﾛｰｿﾝ 秋田-ｱ-ｲ店", {"store_brand": "ローソン", "store_branch": "秋田-アーイ店"}),
    ("ファミリマート 泉店", {"store_brand": "ファミリーマート", "store_branch": "泉店"}), ("MOS BURGER", {"store_brand": "MOS BURGER"}), ("ABCDE x", {"store_brand": "ABCDE"}), ("合十 ¥5", {"total": 5}), ("", {}), (None, {}), ("合計 ¥99999999999999999999", {}),
]


def test_documented_cases(spark):
    df = spark.createDataFrame([(i, x) for i, (x, _) in enumerate(CASES)], "i int, text string")
    got = {r.i: {f: r[f] for f in fixed.FIELDS if r[f] is not None} for r in extract.extract_fields(df).collect()}
    for i, (x, want) in enumerate(CASES):
        assert got[i] == want, x


def test_fuzzy_brands_and_extra_ones(spark):
    df = spark.createDataFrame([("ファミリーマト 本店",), ("マルワ商店 本店",), ("nothing",)], "text string")
    got = extract.extract_fields(df, extra_brands=["マルワ商店"]).select("text", "store_brand").collect()
    assert dict(map(tuple, got)) == {"ファミリーマト 本店": "ファミリーマート", "マルワ商店 本店": "マルワ商店", "nothing": None}


@pytest.mark.parametrize("name", ["MONEY", "TAX", "DATES0", "DATES1", "DATES2", "TIMES0", "BRANCH", "TOWN_FIRST"])
def test_patterns_mean_the_same_in_both_dialects(spark, name):
    rng = random.Random(name)
    pattern = getattr(fixed, name) if name.isupper() and not name[-1].isdigit() else getattr(fixed, name[:-1])[int(name[-1])]
    parts = ["合計", "消費税", "内税", "8", "10", "%", "(", ")", "¥", "1,234", ",", ".", "/", ":", " ", "　", "\xa0", "\n", " ", "2026", "年", "月", "日", "店", "東京都", "新宿区", "本", "A", "ー", "対象", "等"]
    texts = ["".join(rng.choice(parts) for _ in range(rng.randint(1, 14))) for _ in range(400)]
    df = spark.createDataFrame([(i, x) for i, x in enumerate(texts)], "i int, x string")
    got = {r.i: r.m for r in df.select("i", F.regexp_extract_all("x", F.lit(f"(?Ud){pattern}"), F.lit(0)).alias("m")).collect()}
    for i, x in enumerate(texts):
        assert got[i] == [m.group() for m in re.finditer(pattern, x)], repr(x)


def test_line_fields(spark):
    rows = [("お預り 2点 ¥1,000 3", 1000), ("品 12 345", 345), ("なし", None)]
    df = spark.createDataFrame(rows, "x string, want bigint")
    assert df.where(~extract.line_amount(F.col("x")).eqNullSafe(F.col("want"))).count() == 0
    one = df.limit(1).select(extract.line_time(F.lit("25:10 9時5分")).alias("a"), extract.line_time(F.lit("9時5分")).alias("b"), extract.line_date(F.lit("2026/7/1x2")).alias("c"), extract.line_branch(F.lit("1F 本店 東京")).alias("d")).first()
    assert tuple(one) == (None, "09:05", "2026-07-01", "F本店")


def test_printed_values_come_back(spark):
    rng = random.Random(4)
    rows = []
    for i in range(200):
        day, total = datetime.date(2025, 6, 1) + datetime.timedelta(rng.randrange(400)), rng.randrange(1, 200_000)
        paid = -(-total // 1000) * 1000
        rows.append((i, f"マルワ商店\n{day.year}年{day.month:2d}月{day.day:2d}日 {i % 24:02d}:{i % 60:02d}\n合 計 ¥{total:,}\nお預り ¥{paid:,}\nお 釣 ¥{paid - total:,}", day.isoformat(), total, paid))
    df = spark.createDataFrame(rows, "i int, text string, day string, n bigint, paid bigint")
    got = extract.with_fields(df, "text", fixed.BRANDS)
    assert got.where("date = day AND total = n AND deposit = paid AND deposit - change = total").count() == 200


def test_text_functions(spark):
    one = spark.range(1).select(t.compact(F.lit("a - b・ー.c")), t.loose(F.lit("パ-ピ")), t.digit_mask(F.lit("a1２")), t.long_mark(F.lit("カ-ド x-y")), t.amount(F.lit("1,2 3")), t.lines(F.lit("a\x1cb\r\n \nc")), t.ratio(F.lit("abcd"), F.lit("bcde")), t.stem(F.lit("/x/a.b.png"))).first()
    assert tuple(one) == ("abc", "バビ", "a00", "カード x-y", 123, ["a", "b", "c"], 0.75, "a.b")
