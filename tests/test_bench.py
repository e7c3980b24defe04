import statistics

from pyspark.sql import functions as F

from tallybrook.operators import bench


def test_medians_of_many_small_groups_need_one_shuffle_of_rows(spark):
    rows = spark.range(5000).select((F.col("id") % 1500).alias("k"), (F.hash("id") % 50).alias("x"))
    want: dict = {}
    for r in rows.collect():
        want.setdefault(r.k, []).append(r.x)
    out = bench.tilt(rows, "k", "x", 15)
    assert {r.k: (r.tilt, r.rejected) for r in out.collect()} == {k: (statistics.median(v), abs(statistics.median(v)) > 15) for k, v in want.items()}


def test_medians_keep_groups_without_values(spark):
    rows = spark.createDataFrame([(1, None), (1, None), (2, 3.0), (2, None), (None, 4.0), (None, 6.0)], "k int, x double")
    assert {r.k: r.median for r in bench.medians(rows, "k", "x").collect()} == {1: None, 2: 3.0, None: 5.0}


def test_medians_of_large_groups_are_those_of_small_ones(spark, monkeypatch):
    rows = spark.range(3000).select((F.when(F.col("id") % 10 < 8, 0).otherwise(F.col("id") % 90)).alias("k"), (F.hash("id") / 1e6).alias("x"))
    small = {r.k: r.median for r in bench.medians(rows, "k", "x").collect()}
    monkeypatch.setattr(bench, "SMALL", 100)
    assert {r.k: r.median for r in bench.medians(rows, "k", "x").collect()} == small
