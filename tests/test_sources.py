import json
import struct
import zlib
from pathlib import Path

import pytest
from pyspark.sql import functions as F

from tallybrook import fixed
from tallybrook.operators import evaluate
from tallybrook.sources import readers, writers
from tallybrook.streaming import receipts

DATA = Path(__file__).resolve().parent / "data"


def test_truth_map_and_its_sink(spark, tmp_path):
    d = readers.truth_map(spark, f"{DATA}/truth.json")
    rows = evaluate.long_form(d, ["image"], fixed.FIELDS, "v")
    assert d.count() == 2 and rows.count() == 8
    assert d.where("deposit IS NOT NULL AND deposit - change <> total").count() == 0
    writers.truth_json(d, str(tmp_path / "truth"))
    lines = {x["image"]: x["fields"] for x in (json.loads(r.value) for r in spark.read.text(str(tmp_path / "truth")).collect())}
    assert lines["r2.png"] == {"store_branch": "柳橋店", "total": 458} and len(lines["r1.png"]) == 6


def test_case_documents(spark):
    cases = readers.case_documents(spark, f"{DATA}/cases")
    got = {r.case_id: r for r in readers.case_truth(cases).collect()}
    assert tuple(got["K-1"]) == ("K-1", 2160, [80, 100, 180], 3000, 840, "T0123456789012", "湖畔公園店")
    assert tuple(got["K-2"]) == ("K-2", 300, [27], None, None, None, None)
    images = spark.createDataFrame([("K-1_a.png",), ("K-2_b.png",)], "image string")
    assert {(r.image, r.total) for r in readers.with_cases(images, readers.case_truth(cases)).collect()} == {("K-1_a.png", 2160), ("K-2_b.png", 300)}
    with pytest.raises(Exception, match="no document of K-3"):
        readers.with_cases(spark.createDataFrame([("K-3_x.png",)], "image string"), readers.case_truth(cases)).collect()


def test_manifests(spark, tmp_path):
    m = readers.csv_manifest(spark, f"{DATA}/manifest.csv")
    assert {(r.image, tuple(r.rates)) for r in m.collect()} == {("K-1_a.png", (8, 10)), ("K-2_b.png", (10,))}
    entries = readers.degradation_manifest(spark, f"{DATA}/degraded.json")
    assert sorted(r.strength for r in entries.collect()) == ["heavy", "light", "medium"]
    writers.manifest_json(entries, str(tmp_path / "m"), 5, {"light": {"noise": 3}})
    head = spark.read.json(str(tmp_path / "m/header")).first()
    assert (head["count"], head.seed, json.loads(head.params)) == (3, 5, {"light": {"noise": 3}}) and spark.read.json(str(tmp_path / "m/entries")).count() == 3
    assert [json.loads(r.json)["strength"] for r in writers.report(entries.where("strength = 'light'")).collect()] == ["light"]


def test_dictionary_cache_gap(spark, tmp_path):
    (tmp_path / "d.txt").write_text("あ\nb\n")
    assert [r.letter for r in readers.dictionary(spark, str(tmp_path / "d.txt")).orderBy("idx").collect()] == ["blank", "あ", "b", " "]
    items, cache = spark.createDataFrame([(1,), (2,)], "k int"), spark.createDataFrame([(1, "old")], "k int, x string")
    seen = readers.get_or_compute(items, cache, lambda d: d.withColumn("x", F.lit("new")), ["k"], str(tmp_path / "cache"))
    assert sorted(map(tuple, seen.collect())) == [(1, "old"), (2, "new")]
    gaps = spark.createDataFrame([("a", 0), ("a", 1), ("a", 1), ("a", 3), ("b", 1)], "key string, idx int")
    assert sorted(map(tuple, readers.until_gap(gaps, "key").collect())) == [("a", 0), ("a", 1)]
    assert readers.optional(spark, str(tmp_path / "none"), "a int").count() == 0


def test_tensors_and_images(spark, tmp_path):
    rows = spark.createDataFrame([("x", bytearray(16), [2, 2], "float32"), ("y", bytearray(3), [2], "int64")], "stem string, content binary, shape array<bigint>, dtype string")
    writers.tensors(rows, f"file://{tmp_path}/t")
    assert {(r.stem, r.ok) for r in readers.tensors(spark, str(tmp_path / "t")).collect()} == {("x", True), ("y", False)}
    head = b"IHDR" + struct.pack(">II", 3, 2) + b"\x08\x02\0\0\0"
    (tmp_path / "i").mkdir()
    (tmp_path / "i/a.png").write_bytes(b"\x89PNG\r\n\x1a\n" + struct.pack(">I", 13) + head + struct.pack(">I", zlib.crc32(head)))
    (tmp_path / "i/b.jpg").write_bytes(b"broken")
    assert {(r.path[-5:], r.width, r.height, r.ok) for r in readers.images(spark, str(tmp_path / "i")).collect()} == {("a.png", 3, 2, True), ("b.jpg", None, None, False)}


def test_stream(spark, tmp_path):
    spark.createDataFrame([("合計 ¥5",), ("LAWSON 合計 ¥7",)], "text string").write.parquet(str(tmp_path / "in"))
    stream = receipts.extracted(spark.readStream.schema("text string").parquet(str(tmp_path / "in")))
    q = receipts.start(stream, str(tmp_path / "out"), str(tmp_path / "state"))
    q.awaitTermination(120)
    assert {(r.store_brand, r.total) for r in spark.read.parquet(str(tmp_path / "out")).collect()} == {(None, 5), ("LAWSON", 7)}
    rows = spark.readStream.schema("ts timestamp, registration_number string, date string, time string, total bigint, store_brand string").parquet(str(tmp_path / "in2") if (tmp_path / "in2").mkdir() is None else "")
    assert receipts.without_repeats(rows).isStreaming and receipts.totals(rows).isStreaming
