from pyspark.sql import functions as F

from tallybrook import fixed
from tallybrook.functions import vectors as v
from tallybrook.operators import evaluate, extract, labeling, layout, ocr, quality, synth


BOXES = [
    ([], ""),
    ([(0, 10, 50, "b"), (2, 12, 0, "a"), (30, 40, 0, "c")], "a b\nc"),
    ([(30, 40, 0, "c"), (0, 10, 0, "a")], "a\nc"),
    ([(0, 10, 0, "a"), (0, 10, 0, "b")], "a b"),  # equal places keep their order
    ([(0, 10, 0, "a"), (6, 16, 9, "b")], "a\nb"),  # centres lie within each other's edge, the overlap is too small
    ([(5, 5, 0, "flat"), (0, 10, 0, "a")], "flat\na"),  # no height, no overlap
    ([(0, 40, 0, "BIG"), (0, 10, 60, "up"), (30, 40, 60, "low")], "up\nBIG\nlow"),  # a large line takes no small one off its centre
    ([(0, 10, 0, "a"), (4, 14, 9, "b"), (8, 18, 20, "c")], "a b\nc"),  # the extent is the mean, it doesn't grow to take in c
]


def test_boxes_become_lines(spark):
    rows = [(i, [(float(a), float(b), float(x), s) for a, b, x, s in boxes]) for i, (boxes, _) in enumerate(BOXES)] + [(-1, None)]
    df = spark.createDataFrame(rows, "i int, boxes array<struct<top:double,bottom:double,left:double,text:string>>")
    got = {r.i: r.t for r in df.select("i", layout.to_text(F.col("boxes")).alias("t")).collect()}
    assert {i: got[i] for i in range(len(BOXES))} == {i: want for i, (_, want) in enumerate(BOXES)} and got[-1] is None


def test_ctc(spark):
    steps = F.array(*map(F.lit, [0, 1, 1, 0, 1, 2, 2, 0]))
    assert spark.range(1).select(layout.ctc_text(steps, F.array(F.lit("blank"), F.lit("a"), F.lit("b")))).first()[0] == "aab"


def test_nearest_takes_the_lowest_index_of_equals(spark):
    protos = spark.createDataFrame([(0, "a", [1.0, 0.0]), (1, "b", [2.0, 0.0]), (2, "c", [0.0, 1.0])], "proto_idx int, label string, emb array<double>")
    lines = spark.createDataFrame([(1, [3.0, 0.1]), (2, [0.0, 5.0]), (3, [0.0, 0.0])], "line_id int, emb array<double>")
    assert {r.line_id: (r.label, round(r.score, 3)) for r in labeling.nearest(lines, protos).collect()} == {1: ("a", 0.999), 2: ("c", 1.0), 3: ("a", 0.0)}
    p = labeling.prototypes(spark)
    assert p.count() == 78 and p.where("label = 'other'").count() == 33


def test_fallback_fills_only_what_is_missing(spark):
    receipts = spark.createDataFrame([(1, "合計 ¥5\nおにぎり 322\nおつり ¥3"), (2, "nothing")], "image_id int, text string")

    def label(lines):
        return lines.withColumns({"label": F.when(F.col("line").contains("合計"), "total").otherwise("change"), "score": F.lit(0.9)})

    out = {r.image_id: r for r in labeling.extract_with_fallback(receipts, label).collect()}
    assert (out[1].total, out[1].change, out[1].source, out[1].fallback_added) == (5, 3, "regex", [])
    assert out[2].source == "regex" and len(out[2].missing) == len(fixed.FALLBACK_FIELDS)


def test_scores(spark):
    truth = spark.createDataFrame([(1, 5, "本店", None), (2, 6, None, 1)], "k int, total bigint, store_branch string, change bigint")
    got = spark.createDataFrame([(1, 5, "x本店", 9), (3, 1, None, None)], "k int, total bigint, store_branch string, change bigint")
    rows = evaluate.facts(truth, got, ["k"], ["total", "store_branch", "change"])
    assert sorted((r.k, r.field, r.ok) for r in rows.collect()) == [(1, "store_branch", True), (1, "total", True), (2, "change", False), (2, "total", False)]
    assert {(r.k, r.n_ok, r.n) for r in evaluate.score_by(rows, "k").collect()} == {(1, 2, 2), (2, 0, 2)}


def test_quality(spark):
    q = quality.findings(F.lit(300), F.lit(900), F.lit(50), F.lit(60), F.lit(-20), F.lit(0.001))
    r = spark.range(1).select(quality.accepted(q), quality.messages(q)).first()
    assert tuple(r) == (False, ["guide", "low_resolution", "dark", "tilt", "no_text", "-> brighter place", "-> move closer", "-> straighten"])


def test_taxes_and_payment(spark):
    for amount in (0, 1, 107, 108, 109, 123_456_789):
        r = spark.range(1).select(synth.tax_inside(F.lit(amount), F.lit(8)), synth.tax_outside(F.lit(amount), F.lit(10)), synth.deposit(F.lit(amount), F.lit(1000), F.lit(True))).first()
        up = -(-amount // 1000) * 1000
        assert tuple(r) == (amount * 8 // 108, amount * 10 // 100, up + 1000 if up == amount else up)


def test_vectors(spark):
    x = F.array(*map(F.lit, [0.5, -1.0, 0.25]))
    scale = v.int8_scale(x)
    r = spark.range(1).select(v.int8(x, scale), v.int8_scale(F.array(F.lit(0.0))), v.prefix(x, 1), v.norm(v.unit(x))).first()
    assert r[0] == [64, -127, 32] and r[1] == 1e-8 and r[2] == [1.0] and abs(r[3] - 1) < 1e-12


def test_generated_receipts_are_consistent_and_come_back(spark):
    made = synth.receipts(spark.range(400)).cache()
    assert made.where("deposit IS NOT NULL AND deposit - change <> total").count() == 0 and made.where("deposit IS NULL").count() > 50
    shops = [s for all_ in fixed.SHOPS.values() for s in all_]
    got = extract.with_fields(made.select("id", "text"), "text", shops)
    rows = evaluate.facts(made, got, ["id"])
    wrong = rows.where("NOT ok AND NOT (field = 'store_branch')").collect()
    assert not wrong and rows.where("ok").count() > 0.99 * rows.count()
    again = synth.receipts(spark.range(399, -1, -1, 3))
    assert again.exceptAll(made).count() == 0


class Fake:
    def recognise(self, content):
        if content == b"bad":
            raise ValueError
        return [{"text": "¥5", "poly": [[90, 0], [99, 0], [99, 10], [90, 10]]}, {"text": "合計", "poly": [[0, 1], [9, 1], [9, 11], [0, 11]]}]


def test_engine(spark):
    images = spark.createDataFrame([("a", bytearray(b"x"), True), ("b", bytearray(b"bad"), True), ("c", None, False)], "path string, content binary, ok boolean")
    out = {r.path: (r.ok, r.total, r.source) for r in ocr.process(images, Fake, lambda d: d.withColumns({"label": F.lit("other"), "score": F.lit(0.0)})).collect()}
    assert out == {"a": (True, 5, "regex"), "b": (False, None, "regex"), "c": (False, None, None)}
    assert ocr.variants(images, ["x", "y"]).count() == 6
