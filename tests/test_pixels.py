import struct
import zlib

import numpy as np
from pyspark.sql import functions as F

from tallybrook.operators import bench, labeling, pixels, quality
from tallybrook.sources import writers
from tallybrook.operators import extract
from tallybrook import fixed


def page(height=200, width=140, angle=0.0):
    """White paper with dark rows, turned by an angle."""
    y, x = np.mgrid[:height, :width]
    rows = np.rint(y * np.cos(np.radians(angle)) - x * np.sin(np.radians(angle))).astype(int)
    ink = (rows % 14 < 4) & (x > 15) & (x < width - 15) & (x % 7 < 5)
    return np.repeat(np.where(ink, 30, 245).astype(np.uint8)[..., None], 3, axis=2)


def filtered(image, kind):
    """A PNG whose rows have a filter."""
    h, w, b = image.shape
    rows, above = [], np.zeros((w, b), int)
    for line in image.astype(int):
        left, corner = np.vstack((np.zeros((1, b), int), line[:-1])), np.vstack((np.zeros((1, b), int), above[:-1]))
        p = left + above - corner
        paeth = np.where((abs(p - left) <= abs(p - above)) & (abs(p - left) <= abs(p - corner)), left, np.where(abs(p - above) <= abs(p - corner), above, corner))
        guess = [0, left, above, (left + above) // 2, paeth][kind]
        rows.append(bytes([kind]) + ((line - guess) % 256).astype(np.uint8).tobytes())
        above = line
    chunk = lambda k, body: struct.pack(">I", len(body)) + k + body + struct.pack(">I", zlib.crc32(k + body))
    return b"\x89PNG\r\n\x1a\n" + chunk(b"IHDR", struct.pack(">IIBBBBB", w, h, 8, 2, 0, 0, 0)) + chunk(b"IDAT", zlib.compress(b"".join(rows))) + chunk(b"IEND", b"")


def test_png_round_trip():
    image = np.random.default_rng(1).integers(0, 256, (7, 5, 3)).astype(np.uint8)
    assert (pixels.read_png(pixels.write_png(image)) == image).all()
    for kind in range(5):
        assert (pixels.read_png(filtered(image, kind)) == image).all(), kind
    whole = pixels.write_png(image)
    assert pixels.read_png(b"") is None and pixels.read_png(whole[:40]) is None and pixels.read_png(whole[:60] + b"x" + whole[61:]) is None


def test_metrics():
    g = pixels.grey(page())
    assert abs(pixels.sharpness(np.full((9, 9), 7.0))) < 1e-9 < pixels.sharpness(g)
    assert pixels.sharpness(pixels._smooth(g, 2)) < 0.2 * pixels.sharpness(g)
    for angle in (-8, 0, 5):
        assert abs(pixels.tilt(pixels.grey(page(angle=angle))) - angle) <= 1
    assert pixels.tilt(np.full((50, 50), 200.0)) == 0 and pixels.text_share(np.full((50, 50), 200.0)) == 0 < pixels.text_share(g)
    clear, faint = pixels.faintness(g), pixels.faintness(245 - (245 - g) * 0.3)
    assert clear["stroke_p95"] > 100 > faint["stroke_p95"] and faint["ink_p1"] > clear["ink_p1"] and faint["paper_px"] > 100


def test_enhancement_darkens_faint_ink_only():
    faint = (245 - (245.0 - page()) * 0.3).astype(np.uint8)
    out = pixels.enhanced(faint)
    assert out.shape == faint.shape and out.min() < faint.min() - 50 and np.median(out) >= 240
    dark = np.full((60, 60, 3), 40, np.uint8)
    assert abs(pixels.enhanced(dark).astype(int) - 40).max() <= 1


def test_normalised():
    x = pixels.normalised(np.zeros((2, 3, 3), np.uint8))
    assert x.shape == (1, 3, 2, 3) and np.allclose(x[0, :, 0, 0], -pixels.MEAN / pixels.SPREAD)


def test_photographs():
    rng, image = np.random.default_rng, page().astype(float)
    noise = pixels.clouds(rng(1), 90, 70, 20)
    assert noise.shape == (90, 70) and noise.min() == 0 and noise.max() == 1 and np.abs(np.diff(noise, axis=0)).max() < 0.2
    faded = pixels.faded(image, rng(2), 0.5)
    white = image == 255
    assert (faded >= image - 1e-9).all() and (faded[white] == 255).all() and (255 - faded >= 0.2 * (255 - image) - 1e-9).all()
    flat = pixels.curled(np.full((4, 101, 3), 200.0), rng(3), 0.1)
    assert (flat[:, 50] >= flat[:, 0]).all() and (flat[..., 0] >= flat[..., 2]).all()
    assert (pixels.shaken(image, rng(4), 2) == image).all() and np.isclose(pixels.shaken(np.full((9, 9, 3), 5.0), rng(4), 5), 5).all()
    assert pixels.lit(np.full((30, 20, 3), 100.0), rng(5), 0.2, 0.3).std() > 1
    a, about = pixels.photograph(page(), "x", "heavy")
    b, _ = pixels.photograph(page(), "x", "heavy")
    c, _ = pixels.photograph(page(), "y", "heavy")
    assert (a == b).all() and a.dtype == np.uint8 and about["bg"] in pixels.GROUNDS and about["rot90_applied"] in (0, 90, 270) and (a.shape != c.shape or (a != c).any())


def test_in_spark(spark, tmp_path):
    images = spark.createDataFrame([("a", bytearray(pixels.write_png(page()))), ("b", bytearray(b"no image")), ("c", None)], "image string, content binary")
    m = {r.image: r.metrics for r in pixels.measured(images).collect()}
    assert (m["a"].width, m["a"].height) == (140, 200) and m["b"].brightness is None and m["c"].tilt is None
    q = pixels.measured(images).where("image = 'a'").select(quality.accepted(quality.findings(*(F.col(f"metrics.{c}") for c in ("height", "width", "brightness", "sharpness", "tilt", "text_area")))).alias("ok"))
    assert q.first().ok is False  # too small
    made = pixels.photographed(images, strengths=["light", "heavy"])
    rows = made.collect()
    assert len(rows) == 6 and sum(r.content is not None for r in rows) == 2 and {r.bg for r in rows} - {None} <= set(pixels.GROUNDS)
    writers.images(made.select(F.concat("image", F.lit("_"), "strength", F.lit(".png")).alias("name"), "content"), f"file://{tmp_path}/out")
    assert sorted(p.name for p in (tmp_path / "out").iterdir()) == ["a_heavy.png", "a_light.png"]


class Letters:
    def encode(self, text):
        return [ord(c) % 50 + 5 for c in text]


class OneHot:
    def vectors(self, ids, mask):
        return np.eye(64)[ids % 64]


def test_lines_are_embedded(spark, tmp_path):
    ids, mask = labeling.token_rows(["a1", "x" * 50, "９"], Letters(), 1, 2)
    assert ids.shape == (3, 40) and mask.sum(axis=1).tolist() == [4, 40, 3]
    assert ids[0, :4].tolist() == [1, ord("a") % 50 + 5, ord("0") % 50 + 5, 2] and ids[1, -1] != 2 and ids[2, 1] == ord("0") % 50 + 5
    unit = labeling.pooled(np.array([[[3.0, 0.0], [0.0, 4.0], [9.0, 9.0]], [[0.0, 0.0]] * 3]), np.array([[1, 1, 0], [1, 0, 0]]))
    assert np.allclose(unit, [[0.6, 0.8], [0, 0]])
    made = []

    def embed(d):
        made.append(1)
        return labeling.embedded(d, Letters, OneHot, 1, 2, "text")

    protos = spark.createDataFrame([(0, "total", "合計"), (1, "tax", "消費税")], "proto_idx int, label string, text string")
    for _ in range(2):
        kept = labeling.cached_prototypes(protos, embed, f"file://{tmp_path}/cache", "letters")
    assert len(made) == 1 and kept.count() == 2
    lines = labeling.embedded(spark.createDataFrame([(1, "合 計"), (2, "消費税等"), (3, None)], "line_id int, line string"), Letters, OneHot, 1, 2).where("emb IS NOT NULL")
    assert {r.line_id: r.label for r in labeling.nearest(lines, kept).collect()} == {1: "total", 2: "tax"}


def test_exact_quantiles(spark):
    rng = np.random.default_rng(2)
    groups = {"a": rng.normal(size=501), "b": np.repeat([1.0, 2.0], 100), "c": np.array([7.0]), "d": np.append(rng.random(999), 1e9)}
    rows = spark.createDataFrame([(k, float(x)) for k, xs in groups.items() for x in xs] + [("e", None)], "k string, x double")
    got = {(r.k, r.share): r.q for r in bench._quantiles(rows, "k", "x", [0.01, 0.5, 0.95]).collect()}
    assert len(got) == 12 and all(np.isclose(got[k, q], np.quantile(xs, q), rtol=1e-12) for k, xs in groups.items() for q in (0.01, 0.5, 0.95))


def test_not_a_number_is_near_nothing(spark):
    protos = spark.createDataFrame([(0, "bad", [float("nan"), 1.0]), (1, "good", [1.0, 0.0])], "proto_idx int, label string, emb array<double>")
    assert labeling.nearest(spark.createDataFrame([(1, [1.0, 0.0])], "line_id int, emb array<double>"), protos).first().label == "good"


def test_extraction_leaves_other_columns_alone(spark):
    names = ["_text", "_loose", "_brand", "_lines", "_stripped", "__x", "total"]
    d = spark.createDataFrame([("LAWSON 本町店\n合計 ¥5", *"abcdefg")], ["text", *names])
    r = extract.extract_fields(d).first()
    assert [r[n] for n in names[:-1]] == list("abcdef") and (r.total, r.store_brand, r.store_branch) == (5, "LAWSON", "本町店")
    assert [f for f in extract.extract_fields(d).columns if f in fixed.FIELDS] == fixed.FIELDS


def test_misread_brands_by_bounds_are_those_of_a_full_search():
    import difflib
    import random

    rng, brands = random.Random(3), fixed.BRANDS
    forms = [(b, extract._py_loose(b)) for b in brands]
    for _ in range(60):
        b = list(rng.choice(brands))
        b[rng.randrange(len(b))] = rng.choice("xア店")
        whole = extract._py_loose("".join(rng.choice("aアイ店") for _ in range(rng.randint(0, 8))) + "".join(b) + "市")
        best = {n: max(difflib.SequenceMatcher(None, f, whole[i : i + len(f)]).ratio() for i in range(max(1, len(whole) - len(f) + 1))) for n, f in forms}
        top = max(best, key=best.get)
        assert extract.likest_brand(whole, forms) == (top if best[top] >= fixed.FUZZY else None)


def test_stripping_by_bounds_is_that_of_a_full_search():
    import difflib
    import random

    def plain(line, brand):
        form = extract._py_loose(brand)
        cuts = [(i, i + n) for n in (range(max(3, len(form) - 2), len(form) + 3) if len(form) >= 4 else ()) for i in range(len(line) - n + 1)]
        scored = {c: difflib.SequenceMatcher(None, form, extract._py_loose(line[slice(*c)])).ratio() for c in cuts}
        best = max(scored, key=scored.get, default=None)
        return line if best is None or scored[best] < fixed.FUZZY else line[: best[0]] + line[best[1] :]

    rng = random.Random(5)
    for _ in range(150):
        brand = rng.choice(fixed.BRANDS)
        b = list(brand)
        for _ in range(rng.randint(0, 2)):
            b[rng.randrange(len(b))] = rng.choice("xア店ー・")
        line = "".join(rng.choice("aーイ店") for _ in range(rng.randint(0, 6))) + "".join(b) + rng.choice(["", "本町店", "・東店"])
        assert extract.without_likest(line, brand) == plain(line, brand)
