"""Rules over an image's metrics: what is rejected, what is warned of, and the guidance that follows."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from .. import fixed

# Codes of the findings, with the advice for each.
ADVICE = {"dark": "brighter place", "bright": "no direct sun", "low_resolution": "move closer", "blur": "hold still", "tilt": "straighten"}


def findings(height: Column, width: Column, brightness: Column, sharpness: Column, tilt: Column, text_area: Column | None = None) -> Column:
    """array<struct<code, hard>>, in the order of the checks; hard ones reject."""
    edge = F.least(height, width)
    one = lambda condition, code, hard: F.when(condition, F.struct(F.lit(code).alias("code"), F.lit(hard).alias("hard")))
    checks = [
        one(edge < fixed.SHORT_EDGE, "low_resolution", True), one((edge >= fixed.SHORT_EDGE) & (edge < fixed.SHORT_EDGE_WARN), "small", False),
        one(brightness < fixed.DARK, "dark", True), one(brightness > fixed.BRIGHT, "bright", False),
        one(sharpness < fixed.SHARP, "blur", False), one(F.abs(tilt) > fixed.TILT, "tilt", True),
    ]
    if text_area is not None:
        checks.append(one(text_area < fixed.TEXT_AREA, "no_text", False))
    return F.array_compact(F.array(*checks))


def accepted(found: Column) -> Column:
    return ~F.exists(found, lambda x: x["hard"])


def messages(found: Column) -> Column:
    """The findings' codes; if the image is rejected, a heading before them and the advice for each after them."""
    codes = F.transform(found, lambda x: x["code"])
    advice = F.array_compact(F.array(*(F.when(F.array_contains(codes, code), F.lit(f"-> {what}")) for code, what in ADVICE.items())))
    return F.when(accepted(found), codes).otherwise(F.concat(F.array(F.lit("guide")), codes, advice))


def needs_enhancement(stroke_p95: Column, paper_px: Column, ink_p1: Column) -> Column:
    """Faint print on enough paper: dark strokes, little paper or deep ink need nothing."""
    return ~((stroke_p95 >= 100) | (paper_px < 100) | (ink_p1 < 0.32))
