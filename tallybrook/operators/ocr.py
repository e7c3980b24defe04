"""Recognition engines behind an interface: this library has none, and calls one where it is given."""

from __future__ import annotations

from collections.abc import Callable, Iterator
from typing import Protocol

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import labeling, layout

BOXES = "array<struct<top:double,bottom:double,left:double,text:string>>"


class Engine(Protocol):
    """recognise(content) gives a dict of text, and poly (four corners as x, y), for each box of an image."""

    def recognise(self, content: bytes) -> list[dict]: ...


def recognise(images: DataFrame, engine: Callable[[], Engine], content: str = "content") -> DataFrame:
    """images with boxes: a worker makes its engine once and gives it image by image; unreadable ones have null boxes.

    Rejected images should be filtered out first: a filter after this doesn't spare the engine.
    """

    def run(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        model = engine()

        def of(data):
            try:
                found = model.recognise(data)
            except ValueError:
                return None
            ys, xs = ([[p[k] for p in b["poly"]] for b in found] for k in (1, 0))
            return [{"top": float(min(y)), "bottom": float(max(y)), "left": float(min(x)), "text": b["text"]} for b, x, y in zip(found, xs, ys, strict=True)]

        for batch in batches:
            yield batch.map(lambda d: None if d is None else of(d))

    run.__annotations__ = {"batches": Iterator[pd.Series], "return": Iterator[pd.Series]}
    return images.withColumn("boxes", F.pandas_udf(run, BOXES)(content))


def process(images: DataFrame, engine: Callable[[], Engine], label_lines, key: str = "path", extra_brands: list[str] | None = None) -> DataFrame:
    """From images to fields with their source: boxes, lines, patterns, then labels for what is missing.

    ok: any field was found.  images that could not be read (ok = false) keep a row of nulls.
    """
    boxes = recognise(images.where("ok"), engine)
    text = boxes.withColumn("text", layout.to_text(F.col("boxes"))).select(key, F.size("boxes").alias("n_boxes"), "text")
    out = labeling.extract_with_fallback(text, label_lines, "text", key, extra_brands)
    found = F.size("missing") < len(labeling.fixed.FALLBACK_FIELDS)
    out = out.withColumn("ok", found | F.col("store_brand").isNotNull())
    return images.where(~F.col("ok")).select(key, "ok").unionByName(out, allowMissingColumns=True)


def variants(images: DataFrame, configs: list[str]) -> DataFrame:
    """Every image under every named configuration of an engine or its preparation."""
    return images.withColumn("config", F.explode(F.array(*map(F.lit, configs))))
