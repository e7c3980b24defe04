"""Labels of lines by their nearest prototype, and fields from labelled lines."""

from __future__ import annotations

import re
import unicodedata
from collections.abc import Callable, Iterator
from typing import Protocol

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .. import fixed
from ..functions import text as t
from ..functions import vectors as v
from . import extract

#: Prototypes are a small dimension: so many rows at most are broadcast, more are joined in blocks by the caller.
MOST_PROTOTYPES = 10_000


def prototypes(spark: SparkSession) -> DataFrame:
    """proto_idx, label, text of the built-in sentences: the kinds in order, then those of no kind."""
    rows = [(label, s) for label, all_ in fixed.PROTOTYPES.items() for s in all_] + [("other", s) for s in fixed.DISTRACTORS]
    return spark.createDataFrame([(i, *r) for i, r in enumerate(rows)], "proto_idx int, label string, text string")


def nearest(lines: DataFrame, protos: DataFrame, line_id: str = "line_id", emb: str = "emb", dims: int | None = None) -> DataFrame:
    """line_id, proto_idx, label, score: each line's prototype of the highest cosine (ties: the lowest index).

    protos: proto_idx, label, emb.  One row with all prototypes goes to every task (their number is checked), and a
    line's best is a fold over it: no row a pair, no shuffle.
    """
    n = protos.count()
    if n > MOST_PROTOTYPES:
        raise ValueError(f"{n} prototypes; {MOST_PROTOTYPES} at most are broadcast")
    unit = (lambda c: v.prefix(c, dims)) if dims else v.unit
    one = protos.select("proto_idx", "label", unit(F.col("emb")).alias("emb")).agg(F.array_sort(F.collect_list(F.struct("proto_idx", "label", "emb"))).alias("protos"))
    d = lines.select(line_id, unit(F.col(emb)).alias("_e")).crossJoin(F.broadcast(one))  # one row on the other side
    score = lambda p: F.nanvl(v.dot(F.col("_e"), p["emb"]), F.lit(-2.0))  # a vector that is no number is like nothing
    scored = F.transform("protos", lambda p: F.struct(score(p).alias("score"), (-p["proto_idx"]).alias("order"), p["label"].alias("label")))
    best = d.select(line_id, F.array_max(scored).alias("b"))
    return best.select(line_id, (-F.col("b.order")).alias("proto_idx"), F.col("b.label").alias("label"), F.col("b.score").alias("score"))


def nearest_by_dims(lines: DataFrame, protos: DataFrame, dims: list[int], line_id: str = "line_id", emb: str = "emb") -> DataFrame:
    """dims, line_id, proto_idx, label, score: nearest() for several prefixes of the vectors, in one pass over lines."""
    if protos.count() * len(dims) > MOST_PROTOTYPES:
        raise ValueError(f"more than {MOST_PROTOTYPES} prefixes of prototypes")
    each = F.array(*map(F.lit, dims))
    wide = protos.select("proto_idx", "label", F.explode(F.transform(each, lambda k: F.struct(k.alias("k"), v.prefix(F.col("emb"), k).alias("emb")))).alias("x"))
    one = wide.groupBy("x.k").agg(F.array_sort(F.collect_list(F.struct("proto_idx", "label", "x.emb"))).alias("protos"))
    d = lines.select(line_id, F.explode(each).alias("dims"), F.col(emb).alias("_v")).withColumn("_e", v.prefix(F.col("_v"), F.col("dims")))
    d = d.join(F.broadcast(one), F.col("dims") == F.col("k"))  # as many rows as there are prefixes
    score = lambda p: F.nanvl(v.dot(F.col("_e"), p["emb"]), F.lit(-2.0))
    best = d.select("dims", line_id, F.array_max(F.transform("protos", lambda p: F.struct(score(p).alias("score"), (-p["proto_idx"]).alias("order"), p["label"].alias("label")))).alias("b"))
    return best.select("dims", line_id, (-F.col("b.order")).alias("proto_idx"), F.col("b.label").alias("label"), F.col("b.score").alias("score"))


class Tokens(Protocol):
    """encode(text): ids without begin and end."""

    def encode(self, text: str) -> list[int]: ...


class Encoder(Protocol):
    """vectors(ids, mask): a row of numbers for each token of a batch (texts, tokens, width)."""

    def vectors(self, ids: np.ndarray, mask: np.ndarray) -> np.ndarray: ...


def token_rows(texts: list[str], tokens: Tokens, begin: int, end: int, most: int = 40) -> tuple[np.ndarray, np.ndarray]:
    """ids and mask of a batch, padded with 0 to its longest text, or to most: a text that is cut there loses its end.  Digits are 0."""
    rows = [[begin, *tokens.encode(re.sub(r"\d", "0", unicodedata.normalize("NFKC", t))), end][:most] for t in texts]
    ids = np.zeros((len(rows), max(map(len, rows), default=0)), np.int64)
    mask = np.zeros_like(ids)
    for i, row in enumerate(rows):
        ids[i, : len(row)], mask[i, : len(row)] = row, 1
    return ids, mask


def pooled(vectors: np.ndarray, mask: np.ndarray) -> np.ndarray:
    """Means of the tokens that are there, at length one (a zero mean stays)."""
    mean = (vectors * mask[..., None]).sum(axis=1) / np.maximum(mask.sum(axis=1, keepdims=True), 1)
    return mean / np.maximum(np.linalg.norm(mean, axis=1, keepdims=True), 1e-12)


def embedded(lines: DataFrame, tokens: Callable[[], Tokens], encoder: Callable[[], Encoder], begin: int, end: int, line: str = "line", batch: int = 32, most: int = 40) -> DataFrame:
    """lines with emb: a worker makes both once, and gives them batches of lines; null lines have none."""

    def run(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        cut, model = tokens(), encoder()
        for b in batches:
            out: list = [None] * len(b)
            at = [i for i, t in enumerate(b) if t is not None]
            for k in range(0, len(at), batch):
                ids, mask = token_rows([b.iloc[i] for i in at[k : k + batch]], cut, begin, end, most)
                for i, x in zip(at[k : k + batch], pooled(model.vectors(ids, mask), mask), strict=True):
                    out[i] = x.tolist()
            yield pd.Series(out, dtype=object)

    run.__annotations__ = {"batches": Iterator[pd.Series], "return": Iterator[pd.Series]}
    return lines.withColumn("emb", F.pandas_udf(run, "array<double>")(line))


def cached_prototypes(protos: DataFrame, embed, folder: str, model: str, most: int = 40) -> DataFrame:
    """protos with emb, from folder if they were embedded before under the same model, number and length, else embedded and kept there.

    embed: DataFrame -> the same with emb.
    """
    key = f"{model}-{protos.count()}-{most}"
    path = f"{folder.rstrip('/')}/{key}"
    spark = protos.sparkSession
    done = spark._jvm.org.apache.hadoop.fs.Path(f"{path}/_SUCCESS")
    if not done.getFileSystem(spark._jsc.hadoopConfiguration()).exists(done):
        embed(protos).select("proto_idx", "label", "emb").write.mode("overwrite").parquet(path)
    return spark.read.schema("proto_idx int, label string, emb array<double>").parquet(path)


def at_threshold(label: Column, score: Column, threshold: Column | float = fixed.LABEL_THRESHOLD) -> Column:
    return F.when(score < threshold, F.lit("other")).otherwise(label)


def guarded(label: Column, line: Column) -> Column:
    """Deposits and changes only on lines with a word for them; as written, not normalised."""
    lacks = [(label == f) & ~line.rlike(f"(?Ud){p}") for f, p in fixed.GUARDS.items()]
    return F.when(lacks[0] | lacks[1], F.lit("other")).otherwise(label)


def fields_from_labels(lines: DataFrame, image: str = "image_id") -> DataFrame:
    """lines: image, line, label, score.  A row an image: the first line of a label, best first, that gives a value.

    Best first: lines with kana or kanji, then by score, then by text, all descending.
    """
    order = F.struct(F.col("line").rlike("[ぁ-んァ-ヶ一-龥]").alias("worded"), F.col("score"), F.col("line"))
    d = lines.where("label <> 'other'").select(image, "label", order.alias("o"), t.normalised(F.col("line")).alias("_n"))
    ranked = d.groupBy(image).agg(F.sort_array(F.collect_list(F.struct("o", "_n", "label")), asc=False).alias("all"))
    of = {f: ("datetime" if f in ("date", "time") else f) for f in fixed.FALLBACK_FIELDS}
    kinds = sorted(set(of.values()))
    labelled = lambda kind: F.filter("all", lambda x: x["label"] == kind).alias(f"_{kind}")
    ranked = ranked.select(image, *map(labelled, kinds))
    first = lambda kind, f: F.get(F.filter(F.transform(f"_{kind}", lambda x: f(x["_n"])), lambda x: x.isNotNull()), F.lit(0))
    tax = F.filter(F.transform("_tax", lambda x: F.struct(extract.line_rate(x["_n"]).alias("rate"), extract.line_amount(x["_n"]).alias("amt"))), lambda x: x["amt"].isNotNull())
    value = {f: extract.line_amount for f in extract.MONEY_FIELDS} | {
        "date": extract.line_date, "time": extract.line_time, "store_branch": extract.line_branch, "registration_number": extract.registration_of,
    }
    return ranked.select(image, *((extract.tax_sum(tax) if f == "tax" else first(of[f], value[f])).alias(f) for f in fixed.FALLBACK_FIELDS))


def fill_missing(found: DataFrame, fallback: DataFrame, key: str = "image_id") -> DataFrame:
    """found with its null fields from fallback; source tells whether any was filled, missing what is null still."""
    other = fallback.select(F.col(key).alias("_key"), *(F.col(f).alias(f"_{f}") for f in fixed.FALLBACK_FIELDS))
    d = found.join(other, found[key] == F.col("_key"), "left")
    added = F.filter(F.array(*(F.when(F.col(f).isNull() & F.col(f"_{f}").isNotNull(), F.lit(f)) for f in fixed.FALLBACK_FIELDS)), lambda x: x.isNotNull())
    d = d.withColumn("fallback_added", added).withColumns({f: F.coalesce(f, f"_{f}") for f in fixed.FALLBACK_FIELDS})
    have = F.array_compact(F.array(*(F.when(F.col(f).isNotNull(), F.lit(f)) for f in fixed.FALLBACK_FIELDS)))
    d = d.withColumn("missing", F.array_except(F.array(*map(F.lit, fixed.FALLBACK_FIELDS)), have))
    return d.withColumn("source", F.when(F.size("fallback_added") > 0, "regex+fallback").otherwise("regex")).drop("_key", *(f"_{f}" for f in fixed.FALLBACK_FIELDS))


def extract_with_fallback(receipts: DataFrame, label_lines, text: str = "text", key: str = "image_id", extra_brands: list[str] | None = None) -> DataFrame:
    """Fields by pattern, then missing ones from labelled lines.

    label_lines: a DataFrame of (key, line) -> the same with label and score; it gets the lines of those receipts only that
    miss a field, so a model behind it runs on no others.
    """
    found = extract.extract_fields(receipts, text, extra_brands)
    lacks = F.lit(False)
    for f in fixed.FALLBACK_FIELDS:
        lacks = lacks | F.col(f).isNull()
    lines = found.where(lacks).select(key, F.explode(t.lines(F.col(text))).alias("line"))
    labelled = label_lines(lines).withColumn("label", guarded(F.col("label"), F.col("line")))
    return fill_missing(found, fields_from_labels(labelled, key), key)
