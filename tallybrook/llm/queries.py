"""The training-data queries by name, and their SQL where SQL can express them."""

from __future__ import annotations

from collections.abc import Callable

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import word_bpe
from .common import documents
from .lines import LineDedup
from .lm import LanguageModel
from .mixing import Mix
from .secrets import SecretScan
from .simhash import SimHash
from .token_files import token_files
from .toxicity import Toxicity
from .vectors import approximate_top_k, exact_top_k


def labels(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/labels.parquet")


def op1_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return LineDedup().report(documents(spark, sf_dir))


OP1_SQL = """
WITH d AS (SELECT row_number() OVER () AS r, doc_id, string_split(coalesce(text, ''), chr(10)) AS lines FROM documents),
l AS (SELECT r, doc_id, unnest(lines) AS line, unnest(range(len(lines))) AS pos FROM d),
k AS (SELECT *, translate(trim(line, chr(32) || chr(9) || chr(10) || chr(11) || chr(12) || chr(13)),
                          'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS key FROM l),
h AS (SELECT key, max(doc_id) AS keeper FROM k WHERE length(key) >= 40 GROUP BY key HAVING count(DISTINCT doc_id) >= 5),
m AS (SELECT k.*, h.key IS NOT NULL AND k.doc_id < h.keeper AS lost FROM k LEFT JOIN h ON k.key = h.key)
SELECT any_value(doc_id) AS doc_id, count(*)::BIGINT AS n_lines, count(*) FILTER (lost)::BIGINT AS n_dropped,
       sha256(coalesce(string_agg(line, chr(10) ORDER BY pos) FILTER (NOT lost), '')) AS kept_sha256
FROM m GROUP BY r
"""


def op2_lm_scoring(spark: SparkSession, sf_dir: str) -> DataFrame:
    return LanguageModel(public_tokenizers.path("byte_bpe_50k.json")).score(documents(spark, sf_dir))


def op3_word_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    return word_bpe.report(documents(spark, sf_dir), public_tokenizers.path("word_bpe_49k.json"))


def op4_exact_top_k(spark: SparkSession, sf_dir: str) -> DataFrame:
    return exact_top_k(spark.read.parquet(f"{sf_dir}/embeddings.parquet"), F.col("vec_id") % 20 == 0, 20)


OP4_SQL = """
WITH v AS (
  SELECT vec_id, max(list_transform(embedding, lambda x: x::DOUBLE)) AS e FROM embeddings
  WHERE vec_id IS NOT NULL AND embedding IS NOT NULL
    AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0
  GROUP BY vec_id),
w AS (SELECT vec_id, list_transform(e, lambda x: floor(64 * x)) AS e FROM v),
s AS (SELECT q.vec_id AS query_id, c.vec_id, list_dot_product(q.e, c.e)::BIGINT AS score
      FROM w AS q JOIN w AS c ON q.vec_id <> c.vec_id WHERE q.vec_id % 20 = 0),
r AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id)::INTEGER AS rank FROM s)
SELECT query_id, rank, vec_id, score FROM r WHERE rank <= 20
"""


def op5_approximate_top_k(spark: SparkSession, sf_dir: str) -> DataFrame:
    return approximate_top_k(spark.read.parquet(f"{sf_dir}/embeddings.parquet"), F.col("vec_id") % 50 == 0, 5)


def op6_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    return Toxicity().report(documents(spark, sf_dir), labels(spark, sf_dir))


def op7_secret_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return SecretScan().scan(documents(spark, sf_dir))


def op8_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    return SimHash().groups(documents(spark, sf_dir))


def op9_token_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    return token_files(documents(spark, sf_dir), public_tokenizers.path("byte_bpe_50k.json"), end_id=2)


def op10_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return Mix().apply(documents(spark, sf_dir)).select("doc_id", "size", "source", "source_size", "target", "repeats", "taken")


OP10_SQL = """
WITH d AS (
  SELECT doc_id, source,
         coalesce(len(list_filter(string_split_regex(text, '[\\x20\\x09-\\x0D]+'), lambda x: x <> '')), 0)::BIGINT AS size,
         ('0x' || substr(md5('mix:' || coalesce(doc_id::VARCHAR, '')), 1, 15))::BIGINT AS draw
  FROM documents),
s AS (SELECT source, sum(size)::BIGINT AS source_size FROM d GROUP BY source),
p AS (SELECT *, row_number() OVER (ORDER BY source NULLS LAST) AS place FROM s),
w AS (SELECT *, CASE (place - 1) % 3 WHEN 0 THEN 5 WHEN 1 THEN 2 ELSE 1 END AS weight, 2 * source_size AS cap FROM p),
l AS (SELECT *, (1.5::DOUBLE * sum(source_size) OVER ()
                 - coalesce(sum(cap) OVER (ORDER BY cap / weight, place ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0))
                / sum(weight) OVER (ORDER BY cap / weight, place ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS level
      FROM w),
f AS (SELECT arg_min(level, row(cap / weight, place)) FILTER (level * weight < cap) AS settled FROM l),
t AS (SELECT source, source_size,
             CASE WHEN settled IS NULL THEN cap::DOUBLE ELSE least(cap::DOUBLE, settled * weight) END AS target
      FROM l, f),
x AS (SELECT *, CASE WHEN source_size > 0 THEN floor(target / source_size)::BIGINT ELSE 0 END AS whole FROM t),
r AS (SELECT d.doc_id, d.size, d.source, x.source_size, x.target, x.whole, x.target - x.whole * x.source_size AS extra,
             sum(d.size) OVER (PARTITION BY d.source ORDER BY d.draw, d.doc_id, d.size ROWS UNBOUNDED PRECEDING) AS upto
      FROM d JOIN x ON d.source IS NOT DISTINCT FROM x.source)
SELECT doc_id, size, source, source_size, target,
       (whole + CASE WHEN extra > 0 AND upto - size / 2 <= extra THEN 1 ELSE 0 END)::BIGINT AS repeats,
       (size * (whole + CASE WHEN extra > 0 AND upto - size / 2 <= extra THEN 1 ELSE 0 END))::BIGINT AS taken
FROM r
"""

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "op1_line_dedup": op1_line_dedup,
    "op2_lm_scoring": op2_lm_scoring,
    "op3_word_bpe": op3_word_bpe,
    "op4_exact_top_k": op4_exact_top_k,
    "op5_approximate_top_k": op5_approximate_top_k,
    "op6_toxicity": op6_toxicity,
    "op7_secret_scan": op7_secret_scan,
    "op8_simhash": op8_simhash,
    "op9_token_files": op9_token_files,
    "op10_mixing": op10_mixing,
}

ORACLES: dict[str, str] = {"op1_line_dedup": OP1_SQL, "op4_exact_top_k": OP4_SQL, "op10_mixing": OP10_SQL}
