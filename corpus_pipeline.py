"""The corpus pipeline: toxicity, line dedup, near dedup, mixing, tokens.

Each stage takes (spark, docs, sf_dir) and works on all that its predecessor kept, which run() writes as Parquet
and reads again.  All but the last return the columns of documents.
"""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tallybrook.llm import word_bpe
from tallybrook.llm.common import documents, settle, shared_dir
from tallybrook.llm.lines import LineDedup
from tallybrook.llm.mixing import Mix
from tallybrook.llm.queries import labels
from tallybrook.llm.simhash import SimHash
from tallybrook.llm.toxicity import Toxicity


def toxicity(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the model rejects go."""
    return Toxicity().apply(docs, labels(spark, sf_dir))


def line_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Repeated lines go from the texts; n_chars follows."""
    out = LineDedup().apply(docs)
    return out.withColumn("n_chars", F.length("text").cast(docs.schema["n_chars"].dataType)) if "n_chars" in docs.columns else out


def near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of copies (five words, similarity 0.8) stays."""
    return SimHash(words=5, similarity=0.8).keep_one(docs)


def mixing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Rows as often as the mix takes them."""
    return Mix().repeated(docs)


def bpe(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """doc_id, n_tokens, ids, and the digests of the ids and of what they decode to, a row for each row of the mix."""
    return word_bpe.report(docs, public_tokenizers.path("word_bpe_49k.json"), ids=True)


STAGES = [("toxicity", toxicity), ("line_dedup", line_dedup), ("near_dedup", near_dedup), ("mixing", mixing), ("bpe", bpe)]

#: The model, the fingerprints and the tokens are beyond SQL; tests hold the stages against plain versions.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs, folder = documents(spark, sf_dir), shared_dir(spark)
    for name, stage in STAGES[:-1]:
        docs = settle(stage(spark, docs, sf_dir), folder, name)
    return STAGES[-1][1](spark, docs, sf_dir)
