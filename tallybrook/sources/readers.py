"""Sources: truth maps, case documents, manifests, dictionaries, tensors, images, and caches of what was computed before."""

from __future__ import annotations

import zlib

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions import text as t

TRUTH = "store_brand string, store_branch string, registration_number string, date string, time string, total bigint, tax bigint, deposit bigint, change bigint"
CASE = (
    "case_id string, totals struct<total_yen:bigint>, tax_summary struct<rates:array<struct<tax_rate:bigint,tax_amount_yen:bigint,taxable_amount_yen:bigint>>>, "
    "payment struct<cash_received_yen:bigint,change_yen:bigint>, invoice_profile struct<registration_number_printed:boolean,registration_number:string>, store_identity struct<branch:string>, "
    "items array<struct<name:string,quantity:bigint,tax_rate:bigint,unit_price_yen:bigint,amount_yen:bigint>>"
)


def truth_map(spark: SparkSession, path: str) -> DataFrame:
    """image and its fields, from one JSON object of image -> fields; absent fields are null."""
    kind = f"map<string,struct<{TRUTH.replace(' string', ':string').replace(' bigint', ':bigint')}>>"
    d = spark.read.text(path, wholetext=True)
    return d.select(F.explode(F.from_json("value", kind)).alias("image", "f")).select("image", "f.*")


def case_documents(spark: SparkSession, path: str) -> DataFrame:
    """A row a JSON document, with the columns of CASE and the file's name."""
    return spark.read.schema(CASE).option("multiLine", True).json(path).withColumn("file", t.base_name(F.input_file_name()))


def accepted_taxes(taxes: Column) -> Column:
    """Every tax that counts as right: each rate's, and their sum."""
    total = F.aggregate(taxes, F.lit(0).cast("bigint"), lambda a, x: a + x)
    return F.array_sort(F.array_union(taxes, F.array(total)))


def with_cases(images: DataFrame, cases: DataFrame, case: str = "case_id") -> DataFrame:
    """images: image.  Joined with the documents by the case that starts both names, up to the first underscore; a case without a document fails."""
    d = images.withColumn(case, F.split_part("image", F.lit("_"), F.lit(1))).join(cases.withColumn("_there", F.lit(True)), case, "left")
    gone = F.raise_error(F.concat(F.lit("no document of "), F.col(case)))
    return d.withColumn(case, F.when(F.col("_there").isNull(), gone.cast("string")).otherwise(F.col(case))).drop("_there")


def case_truth(cases: DataFrame) -> DataFrame:
    """Fields of case documents that can be scored.  tax_ok: every accepted tax, of rates with something taxable, and their sum."""
    taxed = F.transform(F.filter("tax_summary.rates", lambda r: r["taxable_amount_yen"] > 0), lambda r: r["tax_amount_yen"])
    number = F.col("invoice_profile.registration_number")
    return cases.select(
        "case_id", F.col("totals.total_yen").alias("total"), F.when(F.size(taxed) > 0, accepted_taxes(taxed)).alias("tax_ok"),
        F.col("payment.cash_received_yen").alias("deposit"), F.col("payment.change_yen").alias("change"),
        F.when(F.col("invoice_profile.registration_number_printed") & (number != ""), number).alias("registration_number"), F.nullif("store_identity.branch", F.lit("")).alias("store_branch"),
    )


def degradation_manifest(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.option("multiLine", True).json(path).select(F.inline("entries"))


def csv_manifest(spark: SparkSession, path: str) -> DataFrame:
    """The manifest's columns, the image's base name, and its tax rates as an array."""
    d = spark.read.csv(path, header=True)
    return d.withColumn("image", t.base_name(F.col("image_path"))).withColumn("rates", F.transform(F.split("tax_rates", r"\|"), lambda x: x.cast("int")))


def dictionary(spark: SparkSession, path: str) -> DataFrame:
    """idx, letter of a character dictionary: blank first, a line each, space last."""
    letters = F.concat(F.array(F.lit("blank")), F.split(F.regexp_replace("value", r"\n$", ""), "\n"), F.array(F.lit(" ")))
    return spark.read.text(path, wholetext=True).select(F.posexplode(letters).alias("idx", "letter"))


def optional(spark: SparkSession, path: str, schema: str) -> DataFrame:
    """A Parquet table, or an empty one where there is none."""
    where = spark._jvm.org.apache.hadoop.fs.Path(path)
    there = where.getFileSystem(spark._jsc.hadoopConfiguration()).exists(where)
    return spark.read.schema(schema).parquet(path) if there else spark.createDataFrame([], schema)


def missing(items: DataFrame, cache: DataFrame, *keys: str) -> DataFrame:
    """The items that the cache doesn't have."""
    return items.join(cache.select(*keys), list(keys), "left_anti")


def get_or_compute(items: DataFrame, cache: DataFrame, compute, keys: list[str], new_path: str) -> DataFrame:
    """The cache with what items add to it, written to a new path; compute sees missing items only."""
    cache.unionByName(compute(missing(items, cache, *keys))).write.mode("overwrite").parquet(new_path)
    return items.sparkSession.read.parquet(new_path)


def until_gap(indexes: DataFrame, key: str, idx: str = "idx") -> DataFrame:
    """A key's indexes 0, 1, ... up to the first that is missing.

    Distinct indexes in order have their own place exactly until the gap.  Repeats are removed before the window.
    """
    from pyspark.sql import Window

    place = F.row_number().over(Window.partitionBy(key).orderBy(idx)) - 1
    return indexes.select(key, idx).distinct().withColumn("_at", place).where(F.col("_at") == F.col(idx)).drop("_at")


def tensors(spark: SparkSession, folder: str) -> DataFrame:
    """stem, content, shape, dtype of raw little-endian tensors with a JSON beside each; ok: the length fits the shape."""
    width = F.when(F.col("dtype").rlike("64$"), 8).when(F.col("dtype").rlike("32$"), 4).when(F.col("dtype").rlike("16$"), 2).otherwise(1)
    raw = spark.read.format("binaryFile").load(f"{folder}/*.bin").select(t.stem(F.col("path")).alias("stem"), "content", "length")
    about = spark.read.schema("shape array<bigint>, dtype string").option("multiLine", True).json(f"{folder}/*.json").withColumn("stem", t.stem(F.input_file_name()))
    d = raw.join(about, "stem")
    return d.withColumn("ok", F.col("length") == F.aggregate("shape", F.lit(1).cast("bigint"), lambda a, x: a * x) * width)


_SIZE = T.StructType([T.StructField("width", T.IntegerType()), T.StructField("height", T.IntegerType())])


@F.pandas_udf(_SIZE)
def image_size(content: pd.Series) -> pd.DataFrame:
    """Width and height from a PNG or JPEG header; nulls if it can't be read."""

    def of(b: bytes):
        if b and b[:8] == b"\x89PNG\r\n\x1a\n" and len(b) >= 33 and zlib.crc32(b[12:29]) == int.from_bytes(b[29:33], "big"):
            return int.from_bytes(b[16:20], "big"), int.from_bytes(b[20:24], "big")
        if b and b[:2] == b"\xff\xd8":
            at = 2
            while at + 9 < len(b) and b[at] == 0xFF:
                kind, size = b[at + 1], int.from_bytes(b[at + 2 : at + 4], "big")
                if 0xC0 <= kind <= 0xCF and kind not in (0xC4, 0xC8, 0xCC):
                    return int.from_bytes(b[at + 7 : at + 9], "big"), int.from_bytes(b[at + 5 : at + 7], "big")
                at += 2 + size
        return None, None

    return pd.DataFrame([of(x) for x in content], columns=["width", "height"], dtype=object)


def images(spark: SparkSession, path: str) -> DataFrame:
    """path, content, width, height, ok; an image that can't be read is a row with ok = false, no error."""
    d = spark.read.format("binaryFile").load(path).withColumn("_s", image_size("content"))
    return d.select("path", "content", "_s.*").withColumn("ok", F.col("width").isNotNull())


def embedding_key(model: str, n_protos: Column | int, max_len: int) -> Column:
    """The key under which prototype embeddings are kept."""
    return F.concat_ws("-", F.lit(model), (F.lit(n_protos) if isinstance(n_protos, int) else n_protos).cast("string"), F.lit(str(max_len)))
