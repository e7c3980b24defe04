"""Helpers shared by the training-data operators."""

from __future__ import annotations

import ctypes
import re
import tempfile
import uuid
from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: The white space that every contract here strips and splits at.
SPACE_CLASS = r"\x20\x09-\x0D"
SPACES = " \t\n\x0b\x0c\r"
#: Stands for a null document id wherever an order is needed: below every other id.
NULL_ID = -(2**63)

_WORD = re.compile(rb"[^\x20\x09-\x0D]+")


def shared_dir(spark: SparkSession) -> str:
    """The folder all executors share, as a URI, with a fresh subfolder for this call.

    It is the cluster's ``spark.checkpoint.dir``.  Where that is unset, a session in one JVM (as in tests) gets a
    temporary folder; a cluster gets an error, since no executor would see the folder of another.
    """
    base = spark.conf.get("spark.checkpoint.dir", None)
    if not base:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("spark.checkpoint.dir must name a folder that all executors share")
        base = "file://" + tempfile.mkdtemp(prefix="tallybrook-")
        spark.conf.set("spark.checkpoint.dir", base)
    return f"{base.rstrip('/')}/{uuid.uuid4().hex}"


def settle(df: DataFrame, folder: str, name: str) -> DataFrame:
    """Writes df below folder and reads it back: lineage ends here, and a lost executor costs no recomputation."""
    df.write.mode("overwrite").parquet(f"{folder}/{name}")
    return df.sparkSession.read.schema(df.schema).parquet(f"{folder}/{name}")


def discard(spark: SparkSession, folder: str, *names: str) -> None:
    """Removes settled tables that nothing reads any more."""
    for name in names:
        path = spark._jvm.org.apache.hadoop.fs.Path(f"{folder}/{name}")
        path.getFileSystem(spark._jsc.hadoopConfiguration()).delete(path, True)


def tidied(step: Callable[[Iterator], Iterator]) -> Callable[[Iterator], Iterator]:
    """step for mapInArrow; when a task ends, its worker, which stays for later tasks, returns free memory to the system."""

    def run(batches: Iterator) -> Iterator:
        yield from step(batches)
        pa.default_memory_pool().release_unused()
        if trim := getattr(ctypes.CDLL(None), "malloc_trim", None):  # glibc has it
            trim(0)

    return run


#: Keys with over one in HEAVY rows are heavy: there are fewer than HEAVY of them, which bounds what is broadcast.
HEAVY = 500


def join_spread(left: DataFrame, right: DataFrame, key: str, rows: str, how: str = "inner") -> DataFrame:
    """left joined (inner, or left) with right, however many of left's rows share a key.

    right has a row a key and, in the column rows, how many of left's rows have it; that column isn't returned.  Heavy keys
    are joined where left's rows are, without a shuffle, so no task gets a key's rows together unless they are few.
    """
    total = right.agg(F.sum(rows)).first()[0] or 0
    heavy, light = right.where(F.col(rows) * HEAVY > total).drop(rows), right.where(F.col(rows) * HEAVY <= total).drop(rows)
    few = F.broadcast(heavy)  # fewer than HEAVY rows
    return left.join(few, key).unionByName(left.join(F.broadcast(heavy.select(key)), key, "left_anti").join(light, key, how))


def documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/documents.parquet")


def parallelism(spark: SparkSession) -> int:
    """The number of partitions that an explicit shuffle gets: the session's setting."""
    return int(spark.conf.get("spark.sql.shuffle.partitions"))


def ascii_lower_words(text: str | None) -> list[bytes]:
    """The words of a text in UTF-8, A-Z lower-cased (bytes.lower leaves every other letter alone)."""
    return (text or "").encode("utf-8", "surrogatepass").lower().split()


def crc32_text(col: F.Column | str) -> F.Column:
    """crc32 of an id written as text; a null id counts as the empty text."""
    return F.crc32(F.coalesce(F.col(col).cast("string") if isinstance(col, str) else col.cast("string"), F.lit("")).cast("binary"))
