"""Sinks: JSON truth maps, manifests, reports, and tensors with their descriptions."""

from __future__ import annotations

import json

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def truth_json(truth: DataFrame, path: str, image: str = "image") -> None:
    """A JSON line an image: {"image": ..., "fields": {...}}; absent fields are left out.  Lines keep it distributed."""
    fields = F.struct(*(c for c in truth.columns if c != image))
    truth.select(F.to_json(F.struct(F.col(image).alias("image"), fields.alias("fields")))).write.mode("overwrite").text(path)


def manifest_json(entries: DataFrame, path: str, seed: int, params: dict) -> None:
    """Entries as JSON lines in path/entries, and beside them a header with their number, the seed and the parameters."""
    entries.write.mode("overwrite").json(f"{path}/entries")
    head = entries.agg(F.count("*").alias("count")).select("count", F.lit(seed).alias("seed"), F.lit(json.dumps(params)).alias("params"))
    head.write.mode("overwrite").json(f"{path}/header")


def report(rows: DataFrame) -> DataFrame:
    """A JSON text a row."""
    return rows.select(F.to_json(F.struct("*")).alias("json"))


def tensors(rows: DataFrame, folder: str) -> None:
    """stem, content, shape, dtype: a .bin and a .json file each, through a file system that all executors share."""

    def put(part):
        from pyarrow import fs

        files, path = fs.FileSystem.from_uri(folder)
        files.create_dir(path, recursive=True)
        for r in part:
            for end, data in ((".bin", bytes(r["content"])), (".json", json.dumps({"shape": list(r["shape"]), "dtype": r["dtype"]}).encode())):
                with files.open_output_stream(f"{path}/{r['stem']}{end}") as out:
                    out.write(data)

    rows.select("stem", "content", "shape", "dtype").foreachPartition(put)


def images(rows: DataFrame, folder: str) -> None:
    """name, content: a file each, through a file system that all executors share."""

    def put(part):
        from pyarrow import fs

        files, path = fs.FileSystem.from_uri(folder)
        files.create_dir(path, recursive=True)
        for r in part:
            with files.open_output_stream(f"{path}/{r['name']}") as out:
                out.write(bytes(r["content"]))

    rows.select("name", "content").where("content IS NOT NULL").foreachPartition(put)
