"""Token ids in binary files: fixed-width bit packing with block offsets (operator 9).

File layout, little-endian: the magic, then blocks of BLOCK ids at `bits` bits each (the last block may be
shorter; every block starts at a byte), then the index arrays, then a fixed footer.  The index has the
byte offset of every block, and for every document its id and the position of its first token, so any
document or any range of tokens is read by unpacking the blocks it touches and no others.

Defined results: a null or empty text has the end id only; a null doc_id sorts before all others; rows that
share a doc_id (or have none) are separate documents side by side, ordered by their ids within a file, and over several
files by a hash of the text first; very long texts are one document of any number of blocks; an empty table gives no files
and no rows; other columns are not looked at, whatever their names.  The files stay: they are the result.
"""

from __future__ import annotations

import struct
import uuid
import zlib
from array import array
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import xxhash
from pyarrow import fs
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import byte_bpe
from .common import NULL_ID, parallelism, shared_dir, tidied

MAGIC = b"TBTK0001"
#: Ids in a block: a multiple of 64, so that full blocks are whole words at any width.
BLOCK = 4096
_FOOTER = struct.Struct("<QQQQQ")  # bits, blocks, documents, ids, place of the index


def bits_for(vocabulary: int) -> int:
    return max(1, int(vocabulary - 1).bit_length())


def pack(ids: np.ndarray, bits: int) -> bytes:
    """ids at `bits` bits each, lowest bit first, in whole bytes."""
    n = len(ids)
    rows = np.zeros((-(-n // 64), 64), np.uint64)
    rows.reshape(-1)[:n] = ids
    words = np.zeros((len(rows), bits), np.uint64)
    for j in range(64):
        at, shift = divmod(j * bits, 64)
        words[:, at] |= rows[:, j] << np.uint64(shift)
        if shift + bits > 64:
            words[:, at + 1] |= rows[:, j] >> np.uint64(64 - shift)
    return words.astype("<u8").tobytes()[: -(-n * bits // 8)]


def unpack(data: bytes, bits: int, n: int) -> np.ndarray:
    """The n ids that pack() wrote."""
    groups = -(-n // 64)
    words = np.frombuffer(data.ljust(groups * bits * 8, b"\0"), "<u8").reshape(groups, bits)
    out, mask = np.empty((groups, 64), np.uint32), np.uint64((1 << bits) - 1)
    for j in range(64):
        at, shift = divmod(j * bits, 64)
        x = words[:, at] >> np.uint64(shift)
        if shift + bits > 64:
            x = x | (words[:, at + 1] << np.uint64(64 - shift))
        out[:, j] = x & mask
    return out.reshape(-1)[:n]


def _open(uri: str) -> tuple[fs.FileSystem, str]:
    return fs.FileSystem.from_uri(uri)


class Writer:
    """Streams documents into one file; memory holds one block and the index."""

    def __init__(self, uri: str, bits: int):
        self.files, self.path = _open(uri)
        self.files.create_dir(self.path.rpartition("/")[0], recursive=True)
        # Another attempt at the same task writes another file; the last to end takes the name, with the same bytes.
        self.own = f"{self.path}.{uuid.uuid4().hex}"
        self.out, self.bits = self.files.open_output_stream(self.own), bits
        self.out.write(MAGIC)
        self.at, self.rest, self.kept = len(MAGIC), [], 0
        self.blocks, self.ids, self.starts, self.n = array("q"), array("q"), array("q", [0]), 0

    def add(self, doc_id: int | None, ids: np.ndarray) -> None:
        self.ids.append(NULL_ID if doc_id is None else doc_id)
        self.n += len(ids)
        self.starts.append(self.n)
        self.rest.append(ids)
        self.kept += len(ids)
        if self.kept >= 64 * BLOCK:
            self._flush(False)

    def _flush(self, last: bool) -> None:
        ids = np.concatenate(self.rest) if self.rest else np.zeros(0, np.uint32)
        end = len(ids) if last else len(ids) // BLOCK * BLOCK
        if end:
            size, n = BLOCK * self.bits // 8, -(-end // BLOCK)
            data = pack(ids[:end], self.bits)
            self.blocks.extend(range(self.at, self.at + size * n, size))
            self.out.write(data)
            self.at += len(data)
        self.rest, self.kept = [ids[end:]], len(ids) - end

    def close(self) -> None:
        self._flush(True)
        for x in (self.blocks, self.ids, self.starts):
            self.out.write(np.array(x, "<i8").tobytes())
        self.out.write(_FOOTER.pack(self.bits, len(self.blocks), len(self.ids), self.n, self.at))
        self.out.close()
        self.files.move(self.own, self.path)


class Reader:
    """Random access to a file that Writer wrote."""

    def __init__(self, uri: str):
        files, path = _open(uri)
        self.file = files.open_input_file(path)
        size = self.file.size()
        self.bits, blocks, documents, self.n, self.index = _FOOTER.unpack(self.file.read_at(_FOOTER.size, size - _FOOTER.size))
        if self.file.read_at(len(MAGIC), 0) != MAGIC:
            raise ValueError(f"{uri} is no token file")
        index = np.frombuffer(self.file.read_at(size - _FOOTER.size - self.index, self.index), "<i8")
        self.blocks, self.ids, self.starts = np.split(index, [blocks, blocks + documents])

    def tokens(self, start: int, end: int) -> np.ndarray:
        """The ids at positions start to end of the file."""
        if end <= start:
            return np.zeros(0, np.uint32)
        first, last = start // BLOCK, -(-end // BLOCK)
        stop = self.blocks[last] if last < len(self.blocks) else self.index
        data = self.file.read_at(int(stop - self.blocks[first]), int(self.blocks[first]))
        n = min(last * BLOCK, self.n) - first * BLOCK
        return unpack(data, self.bits, n)[start - first * BLOCK : end - first * BLOCK]

    def documents(self, at_once: int = 1 << 20) -> Iterator[tuple[int | None, int, np.ndarray]]:
        """(doc_id, start, ids) of each document; about at_once tokens are in memory, or one document."""
        i = 0
        while i < len(self.ids):
            j = max(i + 1, int(np.searchsorted(self.starts, self.starts[i] + at_once, "right")) - 1)
            base = int(self.starts[i])
            ids = self.tokens(base, int(self.starts[j]))
            for k in range(i, j):
                a, b = int(self.starts[k]), int(self.starts[k + 1])
                yield (None if self.ids[k] == NULL_ID else int(self.ids[k])), a, ids[a - base : b - base]
            i = j


@dataclass(frozen=True)
class TokenFiles:
    """path: the tokenizer's file; end_id closes each document; rows_per_file: about so many documents share a file."""

    path: str
    end_id: int
    rows_per_file: int = 8_192
    #: Bound of the cut points that are sent to the tasks; beyond it files grow, which are streamed in any case.
    most_files: int = 10_000

    def write(self, docs: DataFrame, folder: str, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
        """Writes the documents in ascending order of doc_id over the files of folder; returns file, documents and ids, in order.

        The cut points come from the id column alone, so that each text is read and encoded once and only
        its ids are shuffled.
        """
        spark = docs.sparkSession
        d = docs.select(F.col(doc_id).cast("long").alias("doc_id"), F.col(text).alias("text"))
        rows, order = d.count(), F.coalesce("doc_id", F.lit(NULL_ID))
        n = max(1, min(self.most_files, -(-rows // self.rows_per_file)))
        cuts = [] if n == 1 else d.agg(F.percentile_approx(order, F.array(*[F.lit(i / n) for i in range(1, n)]), 100 * n)).first()[0] or []
        # An id that is a cut several times has the rows of several files: they are split by a hash of the text.
        edges, times = np.unique(np.array(cuts, np.int64), return_counts=True)
        splits = np.append(np.where(times > 1, times, 0), 0)
        first = np.cumsum(1 + splits) - (1 + splits)  # the shard of what lies below an edge; its own splits follow
        path, end, narrow = self.path, self.end_id, byte_bpe.load(self.path).size <= 1 << 16
        files = int(first[-1] + 1)
        tasks = max(1, min(files, parallelism(spark)))
        key_of = _keys(spark, tasks)

        def encode(batches):
            coder, tail = byte_bpe.load(path), np.array([end], np.uint32)
            for b in batches:
                ids, texts = np.array([NULL_ID if i is None else i for i in b.column(0).to_pylist()], np.int64), b.column(1).to_pylist()
                out = [np.concatenate((coder.encode(t or ""), tail)).astype("<u2" if narrow else "<u4").tobytes() for t in texts]
                at = np.searchsorted(edges, ids, "left")
                shard = first[at].astype(np.int32)
                for i in np.flatnonzero((splits[at] > 0) & (np.append(edges, 0)[at] == ids)):
                    shard[i] += 1 + (xxhash.xxh3_64_intdigest((texts[i] or "").encode("utf-8", "surrogatepass")) * int(splits[at[i]]) >> 64)
                yield pa.RecordBatch.from_arrays([pa.array(key_of[shard.astype(np.int64) * tasks // files], pa.int32()), pa.array(shard, pa.int32()), b.column(0), pa.array(out, pa.binary())], ["task", "shard", "doc_id", "ids"])

        vocabulary_bits = bits_for(byte_bpe.load(self.path).size)

        def write(batches):
            writer, shard = None, None
            done = []
            for b in batches:
                for s, i, x in zip(*(c.to_pylist() for c in b.columns), strict=True):
                    if s != shard:
                        if writer:
                            writer.close()
                            done.append((shard, writer))
                        shard, writer = s, Writer(f"{folder}/ids-{s:06d}.bin", vocabulary_bits)
                    writer.add(i, np.frombuffer(x, "<u2" if narrow else "<u4").astype(np.uint32))
            if writer:
                writer.close()
                done.append((shard, writer))
            yield pa.RecordBatch.from_arrays([pa.array([s for s, _ in done], pa.int32()), pa.array([f"{folder}/ids-{s:06d}.bin" for s, _ in done], pa.string()), pa.array([len(w.ids) for _, w in done], pa.int64()), pa.array([w.n for _, w in done], pa.int64())], ["shard", "file", "n_docs", "n_ids"])

        dealt = d.mapInArrow(tidied(encode), "task int, shard int, doc_id long, ids binary").repartition(tasks, "task").sortWithinPartitions("shard", F.asc_nulls_first("doc_id"), "ids").select("shard", "doc_id", "ids")
        # One row a file, most_files at most: this is the only thing the driver gets.
        written = sorted(dealt.mapInArrow(tidied(write), "shard int, file string, n_docs long, n_ids long").collect())
        before, out = 0, []
        for s, f, docs_in, ids_in in written:
            out.append((s, f, docs_in, ids_in, before))
            before += ids_in
        return spark.createDataFrame(out, "shard int, file string, n_docs long, n_ids long, start long")

    def read(self, files: DataFrame) -> DataFrame:
        """doc_id, start, n_tokens and ids_crc32 of each document, from the files."""

        def read(batches):
            for b in batches:
                for file, base in zip(b.column("file").to_pylist(), b.column("start").to_pylist(), strict=True):
                    rows = []
                    for i, start, ids in Reader(file).documents():
                        rows.append((i, base + start, len(ids), zlib.crc32(ids.astype("<u4").tobytes())))
                        if len(rows) == 10_000:
                            yield _rows(rows)
                            rows = []
                    yield _rows(rows)

        def _rows(rows):
            columns = list(zip(*rows, strict=True)) or [[]] * 4
            return pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in columns], ["doc_id", "start", "n_tokens", "ids_crc32"])

        n = max(1, min(parallelism(files.sparkSession), files.count()))
        return files.repartition(n).select("file", "start").mapInArrow(tidied(read), "doc_id long, start long, n_tokens long, ids_crc32 long")


def _keys(spark, tasks: int) -> np.ndarray:
    """A number for each task that Spark's hash deals to it: neighbouring files go to one task, and tasks get equally many."""
    some = spark.range(64 * tasks).select(F.col("id").cast("int").alias("key"), F.pmod(F.hash(F.col("id").cast("int")), F.lit(tasks)).alias("task"))
    found = {r["task"]: r["key"] for r in some.groupBy("task").agg(F.min("key").alias("key")).collect()}  # a row a task
    return np.array([found.get(t, t) for t in range(tasks)], np.int32)


def token_files(docs: DataFrame, path: str, end_id: int, folder: str | None = None, **options) -> DataFrame:
    """Encodes docs into files below folder (the cluster's shared one unless given) and reads the documents back from them."""
    job = TokenFiles(path, end_id, **options)
    return job.read(job.write(docs, folder or shared_dir(docs.sparkSession)))
