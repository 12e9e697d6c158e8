"""Operator 3 - binary token ids with Elias-Fano document boundaries.

A shard holds the concatenated ids of consecutive documents, as unsigned little-endian integers of 16 or 32
bits by the vocabulary's size, their doc_ids, and the n + 1 boundaries (ids before each document, then the
total) as an Elias-Fano sequence, whose ``select(i)`` gives document i's start and ``select(i + 1)`` its end.
No table of 64-bit offsets exists. Shard bytes::

    magic "IDS1", bytes per id (u32), documents (u64), ids (u64),
    null mask of doc_ids (1 byte each), doc_ids (i64 each), Elias-Fano boundaries, ids

A store is a Parquet folder of one row for each shard (part, seq, n_docs, n_ids, data), as Spark's writers
reach any shared file system. Shards ascend by (part, seq): doc_ids ascend over the store, null ids first,
rows of one doc_id by their text. Null texts are empty documents, which still have the end id. Extra columns
go no further; an empty table gives a store without shards. Documents of one shard are bounded by
``SHARD_IDS``, except that one document is never split.
"""

from __future__ import annotations

import struct
import zlib
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tillroll.llm.common import fresh, shared_path, slices
from tillroll.llm.elias_fano import EliasFano, encode as ef_encode
from tillroll.llm.pretokens import Memo

_HEAD = struct.Struct("<4sIQQ")

#: A shard is closed when it holds so many ids.
SHARD_IDS = 2_000_000

SHARD_SCHEMA = "part int, seq int, n_docs long, n_ids long, data binary"


def pack(doc_ids: list, ids: list[bytes], width: int) -> bytes:
    """One shard; ids: the id bytes of each document."""
    n = len(doc_ids)
    ends = np.cumsum([0] + [len(x) // width for x in ids])
    null = np.array([d is None for d in doc_ids], np.uint8)
    numbers = np.array([0 if d is None else d for d in doc_ids], "<i8")
    return _HEAD.pack(b"IDS1", width, n, int(ends[-1])) + null.tobytes() + numbers.tobytes() + ef_encode(ends) + b"".join(ids)


class Shard:
    """A shard's documents, read in place."""

    def __init__(self, data: bytes):
        magic, width, self.n, self.n_ids = _HEAD.unpack_from(data, 0)
        if magic != b"IDS1":
            raise ValueError("not an id shard")
        at = _HEAD.size
        self.null = np.frombuffer(data, np.uint8, self.n, at).astype(bool)
        self.doc_ids = np.frombuffer(data, "<i8", self.n, at + self.n)
        self.bounds = EliasFano(data, at + 9 * self.n)
        self.ids = np.frombuffer(data, f"<u{width}", self.n_ids, self.bounds.end)

    def span(self, i: int) -> tuple[int, int]:
        start, end = self.bounds.select([i, i + 1])
        return int(start), int(end)

    def document(self, i: int) -> np.ndarray:
        start, end = self.span(i)
        return self.ids[start:end]


class LibraryEncoder:
    """The tokenizers library behind a memo of pieces; gives the bytes of a text's ids."""

    def __init__(self, path: str, end_id: int):
        import os

        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        self.tokenizer.no_truncation()
        self.tokenizer.no_padding()
        self.width = 2 if max(self.tokenizer.get_vocab_size(with_added_tokens=True) - 1, end_id) < 1 << 16 else 4
        self.dtype = f"<u{self.width}"
        self.end = np.array([end_id], self.dtype).tobytes()
        self.memo = Memo(self._pieces)

    def _pieces(self, pieces: list[str]) -> list[bytes]:
        found = self.tokenizer.encode_batch_fast(pieces, add_special_tokens=False)
        return [np.array(e.ids, self.dtype).tobytes() for e in found]

    def encode(self, text: str | None) -> bytes:
        return b"".join(self.memo.of(text or "")) + self.end


@lru_cache(maxsize=2)
def library(path: str, end_id: int) -> LibraryEncoder:
    return LibraryEncoder(path, end_id)


def write_store(docs: DataFrame, path: str, tokenizer: str, end_id: int, id_col: str = "doc_id", text_col: str = "text") -> None:
    """Encode every whole text and write the store. Documents are dealt by ranges of doc_id (rows of one hot
    doc_id spread by their text), so each task writes consecutive ones."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        e = library(tokenizer, end_id)
        part, seq = TaskContext.get().partitionId(), 0
        doc_ids, ids, size = [], [], 0

        def shard() -> pa.RecordBatch:
            row = [[part], [seq], [len(doc_ids)], [size // e.width], [pack(doc_ids, ids, e.width)]]
            return pa.RecordBatch.from_arrays(
                [pa.array(v, t) for v, t in zip(row, (pa.int32(), pa.int32(), pa.int64(), pa.int64(), pa.binary()), strict=True)],
                ["part", "seq", "n_docs", "n_ids", "data"])

        for batch in batches:
            for rows in slices(batch, "text"):
                for d, text in zip(rows.column("doc_id").to_pylist(), rows.column("text").to_pylist(), strict=True):
                    doc_ids.append(d)
                    ids.append(e.encode(text))
                    size += len(ids[-1])
                    if size >= SHARD_IDS * e.width:
                        yield shard()
                        doc_ids, ids, size, seq = [], [], 0, seq + 1
        if doc_ids:
            yield shard()

    rows = fresh(docs, doc_id=id_col, text=text_col)
    ordered = rows.repartitionByRange("doc_id", F.xxhash64("text")).sortWithinPartitions("doc_id", "text")
    ordered.mapInArrow(run, SHARD_SCHEMA).write.option("compression", "zstd").parquet(path)


def read_store(spark: SparkSession, path: str) -> DataFrame:
    """(doc_id, start, n_tokens, ids_crc32) of every document of a store, from its bytes.

    Starts: two prefix sums, of the shards of each part, then over the parts (as many as write tasks)."""
    shards = spark.read.schema(SHARD_SCHEMA).parquet(path)
    parts = shards.groupBy("part").agg(F.sum("n_ids").alias("n"))
    before = parts.select("part", F.coalesce(F.sum("n").over(Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)).alias("before"))
    inside = Window.partitionBy("part").orderBy("seq").rowsBetween(Window.unboundedPreceding, -1)
    base = (shards.select("part", "seq", F.coalesce(F.sum("n_ids").over(inside), F.lit(0)).alias("inside"))
            .join(before, "part").select("part", "seq", (F.col("before") + F.col("inside")).alias("base")))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part, seq, data in zip(batch.column("part").to_pylist(), batch.column("seq").to_pylist(), batch.column("data"), strict=True):
                s = Shard(memoryview(data.as_buffer()))
                bounds = s.bounds.select(np.arange(s.n + 1)).astype(np.int64)
                crc = [zlib.crc32(s.ids[a:b].astype("<u4").tobytes()) for a, b in zip(bounds[:-1], bounds[1:], strict=True)]
                yield pa.RecordBatch.from_arrays(
                    [pa.array(np.full(s.n, part, np.int32)), pa.array(np.full(s.n, seq, np.int32)), pa.array(s.doc_ids, pa.int64(), mask=s.null),
                     pa.array(bounds[:-1]), pa.array(np.diff(bounds)), pa.array(crc, pa.int64())],
                    ["part", "seq", "doc_id", "inner", "n_tokens", "ids_crc32"])

    found = shards.select("part", "seq", "data").mapInArrow(run, "part int, seq int, doc_id long, inner long, n_tokens long, ids_crc32 long")
    return found.join(base, ["part", "seq"]).select("doc_id", (F.col("base") + F.col("inner")).alias("start"), "n_tokens", "ids_crc32")


def encode_and_read(docs: DataFrame, tokenizer: str, end_id: int = 2) -> DataFrame:
    """Write a store in the shared folder and return what reading it back gives."""
    path = shared_path(docs.sparkSession, "ids")
    write_store(docs, path, tokenizer, end_id)
    return read_store(docs.sparkSession, path)
