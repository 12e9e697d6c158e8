"""Shared helpers: reading tables, landing intermediates, word splitting."""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Iterator
from contextlib import contextmanager
from itertools import chain

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: A word is a run of anything but these ASCII white-space bytes (``bytes.split``'s own set).
WORD = r"[^\x20\x09-\x0D]+"

U64 = np.uint64


def read(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def shared_path(spark: SparkSession, tag: str) -> str:
    """A fresh folder under ``spark.checkpoint.dir``; only where that is unset (tests) a local one is set."""
    sc = spark.sparkContext
    root = spark.conf.get("spark.checkpoint.dir", None) or sc.getCheckpointDir()
    if not root:
        if not sc.master.startswith("local"):
            raise RuntimeError("spark.checkpoint.dir is not set; name a folder that all executors share")
        root = tempfile.mkdtemp(prefix="tillroll-")
        sc.setCheckpointDir(root)
    return f"{root.rstrip('/')}/llm-{tag}-{uuid.uuid4().hex[:12]}"


def land(df: DataFrame, tag: str, codec: str = "zstd") -> DataFrame:
    """Write ``df`` to the shared folder and read it back: cuts the lineage and survives lost executors. The write's
    own shuffle files go with its end, as nothing can ask for them again."""
    spark = df.sparkSession
    path = shared_path(spark, tag)
    with setting(spark, "spark.sql.classic.shuffleDependency.fileCleanup.enabled", "true"):
        df.write.option("compression", codec).parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def discard(*landed: DataFrame) -> None:
    """Delete landed tables that nothing reads any more."""
    for df in landed:
        jvm = df.sparkSession._jvm
        for folder in {f.rsplit("/", 1)[0] for f in df.inputFiles()}:
            path = jvm.org.apache.hadoop.fs.Path(folder)
            path.getFileSystem(df.sparkSession._jsparkSession.sessionState().newHadoopConf()).delete(path, True)


@contextmanager
def setting(spark: SparkSession, key: str, value: str) -> Iterator[None]:
    """A session setting while an action runs inside."""
    old = spark.conf.get(key)
    spark.conf.set(key, value)
    try:
        yield
    finally:
        spark.conf.set(key, old)


def small_batches(spark: SparkSession, rows: int):
    """For rows that hold texts: while an action runs inside, Python workers get at most so many rows at once."""
    key = "spark.sql.execution.arrow.maxRecordsPerBatch"
    old = int(spark.conf.get(key))
    return setting(spark, key, str(min(rows, old) if old > 0 else rows))


def partitions(spark: SparkSession) -> int:
    return int(spark.conf.get("spark.sql.shuffle.partitions", "200"))


def shards_for(df: DataFrame, bytes_each: int) -> int:
    """How many groups keep each bounded: by the size of the files that ``df`` reads, one a shuffle partition at least."""
    leaves = df._jdf.queryExecution().optimizedPlan().collectLeaves()
    size = sum(int(str(leaves.apply(i).stats().sizeInBytes())) for i in range(leaves.size()))
    known = size if size < 1 << 55 else 0   # without figures Spark assumes the largest
    return max(partitions(df.sparkSession), -(-known // bytes_each), 1)


def mix64(x: np.ndarray) -> np.ndarray:
    """The finaliser of splitmix64 on unsigned 64-bit integers (wraps)."""
    x = np.asarray(x, dtype=U64)
    with np.errstate(over="ignore"):
        x = (x ^ (x >> U64(30))) * U64(0xBF58476D1CE4E5B9)
        x = (x ^ (x >> U64(27))) * U64(0x94D049BB133111EB)
        return x ^ (x >> U64(31))


def words_of(texts: pa.Array) -> tuple[np.ndarray, np.ndarray, pa.Array]:
    """Words of many texts at once, A-Z lower-cased.

    Returns (bounds, codes, dictionary): text i has the words ``codes[bounds[i]:bounds[i + 1]]``, numbers
    into ``dictionary`` (binary). A null text has no words.
    """
    raw = pc.fill_null(texts, "").cast(pa.binary())
    counts, parts = [np.zeros(1, np.int64)], [pa.array([], pa.large_binary())]
    for at in range(0, len(raw), 256):   # few words are Python objects at once
        words = [t.lower().split() for t in raw.slice(at, 256).to_pylist()]   # bytes: ASCII only
        counts.append(np.fromiter(map(len, words), np.int64, count=len(words)))
        parts.append(pa.array(list(chain.from_iterable(words)), pa.large_binary()))
    bounds = np.cumsum(np.concatenate(counts))
    enc = pa.concat_arrays(parts).dictionary_encode()
    return bounds, enc.indices.to_numpy(zero_copy_only=False).astype(np.int64), enc.dictionary


def hash_words(dictionary: pa.Array) -> np.ndarray:
    """64-bit hashes of the distinct words."""
    import xxhash

    h = xxhash.xxh3_64_intdigest
    return np.fromiter((h(w) for w in dictionary.to_pylist()), dtype=U64, count=len(dictionary))


_ODD = U64(0x9E3779B97F4A7C15)


def shingle_hashes(bounds: np.ndarray, hashes: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of the k-word shingles of many texts, in text order.

    ``hashes``: the word hashes in text order. Returns (bounds, shingles). A text of one to k - 1 words has
    one shingle, its whole sequence; a text without words has none.
    """
    n = np.diff(bounds)
    total = len(hashes)
    rolled = np.zeros(total, dtype=U64)
    with np.errstate(over="ignore"):
        mixed = mix64(hashes + U64(1))
        for j in range(min(k, total)):
            rolled[: total - j] *= _ODD
            rolled[: total - j] += mixed[j:]
    rolled = mix64(rolled ^ U64(k))
    count = np.where(n >= k, n - k + 1, 0)
    short = np.flatnonzero((n > 0) & (n < k))
    out_n = count.copy()
    out_n[short] = 1
    out_bounds = np.concatenate([[0], np.cumsum(out_n)]).astype(np.int64)
    starts = np.repeat(bounds[:-1] - out_bounds[:-1], out_n) + np.arange(out_bounds[-1])
    out = rolled[starts]
    with np.errstate(over="ignore"):
        for i in short:
            h = U64(int(n[i]))
            for w in hashes[bounds[i]:bounds[i + 1]]:
                h = mix64(h * _ODD + w)
            out[out_bounds[i]] = h
    return out_bounds, out


def slices(batch: pa.RecordBatch, column: str, limit: int = 8 << 20):
    """Slices of the batch whose texts hold about ``limit`` bytes each (one row at least)."""
    sizes = pc.fill_null(pc.binary_length(batch.column(column)), 0).to_numpy(zero_copy_only=False)
    ends = np.cumsum(sizes)
    at = 0
    while at < len(sizes):
        done = ends[at - 1] if at else 0
        to = max(at + 1, int(np.searchsorted(ends, done + limit, side="right")))
        yield batch.slice(at, to - at)
        at = to


def signed(x: np.ndarray) -> np.ndarray:
    return x.astype(U64, copy=False).view(np.int64)


def fresh(df: DataFrame, **columns: str) -> DataFrame:
    """Only the named columns under new names: extra columns, whatever their names, go no further."""
    return df.select(*[F.col(f"`{old}`").alias(new) for new, old in columns.items()])


def squeeze(a: np.ndarray) -> bytes:
    """Bytes of an integer array, plane by plane (first all lowest bytes, ...), compressed."""
    import zstandard

    a = np.ascontiguousarray(a)
    planes = a.view(np.uint8).reshape(len(a), a.itemsize).T if len(a) else np.zeros((0,), np.uint8)
    return zstandard.ZstdCompressor(level=1).compress(np.ascontiguousarray(planes).tobytes())


def unsqueeze(data, dtype) -> np.ndarray:
    import zstandard

    raw = np.frombuffer(zstandard.ZstdDecompressor().decompress(data), np.uint8)
    size = np.dtype(dtype).itemsize
    return np.ascontiguousarray(raw.reshape(size, -1).T).reshape(-1).view(dtype)


def squeeze_sorted(a: np.ndarray) -> bytes:
    """For sorted unsigned 64-bit integers: their differences."""
    return squeeze(np.diff(a.astype(U64, copy=False), prepend=U64(0)))


def unsqueeze_sorted(data) -> np.ndarray:
    return np.cumsum(unsqueeze(data, U64), dtype=U64)


def components(edges: DataFrame, tag: str) -> DataFrame:
    """(node, component) of every node on an edge (a, b: long); component: the smallest node reachable.

    Each round every node hooks onto its smallest neighbour, paths are halved, and the edges between the
    roots that remain go on; the edges shrink by a factor each round. All tables stay distributed; each
    round's are landed in the shared folder.
    """
    def distinct(e: DataFrame) -> DataFrame:
        return e.where("a <> b").select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct()

    e = land(distinct(edges), f"{tag}-edges")
    mapping = None
    while not e.isEmpty():
        both = e.unionByName(e.select(F.col("b").alias("a"), F.col("a").alias("b")))
        p = both.groupBy("a").agg(F.min("b").alias("b")).select(F.col("a").alias("node"), F.least("a", "b").alias("root"))
        up = p.select(F.col("node").alias("root"), F.col("root").alias("above"))
        p = land(p.join(up, "root").select("node", F.col("above").alias("root")), f"{tag}-roots")
        root_a = p.select(F.col("node").alias("a"), F.col("root").alias("ra"))
        root_b = p.select(F.col("node").alias("b"), F.col("root").alias("rb"))
        e = land(distinct(e.join(root_a, "a").join(root_b, "b").select(F.col("ra").alias("a"), F.col("rb").alias("b"))), f"{tag}-edges")
        if mapping is None:
            mapping = p
        else:
            on = p.select(F.col("node").alias("root"), F.col("root").alias("above"))
            mapping = land(mapping.join(on, "root", "left").select("node", F.coalesce("above", "root").alias("root")), f"{tag}-map")
    if mapping is None:
        return e.select(F.col("a").alias("node"), F.col("b").alias("component"))
    return mapping.select("node", F.col("root").alias("component"))
