"""SparkSession construction and the shared checkpoint folder.

The library never sets cluster-wide knobs behind the user's back: on a
cluster the session comes from the launcher and we only *read* settings such
as ``spark.checkpoint.dir``. ``local_session`` is for tests and the bench.
"""

from __future__ import annotations

import os
import tempfile
import uuid
from collections.abc import Iterator
from contextlib import contextmanager

from pyspark.sql import DataFrame, SparkSession

# Settings every query here relies on (read by the operators, not forced on
# a cluster session): UTC session zone so calendar functions are stable,
# ANSI on, AQE on for runtime coalescing, skew-join splitting and broadcast
# conversion of joins whose *measured* side is small.
SESSION_DEFAULTS = {
    "spark.sql.session.timeZone": "UTC",
    "spark.sql.ansi.enabled": "true",
    "spark.sql.adaptive.enabled": "true",
    "spark.sql.adaptive.coalescePartitions.enabled": "true",
    "spark.sql.adaptive.skewJoin.enabled": "true",
    # Per-basket aggregates reuse the basket join's partitioning. When one
    # basket id is hot (e.g. a sentinel id on a third of the lines) AQE may
    # only split that join partition if it can add the shuffle the aggregate
    # then needs; partial aggregation runs before that shuffle.
    "spark.sql.adaptive.forceOptimizeSkewedJoin": "true",
    "spark.sql.execution.arrow.pyspark.enabled": "true",
    "spark.ui.enabled": "false",
    "spark.ui.showConsoleProgress": "false",
}


def local_session(cores: int | str = "*", shuffle_partitions: int | None = None,
                  app_name: str = "tillroll", extra: dict | None = None) -> SparkSession:
    """A local-mode session for tests / bench (single JVM, ``cores`` threads)."""
    builder = SparkSession.builder.master(f"local[{cores}]").appName(app_name)
    conf = dict(SESSION_DEFAULTS)
    n = shuffle_partitions or (os.cpu_count() if cores == "*" else int(cores))
    conf["spark.sql.shuffle.partitions"] = str(n)
    conf.setdefault("spark.driver.memory", "8g")
    if extra:
        conf.update(extra)
    for k, v in conf.items():
        builder = builder.config(k, v)
    spark = builder.getOrCreate()
    spark.sparkContext.setLogLevel("ERROR")
    return spark


def ensure_checkpoint_dir(spark: SparkSession, fallback: str | None = None) -> str:
    """Return the shared checkpoint folder, setting one only when none is set.

    On a cluster ``spark.checkpoint.dir`` names a shared (HDFS/object store)
    folder and is used as is. Only an unset value (tests) gets ``fallback``.
    """
    sc = spark.sparkContext
    current = sc.getCheckpointDir() or spark.conf.get("spark.checkpoint.dir", None)
    if current:
        if not sc.getCheckpointDir():
            sc.setCheckpointDir(current)
        return current
    if fallback is None:
        raise RuntimeError("spark.checkpoint.dir is not set; pass a shared folder")
    sc.setCheckpointDir(fallback)
    return fallback


def scratch(spark: SparkSession, tag: str) -> str:
    """A fresh folder under the shared checkpoint folder; a local one only where none is set and the session is local."""
    if spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir():
        root = ensure_checkpoint_dir(spark)
    elif spark.sparkContext.master.startswith("local["):
        root = ensure_checkpoint_dir(spark, tempfile.mkdtemp(prefix="tillroll-"))
    else:
        raise RuntimeError("spark.checkpoint.dir is not set; name a folder that all executors share")
    return f"{root.rstrip('/')}/{tag}-{uuid.uuid4().hex[:12]}"


@contextmanager
def shuffles_dropped(spark: SparkSession) -> Iterator[None]:
    """Inside, an action's shuffle files go with its end; else they stay until the driver collects its garbage."""
    key = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"
    old = spark.conf.get(key)
    spark.conf.set(key, "true")
    try:
        yield
    finally:
        spark.conf.set(key, old)


def cluster_conf(input_bytes: int, target_partition_bytes: int = 256 << 20) -> dict[str, str]:
    """Suggested submit-time settings for an input of ``input_bytes``.

    Shuffles start with enough partitions for ~``target_partition_bytes``
    each and AQE coalesces them at run time, so one setting serves small
    slices and the full history. Pass the result to ``spark-submit --conf``.
    """
    initial = max(200, int(input_bytes // target_partition_bytes))
    return {
        **{k: v for k, v in SESSION_DEFAULTS.items() if k != "spark.ui.showConsoleProgress"},
        "spark.sql.shuffle.partitions": str(initial),
        "spark.sql.adaptive.coalescePartitions.initialPartitionNum": str(initial),
        "spark.sql.adaptive.advisoryPartitionSizeInBytes": str(target_partition_bytes // 2),
        "spark.sql.files.maxPartitionBytes": str(256 << 20),
        "spark.sql.adaptive.skewJoin.skewedPartitionThresholdInBytes": str(target_partition_bytes * 4),
    }


def cut_lineage(df: DataFrame) -> DataFrame:
    """Reliable checkpoint into the shared checkpoint folder (never local)."""
    ensure_checkpoint_dir(df.sparkSession)
    return df.checkpoint(eager=True)
