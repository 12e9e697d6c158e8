"""The presentation edge. Already-aggregated results (a KPI row, a
summary table) cross to the driver whole; large frames (enriched stores, a
chart's points) in ordered batches.
"""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tillroll.session import scratch

#: Rows of a batch.
BATCH_ROWS = 10_000


def to_client(df: DataFrame, order_by: list[str | Column] | None = None):
    """Hand a result to a client as pandas, in display order and with every row."""
    return (df.orderBy(*order_by) if order_by else df).toPandas()


def to_client_batches(df: DataFrame, order_by: list[str | Column] | None = None, rows: int = BATCH_ROWS) -> Iterator[pd.DataFrame]:
    """Every row of a large result as pandas frames of at most ``rows`` rows, in order.

    Tasks pack the sorted rows into batches and write them to the shared folder; the driver fetches one at a time,
    so it holds a batch whatever the result's size or the ties in its order. Timestamps are in the session's zone.
    An empty result gives one frame without rows.
    """
    ordered = df.orderBy(*order_by) if order_by else df

    def pack(incoming: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part, no, held, n = TaskContext.get().partitionId(), 0, [], 0

        def packed(table: pa.Table) -> pa.RecordBatch:
            nonlocal no
            sink = pa.BufferOutputStream()
            with pa.ipc.new_stream(sink, table.schema) as writer:
                writer.write_table(table)
            no += 1
            return pa.RecordBatch.from_arrays([pa.array([part], pa.int32()), pa.array([no], pa.int32()), pa.array([sink.getvalue().to_pybytes()], pa.binary())], ["part", "no", "batch"])

        for b in incoming:
            held.append(b)
            n += b.num_rows
            while n >= rows:
                table = pa.Table.from_batches(held)
                yield packed(table.slice(0, rows))
                held, n = table.slice(rows).to_batches(), n - rows
        if n:
            yield packed(pa.Table.from_batches(held))

    path = scratch(df.sparkSession, "batches")
    ordered.mapInArrow(pack, "part int, no int, batch binary").write.parquet(path)
    kept = df.sparkSession.read.parquet(path)
    index = kept.select("part", "no").orderBy("part", "no").collect()   # two numbers a batch
    if not index:
        yield df.limit(0).toPandas()
    for part, no in index:
        data = kept.where((F.col("part") == part) & (F.col("no") == no)).select("batch").first()[0]
        yield pa.ipc.open_stream(data).read_all().to_pandas()


def scalar(df: DataFrame, default=None):
    """First column of the first row of a one-row result (client side)."""
    row = df.first()
    return default if row is None or row[0] is None else row[0]
