"""Distinct counts over any period from mergeable sketches.

Exact distinct counts don't add up over days, so each new period reads the facts again. One HyperLogLog sketch
a day and key does: a period's count is the estimate of the union of its days' sketches, a few kilobytes each.
The relative standard error is about 1.04 / sqrt(2 ** lg_k) (1.6 % at 12), small counts are exact. NULL counts as one value,
as in ``n_unique``, by a flag next to each sketch.
"""

from __future__ import annotations

from collections.abc import Iterable

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tillroll.operators.period import filter_daily

LG_K = 12
KEYS = ("STORE_ID", "TRANSACTION_SET_ID", "GTIN")


def standard_error(lg_k: int = LG_K) -> float:
    """Relative standard error of an estimate."""
    return 1.04 / 2 ** (lg_k / 2)


def daily_sketches(items: DataFrame, sets: DataFrame, keys: Iterable[str] = KEYS, lg_k: int = LG_K) -> DataFrame:
    """One row a day with sales: for each key (of baskets with a line, or of their lines) a sketch and whether NULL occurs.

    Sketches are made map-side; a day's shuffle is a sketch a task, however many rows it has.
    """
    keys = list(keys)
    baskets = sets.select("TRANSACTION_SET_ID", "STORE_ID", F.year("DATE_TIME").alias("CALENDAR_YEAR"), F.month("DATE_TIME").alias("CALENDAR_MONTH"), F.to_date("DATE_TIME").alias("CALENDAR_DATE"))
    sold = items.select("TRANSACTION_SET_ID", "GTIN").join(baskets, "TRANSACTION_SET_ID")
    parts = []
    for k in keys:
        parts += [F.hll_sketch_agg(F.col(k), F.lit(lg_k)).alias(f"{k}_SKETCH"), F.max(F.col(k).isNull()).alias(f"{k}_NULL")]
    return sold.groupBy("CALENDAR_YEAR", "CALENDAR_MONTH", "CALENDAR_DATE").agg(*parts)


def distinct_over(sketches: DataFrame, year: int | None = None, months: Iterable[int] | None = None, keys: Iterable[str] = KEYS) -> DataFrame:
    """(key, estimate) of a period; 0 where there are no days."""
    parts = [F.struct(F.lit(k).alias("key"), (
        F.coalesce(F.hll_sketch_estimate(F.hll_union_agg(f"{k}_SKETCH")), F.lit(0)) + F.coalesce(F.max(F.col(f"{k}_NULL").cast("int")), F.lit(0))
    ).cast("long").alias("estimate")) for k in keys]
    return filter_daily(sketches, year, months).agg(F.array(*parts).alias("p")).select(F.inline("p"))
