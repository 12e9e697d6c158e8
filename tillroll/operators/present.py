"""Presentation projections: summary-table renames and text formats (P2,
F10-F13, F17). Formatting happens after aggregation, on small results.
"""

from __future__ import annotations

from collections.abc import Iterable, Mapping

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tillroll.functions.exprs import currency, thousands


def present(df: DataFrame, mapping: Mapping[str, str | Column]) -> DataFrame:
    """One projection renaming (and optionally computing) display columns:
    ``{"Revenue": "total_revenue", ...}``."""
    return df.select(*[(F.col(src) if isinstance(src, str) else src).alias(name) for name, src in mapping.items()])


def formatted(df: DataFrame, money: Iterable[str] = (), counts: Iterable[str] = (),
              money_decimals: int = 2, count_decimals: int = 0) -> DataFrame:
    """``$1,234.56`` for money columns, ``1,234`` for counts."""
    conv = {c: currency(c, money_decimals) for c in money}
    conv.update({c: thousands(c, count_decimals) for c in counts})
    return df.withColumns(conv)


def rounded(df: DataFrame, cols: Iterable[str], places: int = 2) -> DataFrame:
    """half-up rounding of display columns (never inside a ranking)."""
    return df.withColumns({c: F.round(F.col(c), places) for c in cols})


def months_subtitle(months: Iterable[int]) -> str:
    """``Months: 1, 2, 3`` for a table subtitle."""
    return "Months: " + ", ".join(str(m) for m in months)


def year_options(daily: DataFrame) -> DataFrame:
    """every year from the first to the last in the data, one per row."""
    return daily.agg(F.min("CALENDAR_YEAR").alias("lo"), F.max("CALENDAR_YEAR").alias("hi")).select(
        F.explode(F.sequence("lo", "hi")).alias("y"))


def with_threshold(df: DataFrame, value: float, name: str = "threshold") -> DataFrame:
    """the user's target line as a constant column of the chart data."""
    return df.withColumn(name, F.lit(value))
