"""The product cube (C2, A1, A2): one kept aggregate that answers the top-products page.

Sums by product at four levels, computed by one ``GROUPING SETS`` over the daily aggregate and written in a folder a
level: product; year and product; month and product; week of a month and product. A question reads the
coarsest level that can tell its period, never lines or days.
"""

from __future__ import annotations

from collections.abc import Iterable
from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tillroll.operators.period import ALL_MONTHS, filter_daily
from tillroll.operators.products import PRODUCT_KEYS
from tillroll.sources.tables import materialize

CALENDAR = ("CALENDAR_YEAR", "CALENDAR_MONTH", "CALENDAR_WEEK")
MEASURES = ("TOTAL_REVENUE_AMOUNT", "QUANTITY", "TRANSACTION_COUNT")

# How many calendar columns each level keeps.
LEVELS = {"product": 0, "year": 1, "month": 2, "week": 3}


def product_cube(daily: DataFrame) -> DataFrame:
    """(LEVEL, calendar columns, product columns, sums); calendar columns that a level doesn't keep are null.

    ``grouping_id`` tells a column that the level leaves out from one that is null in the data.
    """
    sets = [[*CALENDAR[:n], *PRODUCT_KEYS] for n in LEVELS.values()]
    left_out = F.lit(0)
    for c in CALENDAR:
        left_out = left_out + F.grouping(c).cast("int")
    level = F.element_at(F.array(*[F.lit(k) for k in LEVELS]), F.lit(len(CALENDAR) + 1) - left_out)
    return daily.groupingSets(sets, *CALENDAR, *PRODUCT_KEYS).agg(
        *[F.sum(c).alias(c) for c in MEASURES], level.alias("LEVEL"))


def write_cube(daily: DataFrame, path: str) -> None:
    materialize(product_cube(daily), path, partition_by=["LEVEL"])


def read_cube(spark: SparkSession, path: str) -> ProductCube:
    return ProductCube(spark.read.parquet(path))


@dataclass(frozen=True)
class ProductCube:
    """``rows`` of ``product_cube``; its frames stand in for the daily aggregate in ``products``' functions."""

    rows: DataFrame

    def level(self, name: str) -> DataFrame:
        kept = CALENDAR[: LEVELS[name]]
        return self.rows.where(F.col("LEVEL") == name).select(*kept, *PRODUCT_KEYS, *MEASURES)

    def products(self, year: int | None = None, months: Iterable[int] | None = None, everything: bool = False) -> DataFrame:
        """Sums by product (and the calendar columns of the level) over a period; ``everything``: undated days too."""
        if everything:
            return self.level("product")
        if year is not None and (months is None or set(months) == set(ALL_MONTHS)):
            return self.level("year").where(F.col("CALENDAR_YEAR") == F.lit(year))
        return filter_daily(self.level("month"), year, months)

    def weeks(self, year: int | None = None, months: Iterable[int] | None = None, everything: bool = False) -> DataFrame:
        """Sums by product and week (of a month) over a period."""
        weeks = self.level("week")
        return weeks if everything else filter_daily(weeks, year, months)
