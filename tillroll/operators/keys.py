"""Lists of what was sold: keys only, no sums.

Which categories, years, months and stores occur in the daily aggregate follows from keys alone. Where the
aggregate is not materialised, it is not computed for that: lines give their distinct GTINs (two columns
read, pre-aggregated before the shuffle), baskets are kept by a semi join on the lines' basket ids, and only these
few keys meet the product master. On tables laid out by period, lines in a month's folder are known to have a
basket there, so not even that join is left but for the open folder.
"""

from __future__ import annotations

from collections.abc import Iterable, Mapping

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tillroll.operators.period import PERIOD, filter_daily, filter_sets, period_folders

Period = tuple[int | None, Iterable[int] | None]


def given_daily(tables: Mapping[str, DataFrame]) -> DataFrame | None:
    """The daily aggregate, if the tables hold a materialised one."""
    return tables["daily"] if "daily" in tables and not getattr(tables, "derived", False) else None


def _baskets(sets: DataFrame, period: Period | None) -> DataFrame:
    return sets if period is None else filter_sets(sets, *period)


def sold_gtins(items: DataFrame, sets: DataFrame, period: Period | None = None) -> DataFrame:
    """The distinct GTINs of lines with a basket (of the period)."""
    ids = _baskets(sets, period).select("TRANSACTION_SET_ID")
    if not set(PERIOD) <= set(items.columns):
        return items.select("TRANSACTION_SET_ID", "GTIN").join(ids, "TRANSACTION_SET_ID", "left_semi").select("GTIN").distinct()
    dated = items.where(F.col("CALENDAR_YEAR").isNotNull())
    dated = dated if period is None else dated.where(period_folders(items, *period))
    loose = items.where(F.col("CALENDAR_YEAR").isNull()).select("TRANSACTION_SET_ID", "GTIN").join(ids, "TRANSACTION_SET_ID", "left_semi")
    return dated.select("GTIN").unionByName(loose.select("GTIN")).distinct()


def sold_baskets(items: DataFrame, sets: DataFrame, period: Period | None = None) -> DataFrame:
    """Baskets (of the period) that have a line."""
    lines = items
    if period is not None and (folders := period_folders(items, *period)) is not None:
        lines = items.where(folders | F.col("CALENDAR_YEAR").isNull())
    return _baskets(sets, period).join(lines.select("TRANSACTION_SET_ID"), "TRANSACTION_SET_ID", "left_semi")


def categories(tables: Mapping[str, DataFrame], period: Period | None = None) -> DataFrame:
    """The distinct categories sold (NULL: unknown GTINs or products without one), unordered."""
    daily = given_daily(tables)
    if daily is not None:
        return (daily if period is None else filter_daily(daily, *period)).select("CATEGORY").distinct()
    sold = sold_gtins(tables["items"], tables["sets"], period)
    return sold.join(tables["gtin"].select("GTIN", "CATEGORY"), "GTIN", "left").select("CATEGORY").distinct()


def periods(tables: Mapping[str, DataFrame]) -> DataFrame:
    """The distinct (CALENDAR_YEAR, CALENDAR_MONTH) with sales."""
    daily = given_daily(tables)
    if daily is not None:
        return daily.select(*PERIOD).distinct()
    items, sets = tables["items"], tables["sets"]
    calendar = (F.year("DATE_TIME").alias("CALENDAR_YEAR"), F.month("DATE_TIME").alias("CALENDAR_MONTH"))
    if not set(PERIOD) <= set(items.columns):
        return sold_baskets(items, sets).select(*calendar).distinct()
    loose = sets.join(items.where(F.col("CALENDAR_YEAR").isNull()).select("TRANSACTION_SET_ID"), "TRANSACTION_SET_ID", "left_semi")
    return items.where(F.col("CALENDAR_YEAR").isNotNull()).select(*PERIOD).unionByName(loose.select(*calendar)).distinct()


def active_stores(tables: Mapping[str, DataFrame], period: Period | None = None) -> DataFrame:
    """The distinct ids of stores with sales (in the period)."""
    daily = given_daily(tables)
    if daily is not None:
        return (daily if period is None else filter_daily(daily, *period)).select("STORE_ID").distinct()
    return sold_baskets(tables["items"], tables["sets"], period).select("STORE_ID").distinct()
