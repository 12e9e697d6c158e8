"""The shared period slice (year + month set) over the three fact tables.

P6 ``filter_daily``, P7 ``filter_sets``, J1 ``items_in_period`` and A18
``period_slice``. Empty month list means *no rows* (reference behaviour);
``year=None`` means all years.
"""

from __future__ import annotations

from collections.abc import Iterable
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tillroll.functions.exprs import n_unique, zero_sum

ALL_MONTHS = tuple(range(1, 13))

# The columns that fact tables laid out by period are foldered by (sources.layout).
PERIOD = ("CALENDAR_YEAR", "CALENDAR_MONTH")


def _month_list(months: Iterable[int] | None) -> list[int]:
    ms = list(ALL_MONTHS if months is None else months)
    bad = [m for m in ms if m not in ALL_MONTHS]
    if bad:
        raise ValueError(f"months must be in 1..12, got {bad}")
    return ms


def filter_daily(daily: DataFrame, year: int | None = None, months: Iterable[int] | None = None) -> DataFrame:
    """Calendar-column filter; on a table partitioned by year/month this
    prunes whole partition folders."""
    ms = _month_list(months)
    if not ms:
        return daily.where(F.lit(False))
    cond = F.col("CALENDAR_MONTH").isin(ms)
    if year is not None:
        cond = (F.col("CALENDAR_YEAR") == F.lit(year)) & cond
    return daily.where(cond)


def _ts_lit(df: DataFrame, col: str, text: str) -> Column:
    return F.lit(text).cast(df.schema[col].dataType)


def period_predicate(df: DataFrame, ts_col: str, year: int | None, months: Iterable[int] | None) -> Column:
    """year/month predicate on a timestamp, plus a pushable range.

    ``year(ts) = y`` cannot reach Parquet statistics; the added
    ``ts >= y-01-01 AND ts < (y+1)-01-01`` (same rows) can, so row groups and
    files outside the year are skipped.
    """
    ms = _month_list(months)
    if not ms:
        return F.lit(False)
    cond = F.month(ts_col).isin(ms)
    if year is not None:
        lo, hi = min(ms), max(ms)
        end = f"{year + 1}-01-01" if hi == 12 else f"{year}-{hi + 1:02d}-01"
        cond = (
            (F.col(ts_col) >= _ts_lit(df, ts_col, f"{year}-{lo:02d}-01"))
            & (F.col(ts_col) < _ts_lit(df, ts_col, end))
            & (F.year(ts_col) == F.lit(year))
            & cond
        )
    return cond


def filter_sets(sets: DataFrame, year: int | None = None, months: Iterable[int] | None = None,
                ts_col: str = "DATE_TIME") -> DataFrame:
    """Baskets whose timestamp falls in the period."""
    folders = period_folders(sets, year, months)
    found = sets.where(period_predicate(sets, ts_col, year, months))
    return found if folders is None else found.where(folders)


def period_folders(df: DataFrame, year: int | None = None, months: Iterable[int] | None = None) -> Column | None:
    """The folders of a period, for a table laid out by period; None for any other table."""
    if not set(PERIOD) <= set(df.columns):
        return None
    ms = _month_list(months)
    cond = F.col("CALENDAR_MONTH").isin(ms) if ms else F.lit(False)
    return cond if year is None else cond & (F.col("CALENDAR_YEAR") == F.lit(year))


def lines_in(items: DataFrame, year: int | None = None, months: Iterable[int] | None = None) -> DataFrame:
    """Lines that can belong to baskets of the period, to be joined with them.

    Lines laid out by period are read from the period's folders and the open folder (lines whose basket is
    missing, undated or ambiguous) only; lines of any other table are all returned, since they carry no date.
    """
    folders = period_folders(items, year, months)
    if folders is None:
        return items
    return items.where(folders | F.col("CALENDAR_YEAR").isNull()).drop(*PERIOD)


def items_in_period(items: DataFrame, period_sets: DataFrame) -> DataFrame:
    """Lines of baskets in the period, as a LEFT SEMI join.

    A semi join never multiplies lines and needs no distinct of the basket
    ids; AQE turns it into a broadcast join when the period side is measured
    small, otherwise both sides shuffle once on the basket id.
    """
    return items.join(period_sets.select("TRANSACTION_SET_ID"), "TRANSACTION_SET_ID", "left_semi")


@dataclass(frozen=True)
class Slice:
    """The period-filtered frames every page reads (all lazy)."""

    daily: DataFrame
    sets: DataFrame
    items: DataFrame

    def totals(self) -> DataFrame:
        """One row: total_revenue (0 when empty), total_transactions, unique_stores."""
        return self.sets.agg(
            zero_sum("GRAND_TOTAL_AMOUNT").cast("double").alias("total_revenue"),
            F.count(F.lit(1)).alias("total_transactions"),
            n_unique("STORE_ID").alias("unique_stores"),
        )


def period_slice(tables, year: int | None = None, months: Iterable[int] | None = None) -> Slice:
    """``tables``: daily, sets and items by name. Tables that derive the daily aggregate (``daily_in``) restrict
    its baskets first."""
    ms = None if months is None else list(months)
    fs = filter_sets(tables["sets"], year, ms)
    daily = tables.daily_in(year, ms) if hasattr(tables, "daily_in") else filter_daily(tables["daily"], year, ms)
    return Slice(daily=daily, sets=fs, items=items_in_period(lines_in(tables["items"], year, ms), fs))
