"""Headline numbers and table profiles.

One-row results that combine several tables are built with scalar
subqueries (``DataFrame.scalar()``), never with a cross join: each table is
aggregated on its own (partial aggregation, one tiny final task) and the
single values are placed side by side.
"""

from __future__ import annotations

from collections.abc import Iterable

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tillroll.functions.exprs import approx_n_unique, n_unique, ratio, zero_sum


def one_row(first: DataFrame, **others: DataFrame) -> DataFrame:
    """Put one-row, one-column aggregates next to the columns of ``first``."""
    return first.select("*", *[df.scalar().alias(name) for name, df in others.items()])


def year_bounds(daily: DataFrame) -> DataFrame:
    """First and last calendar year in the data."""
    return daily.agg(F.min("CALENDAR_YEAR").alias("min_year"), F.max("CALENDAR_YEAR").alias("max_year"))


def store_activity(stores: DataFrame, daily: DataFrame, period_daily: DataFrame) -> DataFrame:
    """Stores in the master table, stores with any sales, stores with
    sales in the period (distinct counts count NULL as a value)."""
    return one_row(
        stores.agg(F.count(F.lit(1)).alias("master")),
        active_ever=daily.agg(n_unique("STORE_ID")),
        active_in_period=period_daily.agg(n_unique("STORE_ID")),
    )


def home_kpis(stores: DataFrame, gtin: DataFrame, slice_, daily: DataFrame | None = None, period_stores: DataFrame | None = None) -> DataFrame:
    """A16 (home page): store counts, product count, period revenue and
    transactions (from baskets). With ``daily`` the row also carries
    ``active_ever`` (stores with sales in any period), so the home page's
    store-count panel (A17) needs no second frame. ``period_stores``: the
    period's store ids (``keys.active_stores``) instead of its daily rows."""
    # Both basket numbers come from one scan: a struct-valued subquery.
    baskets = slice_.sets.agg(F.struct(
        zero_sum("GRAND_TOTAL_AMOUNT").cast("double").alias("revenue"),
        F.count(F.lit(1)).alias("transactions"),
    ))
    extra = {"active_ever": daily.agg(n_unique("STORE_ID"))} if daily is not None else {}
    row = one_row(
        stores.agg(F.count(F.lit(1)).alias("total_stores")),
        active_stores=(slice_.daily if period_stores is None else period_stores).agg(n_unique("STORE_ID")),
        total_products=gtin.agg(F.count(F.lit(1))),
        _baskets=baskets,
        **extra,
    )
    return row.select(
        "total_stores", *extra, "active_stores", "total_products",
        F.col("_baskets.revenue").alias("total_revenue"),
        F.col("_baskets.transactions").alias("total_transactions"),
    )


def table_profile(spec: Iterable[tuple[str, DataFrame, str]], approx: bool = False) -> DataFrame:
    """A12 + A11 (C6): per (table, column) - row count and distinct values
    (NULL counted as a value). One aggregate per table, stacked.

    ``approx=True`` counts distinct values with HyperLogLog (bounded memory,
    ~2% error) for very high-cardinality columns on huge tables.
    """
    distinct = approx_n_unique if approx else n_unique
    tables: dict[str, tuple[DataFrame, list[str]]] = {}
    for name, df, col in spec:
        tables.setdefault(name, (df, []))[1].append(col)
    parts = []
    for name, (df, cols) in tables.items():
        row = df.agg(F.count(F.lit(1)).alias("n_rows"), *[distinct(c).alias(f"_{i}") for i, c in enumerate(cols)])
        pairs = F.array(*[F.struct(F.lit(c).alias("column_name"), F.col(f"_{i}").alias("n_distinct")) for i, c in enumerate(cols)])
        parts.append(row.select(F.lit(name).alias("table_name"), "n_rows", F.explode(pairs).alias("_p")).select(
            "table_name", "_p.column_name", "n_rows", "_p.n_distinct"))
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    return out


def row_counts(tables: Iterable[tuple[str, DataFrame]]) -> DataFrame:
    """Rows of each table; no column is read."""
    parts = [df.agg(F.count(F.lit(1)).alias("n_rows")).select(F.lit(name).alias("table_name"), "n_rows") for name, df in tables]
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    return out


def key_profile(df: DataFrame, key: str) -> DataFrame:
    """T12 check: rows, distinct keys and duplicate rows of a dimension's key
    (duplicates multiply fact rows in a left join)."""
    return df.agg(
        F.count(F.lit(1)).alias("n_rows"), F.count_distinct(key).alias("n_keys"),
    ).withColumn("duplicates", F.col("n_rows") - F.col("n_keys"))


def top_products_kpis(top: DataFrame, weekly: DataFrame) -> DataFrame:
    """A16 (top products page): revenue and units of the top products, mean
    weekly revenue over the weekly series, number of distinct weeks."""
    return one_row(
        top.agg(zero_sum("total_revenue").cast("double").alias("total_revenue"),
                zero_sum("total_units").cast("double").alias("total_units")),
        avg_weekly_revenue=weekly.agg(ratio(F.sum("weekly_revenue"), F.count("weekly_revenue"))),
        n_weeks=weekly.agg(n_unique("CALENDAR_WEEK")),
    )
