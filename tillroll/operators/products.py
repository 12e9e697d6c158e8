"""Question 1: top non-fuel products and their weekly series.

P8 ``exclude``, P10 ``filter_categories``, A14 ``category_list``,
A1 ``product_totals``, O1 ``top_products``, J8+A2 ``weekly_totals``.
"""

from __future__ import annotations

from collections.abc import Iterable

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tillroll.functions.exprs import n_unique, ratio, zero_sum

# The excluded category and the product grouping keys.
FUEL = "FUEL"
PRODUCT_KEYS = ("BRAND", "SKUPOS_DESCRIPTION", "CATEGORY")


def exclude(df: DataFrame, col: str, value) -> DataFrame:
    """``col != value``; a NULL ``col`` is dropped too (three-valued logic)."""
    return df.where(F.col(col) != F.lit(value))


def filter_categories(daily: DataFrame, categories: Iterable[str] | None = None, fuel: str = FUEL) -> DataFrame:
    """P10: non-fuel rows of the chosen categories; empty/None means all non-fuel."""
    out = exclude(daily, "CATEGORY", fuel)
    cats = list(categories or [])
    return out.where(F.col("CATEGORY").isin(cats)) if cats else out


def category_list(daily: DataFrame, fuel: str | None = FUEL) -> DataFrame:
    """Distinct categories in sort order (fuel excluded unless ``fuel`` is None)."""
    df = exclude(daily, "CATEGORY", fuel) if fuel is not None else daily
    return df.select("CATEGORY").distinct().orderBy(F.asc_nulls_first("CATEGORY"))


def category_count(daily: DataFrame) -> DataFrame:
    """The number of categories found (NULL counts as one)."""
    return daily.agg(n_unique("CATEGORY").alias("n_categories"))


def category_head(daily: DataFrame, n: int = 20) -> DataFrame:
    """The first ``n`` categories in sort order (NULL first), as displayed."""
    return daily.select("CATEGORY").distinct().orderBy(F.asc_nulls_first("CATEGORY")).limit(n)


def product_weeks(daily: DataFrame) -> DataFrame:
    """Sums by product and week: small (products x weeks), and enough for the totals, the top k and the weekly
    series, so that one pass over the facts answers them all."""
    return daily.groupBy("CALENDAR_YEAR", "CALENDAR_WEEK", *PRODUCT_KEYS).agg(
        F.sum("TOTAL_REVENUE_AMOUNT").alias("TOTAL_REVENUE_AMOUNT"), F.sum("QUANTITY").alias("QUANTITY"),
        F.sum("TRANSACTION_COUNT").alias("TRANSACTION_COUNT"))


def product_totals(daily: DataFrame) -> DataFrame:
    """A1: revenue, units, transactions per product with non-null keys.

    Sums stay exact decimals; ``avg_price`` is NULL when units are 0.
    """
    keyed = daily.where(
        F.col("BRAND").isNotNull() & F.col("SKUPOS_DESCRIPTION").isNotNull() & F.col("CATEGORY").isNotNull()
    )
    return (
        keyed.groupBy(*PRODUCT_KEYS)
        .agg(
            zero_sum("TOTAL_REVENUE_AMOUNT").alias("total_revenue"),
            zero_sum("QUANTITY").alias("total_units"),
            zero_sum("TRANSACTION_COUNT").alias("total_transactions"),
        )
        .withColumn("avg_price", ratio("total_revenue", "total_units"))
    )


def top_products(totals: DataFrame, k: int = 5, by: str = "total_revenue") -> DataFrame:
    """O1: top ``k`` by ``by`` descending; group keys break ties.

    Planned as ``TakeOrderedAndProject``: each task keeps its own top ``k``,
    so only ``k`` rows per task reach the final merge.
    """
    return totals.orderBy(F.desc(by), *PRODUCT_KEYS).limit(k)


def weekly_totals(daily: DataFrame, products: DataFrame, grain: str = "week",
                  product_col: str = "SKUPOS_DESCRIPTION") -> DataFrame:
    """J8 + A2: weekly revenue/units of the chosen products.

    Rows are matched on the description only and brands are kept apart (a
    description sold under two brands gives two series), as published.
    ``grain="week"`` folds the same week number of different years together
    (published); ``grain="year_week"`` keeps years apart.

    ``products`` is a top-k result, which the planner or AQE sizes.
    """
    keys = {"week": ["CALENDAR_WEEK"], "year_week": ["CALENDAR_YEAR", "CALENDAR_WEEK"]}[grain]
    rows = daily.join(products.select(product_col), product_col, "left_semi").where(F.col("CALENDAR_WEEK").isNotNull())
    return rows.groupBy(*keys, "SKUPOS_DESCRIPTION", "BRAND").agg(
        zero_sum("TOTAL_REVENUE_AMOUNT").alias("weekly_revenue"),
        zero_sum("QUANTITY").alias("weekly_units"),
    )


def weekly_order():
    """O3: display order of the weekly series - week ascending, revenue
    descending with NULL first (the reference's null placement)."""
    return [F.asc("CALENDAR_WEEK"), F.desc_nulls_first("weekly_revenue")]
