"""Question 2: packaged-beverage brands to drop.

P12 ``matches_any``, A3 ``brand_performance``, P13 HAVING,
O2 ``drop_candidates``, P14 ``below_threshold``, A16 ``brand_kpis``.
"""

from __future__ import annotations

from collections.abc import Iterable

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tillroll.functions.exprs import matches_any, ratio, zero_sum

# Words that mark a beverage category, the default minimum
# transaction count, and the default revenue threshold line.
BEVERAGE_WORDS = ("BEVERAGE", "DRINK")
MIN_TRANSACTIONS = 18
REVENUE_THRESHOLD = 10000


def brand_performance(daily: DataFrame, words: Iterable[str] = BEVERAGE_WORDS,
                      min_transactions: int = MIN_TRANSACTIONS) -> DataFrame:
    """A3: per-brand revenue, units, transactions and two ratios, for rows
    whose category or subcategory contains a word (any case); brands with
    fewer than ``min_transactions`` transactions are dropped (HAVING)."""
    rows = daily.where(
        F.col("CATEGORY").isNotNull() & F.col("BRAND").isNotNull()
        & matches_any(["CATEGORY", "SUBCATEGORY"], words)
    )
    return (
        rows.groupBy("BRAND")
        .agg(
            zero_sum("TOTAL_REVENUE_AMOUNT").alias("revenue"),
            zero_sum("QUANTITY").alias("units"),
            zero_sum("TRANSACTION_COUNT").alias("transactions"),
        )
        .withColumns({
            "rev_per_unit": ratio("revenue", "units"),
            "rev_per_transaction": ratio("revenue", "transactions"),
        })
        .where(F.col("transactions") >= F.lit(min_transactions))
    )


def drop_candidates(perf: DataFrame, k: int = 10, rank_by: str = "revenue") -> DataFrame:
    """O2: the ``k`` weakest brands. Published ranking is by revenue
    (``rank_by="units"`` ranks by units sold); brand name breaks ties."""
    if rank_by not in ("revenue", "units", "transactions"):
        raise ValueError(f"rank_by must be revenue, units or transactions, not {rank_by!r}")
    return perf.orderBy(F.asc(rank_by), F.asc("BRAND")).limit(k)


def below_threshold(perf: DataFrame, threshold: float = REVENUE_THRESHOLD, col: str = "revenue") -> DataFrame:
    """Brands under the threshold line."""
    return perf.where(F.col(col) < F.lit(threshold))


def brand_kpis(perf: DataFrame, threshold: float = REVENUE_THRESHOLD) -> DataFrame:
    """A16 (beverage page): brand count, count below threshold, total revenue,
    mean revenue per brand (0 when there are no brands)."""
    return perf.agg(
        F.count(F.lit(1)).alias("brands"),
        F.count(F.when(F.col("revenue") < F.lit(threshold), F.lit(1))).alias("below"),
        zero_sum("revenue").alias("total"),
        F.coalesce(ratio(F.sum("revenue"), F.count("revenue")), F.lit(0.0)).alias("avg_rev"),
    )
