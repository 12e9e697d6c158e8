"""Supporting job: the day x store x product aggregate (``daily``).

The dashboard receives ``daily`` already aggregated; this builds it from the
basket and line tables. Plan shape:

1. lines INNER JOIN baskets on TRANSACTION_SET_ID - one shuffle of both
   sides; a period filter on the baskets reaches their scan and restricts
   the lines before any product work. A hot basket is split by AQE's skew
   join;
2. LEFT JOIN products on GTIN (AQE broadcasts a product master that it has
   measured small);
3. aggregate per (basket, product attributes), so each basket counts once per
   product group. The rows are dealt by basket and description, so a hot basket
   is spread, into parts sized by the line table's files: a task's hash tables
   hold a few hundred thousand rows whatever the size of the input, where AQE
   would merge parts by their compressed bytes, millions of rows each;
4. aggregate to the daily grain with partial (map-side) aggregation, so a hot
   product or store is pre-reduced before the only remaining shuffle.

``count(DISTINCT basket)`` therefore becomes ``count(*)`` of step 3 rows.
Amounts keep the input's own scale (``functions.exprs.exact``).
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tillroll.functions.exprs import exact
from tillroll.sources.tables import parts_for

PRODUCT_ATTRS = ("CATEGORY", "SUBCATEGORY", "BRAND", "SKUPOS_DESCRIPTION")
DAILY_KEYS = ("CALENDAR_YEAR", "CALENDAR_MONTH", "CALENDAR_WEEK", "CALENDAR_DATE", "STORE_ID") + PRODUCT_ATTRS


def daily_rollup(items: DataFrame, sets: DataFrame, gtin: DataFrame) -> DataFrame:
    qty, qty_back = exact(items, "UNIT_QUANTITY")
    amount, amount_back = exact(items, "GRAND_TOTAL_AMOUNT")
    lines = items.select("TRANSACTION_SET_ID", "GTIN", qty.alias("_qty"), amount.alias("_amount"))
    baskets = sets.select(
        "TRANSACTION_SET_ID", "STORE_ID",
        F.year("DATE_TIME").alias("CALENDAR_YEAR"),
        F.month("DATE_TIME").alias("CALENDAR_MONTH"),
        F.weekofyear("DATE_TIME").alias("CALENDAR_WEEK"),
        F.to_date("DATE_TIME").alias("CALENDAR_DATE"),
    )
    sums = (F.sum("_amount").alias("_amount"), F.sum("_qty").alias("_qty"))
    products = gtin.select("GTIN", *PRODUCT_ATTRS)
    sold = lines.join(baskets, "TRANSACTION_SET_ID", "inner").join(products, "GTIN", "left").drop("GTIN")
    dealt = sold.repartition(parts_for(items), "TRANSACTION_SET_ID", "SKUPOS_DESCRIPTION")
    per_basket = dealt.groupBy("TRANSACTION_SET_ID", *DAILY_KEYS).agg(*sums)
    return per_basket.groupBy(*DAILY_KEYS).agg(
        amount_back(F.sum("_amount")).alias("TOTAL_REVENUE_AMOUNT"),
        qty_back(F.sum("_qty")).alias("QUANTITY"),
        F.count(F.lit(1)).alias("TRANSACTION_COUNT"),
    )
