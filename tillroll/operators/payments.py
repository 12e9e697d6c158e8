"""Question 3: cash vs credit vs debit customers.

J2/J3 ``payment_lines``, A4 ``payment_summary``, A5 ``product_by_payment``,
``payment_cube`` (both in one pass), W1 ``top_n_per_group``, A10 ``mean_of_group_means``.

Scale notes. There are only three payment types, so grouping lines straight
by type would send every line of a type through one reducer. The chosen
baskets join their lines first and are reduced to one row per basket and
GTIN inside the join's partitions. The summary needs no product attribute:
only how often a GTIN occurs in the product master (a duplicate multiplies
its lines, as published), then one row per basket. Product attributes are
joined to the reduced rows, for A5 alone.
"""

from __future__ import annotations

from collections.abc import Callable, Iterable, Sequence
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tillroll.functions.exprs import exact, ratio
from tillroll.operators.present import formatted, present, rounded

# The payment types compared, and the default selection.
PAYMENT_TYPES = ("CASH", "CREDIT", "DEBIT")
DEFAULT_SELECTION = ("CASH", "CREDIT")

AMOUNT_BASES = ("basket_per_line", "basket", "line")


MEASURES = ("set_amount_lines", "n_set_amount", "line_amount", "n_line_amount", "units")


@dataclass(frozen=True)
class PaymentLines:
    """The lines of the chosen baskets, reduced to one row per basket and GTIN, and the product master.

    ``baskets`` columns: TRANSACTION_SET_ID, PAYMENT_TYPE, GTIN, ``set_amount_lines`` (basket total x its
    lines), ``n_set_amount``, ``basket_amount`` (once), ``line_amount``, ``n_line_amount``, ``units``; amounts
    in whole units of the input's scale, which ``set_back``, ``line_back`` and ``units_back`` undo.
    """

    baskets: DataFrame
    gtin: DataFrame
    set_back: Callable[[Column], Column]
    line_back: Callable[[Column], Column]
    units_back: Callable[[Column], Column]


def payment_lines(sets: DataFrame, items: DataFrame, gtin: DataFrame, types: Iterable[str] = PAYMENT_TYPES) -> PaymentLines:
    """Baskets of the chosen types (always of ``PAYMENT_TYPES``) joined with all their lines."""
    chosen = [t for t in types if t in PAYMENT_TYPES]
    set_c, set_back = exact(sets, "GRAND_TOTAL_AMOUNT")
    line_c, line_back = exact(items, "GRAND_TOTAL_AMOUNT")
    unit_c, units_back = exact(items, "UNIT_QUANTITY")
    baskets = sets.where(F.col("PAYMENT_TYPE").isin(chosen)).select("TRANSACTION_SET_ID", "PAYMENT_TYPE", set_c.alias("_set"))
    lines = items.select("TRANSACTION_SET_ID", "GTIN", line_c.alias("_line"), unit_c.alias("_units"))
    reduced = lines.join(baskets, "TRANSACTION_SET_ID", "inner").groupBy("TRANSACTION_SET_ID", "PAYMENT_TYPE", "GTIN").agg(
        F.sum("_set").alias("set_amount_lines"), F.count("_set").alias("n_set_amount"), F.max("_set").alias("basket_amount"),
        F.sum("_line").alias("line_amount"), F.count("_line").alias("n_line_amount"), F.sum("_units").alias("units"),
    )
    return PaymentLines(reduced, gtin, set_back, line_back, units_back)


def basket_totals(lines: PaymentLines) -> DataFrame:
    """One row per basket: its measures, each line once for every product row that its GTIN matches (an unknown
    GTIN counts once). Only GTINs that occur more than once are joined."""
    times = lines.gtin.where(F.col("GTIN").isNotNull()).groupBy("GTIN").agg(F.count(F.lit(1)).cast("int").alias("_times")).where("_times > 1")
    n = F.coalesce("_times", F.lit(1))
    matched = lines.baskets.join(times, "GTIN", "left")
    return matched.groupBy("TRANSACTION_SET_ID", "PAYMENT_TYPE").agg(
        *[F.sum(F.col(c) * n).alias(c) for c in MEASURES], F.max("basket_amount").alias("basket_amount"))


def basket_products(lines: PaymentLines) -> DataFrame:
    """One row per basket and product (description, category), known category only."""
    products = lines.gtin.where(F.col("CATEGORY").isNotNull()).select("GTIN", "CATEGORY", "SKUPOS_DESCRIPTION")
    joined = lines.baskets.join(products, "GTIN", "inner")
    return joined.groupBy("TRANSACTION_SET_ID", "PAYMENT_TYPE", "SKUPOS_DESCRIPTION", "CATEGORY").agg(F.sum("set_amount_lines").alias("set_amount_lines"))


def payment_cube(lines: PaymentLines) -> DataFrame:
    """Both levels that a comparison of payment types needs, from one pass over the lines: per type, and per type and
    product of a known category.

    Each line meets its products once; one ``GROUPING SETS`` makes rows per basket and per basket and product, a
    second aggregation adds them up. ``PER_PRODUCT`` tells the levels apart; ``n_baskets`` counts distinct baskets.
    """
    products = lines.gtin.select("GTIN", "CATEGORY", "SKUPOS_DESCRIPTION")
    joined = lines.baskets.join(products, "GTIN", "left")
    basket, product = ["TRANSACTION_SET_ID", "PAYMENT_TYPE"], ["SKUPOS_DESCRIPTION", "CATEGORY"]
    per_basket = joined.groupingSets([basket, [*basket, *product]], *basket, *product).agg(
        (F.grouping("CATEGORY") == 0).alias("PER_PRODUCT"), *[F.sum(c).alias(c) for c in MEASURES], F.max("basket_amount").alias("basket_amount"))
    known = per_basket.where(~F.col("PER_PRODUCT") | F.col("CATEGORY").isNotNull())
    return known.groupBy("PER_PRODUCT", "PAYMENT_TYPE", *product).agg(
        F.count(F.lit(1)).alias("n_baskets"), *[F.sum(c).alias(c) for c in MEASURES],
        F.sum("basket_amount").alias("basket_amount"), F.count("basket_amount").alias("n_basket_amount"))


def _type_totals(lines: PaymentLines) -> DataFrame:
    """The measures per payment type, without the product master's attributes."""
    return basket_totals(lines).groupBy("PAYMENT_TYPE").agg(
        F.count(F.lit(1)).alias("n_baskets"), *[F.sum(c).alias(c) for c in MEASURES],
        F.sum("basket_amount").alias("basket_amount"), F.count("basket_amount").alias("n_basket_amount"))


def payment_summary(lines: PaymentLines, amount_basis: str = "basket_per_line", cube: DataFrame | None = None) -> DataFrame:
    """A4: per payment type - distinct baskets, spend, mean ticket, items and
    items per basket. ``cube``: a kept ``payment_cube`` of the lines to read instead of them.

    ``amount_basis``:
      * ``"basket_per_line"`` (published): the basket total is summed once per
        line and the ticket is the mean over lines;
      * ``"basket"``: each basket's total once, ticket = mean over baskets;
      * ``"line"``: line amounts, ticket = mean line amount.
    """
    if amount_basis not in AMOUNT_BASES:
        raise ValueError(f"amount_basis must be one of {AMOUNT_BASES}")
    spend, n, back = {
        "basket_per_line": ("set_amount_lines", "n_set_amount", lines.set_back),
        "basket": ("basket_amount", "n_basket_amount", lines.set_back),
        "line": ("line_amount", "n_line_amount", lines.line_back),
    }[amount_basis]
    totals = _type_totals(lines) if cube is None else cube.where("NOT PER_PRODUCT")
    return totals.select(
        "PAYMENT_TYPE", F.col("n_baskets").alias("num_transactions"),
        back(F.coalesce(F.col(spend), F.lit(0))).alias("total_spend"),
        ratio(back(F.col(spend)), n).alias("avg_ticket"),
        lines.units_back(F.coalesce(F.col("units"), F.lit(0))).alias("total_items"),
    ).withColumn("avg_items_per_txn", ratio("total_items", "num_transactions"))


def product_by_payment(lines: PaymentLines, cube: DataFrame | None = None) -> DataFrame:
    """A5: per type x product x category (non-null category) - distinct
    baskets (``purchase_count``) and revenue on the published basis (basket
    total once per line). Rows of ``basket_products`` are one per basket
    within a group, so ``count(*)`` is the distinct basket count. ``cube``:
    a kept ``payment_cube`` of the lines to read instead of them."""
    if cube is not None:
        return cube.where("PER_PRODUCT").select(
            "PAYMENT_TYPE", "SKUPOS_DESCRIPTION", "CATEGORY", F.col("n_baskets").alias("purchase_count"),
            lines.set_back(F.coalesce(F.col("set_amount_lines"), F.lit(0))).alias("revenue"))
    return basket_products(lines).groupBy("PAYMENT_TYPE", "SKUPOS_DESCRIPTION", "CATEGORY").agg(
        F.count(F.lit(1)).alias("purchase_count"),
        lines.set_back(F.coalesce(F.sum("set_amount_lines"), F.lit(0))).alias("revenue"),
    )


def top_n_per_group(df: DataFrame, group: str | Sequence[str], order: Sequence[Column], n: int = 5) -> DataFrame:
    """First ``n`` rows per group in ``order`` (caller adds tie-breakers).

    ``row_number() <= n`` is planned as a partial ``WindowGroupLimit`` before
    the shuffle, so each task forwards at most ``n`` rows per group even when
    one group holds most rows.
    """
    groups = [group] if isinstance(group, str) else list(group)
    w = Window.partitionBy(*groups).orderBy(*order)
    return df.withColumn("_rn", F.row_number().over(w)).where(F.col("_rn") <= n).drop("_rn")


def top_products_by_payment(lines: PaymentLines, n: int = 5, cube: DataFrame | None = None) -> DataFrame:
    """W1 on A5: most-purchased products per payment type; description then
    category (NULL first) break ties."""
    return top_n_per_group(
        product_by_payment(lines, cube), "PAYMENT_TYPE",
        [F.desc("purchase_count"), F.asc_nulls_first("SKUPOS_DESCRIPTION"), F.asc_nulls_first("CATEGORY")], n,
    )


def payment_table(top: DataFrame) -> DataFrame:
    """The top products per type as displayed: revenue rounded and as currency, counts with separators."""
    shown = present(top, {
        "Payment_Type": "PAYMENT_TYPE", "Product": "SKUPOS_DESCRIPTION", "Category": "CATEGORY", "Purchase_Count": "purchase_count",
        "Revenue": F.col("revenue").cast("double"),
    })
    return formatted(rounded(shown, ["Revenue"], 2), money=["Revenue"], counts=["Purchase_Count"])


def mean_of_group_means(summary: DataFrame, col: str = "avg_ticket") -> DataFrame:
    """A10: the published "overall average" line - the unweighted mean of the
    per-type means (not the overall mean; see ``weighted_mean``)."""
    return summary.agg(F.avg(col).alias("overall_avg"))


def weighted_mean(lines: PaymentLines) -> DataFrame:
    """The overall mean ticket over all lines (weighted alternative to A10)."""
    return basket_totals(lines).agg(ratio(lines.set_back(F.sum("set_amount_lines")), F.sum("n_set_amount")).alias("overall_avg"))


def payment_kpis(summary: DataFrame, selection: Iterable[str] = DEFAULT_SELECTION) -> DataFrame:
    """A16 (payment page): the summary rows of the selected types."""
    return summary.where(F.col("PAYMENT_TYPE").isin(list(selection)))
