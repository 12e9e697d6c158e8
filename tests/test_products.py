from decimal import Decimal

from tillroll.operators import products

D = Decimal
SCHEMA = ("CALENDAR_YEAR int, CALENDAR_MONTH int, CALENDAR_WEEK int, STORE_ID bigint, CATEGORY string, "
          "SUBCATEGORY string, BRAND string, SKUPOS_DESCRIPTION string, TOTAL_REVENUE_AMOUNT decimal(18,2), "
          "QUANTITY decimal(18,2), TRANSACTION_COUNT bigint")


def row(cat, brand, desc, rev, qty=D("1.00"), week=1, n=1):
    return (2024, 1, week, 1, cat, None, brand, desc, D(rev), qty, n)


def test_tie_at_cut_keeps_five_smallest_keys(spark):
    rows = [row("Snacks", f"B{i}", f"P{i}", "10.00") for i in (6, 2, 4, 1, 5, 3)]
    daily = spark.createDataFrame(rows, SCHEMA)
    top = products.top_products(products.product_totals(daily), 5).collect()
    assert [r.BRAND for r in top] == ["B1", "B2", "B3", "B4", "B5"]


def test_null_category_dropped_by_fuel_exclusion(spark):
    daily = spark.createDataFrame([row(None, "B", "P", "5.00"), row("FUEL", "B", "G", "9.00"),
                                   row("Snacks", "B", "S", "1.00")], SCHEMA)
    assert [r.CATEGORY for r in products.filter_categories(daily).collect()] == ["Snacks"]


def test_empty_category_selection_means_all_non_fuel(spark):
    daily = spark.createDataFrame([row("A", "B", "P", "5.00"), row("FUEL", "B", "G", "9.00"),
                                   row("C", "B", "S", "1.00")], SCHEMA)
    assert products.filter_categories(daily, []).count() == 2
    assert products.filter_categories(daily, ["A"]).count() == 1


def test_zero_units_gives_null_price(spark):
    daily = spark.createDataFrame([row("A", "B", "P", "10.00", qty=D("0.00"))], SCHEMA)
    assert products.product_totals(daily).first().avg_price is None


def test_weekly_keeps_brands_of_same_description_apart(spark):
    rows = [row("A", "X", "Desc", "100.00"), row("A", "Y", "Desc", "50.00"), row("A", None, "Desc", "7.00"),
            row("A", "Z", "Other", "1.00")]
    daily = spark.createDataFrame(rows, SCHEMA)
    top = products.top_products(products.product_totals(daily), 1)
    weekly = products.weekly_totals(daily, top).collect()
    assert sorted((r.BRAND or "") for r in weekly) == ["", "X", "Y"]


def test_weekly_year_week_grain_separates_years(spark):
    rows = [row("A", "X", "D", "1.00"), (2025, 1, 1, 1, "A", None, "X", "D", D("2.00"), D("1.00"), 1)]
    daily = spark.createDataFrame(rows, SCHEMA)
    top = products.top_products(products.product_totals(daily), 1)
    assert products.weekly_totals(daily, top, "week").count() == 1
    assert products.weekly_totals(daily, top, "year_week").count() == 2


def test_top_products_subset_of_totals(small_tables):
    cat = products.filter_categories(small_tables["daily"])
    totals = products.product_totals(cat)
    top = products.top_products(totals, 5)
    assert top.join(totals, list(products.PRODUCT_KEYS), "left_anti").count() == 0
