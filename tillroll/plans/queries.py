"""Registered queries: one callable ``(spark, sf_dir) -> DataFrame`` per
operator of the inventory, each built from the library's operators over the
fixture views of the driver tables. Output columns are named and typed to
match ``tillroll.plans.oracle`` (amounts as double cast from exact decimal
sums, display ratios rounded to 4 places).
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tillroll.functions.exprs import zero_sum
from tillroll.operators import brands, cube, demographics, keys, kpis, payments, period, present, products, sketches
from tillroll.operators.rollup import DAILY_KEYS
from tillroll.plans import pages
from tillroll.session import scratch
from tillroll.sources import census, fixtures, layout, refresh, schemas, tables
from tillroll.sources.schemas import ACS_VARS, TRACT_KEYS

# The period and thresholds the checks run with.
YEAR = 1997
MONTHS = (1, 2, 3)
THRESHOLD = 36_000_000
TOP_K = 5
TARGET = 50_000.0
DROP_K = 10


def _t(spark: SparkSession, sf_dir: str) -> fixtures.RetailTables:
    return fixtures.retail_tables(spark, sf_dir)


def _d(c: str):
    return F.col(c).cast("double").alias(c)


def _landed(spark: SparkSession, sf_dir: str) -> fixtures.RetailTables:
    """The tables with baskets and lines laid out by period in the shared folder."""
    return fixtures.RetailTables(layout.land_by_period(spark, _t(spark, sf_dir), scratch(spark, "by-period")))


def _kept(df: DataFrame, tag: str) -> DataFrame:
    """A small frame that several branches of one query read, written once to the shared folder."""
    path = scratch(df.sparkSession, tag)
    tables.materialize(df, path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def _r4(c: str, name: str | None = None):
    return F.round(F.col(c), 4).alias(name or c)


# --- period slice ----------------------------------------------------------

def filter_year_month(spark, sf_dir):
    d = _t(spark, sf_dir).daily_in(YEAR, MONTHS)
    return d.agg(F.count(F.lit(1)).alias("n_rows"), zero_sum("TOTAL_REVENUE_AMOUNT").cast("double").alias("revenue"))


def set_kpis(spark, sf_dir):
    t = _t(spark, sf_dir)
    return period.period_slice(t, YEAR, MONTHS).totals()


def items_in_period(spark, sf_dir):
    t = _t(spark, sf_dir)
    s = period.filter_sets(t["sets"], YEAR)
    return period.items_in_period(t["items"], s).agg(F.count(F.lit(1)).alias("n_items"))


def items_in_period_landed(spark, sf_dir):
    """J1 on lines laid out by period: only the period's folders and the open one are read."""
    return period.period_slice(_landed(spark, sf_dir), YEAR, MONTHS).items.agg(
        F.count(F.lit(1)).alias("n_items"), zero_sum("UNIT_QUANTITY").cast("double").alias("units"))


def filter_year_month_landed(spark, sf_dir):
    """P6 derived from facts laid out by period."""
    d = _landed(spark, sf_dir).daily_in(YEAR, MONTHS)
    return d.agg(F.count(F.lit(1)).alias("n_rows"), zero_sum("TOTAL_REVENUE_AMOUNT").cast("double").alias("revenue"))


def payment_summary_period_landed(spark, sf_dir):
    """J2 and A4 on facts laid out by period."""
    t = _landed(spark, sf_dir)
    lines = payments.payment_lines(period.filter_sets(t["sets"], YEAR, MONTHS), period.lines_in(t["items"], YEAR, MONTHS), t["gtin"])
    s = payments.payment_summary(lines)
    return s.select("PAYMENT_TYPE", "num_transactions", _d("total_spend"), _r4("avg_ticket"), _d("total_items"), _r4("avg_items_per_txn"))


def category_list_period_landed(spark, sf_dir):
    """A14 on facts laid out by period: distinct GTINs of the period's folders, without the basket join."""
    return products.category_list(keys.categories(_landed(spark, sf_dir), (YEAR, MONTHS)))


def refreshed_daily(spark, sf_dir):
    """A daily table built without March, then brought up to date after March's lines arrived."""
    t, path = _t(spark, sf_dir), scratch(spark, "refreshed")
    march = period.filter_sets(t["sets"], YEAR, (3,)).select("TRANSACTION_SET_ID")
    before = {**t, "items": t["items"].join(march, "TRANSACTION_SET_ID", "left_anti")}
    for facts in (before, t):
        laid_out = scratch(spark, "by-period")
        refresh.refresh_daily(spark, layout.land_by_period(spark, facts, laid_out), path)
        tables.remove(spark, laid_out)   # read no more: the daily table stands by itself
    d = spark.read.parquet(f"{path}/daily")
    return d.groupBy("CALENDAR_YEAR", "CALENDAR_MONTH").agg(F.count(F.lit(1)).alias("n_rows"), F.sum("TOTAL_REVENUE_AMOUNT").cast("double").alias("revenue"))


# --- question 1 --------------------------------------------------------------

def category_list(spark, sf_dir):
    return products.category_list(keys.categories(_t(spark, sf_dir)))


def category_count(spark, sf_dir):
    return products.category_count(keys.categories(_t(spark, sf_dir)))


def category_list_head(spark, sf_dir):
    return products.category_head(keys.categories(_t(spark, sf_dir)), 20)


def _top5(daily: DataFrame) -> DataFrame:
    return products.top_products(products.product_totals(products.filter_categories(daily)), TOP_K)


def top_products(spark, sf_dir):
    top = _top5(_t(spark, sf_dir)["daily"])
    return top.select(
        *products.PRODUCT_KEYS, _d("total_revenue"), _d("total_units"),
        F.col("total_transactions").cast("bigint").alias("total_transactions"), _r4("avg_price"),
    )


def _product_weeks(spark, sf_dir) -> DataFrame:
    """The small product x week frame, written once because the top list and its weekly series both read it."""
    return _kept(products.product_weeks(products.filter_categories(_t(spark, sf_dir)["daily"])), "product-weeks")


def _weekly(weeks: DataFrame, grain: str) -> DataFrame:
    top = products.top_products(products.product_totals(weeks), TOP_K)
    return products.weekly_totals(weeks, top, grain)


def weekly_top_products(spark, sf_dir):
    w = _weekly(_product_weeks(spark, sf_dir), "week")
    return w.select("CALENDAR_WEEK", "SKUPOS_DESCRIPTION", "BRAND", _d("weekly_revenue"), _d("weekly_units"))


def weekly_top_products_ranked(spark, sf_dir):
    """O3: the display order of the weekly series, as a rank."""
    w = _weekly(_product_weeks(spark, sf_dir), "week")
    order = [*products.weekly_order(), F.asc_nulls_first("SKUPOS_DESCRIPTION"), F.asc_nulls_first("BRAND")]
    return w.select("CALENDAR_WEEK", "SKUPOS_DESCRIPTION", "BRAND", F.row_number().over(Window.orderBy(*order)).alias("position"))


def weekly_top_products_target(spark, sf_dir):
    """the weekly series with the user's target line."""
    w = _weekly(_product_weeks(spark, sf_dir), "week")
    return present.with_threshold(w, TARGET, "target").select("CALENDAR_WEEK", "SKUPOS_DESCRIPTION", "BRAND", "target")


def weekly_top_products_year_week(spark, sf_dir):
    w = _weekly(_product_weeks(spark, sf_dir), "year_week")
    return w.select("CALENDAR_YEAR", "CALENDAR_WEEK", "SKUPOS_DESCRIPTION", "BRAND", _d("weekly_revenue"))


def top_products_kpis(spark, sf_dir):
    weeks = _product_weeks(spark, sf_dir)
    top = products.top_products(products.product_totals(weeks), TOP_K)
    k = kpis.top_products_kpis(top, products.weekly_totals(weeks, top, "week"))
    return k.select("total_revenue", "total_units", _r4("avg_weekly_revenue"), "n_weeks")


def summary_text(spark, sf_dir):
    top = _top5(_t(spark, sf_dir)["daily"])
    shown = present.present(top, {
        "Product": "SKUPOS_DESCRIPTION", "Brand": "BRAND", "Category": "CATEGORY",
        "Revenue": F.col("total_revenue").cast("double"), "Units": F.col("total_units").cast("double"),
        "Avg_Price": "avg_price", "Transactions": "total_transactions",
    })
    return present.formatted(shown, money=["Revenue", "Avg_Price"], counts=["Units", "Transactions"])


SELECTED_CATEGORIES = ("Energy Drinks", "STANDARD")


def top_products_selected_categories(spark, sf_dir):
    """P10 with a non-empty selection: top five within two categories."""
    daily = _t(spark, sf_dir)["daily"]
    top = products.top_products(products.product_totals(
        products.filter_categories(daily, SELECTED_CATEGORIES)), TOP_K)
    return top.select(*products.PRODUCT_KEYS, _d("total_revenue"), _d("total_units"))


def weekly_top_products_period(spark, sf_dir):
    """C2 on a period slice: the weekly series of the period's top five."""
    weeks = _kept(products.product_weeks(products.filter_categories(_t(spark, sf_dir).daily_in(YEAR, MONTHS))), "product-weeks")
    w = _weekly(weeks, "week")
    return w.select("CALENDAR_WEEK", "SKUPOS_DESCRIPTION", "BRAND", _d("weekly_revenue"), _d("weekly_units"))


def _cube(spark, sf_dir) -> cube.ProductCube:
    path = scratch(spark, "cube")
    cube.write_cube(_t(spark, sf_dir)["daily"], path)
    return cube.read_cube(spark, path)


def top_products_cube(spark, sf_dir):
    """A1 and O1 from the kept cube."""
    top = _top5(_cube(spark, sf_dir).products(everything=True))
    return top.select(
        *products.PRODUCT_KEYS, _d("total_revenue"), _d("total_units"),
        F.col("total_transactions").cast("bigint").alias("total_transactions"), _r4("avg_price"),
    )


def weekly_top_products_cube(spark, sf_dir):
    """J8 and A2 from the kept cube."""
    c = _cube(spark, sf_dir)
    w = products.weekly_totals(products.filter_categories(c.weeks(everything=True)), _top5(c.products(everything=True)), "week")
    return w.select("CALENDAR_WEEK", "SKUPOS_DESCRIPTION", "BRAND", _d("weekly_revenue"), _d("weekly_units"))


def top_products_kpis_cube(spark, sf_dir):
    """A16 of the top-products page over a period, from the kept cube."""
    c = _cube(spark, sf_dir)
    top = _top5(c.products(YEAR, MONTHS))
    k = kpis.top_products_kpis(top, products.weekly_totals(products.filter_categories(c.weeks(YEAR, MONTHS)), top, "week"))
    return k.select("total_revenue", "total_units", _r4("avg_weekly_revenue"), "n_weeks")


# --- question 2 --------------------------------------------------------------

def _bev(spark, sf_dir) -> DataFrame:
    return brands.brand_performance(_t(spark, sf_dir)["daily"])


def brand_performance(spark, sf_dir):
    return _bev(spark, sf_dir).select(
        "BRAND", _d("revenue"), _d("units"), F.col("transactions").cast("bigint").alias("transactions"),
        _r4("rev_per_unit"), _r4("rev_per_transaction"),
    )


def drop_candidates(spark, sf_dir):
    return brands.drop_candidates(_bev(spark, sf_dir), DROP_K).select("BRAND", _d("revenue"))


def drop_candidates_by_units(spark, sf_dir):
    return brands.drop_candidates(_bev(spark, sf_dir), DROP_K, rank_by="units").select("BRAND", _d("units"))


def threshold_count(spark, sf_dir):
    k = brands.brand_kpis(_bev(spark, sf_dir), THRESHOLD)
    return k.select("brands", "below", _d("total"), _r4("avg_rev"))


def below_threshold(spark, sf_dir):
    return brands.below_threshold(_bev(spark, sf_dir), THRESHOLD).select("BRAND", _d("revenue"))


# --- question 3 --------------------------------------------------------------

def _lines(spark, sf_dir, types=payments.PAYMENT_TYPES) -> payments.PaymentLines:
    t = _t(spark, sf_dir)
    return payments.payment_lines(t["sets"], t["items"], t["gtin"], types)


def payment_summary_published(spark, sf_dir):
    s = payments.payment_summary(_lines(spark, sf_dir), "basket_per_line")
    return s.select("PAYMENT_TYPE", "num_transactions", _d("total_spend"), _r4("avg_ticket"),
                    _d("total_items"), _r4("avg_items_per_txn"))


def payment_summary_per_basket(spark, sf_dir):
    s = payments.payment_summary(_lines(spark, sf_dir), "basket")
    return s.select("PAYMENT_TYPE", "num_transactions", _d("total_spend"), _r4("avg_ticket"))


def payment_summary_line(spark, sf_dir):
    s = payments.payment_summary(_lines(spark, sf_dir), "line")
    return s.select("PAYMENT_TYPE", _d("total_spend"), _r4("avg_ticket", "avg_line"))


def payment_kpis(spark, sf_dir):
    lines = _lines(spark, sf_dir, payments.DEFAULT_SELECTION)
    s = payments.payment_kpis(payments.payment_summary(lines), payments.DEFAULT_SELECTION)
    return s.select("PAYMENT_TYPE", "num_transactions", _d("total_spend"), _r4("avg_ticket"),
                    _r4("avg_items_per_txn"))


def payment_summary_period(spark, sf_dir):
    """C4 on a period slice: baskets of the period (pushed to the scan) joined
    with all their lines."""
    t = _t(spark, sf_dir)
    lines = payments.payment_lines(period.filter_sets(t["sets"], YEAR, MONTHS), t["items"], t["gtin"])
    s = payments.payment_summary(lines)
    return s.select("PAYMENT_TYPE", "num_transactions", _d("total_spend"), _r4("avg_ticket"),
                    _d("total_items"), _r4("avg_items_per_txn"))


def payment_table(spark, sf_dir):
    """P2 + F3 + F10: the top products of each type as displayed."""
    p = payments.payment_table(payments.top_products_by_payment(_lines(spark, sf_dir), TOP_K))
    return p.select("Payment_Type", "Product", "Category", "Purchase_Count", "Revenue")


def payment_summary_duplicate_gtin(spark, sf_dir):
    """Products listed twice multiply their lines."""
    t = _t(spark, sf_dir)
    twice = t["gtin"].unionByName(t["gtin"].where(F.col("GTIN") % 7 == 0))
    lines = payments.payment_lines(t["sets"], t["items"], twice)
    s = payments.payment_summary(lines)
    return s.select("PAYMENT_TYPE", "num_transactions", _d("total_spend"), _d("total_items"))


def product_by_payment(spark, sf_dir):
    p = payments.product_by_payment(_lines(spark, sf_dir))
    return p.select("PAYMENT_TYPE", "SKUPOS_DESCRIPTION", "CATEGORY", "purchase_count", _d("revenue"))


def top_products_by_payment(spark, sf_dir):
    p = payments.top_products_by_payment(_lines(spark, sf_dir), TOP_K)
    return p.select("PAYMENT_TYPE", "SKUPOS_DESCRIPTION", "CATEGORY", "purchase_count", _d("revenue"))


def mean_of_group_means(spark, sf_dir):
    s = payments.payment_summary(_lines(spark, sf_dir))
    return payments.mean_of_group_means(s).select(F.round("overall_avg", 3).alias("overall_avg"))


def overall_mean_ticket(spark, sf_dir):
    return payments.weighted_mean(_lines(spark, sf_dir)).select(F.round("overall_avg", 3).alias("overall_avg"))


def payment_cube(spark, sf_dir):
    """A4 and A5 from one pass over the lines: per type, and per type and product."""
    lines = _lines(spark, sf_dir)
    c = payments.payment_cube(lines)
    return c.select("PER_PRODUCT", "PAYMENT_TYPE", "SKUPOS_DESCRIPTION", "CATEGORY", "n_baskets",
                    lines.set_back(F.col("set_amount_lines")).cast("double").alias("spend"), lines.units_back(F.col("units")).cast("double").alias("units"))


# --- question 4 --------------------------------------------------------------

def _enriched(spark, sf_dir) -> DataFrame:
    t = _t(spark, sf_dir)
    raw = fixtures.census_tables(spark, sf_dir, t["stores"])
    return demographics.enrich_stores(
        t["stores"],
        census.parse_geocode(raw["geocode_raw"]),
        census.parse_tract_acs(raw["tract_raw"]),
        census.parse_county_acs(raw["county_raw"]),
        demographics.store_performance(t["daily"]),
    )


def store_enriched(spark, sf_dir):
    e = _enriched(spark, sf_dir)
    return e.select(
        "STORE_ID", "STATE", *TRACT_KEYS, *ACS_VARS, "county_NAME", *[f"county_{v}" for v in ACS_VARS], _d("revenue"), F.col("transactions").cast("bigint").alias("transactions"),
    )


def store_performance(spark, sf_dir):
    p = demographics.store_performance(_t(spark, sf_dir)["daily"])
    return p.select("STORE_ID", _d("revenue"), F.col("transactions").cast("bigint").alias("transactions"))


def _summary_cols(df):
    return df.select("STATE", "store_count", "avg_tract_pop", "avg_income", "avg_poverty", "avg_home_value")


def state_summary(spark, sf_dir):
    return _summary_cols(demographics.state_summary(demographics.valid_stores(_enriched(spark, sf_dir))))


def state_table(spark, sf_dir):
    """P2 + F3 + F10 + O4: the state summary as displayed, with its position."""
    return demographics.state_table(demographics.state_summary(demographics.valid_stores(_enriched(spark, sf_dir))))


def state_summary_clean(spark, sf_dir):
    e = demographics.clean_annotations(_enriched(spark, sf_dir))
    return _summary_cols(demographics.state_summary(demographics.valid_stores(e)))


def demographic_points(spark, sf_dir):
    return demographics.demographic_points(demographics.valid_stores(_enriched(spark, sf_dir)))


def box_stats(spark, sf_dir):
    pts = demographics.demographic_points(demographics.valid_stores(_enriched(spark, sf_dir)))
    return demographics.box_stats(pts, "STATE", "income")


def parse_geocode(spark, sf_dir):
    stores = _t(spark, sf_dir)["stores"]
    return census.parse_geocode(fixtures.geocode_payloads(stores))


def parse_tract_acs(spark, sf_dir):
    raw = fixtures.census_tables(spark, sf_dir)["tract_raw"]
    return census.parse_tract_acs(raw)


def parse_county_acs(spark, sf_dir):
    raw = fixtures.supplier_county_payloads(fixtures.read_driver(spark, sf_dir, "supplier"))
    return census.parse_county_acs(raw)


def parse_county_acs_reordered(spark, sf_dir):
    """The header names the columns, whatever their order."""
    raw = fixtures.supplier_county_payloads(fixtures.read_driver(spark, sf_dir, "supplier"), reverse=True)
    return census.parse_county_acs(raw)


def pending_stores(spark, sf_dir):
    """S13 for stores: never geocoded, or geocoded without a tract."""
    stores = _t(spark, sf_dir)["stores"]
    parsed = census.parse_geocode(fixtures.geocode_payloads(stores.where(F.col("STORE_ID") % 4 != 2)))
    return census.pending_stores(stores, parsed)


def fresh_responses(spark, sf_dir):
    """Landed responses younger than two hours at a fixed moment (store n's landed n % 300 minutes before)."""
    stores = _t(spark, sf_dir)["stores"]
    now = F.lit("2024-01-01 12:00:00").cast("timestamp")
    landed = fixtures.geocode_payloads(stores).withColumn("fetched_at", now - F.make_interval(mins=(F.col("STORE_ID").cast("int") % 300)))
    return tables.read_if_fresh(landed, 7200, now=now).select("STORE_ID")


def _spread(df: DataFrame) -> DataFrame:
    """Narrow rows of a small file that become long responses: dealt out, so that more than the file's one task make and parse them."""
    return df.repartition(int(df.sparkSession.conf.get("spark.sql.shuffle.partitions")))


def _responses(spark, sf_dir) -> dict[str, DataFrame]:
    raw = fixtures.census_tables(spark, sf_dir, _spread(_t(spark, sf_dir)["stores"].select("STORE_ID", "c_nationkey")))
    return {"geocode": raw["geocode_raw"], "tract": raw["tract_raw"], "county": fixtures.supplier_county_payloads(_spread(fixtures.read_driver(spark, sf_dir, "supplier")))}


def quarantine_counts(spark, sf_dir):
    """Landed responses that can't be used in full, by reason."""
    return census.reason_counts(_responses(spark, sf_dir))


def pending_stores_reasons(spark, sf_dir):
    """S13 with reasons: never geocoded, no tract, or a malformed answer."""
    stores = _t(spark, sf_dir)["stores"]
    landed = fixtures.geocode_payloads(stores.where(F.col("STORE_ID") % 4 != 2))
    pending = census.pending_stores(stores, census.parse_geocode(landed))
    return census.work_list(pending, census.quarantine(landed, "geocode", ["STORE_ID"]), ["STORE_ID"]).select("STORE_ID", "reason")


def pending_keys(spark, sf_dir):
    """Tracts of geocoded stores that still lack ACS data (their landed
    response held no data row), i.e. the next fetch's work list."""
    raw = fixtures.census_tables(spark, sf_dir)
    keys = census.parse_geocode(raw["geocode_raw"])
    return census.pending_keys(keys, census.parse_tract_acs(raw["tract_raw"]), TRACT_KEYS)


# --- home page, validation, parameters ----------------------------------------

def year_bounds(spark, sf_dir):
    return kpis.year_bounds(keys.periods(_t(spark, sf_dir)))


def store_activity(spark, sf_dir):
    t = _t(spark, sf_dir)
    return kpis.store_activity(t["stores"], keys.active_stores(t), keys.active_stores(t, (YEAR, MONTHS)))


def home_kpis(spark, sf_dir):
    t = _t(spark, sf_dir)
    sl = period.period_slice(t, YEAR, MONTHS)
    return kpis.home_kpis(t["stores"], t["gtin"], sl, period_stores=keys.active_stores(t, (YEAR, MONTHS)))


def distinct_sketch(spark, sf_dir):
    """A11 and A17 over a period from stored daily sketches, held against the exact counts: within three standard errors?"""
    t = _t(spark, sf_dir)
    path = scratch(spark, "sketches")
    tables.materialize(sketches.daily_sketches(t["items"], t["sets"]), path, partition_by=period.PERIOD)
    found = sketches.distinct_over(spark.read.parquet(path), YEAR, MONTHS)
    baskets = keys.sold_baskets(t["items"], t["sets"], (YEAR, MONTHS))
    exact = kpis.table_profile([("baskets", baskets, "STORE_ID"), ("baskets", baskets, "TRANSACTION_SET_ID"),
                                ("lines", keys.sold_gtins(t["items"], t["sets"], (YEAR, MONTHS)), "GTIN")])
    bound = F.col("n_distinct") * F.lit(3 * sketches.standard_error()) + 1
    return exact.join(found, exact["column_name"] == found["key"]).select(
        "key", F.col("n_distinct").alias("exact"), (F.abs(F.col("estimate") - F.col("n_distinct")) <= bound).alias("within_bound"))


def table_profile(spark, sf_dir):
    t = _t(spark, sf_dir)
    return kpis.table_profile([
        ("stores", t["stores"], "STATE"), ("stores", t["stores"], "STORE_CHAIN_NAME"),
        ("gtin", t["gtin"], "BRAND"), ("sets", t["sets"], "PAYMENT_TYPE"), ("items", t["items"], "GTIN"),
    ])


def daily_key_profile(spark, sf_dir):
    """T12 on the line table, whose GTIN repeats."""
    return kpis.key_profile(_t(spark, sf_dir)["items"], "GTIN")


def gtin_key_profile(spark, sf_dir):
    """T12 on a product master that lists every seventh product twice."""
    g = _t(spark, sf_dir)["gtin"]
    return kpis.key_profile(g.unionByName(g.where(F.col("GTIN") % 7 == 0)), "GTIN")


def table_counts(spark, sf_dir):
    """Rows of the five tables."""
    t = _t(spark, sf_dir)
    return kpis.row_counts([(n, t[n]) for n in ("stores", "gtin", "sets", "items")])


def months_subtitle(spark, sf_dir):
    """the months in the data, as the table's subtitle."""
    months = F.array_sort(F.collect_set("CALENDAR_MONTH"))   # twelve at most
    return keys.periods(_t(spark, sf_dir)).agg(F.concat(F.lit("Months: "), F.concat_ws(", ", months.cast("array<string>"))).alias("subtitle"))


def parameter_values(spark, sf_dir):
    return present.year_options(keys.periods(_t(spark, sf_dir)))


def daily_rollup(spark, sf_dir):
    d = _t(spark, sf_dir)["daily"]
    return d.select(*DAILY_KEYS, F.col("TOTAL_REVENUE_AMOUNT").cast("double").alias("revenue"),
                    F.col("QUANTITY").cast("double").alias("quantity"), "TRANSACTION_COUNT")


# --- sources and pages ----------------------------------------------------------

def load_items_parts(spark, sf_dir):
    """The item table written in several parts and read as one scan under its contract."""
    path = scratch(spark, "items")
    _t(spark, sf_dir)["items"].repartition(5).write.parquet(path)
    return tables.load_items(spark, path, schemas.ITEMS).agg(
        F.count(F.lit(1)).alias("n_items"), zero_sum("UNIT_QUANTITY").cast("double").alias("units"), zero_sum("GRAND_TOTAL_AMOUNT").cast("double").alias("amount"))


def materialized_daily(spark, sf_dir):
    """The daily table written by year and month, read back, one period of it."""
    path = scratch(spark, "daily")
    tables.materialize(_t(spark, sf_dir)["daily"], path, partition_by=period.PERIOD)
    d = period.filter_daily(tables.read_or_none(spark, path), YEAR, MONTHS)
    return d.groupBy("CALENDAR_MONTH").agg(F.count(F.lit(1)).alias("n_rows"), zero_sum("TOTAL_REVENUE_AMOUNT").cast("double").alias("revenue"),
                                           F.sum("TRANSACTION_COUNT").alias("transactions"))


def _folder(spark, sf_dir) -> fixtures.RetailTables:
    """The named tables written under their files' names and loaded from that folder under their contracts."""
    t, root = _t(spark, sf_dir), scratch(spark, "folder")
    for name, file, contract in schemas.DATASETS:
        if contract is not None:
            tables.materialize(t[name], f"{root}/{file}")
    return fixtures.RetailTables(tables.load_folder(spark, root))


def load_folder(spark, sf_dir):
    """Rows and distinct keys of the loaded folder's tables."""
    t = _folder(spark, sf_dir)
    return kpis.table_profile([("stores", t["stores"], "STORE_ID"), ("gtin", t["gtin"], "GTIN"), ("sets", t["sets"], "TRANSACTION_SET_ID"),
                               ("items", t["items"], "GTIN"), ("daily", t["daily"], "CATEGORY")])


def page_home(spark, sf_dir):
    """C1 over a period."""
    return pages.home_page(_t(spark, sf_dir), YEAR, MONTHS)["kpis"]


def page_top_products(spark, sf_dir):
    """The table of the page, from tables loaded out of a folder."""
    p = pages.top_products_page(_folder(spark, sf_dir), YEAR, MONTHS, persist=False)["table"]
    return p.select("Product", "Brand", "Category", "Revenue", "Units", "Avg Price", "Transactions")


def page_brands(spark, sf_dir):
    """The KPIs of the page over a period."""
    return pages.brands_page(_t(spark, sf_dir), YEAR, MONTHS, threshold=THRESHOLD, persist=False)["kpis"].select("brands", "below", _d("total"), _r4("avg_rev"))


def page_payments(spark, sf_dir):
    """C4: the summary of the page over a period, on facts laid out by period."""
    s = pages.payments_page(_landed(spark, sf_dir), YEAR, MONTHS, payments.PAYMENT_TYPES, persist=False)["summary"]
    return s.select("PAYMENT_TYPE", "num_transactions", _d("total_spend"), _r4("avg_ticket"), _d("total_items"), _r4("avg_items_per_txn"))


def page_payments_table(spark, sf_dir):
    """C4: the table of the page, all periods."""
    return pages.payments_page(_t(spark, sf_dir), None, None, payments.PAYMENT_TYPES, persist=False)["table"]


def page_demographics(spark, sf_dir):
    """The state table of the page, from landed and parsed responses."""
    t = _t(spark, sf_dir)
    parsed = pages.land_census(fixtures.census_tables(spark, sf_dir, t["stores"]), scratch(spark, "census"))
    return pages.demographics_page(t, parsed, persist=False)["state_table"]


def page_validation(spark, sf_dir):
    """The profile of the page."""
    return pages.validation_page(_t(spark, sf_dir))["profile"]


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    f.__name__: f for f in (
        filter_year_month, set_kpis, items_in_period, category_list, category_list_head,
        category_count, top_products, weekly_top_products, weekly_top_products_ranked, weekly_top_products_target,
        weekly_top_products_year_week, top_products_kpis, summary_text,
        top_products_selected_categories, weekly_top_products_period, payment_summary_period,
        brand_performance, drop_candidates, drop_candidates_by_units, threshold_count, below_threshold,
        payment_summary_published, payment_summary_per_basket, payment_summary_line, payment_kpis,
        payment_table, payment_summary_duplicate_gtin, product_by_payment, top_products_by_payment, mean_of_group_means, overall_mean_ticket,
        store_enriched, store_performance, state_summary, state_table, state_summary_clean, demographic_points, box_stats,
        parse_geocode, parse_tract_acs, parse_county_acs, parse_county_acs_reordered, pending_keys, pending_stores, fresh_responses,
        year_bounds, store_activity, home_kpis, table_profile, table_counts, daily_key_profile, gtin_key_profile, parameter_values, months_subtitle, daily_rollup,
        items_in_period_landed, filter_year_month_landed, payment_summary_period_landed, category_list_period_landed, refreshed_daily,
        top_products_cube, weekly_top_products_cube, top_products_kpis_cube, payment_cube, quarantine_counts, pending_stores_reasons, distinct_sketch,
        load_items_parts, materialized_daily, load_folder,
        page_home, page_top_products, page_brands, page_payments, page_payments_table, page_demographics, page_validation,
    )
}

__all__ = ["QUERIES"]
