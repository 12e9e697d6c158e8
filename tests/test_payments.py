from decimal import Decimal

from pyspark.sql import functions as F

from tillroll.operators import kpis, payments

D = Decimal
SETS = "TRANSACTION_SET_ID bigint, DATE_TIME timestamp, STORE_ID bigint, GRAND_TOTAL_AMOUNT decimal(18,2), PAYMENT_TYPE string"
ITEMS = "TRANSACTION_SET_ID bigint, GTIN bigint, UNIT_QUANTITY decimal(18,2), UNIT_PRICE decimal(18,2), GRAND_TOTAL_AMOUNT decimal(18,2)"
GTIN = "GTIN bigint, CATEGORY string, SUBCATEGORY string, BRAND string, SKUPOS_DESCRIPTION string"


def _frames(spark, gtin_rows=None):
    sets = spark.createDataFrame([(1, None, 1, D("30.00"), "CASH"), (2, None, 1, D("5.00"), "CREDIT"),
                                  (3, None, 1, D("7.00"), None)], SETS)
    items = spark.createDataFrame([(1, 10, D("1"), None, D("8.00")), (1, 11, D("2"), None, D("12.00")),
                                   (1, 12, D("1"), None, D("10.00")), (2, None, D("1"), None, D("5.00")),
                                   (3, 10, D("1"), None, D("7.00"))], ITEMS)
    gtin = spark.createDataFrame(gtin_rows or [(10, "Snacks", None, "B", "P10"), (11, "Snacks", None, "B", "P11"),
                                               (12, "Drinks", None, "C", "P12")], GTIN)
    return sets, items, gtin


def _by_type(df):
    return {r.PAYMENT_TYPE: r for r in df.collect()}


def test_three_amount_bases(spark):
    lines = payments.payment_lines(*_frames(spark))
    pub = _by_type(payments.payment_summary(lines, "basket_per_line"))["CASH"]
    bas = _by_type(payments.payment_summary(lines, "basket"))["CASH"]
    lin = _by_type(payments.payment_summary(lines, "line"))["CASH"]
    assert pub.total_spend == 90 and bas.total_spend == 30 and lin.total_spend == 30
    assert pub.num_transactions == 1 and pub.total_items == 4
    assert pub.avg_ticket == 30.0 and bas.avg_ticket == 30.0 and lin.avg_ticket == 10.0
    assert pub.avg_items_per_txn == 4.0


def test_null_payment_type_and_null_gtin(spark):
    lines = payments.payment_lines(*_frames(spark))
    s = _by_type(payments.payment_summary(lines))
    assert set(s) == {"CASH", "CREDIT"}          # NULL type dropped
    assert s["CREDIT"].num_transactions == 1     # line with NULL GTIN kept


def test_duplicate_gtin_doubles_lines_and_is_reported(spark):
    dup = [(10, "Snacks", None, "B", "P10"), (10, "Snacks", None, "B", "P10"), (11, "Snacks", None, "B", "P11"),
           (12, "Drinks", None, "C", "P12")]
    sets, items, gtin = _frames(spark, dup)
    lines = payments.payment_lines(sets, items, gtin)
    cash = _by_type(payments.payment_summary(lines))["CASH"]
    assert cash.total_spend == 120 and cash.num_transactions == 1 and cash.total_items == 5   # four joined lines
    p = {(r.PAYMENT_TYPE, r.SKUPOS_DESCRIPTION): r for r in payments.product_by_payment(lines).collect()}
    assert p[("CASH", "P10")].revenue == 60 and p[("CASH", "P10")].purchase_count == 1
    prof = kpis.key_profile(gtin, "GTIN").first()
    assert prof.duplicates == 1


def test_top_n_per_group_ties_and_nulls(spark):
    rows = [("CASH", None, "A", 3), ("CASH", "b", "A", 3), ("CASH", "a", "A", 3), ("CASH", "c", "A", 1),
            ("CREDIT", "z", "A", 9)]
    df = spark.createDataFrame(rows, "PAYMENT_TYPE string, SKUPOS_DESCRIPTION string, CATEGORY string, purchase_count bigint")
    got = payments.top_n_per_group(df, "PAYMENT_TYPE", [F.desc("purchase_count"),
                                                       F.asc_nulls_first("SKUPOS_DESCRIPTION")], 2).collect()
    cash = [r.SKUPOS_DESCRIPTION for r in got if r.PAYMENT_TYPE == "CASH"]
    assert cash == [None, "a"] or sorted(cash, key=lambda x: (x is not None, x)) == [None, "a"]
    assert len(got) == 3


def test_mean_of_group_means_is_unweighted(spark):
    summary = spark.createDataFrame([("CASH", 10.0), ("CREDIT", 30.0)], "PAYMENT_TYPE string, avg_ticket double")
    assert payments.mean_of_group_means(summary).first().overall_avg == 20.0


def test_product_by_payment_counts_distinct_baskets(spark):
    sets, items, gtin = _frames(spark)
    extra = spark.createDataFrame([(1, 10, D("1"), None, D("8.00"))], items.schema)
    lines = payments.payment_lines(sets, items.unionByName(extra), gtin)
    p = {(r.PAYMENT_TYPE, r.SKUPOS_DESCRIPTION): r for r in payments.product_by_payment(lines).collect()}
    assert p[("CASH", "P10")].purchase_count == 1
    assert p[("CASH", "P10")].revenue == 60  # basket total once per line (two lines)


def test_selection_is_within_the_three_types(spark):
    sets, items, gtin = _frames(spark)
    mobile = sets.withColumn("PAYMENT_TYPE", F.lit("MOBILE"))
    assert payments.payment_summary(payments.payment_lines(mobile, items, gtin, ["MOBILE"])).count() == 0


def test_amounts_keep_three_decimals(spark):
    sets, _, gtin = _frames(spark)
    items = spark.createDataFrame([(1, 10, D("12.345"), D("3.459"))], "TRANSACTION_SET_ID bigint, GTIN bigint, UNIT_QUANTITY decimal(18,3), GRAND_TOTAL_AMOUNT decimal(18,3)")
    row = _by_type(payments.payment_summary(payments.payment_lines(sets, items, gtin), "line"))["CASH"]
    assert row.total_items == D("12.345") and row.total_spend == D("3.459")
