from decimal import Decimal

from pyspark.sql import functions as F

from tillroll.functions.exprs import currency, matches_any, n_unique, ratio, thousands, zero_sum


def test_zero_sum_all_null_group_is_zero(spark):
    df = spark.createDataFrame([("X", None), ("X", None), ("X", None)], "brand string, rev decimal(18,2)")
    row = df.groupBy("brand").agg(zero_sum("rev").alias("s")).first()
    assert row.s == 0


def test_n_unique_counts_null_once(spark):
    df = spark.createDataFrame([(1,), (1,), (None,)], "STORE_ID bigint")
    assert df.agg(n_unique("STORE_ID").alias("n")).first().n == 2
    no_null = spark.createDataFrame([(1,), (2,)], "STORE_ID bigint")
    assert no_null.agg(n_unique("STORE_ID").alias("n")).first().n == 2


def test_n_unique_empty_frame_is_zero(spark):
    df = spark.createDataFrame([], "STORE_ID bigint")
    assert df.agg(n_unique("STORE_ID").alias("n")).first().n == 0


def test_ratio_zero_or_null_denominator_is_null(spark):
    df = spark.createDataFrame([(Decimal("10.00"), Decimal("0.00")), (Decimal("10.00"), None),
                                (Decimal("10.00"), Decimal("4.00"))], "r decimal(18,2), u decimal(18,2)")
    got = [r.x for r in df.select(ratio("r", "u").alias("x")).collect()]
    assert got == [None, None, 2.5]


def test_matches_any_case_insensitive_and_null_aware(spark):
    rows = [("Packaged Beverages", None), (None, "sports DRINK"), (None, None), ("Snacks", "chips")]
    df = spark.createDataFrame(rows, "CATEGORY string, SUBCATEGORY string")
    got = [r.m for r in df.select(matches_any(["CATEGORY", "SUBCATEGORY"], ["BEVERAGE", "DRINK"]).alias("m")).collect()]
    assert got[0] is True and got[1] is True
    assert not got[2] and got[3] is False


def test_currency_and_thousands(spark):
    df = spark.createDataFrame([(1234.5, 1234567.0)], "a double, b double")
    row = df.select(currency("a").alias("c"), thousands("b").alias("t")).first()
    assert row.c == "$1,234.50"
    assert row.t == "1,234,567"


def test_ratio_is_double(spark):
    df = spark.range(1).select(ratio(F.lit(1), F.lit(3)).alias("x"))
    assert dict(df.dtypes)["x"] == "double"


def test_months_subtitle():
    from tillroll.operators.present import months_subtitle

    assert months_subtitle([1, 2, 3]) == "Months: 1, 2, 3"
