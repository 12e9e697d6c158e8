import pytest
from pyspark.sql import functions as F

from tillroll.sources import tables
from tillroll.sources.schemas import STORE_TRACT


def test_materialize_partitioned_and_read_back(spark, small_tables, tmp_path):
    path = str(tmp_path / "daily")
    tables.materialize(small_tables["daily"], path, partition_by=["CALENDAR_YEAR", "CALENDAR_MONTH"])
    back = spark.read.parquet(path)
    assert back.count() == small_tables["daily"].count()
    plan = back.where((F.col("CALENDAR_YEAR") == 1996) & (F.col("CALENDAR_MONTH") == 1))._jdf \
        .queryExecution().executedPlan().toString()
    assert "PartitionFilters" in plan and "CALENDAR_YEAR" in plan.split("PartitionFilters")[1][:300]


def test_read_or_none(spark, tmp_path):
    assert tables.read_or_none(spark, str(tmp_path / "nope")) is None


def test_contract_checks_and_casts(spark):
    df = spark.createDataFrame([(1, "16", "051", "1")], "store_id int, STATEFP string, COUNTYFP string, TRACT string")
    out = tables.check_contract(df, STORE_TRACT)
    assert dict(out.dtypes)["STORE_ID"] == "string"
    with pytest.raises(ValueError):
        tables.check_contract(df.drop("TRACT"), STORE_TRACT)


def test_load_items_reads_every_part(spark, small_tables, tmp_path):
    path = str(tmp_path / "items")
    small_tables["items"].repartition(9).write.parquet(path)
    assert tables.load_items(spark, path).count() == small_tables["items"].count()


def test_refresh_rebuilds_derived_tables(spark, tmp_path):
    path = str(tmp_path / "t")
    spark.range(3).write.parquet(path)
    df = tables.cached(spark.read.parquet(path))
    assert df.count() == 3
    again = tables.refresh(spark, {path: lambda: spark.range(5)}, [df])
    assert again[path].count() == 5 and spark.read.parquet(path).count() == 5


def test_load_daily_normalises_week_column(spark, small_tables, tmp_path):
    path = str(tmp_path / "daily_src")
    small_tables["daily"].withColumnRenamed("CALENDAR_WEEK", "WEEk").write.parquet(path)
    d = tables.load_daily(spark, path)
    assert "CALENDAR_WEEK" in d.columns and "WEEk" not in d.columns
    assert d.count() == small_tables["daily"].count()
    kept = dict(small_tables["daily"].dtypes)
    assert dict(d.dtypes)["TOTAL_REVENUE_AMOUNT"] == kept["TOTAL_REVENUE_AMOUNT"]   # the scale it came in
    assert dict(d.dtypes)["QUANTITY"] == kept["QUANTITY"]


def _retail_folder(t, root):
    """A data folder as the stores deliver it: text basket ids, seven item parts, no calendar date."""
    text = lambda df, *cols: df.withColumns({c: F.col(c).cast("string") for c in cols})
    t["gtin"].write.parquet(f"{root}/cstore_master_ctin.parquet")
    t["stores"].withColumns({"LATITUDE": F.lit(43.6), "LONGITUDE": F.lit(-111.9)}).write.parquet(f"{root}/cstore_stores.parquet")
    text(t["sets"], "TRANSACTION_SET_ID").write.parquet(f"{root}/cstore_transaction_sets.parquet")
    text(t["items"], "TRANSACTION_SET_ID").repartition(7).write.parquet(f"{root}/transaction_items")
    t["daily"].drop("CALENDAR_DATE").withColumnRenamed("CALENDAR_WEEK", "WEEk").write.parquet(f"{root}/cstore_transactions_daily_agg.parquet")


def test_every_page_runs_from_a_data_folder(spark, small_tables, tmp_path):
    from tillroll.plans import pages
    from tillroll.sources import census, fixtures

    _retail_folder(small_tables, str(tmp_path))
    t = tables.load_folder(spark, str(tmp_path))
    assert set(t) == {"gtin", "stores", "sets", "items", "daily"}   # the four unused tables are optional
    assert dict(t["items"].dtypes)["TRANSACTION_SET_ID"] == "string"
    assert spark.table("items").count() == small_tables["items"].count()
    raw = fixtures.census_tables(spark, "/root/testdata/sf0.001", small_tables["stores"])
    parsed = {"store_tract": census.parse_geocode(raw["geocode_raw"]), "tract_acs": census.parse_tract_acs(raw["tract_raw"])}
    for name, make in {"home": lambda x: pages.home_page(x, 1997, [1, 2, 3]), "validation": pages.validation_page, "top": pages.top_products_page,
                       "brands": lambda x: pages.brands_page(x, min_transactions=0), "payments": pages.payments_page,
                       "demographics": lambda x: pages.demographics_page(x, parsed)}.items():
        got, want = make(t), make(small_tables)
        for frame in want:
            if frame not in ("enriched", "pending_stores"):   # the folder's stores have coordinates
                assert sorted(map(str, got[frame].collect())) == sorted(map(str, want[frame].collect())), (name, frame)


def test_missing_column_is_reported(spark, small_tables):
    from tillroll.sources.schemas import STORES

    with pytest.raises(ValueError, match="STATE"):
        tables.check_contract(small_tables["stores"].drop("STATE"), STORES, "stores")


def test_amounts_keep_their_scale(spark):
    from tillroll.sources.schemas import ITEMS

    df = spark.sql("SELECT 'a' AS TRANSACTION_SET_ID, 1 AS GTIN, CAST(12.3456 AS DECIMAL(12,4)) AS UNIT_QUANTITY, 3.459D AS GRAND_TOTAL_AMOUNT")
    row = tables.check_contract(df, ITEMS).first()
    assert str(row.UNIT_QUANTITY) == "12.3456" and row.GRAND_TOTAL_AMOUNT == 3.459
