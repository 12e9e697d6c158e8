"""The kept cube, sketches, exact quantiles, one pass over payments, quarantine, and the hand-off in batches."""

import random
import re

import pytest
from pyspark.sql import functions as F

from tillroll.operators import cube, demographics, payments, period, products, sketches
from tillroll.plans import pages
from tillroll.sources import census, client, fixtures, tables

SF = "/root/testdata/sf0.001"


def _rows(df):
    return sorted((tuple(r) for r in df.collect()), key=str)


@pytest.fixture(scope="module")
def kept(spark, tmp_path_factory):
    t = fixtures.retail_tables(spark, SF)
    path = str(tmp_path_factory.mktemp("cube"))
    daily = t["daily"].unionByName(t["daily"].limit(40).withColumns({c: F.lit(None).cast("int") for c in cube.CALENDAR}))   # undated days
    cube.write_cube(daily, path)
    return daily, cube.read_cube(spark, path)


def test_cube_answers_like_the_days(kept):
    daily, c = kept
    for p in [(None, None), (1997, None), (1997, tuple(range(1, 13))), (1997, (1, 2, 3)), (None, (5,)), (1997, ()), (1890, None)]:
        days = period.filter_daily(daily, *p)
        assert _rows(products.product_totals(c.products(*p))) == _rows(products.product_totals(days)), p
        assert _rows(products.product_weeks(c.weeks(*p))) == _rows(products.product_weeks(days)), p
    assert _rows(products.product_totals(c.products(everything=True))) == _rows(products.product_totals(daily))
    assert _rows(products.product_weeks(c.weeks(everything=True))) == _rows(products.product_weeks(daily))


def test_cube_reads_one_level(kept):
    _, c = kept
    for df, level in ((c.products(everything=True), "product"), (c.products(1997), "year"), (c.products(1997, (1,)), "month"), (c.weeks(1997), "week")):
        files = {f for f in df.select("_metadata.file_path").distinct().toPandas()["file_path"]} if "_metadata" in df.columns else set(df.inputFiles())
        plan = df._jdf.queryExecution().executedPlan().toString()
        assert re.search(rf"PartitionFilters: \[[^\]]*LEVEL[^\]]* = {level}", plan) and files


def test_top_products_page_from_the_cube_reads_no_lines(spark, kept):
    t = fixtures.retail_tables(spark, SF)
    path_free = dict(pages.top_products_page({**t, "cube": kept[1]}, 1997, (1, 2, 3), persist=False))
    plain = dict(pages.top_products_page({**t, "daily": kept[0]}, 1997, (1, 2, 3), persist=False))
    assert set(path_free) == set(plain)
    for name, df in path_free.items():
        assert "l_orderkey" not in df._jdf.queryExecution().executedPlan().toString()
        assert _rows(df) == _rows(plain[name]), name


def test_payments_page_scans_the_lines_once(spark):
    t = fixtures.retail_tables(spark, SF)
    page = pages.payments_page(t, 1997, None, payments.PAYMENT_TYPES)
    try:
        for name, df in page.items():
            plan = df._jdf.queryExecution().optimizedPlan().toString()
            assert plan.count("InMemoryRelation") == 1 and "l_orderkey" not in plan.split("InMemoryRelation")[0], name
        stored = page.cached[0]._jdf.queryExecution().executedPlan().toString()
        assert len(page.cached) == 1 and len({x for x in re.findall(r"FileScan parquet \[l_orderkey#\d+", stored)}) == 1
    finally:
        page.release()


def test_payment_cube_equals_the_two_passes(spark):
    t = fixtures.retail_tables(spark, SF)
    twice = t["gtin"].unionByName(t["gtin"].where("GTIN % 7 = 0")).unionByName(t["gtin"].where("GTIN % 5 = 0").withColumn("CATEGORY", F.lit("OTHER")))
    for gtin in (t["gtin"], twice, t["gtin"].where("false")):
        lines = payments.payment_lines(t["sets"], t["items"].unionByName(t["items"].limit(20).withColumn("GTIN", F.lit(None).cast("long"))), gtin)
        c = payments.payment_cube(lines)
        for basis in payments.AMOUNT_BASES:
            assert _rows(payments.payment_summary(lines, basis, c)) == _rows(payments.payment_summary(lines, basis))
        assert _rows(payments.product_by_payment(lines, c)) == _rows(payments.product_by_payment(lines))


def test_quantiles_equal_percentile(spark):
    r = random.Random(2)
    rows = [(g, r.choice([None, 1.0, 2.5, r.random() * 100, -3.0])) for g in ("a", "b", None) for _ in range(r.randint(50, 200))]
    rows += [("one", 4.0), ("two", 1.0), ("two", 2.0), ("nulls", None), ("same", 7.0)] + [("same", 7.0)] * 9
    df = spark.createDataFrame(rows, "g string, v double")
    p = [0.25, 0.5, 0.75, 0.0, 1.0, 0.1]
    want = df.groupBy("g").agg(F.percentile("v", F.array(*[F.lit(x) for x in p])).alias("q"), F.min("v").alias("min"), F.max("v").alias("max"))
    got = {x[0]: x[1:] for x in _rows(demographics.quantiles(df, "g", F.col("v"), p))}
    for g, q, lo, hi in _rows(want):
        assert got[g] == (*(q or [None] * len(p)), lo, hi) if q is None else got[g] == pytest.approx((*q, lo, hi), rel=1e-12)
    plan = demographics.box_stats(df, "g", "v")._jdf.queryExecution().optimizedPlan().toString()
    assert "percentile" not in plan
    assert demographics.box_stats(df.where("false"), "g", "v").count() == 0


def test_sketches_merge_over_periods(spark, tmp_path):
    """Many baskets, so estimates are not exact: each period's union is within three standard errors."""
    ids = spark.range(120_000)
    sets = ids.select(F.col("id").alias("TRANSACTION_SET_ID"), F.when(F.col("id") % 50 > 0, F.col("id") % 7000).alias("STORE_ID"),
                      (F.lit("1997-01-01").cast("timestamp") + F.make_interval(days=(F.col("id") % 360).cast("int"))).alias("DATE_TIME"))
    items = ids.select(F.col("id").alias("TRANSACTION_SET_ID"), (F.hash("id") % 30_000).alias("GTIN")).unionByName(ids.select(F.col("id") + 1_000_000, "id").toDF("TRANSACTION_SET_ID", "GTIN"))
    path = str(tmp_path / "s")
    tables.materialize(sketches.daily_sketches(items, sets), path, partition_by=period.PERIOD)
    kept = spark.read.parquet(path)
    assert kept.count() == 360
    for p in [(None, None), (1997, (1, 2, 3)), (1997, (12,)), (1998, None)]:
        got = {r["key"]: r["estimate"] for r in sketches.distinct_over(kept, *p).collect()}
        sold = items.join(period.filter_sets(sets, *p), "TRANSACTION_SET_ID").cache()
        for k in sketches.KEYS:
            exact = sold.select(k).distinct().count()
            assert abs(got[k] - exact) <= 3 * sketches.standard_error() * exact, (p, k, got[k], exact)
        sold.unpersist()


GEO = '{"result":{"geographies":{"Census Tracts":[%s]}}}'
ONE = '{"STATE":"16","COUNTY":"001","TRACT":"000100"}'


def test_reasons(spark):
    cases = {
        "geocode": [(None, "empty"), ("  ", "empty"), ("{", "malformed"), ("[1]", "malformed"), ('{"result":null}', "malformed"), (GEO % "", "no_tract"),
                    (GEO % '{"STATE":"16","COUNTY":"001"}', "missing_field"), (GEO % "null", "missing_field"), (GEO % ONE, None), (GEO % f"{ONE},{{}}", None)],
        "tract": [(None, "empty"), ("<html>", "malformed"), ('{"a":1}', "malformed"), ('["a"]', "malformed"), ('[["a","b"]]', "header_only"), ('[["a","b"],["1"]]', "short_row"), ('[["a","b"],["1",null]]', None)],
    }
    names = [*census.ACS_VARS, "NAME", "state", "county"]
    head = "[" + ",".join(f'"{n}"' for n in names) + "]"
    row = "[" + ",".join(['"1"'] * len(names)) + "]"
    cases["county"] = [("", "empty"), ("nope", "malformed"), ('[["a"],["1"]]', "no_header"), (f"[{head}]", "header_only"), (f"[{head},{row},[\"1\"]]", "short_row"), (f"[{head},{row}]", None)]
    for kind, rows in cases.items():
        df = spark.createDataFrame([(i, p) for i, (p, _) in enumerate(rows)], "id int, payload string")
        got = {r["id"]: r["reason"] for r in census.quarantine(df, kind, ["id"]).collect()}
        assert got == {i: why for i, (_, why) in enumerate(rows) if why}, kind
    with pytest.raises(ValueError, match="kind"):
        census.reason("zip")


def test_work_list_names_the_latest_reason(spark):
    raw = spark.createDataFrame([("1", "{", "2024-01-01"), ("1", GEO % "", "2024-01-02"), ("2", GEO % ONE, "2024-01-01"), ("3", None, "2024-01-01")], "STORE_ID string, payload string, t string")
    raw = raw.select("STORE_ID", "payload", F.col("t").cast("timestamp").alias("fetched_at"))
    stores = spark.createDataFrame([("1",), ("2",), ("3",), ("4",)], "STORE_ID string")
    pending = census.pending_stores(stores, census.parse_geocode(raw))
    assert _rows(census.work_list(pending, census.quarantine(raw, "geocode", ["STORE_ID"]), ["STORE_ID"])) == [("1", "no_tract"), ("3", "empty"), ("4", "never_fetched")]


def test_batches_hand_over_every_row_in_order(spark):
    df = spark.range(100_000).select((F.col("id") % 3).alias("tie"), (F.lit(100_000) - F.col("id")).alias("k"), F.lit("x" * 50).alias("text"))
    seen, sizes = [], []
    for frame in client.to_client_batches(df, ["tie", "k"], rows=7_000):
        sizes.append(len(frame))
        seen += list(zip(frame["tie"], frame["k"]))
    assert seen == sorted(seen) and len(set(seen)) == 100_000
    assert max(sizes) <= 7_000
    assert [list(f.columns) for f in client.to_client_batches(df.where("false"))] == [["tie", "k", "text"]]
