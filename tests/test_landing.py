import datetime as dt
import json

from tillroll.sources import census
from tillroll.sources.schemas import GEOCODE_RAW


def _payload(tract):
    return json.dumps({"result": {"geographies": {"Census Tracts": [{"STATE": "16", "COUNTY": "051", "TRACT": tract}]}}})


def test_failed_retry_keeps_the_earlier_tract(spark):
    from pyspark.sql import functions as F

    t0, t1 = dt.datetime(2024, 1, 1), dt.datetime(2024, 1, 2)
    raw = spark.createDataFrame([("1", _payload("000100"), t0), ("1", "Gateway Time-out", t1), ("2", "bad", t0)], GEOCODE_RAW)
    parsed = census.parse_geocode(raw)
    kept = census.latest(parsed, ["STORE_ID"], ok=F.col("TRACT").isNotNull())
    assert {r.STORE_ID: r.TRACT for r in kept.collect()} == {"1": "000100", "2": None}
    stores = spark.createDataFrame([(1, 43.0, -111.0), (2, 44.0, -112.0), (3, None, None)], "STORE_ID bigint, LATITUDE double, LONGITUDE double")
    assert {r.STORE_ID for r in census.pending_stores(stores, kept).collect()} == {"2", "3"}


def test_read_if_fresh(spark):
    from pyspark.sql import functions as F

    from tillroll.sources.tables import read_if_fresh

    now = dt.datetime(2024, 1, 1, 12, 0, 0)
    df = spark.createDataFrame([("a", now - dt.timedelta(hours=1)), ("b", now - dt.timedelta(hours=3))],
                               "k string, fetched_at timestamp")
    got = read_if_fresh(df, 7200, now=F.lit(now).cast("timestamp")).collect()
    assert [r.k for r in got] == ["a"]


def test_land_census_keeps_latest_response_per_key(spark, tmp_path):
    from tillroll.plans import pages
    from tillroll.sources.schemas import COUNTY_RAW, TRACT_RAW

    t0, t1 = dt.datetime(2024, 1, 1), dt.datetime(2024, 1, 2)
    geo = spark.createDataFrame([("1", _payload("000100"), t0), ("1", _payload("000200"), t1)], GEOCODE_RAW)
    tract = spark.createDataFrame([], TRACT_RAW)
    county = spark.createDataFrame([], COUNTY_RAW)
    out = pages.land_census({"geocode_raw": geo, "tract_raw": tract, "county_raw": county}, str(tmp_path / "c"))
    rows = out["store_tract"].collect()
    assert len(rows) == 1 and rows[0].TRACT == "000200"


def test_land_census_ttl_drops_stale_responses(spark, tmp_path):
    from tillroll.plans import pages
    from tillroll.sources.schemas import COUNTY_RAW, TRACT_RAW

    now = dt.datetime.now()
    geo = spark.createDataFrame([("1", _payload("000100"), now - dt.timedelta(hours=5)),
                                 ("2", _payload("000200"), now - dt.timedelta(minutes=5))], GEOCODE_RAW)
    raw = {"geocode_raw": geo, "tract_raw": spark.createDataFrame([], TRACT_RAW),
           "county_raw": spark.createDataFrame([], COUNTY_RAW)}
    out = pages.land_census(raw, str(tmp_path / "c"), ttl_seconds=7200)
    assert [r.STORE_ID for r in out["store_tract"].collect()] == ["2"]
