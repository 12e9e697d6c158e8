import json

from tillroll.sources import census
from tillroll.sources.schemas import ACS_VARS

GEO_OK = json.dumps({"result": {"geographies": {"Census Tracts": [{"STATE": "16", "COUNTY": "051", "TRACT": "970100"}]}}})
GEO_EMPTY = json.dumps({"result": {"geographies": {"Census Tracts": []}}})


def test_parse_geocode_cases(spark):
    raw = spark.createDataFrame([("1", GEO_OK), ("2", GEO_EMPTY), ("3", "<html>oops"), ("4", None)],
                                "STORE_ID string, payload string")
    got = {r.STORE_ID: (r.STATEFP, r.COUNTYFP, r.TRACT) for r in census.parse_geocode(raw).collect()}
    assert got["1"] == ("16", "051", "970100")          # leading zeros stay text
    assert got["2"] == got["3"] == got["4"] == (None, None, None)


def _tract_payload(values, header_only=False):
    header = list(ACS_VARS) + ["state", "county", "tract"]
    return json.dumps([header] if header_only else [header, list(values) + ["16", "051", "970100"]])


def test_parse_tract_acs_cases(spark):
    vals = [str(i) for i in range(10)]
    vals[2] = "-666666666"
    vals[4] = None
    raw = spark.createDataFrame([
        ("16", "051", "970100", _tract_payload(vals)),
        ("16", "051", "970200", _tract_payload(None, header_only=True)),
        ("16", "051", "970300", "garbage"),
    ], "STATEFP string, COUNTYFP string, TRACT string, payload string")
    rows = census.parse_tract_acs(raw).collect()
    assert len(rows) == 1
    r = rows[0].asDict()
    assert r["TRACT"] == "970100" and r["B01003_001E"] == "0"
    assert r["B19019_001E"] == "-666666666" and r["B17001_002E"] is None
    assert r["B08201_001E"] == "9"


def test_parse_county_acs_header_lookup_and_short_rows(spark):
    header = ["NAME"] + list(ACS_VARS) + ["county", "state"]     # order differs from request order
    full = ["Ada County"] + [str(i) for i in range(10)] + ["001", "16"]
    short = ["Bear Lake"] + [str(i) for i in range(10)]
    raw = spark.createDataFrame([(json.dumps([header, full, short]),)], "payload string")
    rows = {r.NAME: r for r in census.parse_county_acs(raw).collect()}
    assert rows["Ada County"].county == "001" and rows["Ada County"].state == "16"
    assert rows["Ada County"].B19019_001E == "2"
    assert rows["Bear Lake"].county is None


def test_pending_keys_incremental(spark):
    keys = spark.createDataFrame([("16", "051", "1"), ("16", "051", "1"), ("16", "051", "2"), ("16", None, "3")],
                                 "STATEFP string, COUNTYFP string, TRACT string")
    landed = spark.createDataFrame([("16", "051", "1")], "STATEFP string, COUNTYFP string, TRACT string")
    got = census.pending_keys(keys, landed, ["STATEFP", "COUNTYFP", "TRACT"]).collect()
    assert [tuple(r) for r in got] == [("16", "051", "2")]
