import numpy as np

from tillroll.operators import demographics
from tillroll.sources.schemas import ACS_VARS, COUNTY_ACS, TRACT_ACS


def _stores(spark):
    return spark.createDataFrame([(1, "ID", "Springfield"), (2, "ID", "Riverton"), (3, "UT", "Logan")],
                                 "STORE_ID bigint, STATE string, CITY string")


def test_enrich_keeps_every_store_and_handles_case_clash(spark):
    st = spark.createDataFrame([("1", "16", "051", "970100"), ("2", None, None, None)],
                               "STORE_ID string, STATEFP string, COUNTYFP string, TRACT string")
    tract = spark.createDataFrame([("16", "051", "970100", *[str(100 + i) for i in range(10)])], TRACT_ACS)
    county = spark.createDataFrame([(*[str(900 + i) for i in range(10)], "Jefferson County", "16", "051")], COUNTY_ACS)
    perf = spark.createDataFrame([("1", 10, 2)], "STORE_ID string, revenue long, transactions long")
    out = demographics.enrich_stores(_stores(spark), st, tract, county, perf)
    rows = {r.STORE_ID: r for r in out.collect()}
    assert len(rows) == 3
    assert rows["1"].STATE == "ID" and rows["1"].county_NAME == "Jefferson County"
    assert rows["1"].B01003_001E == "100" and rows["1"]["county_B01003_001E"] == "900"
    assert rows["1"].COUNTYFP == "051"
    assert rows["2"].B01003_001E is None and rows["3"].revenue is None
    assert "state" not in out.columns and "county_state" not in out.columns


def test_missing_county_behaves_as_empty(spark):
    st = spark.createDataFrame([("1", "16", "051", "970100")], "STORE_ID string, STATEFP string, COUNTYFP string, TRACT string")
    tract = spark.createDataFrame([], TRACT_ACS)
    out = demographics.enrich_stores(_stores(spark), st, tract, None, None)
    assert out.count() == 3 and all(f"county_{v}" in out.columns for v in ACS_VARS)


def test_state_summary_and_annotation_cleaning(spark):
    rows = [("1", "ID", "100", "50000", "5", "200000"), ("2", "ID", "300", "-666666666", "7", "100000"),
            ("3", "ID", None, "1", "1", "1")]
    df = spark.createDataFrame(rows, "STORE_ID string, STATE string, B01003_001E string, B19019_001E string, "
                                     "B17001_002E string, B25077_001E string")
    s = demographics.state_summary(demographics.valid_stores(df)).first()
    assert s.store_count == 2 and s.avg_income == (50000 - 666666666) / 2
    c = demographics.state_summary(demographics.valid_stores(demographics.clean_annotations(df))).first()
    assert c.store_count == 1 and c.avg_income == 50000.0


def test_box_stats_matches_numpy(spark):
    rng = np.random.default_rng(7)
    vals = {"A": rng.integers(0, 1000, 57).tolist(), "B": rng.integers(0, 50, 10).tolist()}
    rows = [(k, float(v)) for k, vs in vals.items() for v in vs]
    df = spark.createDataFrame(rows, "STATE string, income double")
    got = {r.STATE: r for r in demographics.box_stats(df, "STATE", "income").collect()}
    for k, vs in vals.items():
        q1, q2, q3 = np.percentile(vs, [25, 50, 75])
        assert abs(got[k].q1 - round(q1, 4)) < 1e-9 and abs(got[k].median - round(q2, 4)) < 1e-9
        assert abs(got[k].upper_fence - (round(q3, 4) + 1.5 * (round(q3, 4) - round(q1, 4)))) < 1e-6
        assert got[k].min == min(vs) and got[k].max == max(vs)
