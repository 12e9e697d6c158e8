"""Work and memory that must not outgrow the input: responses parsed once, rows of a task bounded by the files' size."""

import numpy as np
from pyspark.sql import functions as F

from tillroll.operators import rollup
from tillroll.sources import census, fixtures, tables

SF = "/root/testdata/sf0.01"


def test_quarantine_parses_a_response_once(spark):
    """The reason is made from one parsed column: no filter on it goes below the parsing and no use parses again."""
    ids = spark.range(20).select(F.col("id").cast("int").alias("s_suppkey"), F.lit(1).alias("s_nationkey"), F.lit("n").alias("s_name"))
    raw = fixtures.supplier_county_payloads(ids)
    plan = census.quarantine(raw, "county")._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("from_json") == 1 and plan.count("try_parse_json") <= 1
    assert "Filter" not in plan
    counts = {(r["source"], r["reason"]): r["n"] for r in census.reason_counts({"county": raw}).collect()}
    assert counts == {("county", "short_row"): 4}


def test_parts_follow_the_files_size(spark, tmp_path):
    rows = spark.createDataFrame([(float(x),) for x in np.random.default_rng(1).random(20_000)], "v double")
    rows.coalesce(1).write.parquet(str(tmp_path / "t"))
    t = spark.read.parquet(str(tmp_path / "t"))
    own = int(spark.conf.get("spark.sql.shuffle.partitions"))
    assert tables.parts_for(t) == own
    assert 12 <= tables.parts_for(t.select("v"), 10_000) <= 40     # 160 kB and what Parquet adds
    assert tables.parts_for(t, 1, most=50) == 50
    assert tables.parts_for(spark.createDataFrame([(1,)], "v int"), 1, most=50) <= 50


def test_rollup_parts_are_not_merged_by_their_bytes(spark, monkeypatch):
    """The per-basket sums run on parts numbered by the lines' size, which AQE leaves alone, and once per task."""
    monkeypatch.setattr(rollup, "parts_for", lambda df: 13, raising=False)
    t = fixtures.retail_tables(spark, SF)
    df = rollup.daily_rollup(t["items"], t["sets"], t["gtin"])
    df.write.format("noop").mode("overwrite").save()
    plan = df._jdf.queryExecution().executedPlan().toString()
    assert "SKUPOS_DESCRIPTION" in plan and ", 13), REPARTITION_BY_NUM" in plan
