import re

from tillroll.plans.queries import QUERIES

SF = "/root/testdata/sf0.01"


def _plan(df):
    return df._jdf.queryExecution().executedPlan().toString()


def test_entry_runs_with_stable_schema(spark):
    from __spark_entry__ import entry

    df = entry(spark)
    assert df.columns == ["BRAND", "SKUPOS_DESCRIPTION", "CATEGORY", "total_revenue", "total_units",
                          "total_transactions", "avg_price"]
    assert 0 < df.count() <= 5


def test_top_k_is_take_ordered(spark):
    assert "TakeOrderedAndProject" in _plan(QUERIES["top_products"](spark, SF))


def test_top_n_per_group_uses_partial_window_group_limit(spark):
    plan = _plan(QUERIES["top_products_by_payment"](spark, SF))
    assert re.search(r"WindowGroupLimit .*Partial", plan)


def test_semi_join_for_period_items(spark):
    plan = _plan(QUERIES["items_in_period"](spark, SF))
    assert "LeftSemi" in plan


def test_one_pass_answers_the_top_list_and_its_weeks(spark):
    """The top list and its weeks read the product x week frame written once, not the lines, and nothing stays cached."""
    for name in ("weekly_top_products", "top_products_kpis", "weekly_top_products_period"):
        df = QUERIES[name](spark, SF)
        plan = df._jdf.queryExecution().optimizedPlan().toString()
        assert "l_orderkey" not in plan and "InMemoryRelation" not in plan
        assert df.count() > 0


def test_building_a_query_starts_no_count_job(spark):
    tracker = spark.sparkContext.statusTracker()
    spark.sparkContext.setJobGroup("build", "build")
    try:
        for name in ("top_products", "payment_summary_published", "daily_rollup"):
            QUERIES[name](spark, SF)
        jobs = [j for j in tracker.getJobIdsForGroup("build")]
        # reading a Parquet footer for the schema may start a job of one task; nothing else does
        assert all(tracker.getStageInfo(s) is None or tracker.getStageInfo(s).numTasks <= 1 for j in jobs for s in tracker.getJobInfo(j).stageIds)
    finally:
        spark.sparkContext.setLocalProperty("spark.jobGroup.id", None)


def test_period_reaches_the_basket_scan(spark):
    for name in ("filter_year_month", "home_kpis", "store_activity"):
        plan = QUERIES[name](spark, SF)._jdf.queryExecution().toString()
        pushed = [x for x in re.findall(r"PushedFilters: \[([^\]]*)", plan)]
        assert any("GreaterThanOrEqual(o_orderdate" in x and "LessThan(o_orderdate" in x for x in pushed), name


def test_basket_aggregate_reuses_join_partitioning(spark):
    """With no broadcast (as at scale) the first aggregate over the joined lines sits in the same stage as the
    basket join: no exchange between them."""
    old = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    aqe = spark.conf.get("spark.sql.adaptive.enabled")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    spark.conf.set("spark.sql.adaptive.enabled", "false")
    try:
        from tillroll.operators import payments
        from tillroll.sources import fixtures

        t = fixtures.retail_tables(spark, SF)
        plan = _plan(payments.payment_lines(t["sets"], t["items"], t["gtin"]).baskets)
        above = plan[: plan.index("SortMergeJoin")]
        assert "HashAggregate" in above and "Exchange" not in above
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", old)
        spark.conf.set("spark.sql.adaptive.enabled", aqe)


def test_scans_read_only_needed_columns(spark):
    plan = _plan(QUERIES["payment_summary_line"](spark, SF))
    scan = [l for l in plan.splitlines() if "FileScan parquet" in l and "l_orderkey" in l][0]
    assert "l_shipdate" not in scan and "l_comment" not in scan
