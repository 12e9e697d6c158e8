"""Invariants from the test plan, on the driver's smallest tables."""

from pyspark.sql import functions as F

from tillroll.operators import demographics, payments
from tillroll.sources import tables


def test_basket_spend_never_exceeds_published(small_tables):
    t = small_tables
    lines = payments.payment_lines(t["sets"], t["items"], t["gtin"])
    pub = {r.PAYMENT_TYPE: r.total_spend for r in payments.payment_summary(lines, "basket_per_line").collect()}
    per = {r.PAYMENT_TYPE: r.total_spend for r in payments.payment_summary(lines, "basket").collect()}
    assert pub.keys() == per.keys() and all(per[k] <= pub[k] for k in pub)


def test_store_count_preserved_by_enrichment(small_tables):
    t = small_tables
    perf = demographics.store_performance(t["daily"])
    empty_tract = t["stores"].sparkSession.createDataFrame(
        [], "STORE_ID string, STATEFP string, COUNTYFP string, TRACT string")
    from tillroll.sources.schemas import TRACT_ACS
    out = demographics.enrich_stores(t["stores"], empty_tract,
                                     t["stores"].sparkSession.createDataFrame([], TRACT_ACS), None, perf)
    assert out.count() == t["stores"].count()
    # revenue over all stores equals the daily total (no fan-out, nothing lost)
    total = out.agg(F.sum("revenue")).first()[0]
    assert total == t["daily"].agg(F.sum("TOTAL_REVENUE_AMOUNT")).first()[0]


def test_register_exposes_views(spark, small_tables):
    tables.register(spark, {"gtin_v": small_tables["gtin"], "sets_v": small_tables["sets"]})
    n = spark.sql("SELECT count(*) AS n FROM gtin_v").first().n
    assert n == small_tables["gtin"].count()


def test_daily_revenue_equals_line_revenue_of_known_baskets(small_tables):
    t = small_tables
    joined = t["items"].join(t["sets"].select("TRANSACTION_SET_ID"), "TRANSACTION_SET_ID", "left_semi")
    want = joined.agg(F.sum("GRAND_TOTAL_AMOUNT")).first()[0]
    assert t["daily"].agg(F.sum("TOTAL_REVENUE_AMOUNT")).first()[0] == want


def test_table_profile_approx_close_to_exact(small_tables):
    from tillroll.operators import kpis

    spec = [("items", small_tables["items"], "GTIN")]
    exact = kpis.table_profile(spec).first().n_distinct
    approx = kpis.table_profile(spec, approx=True).first().n_distinct
    assert abs(approx - exact) <= 0.06 * exact
