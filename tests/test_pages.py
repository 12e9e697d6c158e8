from tillroll.plans import pages
from tillroll.sources import fixtures


def test_every_page_pulls_and_releases(spark, small_tables, tmp_path):
    t = small_tables
    census_raw = fixtures.census_tables(spark, "/root/testdata/sf0.001", t["stores"])
    parsed = pages.land_census(census_raw, str(tmp_path / "census"))
    built = [
        pages.home_page(t, 1996, [1, 2, 3]),
        pages.validation_page(t),
        pages.top_products_page(t, None, None, target=1000.0),
        pages.brands_page(t, None, None, min_transactions=0),
        pages.payments_page(t, None, None, ("CASH", "CREDIT", "DEBIT")),
        pages.demographics_page(t, parsed),
        pages.demographics_page(t, {k: v for k, v in parsed.items() if k != "county_acs"}, clean=True),
    ]
    for page in built:
        for name, df in page.items():
            df.collect()
        if hasattr(page, "release"):
            page.release()
    top = pages.top_products_page(t, persist=False, target=1000.0)
    assert 0 < top["top"].count() <= 5
    assert "target" in top["weekly"].columns
    pay = pages.payments_page(t, persist=False)
    assert {r.PAYMENT_TYPE for r in pay["summary"].collect()} <= {"CASH", "CREDIT"}


def test_page_kpis_agree_with_registered_queries(spark, small_tables):
    from tillroll.plans import queries

    home = pages.home_page(small_tables, queries.YEAR, queries.MONTHS)["kpis"].first().asDict()
    q = queries.home_kpis(spark, "/root/testdata/sf0.001").first().asDict()
    act = queries.store_activity(spark, "/root/testdata/sf0.001").first()
    assert home.pop("active_ever") == act.active_ever
    assert home == q
