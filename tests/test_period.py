from pyspark.sql import functions as F

from tillroll.operators import period


def test_empty_month_list_gives_no_rows(small_tables):
    assert period.filter_daily(small_tables["daily"], None, []).count() == 0
    assert period.filter_sets(small_tables["sets"], 1996, []).count() == 0


def test_twelve_month_slices_sum_to_whole(small_tables):
    daily = small_tables["daily"]
    whole = daily.agg(F.sum("TOTAL_REVENUE_AMOUNT")).first()[0]
    parts = sum((period.filter_daily(daily, None, [m]).agg(F.sum("TOTAL_REVENUE_AMOUNT")).first()[0] or 0)
                for m in range(1, 13))
    assert parts == whole


def test_year_filter_matches_calendar_functions(small_tables):
    sets = small_tables["sets"]
    got = period.filter_sets(sets, 1996, [2, 3]).count()
    want = sets.where((F.year("DATE_TIME") == 1996) & F.month("DATE_TIME").isin(2, 3)).count()
    assert got == want


def test_items_in_period_never_increases_rows(small_tables):
    items, sets = small_tables["items"], small_tables["sets"]
    kept = period.items_in_period(items, period.filter_sets(sets, None, None)).count()
    assert kept <= items.count()


def test_slice_totals_zero_when_empty(small_tables):
    t = small_tables
    sl = period.period_slice(t, 1996, [])
    row = sl.totals().first()
    assert row.total_revenue == 0.0 and row.total_transactions == 0 and row.unique_stores == 0


def test_period_filter_reaches_parquet_scan(small_tables):
    plan = period.filter_sets(small_tables["sets"], 1996, [1]).select("TRANSACTION_SET_ID")._jdf \
        .queryExecution().executedPlan().toString()
    assert "PushedFilters" in plan and "o_orderdate" in plan.split("PushedFilters")[1][:400]


def test_invalid_month_rejected(small_tables):
    import pytest

    with pytest.raises(ValueError):
        period.filter_sets(small_tables["sets"], 1996, [13])


def test_december_range_crosses_year(small_tables):
    sets = small_tables["sets"]
    got = period.filter_sets(sets, 1996, [12]).count()
    want = sets.where((F.year("DATE_TIME") == 1996) & (F.month("DATE_TIME") == 12)).count()
    assert got == want
