"""Property test: daily_rollup equals a pandas brute force on random
baskets (null attributes, repeated products in a basket, GTINs sharing
attributes, lines whose basket is missing, products missing from the master)."""

import datetime as dt
from decimal import Decimal

import pandas as pd
from hypothesis import HealthCheck, given, settings
from hypothesis import strategies as st

from tillroll.operators.rollup import daily_rollup

ATTR = st.sampled_from(["A", "B", None])
money = st.integers(0, 99999).map(lambda c: Decimal(c) / 100)

line = st.tuples(st.integers(1, 12), st.integers(1, 8), st.integers(0, 20).map(Decimal), money)
basket = st.tuples(st.integers(0, 40), st.integers(1, 3))  # day offset, store
product = st.tuples(ATTR, ATTR, ATTR, ATTR)


def _expected(items, sets, gtin):
    j = items.merge(sets, on="TRANSACTION_SET_ID").merge(gtin, on="GTIN", how="left")
    keys = ["CALENDAR_DATE", "STORE_ID", "CATEGORY", "SUBCATEGORY", "BRAND", "SKUPOS_DESCRIPTION"]
    j["CALENDAR_DATE"] = j.DATE_TIME.dt.date
    j = j.fillna({k: "<null>" for k in keys[2:]})
    g = j.groupby(keys)
    out = {}
    for k, grp in g:
        out[tuple(None if x == "<null>" else x for x in k)] = (
            sum(grp.GRAND_TOTAL_AMOUNT), sum(grp.UNIT_QUANTITY), grp.TRANSACTION_SET_ID.nunique())
    return out


@settings(max_examples=12, deadline=None, suppress_health_check=[HealthCheck.function_scoped_fixture])
@given(lines=st.lists(line, min_size=1, max_size=40), baskets=st.lists(basket, min_size=1, max_size=10),
       products=st.lists(product, min_size=1, max_size=7))
def test_daily_rollup_matches_brute_force(spark, lines, baskets, products):
    start = dt.datetime(2024, 12, 20)
    sets = pd.DataFrame([(i + 1, start + dt.timedelta(days=d, hours=i % 5), s) for i, (d, s) in enumerate(baskets)],
                        columns=["TRANSACTION_SET_ID", "DATE_TIME", "STORE_ID"])
    gtin = pd.DataFrame([(i + 1, *p) for i, p in enumerate(products)],
                        columns=["GTIN", "CATEGORY", "SUBCATEGORY", "BRAND", "SKUPOS_DESCRIPTION"])
    items = pd.DataFrame(lines, columns=["TRANSACTION_SET_ID", "GTIN", "UNIT_QUANTITY", "GRAND_TOTAL_AMOUNT"])

    s_sets = spark.createDataFrame(sets, "TRANSACTION_SET_ID bigint, DATE_TIME timestamp_ntz, STORE_ID bigint")
    s_gtin = spark.createDataFrame(gtin.astype(object).where(gtin.notna(), None),
                                   "GTIN bigint, CATEGORY string, SUBCATEGORY string, BRAND string, SKUPOS_DESCRIPTION string")
    s_items = spark.createDataFrame(items, "TRANSACTION_SET_ID bigint, GTIN bigint, UNIT_QUANTITY decimal(18,2), "
                                           "GRAND_TOTAL_AMOUNT decimal(18,2)")
    got = {(r.CALENDAR_DATE, r.STORE_ID, r.CATEGORY, r.SUBCATEGORY, r.BRAND, r.SKUPOS_DESCRIPTION):
           (r.TOTAL_REVENUE_AMOUNT, r.QUANTITY, r.TRANSACTION_COUNT)
           for r in daily_rollup(s_items, s_sets, s_gtin).collect()}
    assert got == _expected(items, sets, gtin)
