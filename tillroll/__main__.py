"""Command line: print the result frames of one dashboard page.

    python -m tillroll payments --sf /root/testdata/sf0.1 --year 1997 --months 1,2,3
    python -m tillroll top_products --categories "Energy Drinks,STANDARD" --target 50000
    python -m tillroll demographics --geocode G --tract T --county C   # landed response tables

Pages: home, validation, top_products, brands, payments, demographics.
Without ``--geocode/--tract/--county`` the demographics page uses responses
derived from the fixture tables. Each frame is pulled through the client
edge whole, in its display order. ``--data`` reads the nine retail tables of a
folder; the demographics page then needs the landed responses.
"""

from __future__ import annotations

import argparse

import pandas as pd
from pyspark.sql import functions as F


def _ints(text: str | None):
    return [int(x) for x in text.split(",")] if text else None


def main(argv: list[str] | None = None) -> None:
    ap = argparse.ArgumentParser(prog="python -m tillroll")
    ap.add_argument("page", choices=["home", "validation", "top_products", "brands", "payments", "demographics"])
    ap.add_argument("--sf", default="/root/testdata/sf0.1", help="folder of the fixture tables")
    ap.add_argument("--data", help="folder of the nine retail tables (instead of --sf)")
    ap.add_argument("--year", type=int, default=None, help="calendar year (default: all years)")
    ap.add_argument("--months", default=None, help="comma list, e.g. 1,2,3 (default: all)")
    ap.add_argument("--categories", default=None, help="top products: comma list of categories")
    ap.add_argument("--target", type=float, default=None, help="top products: target line value")
    ap.add_argument("--threshold", type=float, default=None, help="brands: revenue threshold line")
    ap.add_argument("--min-transactions", type=int, default=None)
    ap.add_argument("--rank-by", default="revenue", choices=["revenue", "units", "transactions"])
    ap.add_argument("--types", default="CASH,CREDIT", help="payments: comma list of payment types")
    ap.add_argument("--amount-basis", default="basket_per_line", choices=["basket_per_line", "basket", "line"])
    ap.add_argument("--geocode", help="demographics: landed geocode responses (Parquet)")
    ap.add_argument("--tract", help="demographics: landed tract ACS responses (Parquet)")
    ap.add_argument("--county", help="demographics: landed county ACS responses (Parquet)")
    ap.add_argument("--clean", action="store_true", help="demographics: drop ACS annotation codes")
    a = ap.parse_args(argv)

    from tillroll.operators import brands, demographics, products
    from tillroll.plans import pages
    from tillroll.session import local_session
    from tillroll.sources import census, client, fixtures, tables

    spark = local_session()
    t = tables.load_folder(spark, a.data) if a.data else fixtures.retail_tables(spark, a.sf)
    months = _ints(a.months)
    if a.page == "home":
        page = pages.home_page(t, a.year, months)
    elif a.page == "validation":
        page = pages.validation_page(t)
    elif a.page == "top_products":
        cats = a.categories.split(",") if a.categories else None
        page = pages.top_products_page(t, a.year, months, cats, target=a.target)
    elif a.page == "brands":
        kw = {"rank_by": a.rank_by}
        if a.threshold is not None:
            kw["threshold"] = a.threshold
        if a.min_transactions is not None:
            kw["min_transactions"] = a.min_transactions
        page = pages.brands_page(t, a.year, months, **kw)
    elif a.page == "payments":
        page = pages.payments_page(t, a.year, months, a.types.split(","), a.amount_basis)
    else:
        if a.geocode and a.tract:
            raw = {"geocode_raw": spark.read.parquet(a.geocode), "tract_raw": spark.read.parquet(a.tract)}
            if a.county:
                raw["county_raw"] = spark.read.parquet(a.county)
        elif a.data:
            ap.error("--data needs --geocode and --tract for the demographics page")
        else:
            raw = fixtures.census_tables(spark, a.sf, t["stores"])
        parsed = {"store_tract": census.parse_geocode(raw["geocode_raw"]),
                  "tract_acs": census.parse_tract_acs(raw["tract_raw"])}
        if "county_raw" in raw:
            parsed["county_acs"] = census.parse_county_acs(raw["county_raw"])
        page = pages.demographics_page(t, parsed, a.year, months, clean=a.clean)

    by_state = [F.asc_nulls_first("STATE"), "STORE_ID"]
    order = {
        "weekly": products.weekly_order(), "state_summary": demographics.summary_order(), "state_table": ["position"],
        "drop": [a.rank_by, "BRAND"], "top": [F.desc("total_revenue"), *products.PRODUCT_KEYS], "performance": [F.desc("revenue"), "BRAND"],
        "top_products": ["PAYMENT_TYPE", F.desc("purchase_count"), F.asc_nulls_first("SKUPOS_DESCRIPTION"), F.asc_nulls_first("CATEGORY")],
        "summary": ["PAYMENT_TYPE"], "kpis": ["PAYMENT_TYPE"] if a.page == "payments" else None, "points": by_state, "enriched": by_state,
        "income_box": [F.asc_nulls_first("STATE")], "pending_tracts": ["STATEFP", "COUNTYFP", "TRACT"], "pending_stores": ["STORE_ID"],
        "year_options": ["y"], "profile": ["table_name", "column_name"], "row_counts": ["table_name"],
    }
    if a.page == "top_products":
        from tillroll.operators.present import months_subtitle

        print(months_subtitle(months or range(1, 13)))
    with pd.option_context("display.width", 200, "display.max_columns", 40):
        for name, df in page.items():
            print(f"== {name}")
            print(client.to_client(df, order.get(name)).to_string(index=False))
    if hasattr(page, "release"):
        page.release()
    spark.stop()


if __name__ == "__main__":
    main()
