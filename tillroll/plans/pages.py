"""Composed queries, one per dashboard page.

Each page function takes the table dict (``gtin sets items stores daily``
plus, for demographics, the landed census tables) and the user's
parameters, and returns the page's named result frames - KPI rows, summary
tables and chart datasets - all lazy. Nothing is collected here; a client
pulls each (small) frame with ``sources.client.to_client``.
"""

from __future__ import annotations

from collections.abc import Iterable, Mapping

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tillroll.operators import brands, demographics, keys, kpis, payments, period, present, products
from tillroll.sources import census, tables

Tables = Mapping[str, DataFrame]


class PageResult(dict):
    """Named result frames of a page, plus the intermediates it persisted.

    A page's outputs share intermediates (the product x week frame, the top-k
    list, a summary, ...), all of them aggregates. With ``persist=True`` these
    are kept with ``MEMORY_AND_DISK`` so each is computed once for all
    outputs; call ``release()`` after the page has been pulled.
    """

    def __init__(self, frames: Mapping[str, DataFrame], cached: list[DataFrame]):
        super().__init__(frames)
        self.cached = cached

    def release(self) -> None:
        for df in self.cached:
            df.unpersist()


def _keep(df: DataFrame, persist: bool, cached: list[DataFrame]) -> DataFrame:
    if not persist:
        return df
    df = tables.cached(df)
    cached.append(df)
    return df


def _slice(t: Tables, year, months) -> period.Slice:
    return period.period_slice(t, year, months)


def home_page(t: Tables, year: int | None = None, months: Iterable[int] | None = None) -> dict[str, DataFrame]:
    """Headline KPIs and store counts for the period (one KPI row that
    also carries the store-count panel: master, active ever, active in the
    period)."""
    sl = _slice(t, year, months)
    return {
        "kpis": kpis.home_kpis(t["stores"], t["gtin"], sl, daily=keys.active_stores(t), period_stores=keys.active_stores(t, (year, months))),
        "year_options": present.year_options(keys.periods(t)),
    }


def validation_page(t: Tables) -> dict[str, DataFrame]:
    """Row counts and distinct values of the master tables."""
    return {
        "profile": kpis.table_profile([
            ("stores", t["stores"], "STATE"), ("stores", t["stores"], "STORE_CHAIN_NAME"),
            ("gtin", t["gtin"], "GTIN"),
        ]),
        "row_counts": kpis.row_counts([("sets", t["sets"]), ("items", t["items"])]),
        "gtin_keys": kpis.key_profile(t["gtin"], "GTIN"),
    }


def top_products_page(t: Tables, year=None, months=None, categories: Iterable[str] | None = None,
                      k: int = 5, grain: str = "week", target: float | None = None,
                      persist: bool = True) -> PageResult:
    """Top non-fuel products, their weekly series and KPIs. Where ``t`` holds a kept ``cube`` (``ProductCube``), it
    answers them and neither lines nor days are read."""
    cached: list[DataFrame] = []
    days = t["cube"].weeks(year, months) if "cube" in t else _slice(t, year, months).daily
    weeks = _keep(products.product_weeks(products.filter_categories(days, categories)), persist, cached)
    top = _keep(products.top_products(products.product_totals(weeks), k), persist, cached)
    weekly = _keep(products.weekly_totals(weeks, top, grain), persist, cached)
    if target is not None:
        weekly = present.with_threshold(weekly, target, "target")
    table = present.formatted(
        present.present(top, {
            "Product": "SKUPOS_DESCRIPTION", "Brand": "BRAND", "Category": "CATEGORY",
            "Revenue": F.round(F.col("total_revenue").cast("double"), 2), "Units": "total_units",
            "Avg Price": F.round("avg_price", 2), "Transactions": "total_transactions",
        }),
        money=["Revenue", "Avg Price"], counts=["Units", "Transactions"],
    )
    return PageResult({
        "categories": products.category_list(days if "cube" in t else keys.categories(t, (year, months))),
        "top": top,
        "weekly": weekly,
        "kpis": kpis.top_products_kpis(top, weekly),
        "table": table,
    }, cached)


def brands_page(t: Tables, year=None, months=None, min_transactions: int = brands.MIN_TRANSACTIONS,
                threshold: float = brands.REVENUE_THRESHOLD, k: int = 10, rank_by: str = "revenue",
                persist: bool = True) -> PageResult:
    """Beverage brand performance and drop candidates."""
    sl = _slice(t, year, months)
    cached: list[DataFrame] = []
    perf = _keep(brands.brand_performance(sl.daily, min_transactions=min_transactions), persist, cached)
    drop = brands.drop_candidates(perf, k, rank_by)
    return PageResult({
        "category_count": products.category_count(keys.categories(t, (year, months))),
        "categories_head": products.category_head(keys.categories(t, (year, months)), 20),
        "performance": present.with_threshold(perf, threshold),
        "drop": drop,
        "kpis": brands.brand_kpis(perf, threshold),
        "table": present.formatted(
            present.present(drop, {
                "Brand": "BRAND", "Revenue": F.round(F.col("revenue").cast("double"), 2), "Units Sold": "units",
                "Transactions": "transactions", "$/Unit": F.round("rev_per_unit", 2),
                "$/Transaction": F.round("rev_per_transaction", 2),
            }),
            money=["Revenue", "$/Unit", "$/Transaction"], counts=["Units Sold", "Transactions"],
        ),
    }, cached)


def payments_page(t: Tables, year=None, months=None, selection: Iterable[str] = payments.DEFAULT_SELECTION,
                  amount_basis: str = "basket_per_line", n: int = 5, persist: bool = True) -> PageResult:
    """C4: payment-type comparison, top products per type, mean-of-means line.

    One pass over the lines makes ``payment_cube`` (types and types x products), which is kept and answers all.
    """
    sl = _slice(t, year, months)
    # The inner join with the period's baskets already restricts the lines;
    # a semi join of the items first would only add a pass.
    lines = payments.payment_lines(sl.sets, period.lines_in(t["items"], year, months), t["gtin"], list(selection))
    cached: list[DataFrame] = []
    cube = _keep(payments.payment_cube(lines), persist, cached)
    summary = payments.payment_summary(lines, amount_basis, cube)
    top = payments.top_products_by_payment(lines, n, cube)
    return PageResult({
        "summary": summary,
        "kpis": payments.payment_kpis(summary, list(selection)),
        "top_products": top,
        "table": payments.payment_table(top),
        "overall_avg": payments.mean_of_group_means(summary),
    }, cached)


def land_census(census_raw: Mapping[str, DataFrame], out_dir: str,
                ttl_seconds: int | None = None) -> dict[str, DataFrame]:
    """S6/S7 for the lookups: parse the landed responses once and write the
    parsed tables (store -> tract, tract ACS, county ACS) as Parquet, as the
    dashboard cached them in files; returns the re-read tables.

    When responses carry ``fetched_at`` and a key was fetched more than once,
    only its latest successful response is kept (a failed one where there is
    no other), so the enrichment joins stay 1:1. With
    ``ttl_seconds`` (the dashboard cached lookups for 7,200 s) older
    responses are ignored, so their keys return to the pending work list.
    """
    spark = next(iter(census_raw.values())).sparkSession
    if ttl_seconds is not None:
        census_raw = {k: (tables.read_if_fresh(v, ttl_seconds) if "fetched_at" in v.columns else v)
                      for k, v in census_raw.items()}
    parsed = {
        "store_tract": (census.parse_geocode(census_raw["geocode_raw"]), ["STORE_ID"], F.col("TRACT").isNotNull()),
        "tract_acs": (census.parse_tract_acs(census_raw["tract_raw"]), ["STATEFP", "COUNTYFP", "TRACT"], None),
        "county_acs": (census.parse_county_acs(census_raw["county_raw"]), ["state", "county"], None),
    }
    out = {}
    for name, (df, keys, ok) in parsed.items():
        if "fetched_at" in df.columns:
            df = census.latest(df, keys, ok=ok)
        path = f"{out_dir.rstrip('/')}/{name}"
        tables.materialize(df, path)
        out[name] = spark.read.parquet(path)
    return out


def demographics_page(t: Tables, census_tables: Mapping[str, DataFrame], year=None, months=None,
                      clean: bool = False, persist: bool = True) -> PageResult:
    """Stores enriched with tract and county statistics and performance.

    ``census_tables`` holds the parsed ``store_tract`` and ``tract_acs`` and
    optionally ``county_acs`` (a missing county table behaves as empty).
    """
    sl = _slice(t, year, months)
    cached: list[DataFrame] = []
    store_tract, tract_acs = census_tables["store_tract"], census_tables["tract_acs"]
    enriched = demographics.enrich_stores(t["stores"], store_tract, tract_acs, census_tables.get("county_acs"),
                                          demographics.store_performance(sl.daily))
    if clean:
        enriched = demographics.clean_annotations(enriched)
    enriched = _keep(enriched, persist, cached)
    valid = demographics.valid_stores(enriched)
    points = demographics.demographic_points(valid)
    summary = demographics.state_summary(valid)
    return PageResult({
        "pending_stores": census.pending_stores(t["stores"], store_tract),
        "pending_tracts": census.pending_keys(store_tract, tract_acs, ("STATEFP", "COUNTYFP", "TRACT")),
        "enriched": enriched,
        "state_summary": summary,
        "state_table": demographics.state_table(summary),
        "points": points,
        "income_box": demographics.box_stats(points, "STATE", "income"),
    }, cached)
