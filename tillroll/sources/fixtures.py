"""Logical retail tables as deterministic views over the driver's Parquet.

The driver ships TPC-H-style tables; this maps them onto the retail model
(``gtin``, ``sets``, ``items``, ``stores``, ``daily``) and derives landed
Census responses from them so the parsers and joins run on real-shaped
input whose size grows with the data. Nulls are injected on purpose so null
handling is observable. The same mapping is written in SQL for the oracle
(``tillroll.plans.oracle``).
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tillroll.operators.period import filter_daily, filter_sets, lines_in
from tillroll.operators.rollup import daily_rollup
from tillroll.sources.tables import load_table
from tillroll.sources.schemas import ACS_VARS

# Fixture mapping of part types to categories, and of order
# priorities to payment types.
CATEGORY_OF_TYPE = {"ECONOMY": "FUEL", "PROMO": "Packaged Beverages", "SMALL": "Energy Drinks", "LARGE": None}
PAYMENT_OF_PRIORITY = {"1-URGENT": "CASH", "2-HIGH": "CREDIT", "3-MEDIUM": "DEBIT", "5-LOW": "MOBILE"}
STATE_FIPS = "16"


def read_driver(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return load_table(spark, f"{sf_dir.rstrip('/')}/{name}.parquet")


def _null_str() -> Column:
    return F.lit(None).cast("string")


def _case(col: str, mapping: dict, default: Column) -> Column:
    expr = None
    for k, v in mapping.items():
        val = F.lit(v) if v is not None else _null_str()
        expr = F.when(F.col(col) == k, val) if expr is None else expr.when(F.col(col) == k, val)
    return expr.otherwise(default)


def gtin_view(part: DataFrame) -> DataFrame:
    return part.select(
        F.col("p_partkey").alias("GTIN"),
        _case("p_type", CATEGORY_OF_TYPE, F.col("p_type")).alias("CATEGORY"),
        F.when(F.col("p_size") > 45, F.lit("Sports drink")).alias("SUBCATEGORY"),
        F.when(F.col("p_partkey") % 11 == 0, _null_str()).otherwise(F.col("p_brand")).alias("BRAND"),
        F.when(F.col("p_partkey") % 13 == 0, _null_str()).otherwise(F.col("p_name")).alias("SKUPOS_DESCRIPTION"),
    )


def sets_view(orders: DataFrame) -> DataFrame:
    return orders.select(
        F.col("o_orderkey").alias("TRANSACTION_SET_ID"),
        F.col("o_orderdate").alias("DATE_TIME"),
        F.col("o_custkey").alias("STORE_ID"),
        F.col("o_totalprice").cast("decimal(18,2)").alias("GRAND_TOTAL_AMOUNT"),
        _case("o_orderpriority", PAYMENT_OF_PRIORITY, _null_str()).alias("PAYMENT_TYPE"),
    )


def items_view(lineitem: DataFrame) -> DataFrame:
    return lineitem.select(
        F.col("l_orderkey").alias("TRANSACTION_SET_ID"),
        F.col("l_partkey").alias("GTIN"),
        # three decimals, as fuel lines have
        (F.col("l_quantity").cast("decimal(15,3)") + (F.col("l_linenumber") % 8).cast("decimal(9,0)") * F.lit("0.125").cast("decimal(4,3)")).cast("decimal(18,3)").alias("UNIT_QUANTITY"),
        F.col("l_extendedprice").cast("decimal(18,2)").alias("GRAND_TOTAL_AMOUNT"),
    )


def stores_view(customer: DataFrame, nation: DataFrame) -> DataFrame:
    return customer.join(nation, customer["c_nationkey"] == nation["n_nationkey"], "left").select(
        F.col("c_custkey").alias("STORE_ID"),
        F.col("c_mktsegment").alias("STORE_CHAIN_NAME"),
        F.col("n_name").alias("STATE"),
        F.col("c_name").alias("CITY"),
        F.col("c_nationkey"),
    )


class RetailTables(dict):
    """Table name -> DataFrame; ``daily`` is derived on first access only."""

    def __missing__(self, key):
        if key != "daily":
            raise KeyError(key)
        self["daily"] = daily_rollup(self["items"], self["sets"], self["gtin"])
        self.derived = True
        return self["daily"]

    def daily_in(self, year: int | None, months) -> DataFrame:
        """The daily aggregate of a period. Where it is derived, the period restricts the baskets before the
        join, so it reaches their scan; a table that was given is filtered (and pruned by its folders)."""
        if "daily" in self and not getattr(self, "derived", False):
            return filter_daily(self["daily"], year, months)
        return daily_rollup(lines_in(self["items"], year, months), filter_sets(self["sets"], year, months), self["gtin"])


def retail_tables(spark: SparkSession, sf_dir: str, daily: DataFrame | None = None) -> RetailTables:
    """gtin, sets, items, stores and the daily aggregate (all lazy).

    Pass ``daily`` to use a materialised daily table instead of deriving it.
    """
    t = {n: read_driver(spark, sf_dir, n) for n in ("part", "orders", "lineitem", "customer", "nation")}
    out = RetailTables(
        gtin=gtin_view(t["part"]),
        sets=sets_view(t["orders"]),
        items=items_view(t["lineitem"]),
        stores=stores_view(t["customer"], t["nation"]),
    )
    if daily is not None:
        out["daily"] = daily
    return out


# --- landed Census responses derived from the driver tables -----------------
# Rule (mirrored by the oracle SQL):
#   store s (customer c): g = c_custkey % 10; g = 0 -> empty tract list,
#   g = 1 -> malformed text; otherwise tract STATE "16",
#   COUNTY = lpad(c_nationkey, 3), TRACT = lpad(c_nationkey*1000 + c_custkey % 97, 6).
#   tract (nk, tk = TRACT % 1000): tk % 10 = 3 -> header-only response;
#   variable k (1..10) = k * (nk*100 + tk + 1), except income (k = 3) is the
#   annotation code -666666666 when tk % 10 = 5 and poverty (k = 5) is JSON
#   null when tk % 10 = 6.
#   county (nation n): one response per nation, header + one row,
#   variable k = k * (n_regionkey*1000 + n_nationkey), NAME = n_name.
ANNOTATION = "-666666666"


def _json_str(c: Column) -> Column:
    return F.concat(F.lit('"'), c, F.lit('"'))


def _json_array(parts: list[Column]) -> Column:
    return F.concat(F.lit("["), F.concat_ws(",", *parts), F.lit("]"))


def geocode_payloads(stores: DataFrame) -> DataFrame:
    sid = F.col("STORE_ID")
    county = F.lpad(F.col("c_nationkey").cast("string"), 3, "0")
    tract = F.lpad((F.col("c_nationkey") * 1000 + sid % 97).cast("string"), 6, "0")
    ok = F.concat(
        F.lit('{"result":{"geographies":{"Census Tracts":[{"STATE":"' + STATE_FIPS + '","COUNTY":"'),
        county, F.lit('","TRACT":"'), tract, F.lit('"}]}}}'),
    )
    payload = (
        F.when(sid % 10 == 0, F.lit('{"result":{"geographies":{"Census Tracts":[]}}}'))
        .when(sid % 10 == 1, F.lit("not json"))
        .otherwise(ok)
    )
    return stores.select(sid.cast("string").alias("STORE_ID"), payload.alias("payload"))


def tract_payloads(tract_keys: DataFrame) -> DataFrame:
    nk = F.col("COUNTYFP").cast("int")
    tk = F.col("TRACT").cast("int") % 1000
    base = nk * 100 + tk + 1
    vals = []
    for k, var in enumerate(ACS_VARS, start=1):
        v = _json_str((base * k).cast("string"))
        if var == "B19019_001E":
            v = F.when(tk % 10 == 5, F.lit(f'"{ANNOTATION}"')).otherwise(v)
        if var == "B17001_002E":
            v = F.when(tk % 10 == 6, F.lit("null")).otherwise(v)
        vals.append(v)
    header = _json_array([F.lit(f'"{h}"') for h in (*ACS_VARS, "state", "county", "tract")])
    row = _json_array(vals + [_json_str(F.col(c)) for c in ("STATEFP", "COUNTYFP", "TRACT")])
    payload = F.when(tk % 10 == 3, F.concat(F.lit("["), header, F.lit("]"))).otherwise(
        F.concat(F.lit("["), header, F.lit(","), row, F.lit("]")))
    return tract_keys.select("STATEFP", "COUNTYFP", "TRACT", payload.alias("payload"))


def county_payloads(nation: DataFrame) -> DataFrame:
    base = F.col("n_regionkey") * 1000 + F.col("n_nationkey")
    header = _json_array([F.lit(f'"{h}"') for h in (*ACS_VARS, "NAME", "state", "county")])
    row = _json_array(
        [_json_str((base * k).cast("string")) for k in range(1, len(ACS_VARS) + 1)]
        + [_json_str(F.col("n_name")), F.lit(f'"{STATE_FIPS}"'),
           _json_str(F.lpad(F.col("n_nationkey").cast("string"), 3, "0"))]
    )
    return nation.select(F.concat(F.lit("["), header, F.lit(","), row, F.lit("]")).alias("payload"))


def supplier_county_payloads(supplier: DataFrame, reverse: bool = False) -> DataFrame:
    """County-style responses with two data rows each, one per supplier; the
    second row is short (no ``county``) when s_suppkey % 5 = 0. ``reverse``:
    the variables come in the opposite order, after the name."""
    base = F.col("s_suppkey")
    names = ("NAME", *reversed(ACS_VARS), "state", "county") if reverse else (*ACS_VARS, "NAME", "state", "county")
    header = _json_array([F.lit(f'"{h}"') for h in names])
    state = _json_str(F.lpad(F.col("s_nationkey").cast("string"), 2, "0"))

    def row(tag: int, short: Column | None = None) -> Column:
        vals = [_json_str((base * k + tag).cast("string")) for k in range(1, len(ACS_VARS) + 1)]
        name = _json_str(F.col("s_name"))
        vals = [name, *reversed(vals), state] if reverse else [*vals, name, state]
        full = _json_array(vals + [_json_str(F.concat(F.lpad(base.cast("string"), 5, "0"), F.lit(str(tag))))])
        return full if short is None else F.when(short, _json_array(vals)).otherwise(full)

    payload = F.concat(F.lit("["), header, F.lit(","), row(0), F.lit(","), row(1, base % 5 == 0), F.lit("]"))
    return supplier.select(payload.alias("payload"))


def census_tables(spark: SparkSession, sf_dir: str, stores: DataFrame | None = None) -> dict[str, DataFrame]:
    """Landed raw responses: geocode (per store), tract (per distinct tract
    of the geocoded stores), county (per nation)."""
    from tillroll.sources.census import parse_geocode

    if stores is None:
        stores = stores_view(read_driver(spark, sf_dir, "customer"), read_driver(spark, sf_dir, "nation"))
    geo_raw = geocode_payloads(stores)
    tracts = parse_geocode(geo_raw).select("STATEFP", "COUNTYFP", "TRACT").dropna().distinct()
    return {
        "geocode_raw": geo_raw,
        "tract_raw": tract_payloads(tracts),
        "county_raw": county_payloads(read_driver(spark, sf_dir, "nation")),
    }
