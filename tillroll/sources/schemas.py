"""Explicit table contracts (never inferred).

Column names follow the source system's upper-case names; ``WEEk`` from the
source is normalised to ``CALENDAR_WEEK`` at load.
"""

from __future__ import annotations

from pyspark.sql.types import (
    ArrayType,
    DoubleType,
    IntegerType,
    LongType,
    StringType,
    StructField,
    StructType,
    TimestampType,
)

# The ten American Community Survey 5-year variables the store
# demographics compare, in request order (public Census variable codes).
ACS_VARS = (
    "B01003_001E",  # total population
    "B01001_001E",  # sex by age: total
    "B19019_001E",  # median household income
    "B15003_025E",  # educational attainment: doctorate degree
    "B17001_002E",  # income below poverty level
    "B25077_001E",  # median home value
    "B25064_001E",  # median gross rent
    "B08301_001E",  # means of transportation to work: total
    "B23025_004E",  # employment status: civilian labor force, employed
    "B08201_001E",  # household size by vehicles available: total
)

# Friendly names for the four variables the state summary reports.
POPULATION, INCOME, POVERTY, HOME_VALUE = "B01003_001E", "B19019_001E", "B17001_002E", "B25077_001E"

TRACT_KEYS = ("STATEFP", "COUNTYFP", "TRACT")


def _s(name, t, nullable=True):
    return StructField(name, t, nullable)


def _id(name):
    """Integers and text stay what they are."""
    return StructField(name, LongType(), True, {"kind": "id"})


def _amount(name):
    """Any number keeps its type and scale; text becomes a double."""
    return StructField(name, DoubleType(), True, {"kind": "amount"})


DAILY = StructType([
    _s("CALENDAR_YEAR", IntegerType()), _s("CALENDAR_MONTH", IntegerType()), _s("CALENDAR_WEEK", IntegerType()),
    _id("STORE_ID"), _s("CATEGORY", StringType()), _s("SUBCATEGORY", StringType()),
    _s("BRAND", StringType()), _s("SKUPOS_DESCRIPTION", StringType()),
    _amount("TOTAL_REVENUE_AMOUNT"), _amount("QUANTITY"), _s("TRANSACTION_COUNT", LongType()),
])

SETS = StructType([
    _id("TRANSACTION_SET_ID"), _s("DATE_TIME", TimestampType()), _id("STORE_ID"), _amount("GRAND_TOTAL_AMOUNT"),
    _s("PAYMENT_TYPE", StringType()),
])

ITEMS = StructType([_id("TRANSACTION_SET_ID"), _id("GTIN"), _amount("UNIT_QUANTITY"), _amount("GRAND_TOTAL_AMOUNT")])

GTIN = StructType([_id("GTIN"), _s("CATEGORY", StringType()), _s("SKUPOS_DESCRIPTION", StringType())])

STORES = StructType([
    _id("STORE_ID"), StructField("LATITUDE", DoubleType(), True, {"optional": True}),
    StructField("LONGITUDE", DoubleType(), True, {"optional": True}),
    _s("STATE", StringType()), _s("CITY", StringType()), _s("STORE_CHAIN_NAME", StringType()),
])

# Source column names that differ from the contract (matched case-insensitively).
ALIASES = {"daily": {"CALENDAR_WEEK": ("WEEk",)}}

# The data folder's nine tables, their files, and the contracts of those that the queries use.
DATASETS = (
    ("gtin", "cstore_master_ctin.parquet", GTIN),
    ("discounts", "cstore_discounts.parquet", None),
    ("stores", "cstore_stores.parquet", STORES),
    ("payments", "cstore_payments.parquet", None),
    ("daily", "cstore_transactions_daily_agg.parquet", DAILY),
    ("shopper", "cstore_shopper.parquet", None),
    ("sets", "cstore_transaction_sets.parquet", SETS),
    ("status", "cstore_store_status.parquet", None),
    ("items", "transaction_items", ITEMS),
)

STORE_TRACT = StructType([_s("STORE_ID", StringType())] + [_s(k, StringType()) for k in TRACT_KEYS])

TRACT_ACS = StructType([_s(k, StringType()) for k in TRACT_KEYS] + [_s(v, StringType()) for v in ACS_VARS])

COUNTY_ACS = StructType(
    [_s(v, StringType()) for v in ACS_VARS]
    + [_s("NAME", StringType()), _s("state", StringType()), _s("county", StringType())]
)

# Landed raw responses of the three lookups (one row per request).
GEOCODE_RAW = StructType([
    _s("STORE_ID", StringType()), _s("payload", StringType()), _s("fetched_at", TimestampType()),
])
TRACT_RAW = StructType(
    [_s(k, StringType()) for k in TRACT_KEYS]
    + [_s("payload", StringType()), _s("fetched_at", TimestampType())]
)
COUNTY_RAW = StructType([_s("payload", StringType()), _s("fetched_at", TimestampType())])

# JSON shapes of the payloads.
GEOCODE_JSON = (
    "result struct<geographies:struct<`Census Tracts`:"
    "array<struct<STATE:string,COUNTY:string,TRACT:string>>>>"
)
TABLE_JSON = ArrayType(ArrayType(StringType()))
