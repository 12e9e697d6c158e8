"""Independent expected-result definitions in plain SQL (run by DuckDB on
the driver's tables). Each key matches a query in ``tillroll.plans.queries``
with the same column names. Written from the specification, not generated
from the Spark plans.
"""

from __future__ import annotations

from tillroll.sources.schemas import ACS_VARS

VIEWS = """WITH gtin AS (
 SELECT p_partkey AS GTIN,
  CASE p_type WHEN 'ECONOMY' THEN 'FUEL' WHEN 'PROMO' THEN 'Packaged Beverages'
   WHEN 'SMALL' THEN 'Energy Drinks' WHEN 'LARGE' THEN NULL ELSE p_type END AS CATEGORY,
  CASE WHEN p_size > 45 THEN 'Sports drink' END AS SUBCATEGORY,
  CASE WHEN p_partkey % 11 = 0 THEN NULL ELSE p_brand END AS BRAND,
  CASE WHEN p_partkey % 13 = 0 THEN NULL ELSE p_name END AS SKUPOS_DESCRIPTION FROM part),
sets AS (
 SELECT o_orderkey AS TRANSACTION_SET_ID, o_orderdate AS DATE_TIME, o_custkey AS STORE_ID,
  CAST(o_totalprice AS DECIMAL(18,2)) AS GRAND_TOTAL_AMOUNT,
  CASE o_orderpriority WHEN '1-URGENT' THEN 'CASH' WHEN '2-HIGH' THEN 'CREDIT'
   WHEN '3-MEDIUM' THEN 'DEBIT' WHEN '5-LOW' THEN 'MOBILE' END AS PAYMENT_TYPE FROM orders),
items AS (
 SELECT l_orderkey AS TRANSACTION_SET_ID, l_partkey AS GTIN,
  CAST(CAST(l_quantity AS DECIMAL(15,3)) + CAST(l_linenumber % 8 AS DECIMAL(9,0)) * CAST(0.125 AS DECIMAL(4,3)) AS DECIMAL(18,3)) AS UNIT_QUANTITY,
  CAST(l_extendedprice AS DECIMAL(18,2)) AS GRAND_TOTAL_AMOUNT FROM lineitem),
stores AS (
 SELECT c_custkey AS STORE_ID, c_mktsegment AS STORE_CHAIN_NAME, n_name AS STATE, c_name AS CITY, c_nationkey
 FROM customer LEFT JOIN nation ON c_nationkey = n_nationkey),
daily AS (
 SELECT CAST(year(s.DATE_TIME) AS INTEGER) AS CALENDAR_YEAR, CAST(month(s.DATE_TIME) AS INTEGER) AS CALENDAR_MONTH,
  CAST(weekofyear(s.DATE_TIME) AS INTEGER) AS CALENDAR_WEEK, CAST(s.DATE_TIME AS DATE) AS CALENDAR_DATE, s.STORE_ID,
  g.CATEGORY, g.SUBCATEGORY, g.BRAND, g.SKUPOS_DESCRIPTION,
  sum(i.GRAND_TOTAL_AMOUNT) AS TOTAL_REVENUE_AMOUNT, sum(i.UNIT_QUANTITY) AS QUANTITY,
  count(DISTINCT i.TRANSACTION_SET_ID) AS TRANSACTION_COUNT
 FROM items i JOIN sets s ON i.TRANSACTION_SET_ID = s.TRANSACTION_SET_ID
 LEFT JOIN gtin g ON i.GTIN = g.GTIN GROUP BY 1,2,3,4,5,6,7,8,9)
"""

TOP5 = """, top5 AS (SELECT BRAND, SKUPOS_DESCRIPTION, CATEGORY, sum(TOTAL_REVENUE_AMOUNT) AS rev,
  sum(QUANTITY) AS units, sum(TRANSACTION_COUNT) AS txns FROM daily
 WHERE CATEGORY <> 'FUEL' AND BRAND IS NOT NULL AND SKUPOS_DESCRIPTION IS NOT NULL
 GROUP BY 1,2,3 ORDER BY rev DESC, BRAND, SKUPOS_DESCRIPTION, CATEGORY LIMIT 5)
"""

BEV = """, bev AS (SELECT BRAND, sum(TOTAL_REVENUE_AMOUNT) AS revenue, sum(QUANTITY) AS units,
  sum(TRANSACTION_COUNT) AS transactions FROM daily
 WHERE CATEGORY IS NOT NULL AND BRAND IS NOT NULL AND (upper(CATEGORY) LIKE '%BEVERAGE%'
  OR upper(CATEGORY) LIKE '%DRINK%' OR upper(SUBCATEGORY) LIKE '%BEVERAGE%' OR upper(SUBCATEGORY) LIKE '%DRINK%')
 GROUP BY 1 HAVING sum(TRANSACTION_COUNT) >= 18)
"""


def pay(types=("CASH", "CREDIT", "DEBIT")) -> str:
    inlist = ",".join(f"'{t}'" for t in types)
    return f""", pay AS (SELECT s.TRANSACTION_SET_ID, s.PAYMENT_TYPE, s.GRAND_TOTAL_AMOUNT AS set_amount,
  i.GRAND_TOTAL_AMOUNT AS line_amount, i.UNIT_QUANTITY, g.CATEGORY, g.SKUPOS_DESCRIPTION
 FROM sets s JOIN items i ON s.TRANSACTION_SET_ID = i.TRANSACTION_SET_ID
 LEFT JOIN gtin g ON i.GTIN = g.GTIN WHERE s.PAYMENT_TYPE IN ({inlist}))
"""


PAY = pay()

# Landed-response rule of the fixtures, evaluated directly: per store g, nk, tk.
GEO = """, geo AS (SELECT STORE_ID, STATE, CITY, c_nationkey AS nk, STORE_ID % 97 AS tk, STORE_ID % 10 AS g,
  c_nationkey*100 + STORE_ID % 97 + 1 AS base FROM stores)
"""


def _tract_var(k: int, var: str, ok: str = "g > 1") -> str:
    val = f"CAST({k}*base AS VARCHAR)"
    if var == "B19019_001E":
        val = f"CASE WHEN tk % 10 = 5 THEN '-666666666' ELSE {val} END"
    if var == "B17001_002E":
        val = f"CASE WHEN tk % 10 = 6 THEN NULL ELSE {val} END"
    return f"CASE WHEN {ok} AND tk % 10 <> 3 THEN {val} END AS {var}"


TRACT_KEYS_SQL = """CASE WHEN g > 1 THEN '16' END AS STATEFP,
  CASE WHEN g > 1 THEN lpad(CAST(nk AS VARCHAR),3,'0') END AS COUNTYFP,
  CASE WHEN g > 1 THEN lpad(CAST(nk*1000+tk AS VARCHAR),6,'0') END AS TRACT"""

ENRICHED = (
    GEO
    + ", enriched AS (SELECT CAST(geo.STORE_ID AS VARCHAR) AS STORE_ID, STATE, CITY, "
    + TRACT_KEYS_SQL + ",\n  "
    + ",\n  ".join(_tract_var(k, v) for k, v in enumerate(ACS_VARS, start=1))
    + ",\n  CASE WHEN g > 1 THEN n.n_name END AS county_NAME,"
    + "".join(f"\n  CASE WHEN g > 1 THEN CAST({k}*(n.n_regionkey*1000 + n.n_nationkey) AS VARCHAR) END AS county_{v}," for k, v in enumerate(ACS_VARS, start=1))
    + "\n  p.revenue, p.transactions"
    + "\n FROM geo LEFT JOIN nation n ON geo.nk = n.n_nationkey"
    + "\n LEFT JOIN (SELECT STORE_ID, sum(TOTAL_REVENUE_AMOUNT) AS revenue, sum(TRANSACTION_COUNT) AS transactions"
    + " FROM daily GROUP BY 1) p ON geo.STORE_ID = p.STORE_ID)\n"
)

VALID = "SELECT * FROM enriched WHERE B01003_001E IS NOT NULL AND B19019_001E IS NOT NULL"


def _summary(clean: bool) -> str:
    def v(c):
        x = f"CAST({c} AS DOUBLE)"
        return f"CASE WHEN {x} >= 0 THEN {x} END" if clean else x
    src = VALID
    if clean:
        # annotation codes become NULL before the completeness filter
        src = ("SELECT * FROM enriched WHERE B01003_001E IS NOT NULL AND B19019_001E IS NOT NULL"
               " AND CAST(B01003_001E AS DOUBLE) >= 0 AND CAST(B19019_001E AS DOUBLE) >= 0")
    return (VIEWS + ENRICHED + "SELECT STATE, count(STORE_ID) AS store_count, "
            f"avg({v('B01003_001E')}) AS avg_tract_pop, avg({v('B19019_001E')}) AS avg_income, "
            f"avg({v('B17001_002E')}) AS avg_poverty, avg({v('B25077_001E')}) AS avg_home_value "
            f"FROM ({src}) z GROUP BY 1")


def _parse_tract() -> str:
    cols = ",\n  ".join(_tract_var(k, v) for k, v in enumerate(ACS_VARS, start=1))
    return (VIEWS + GEO + "SELECT DISTINCT " + TRACT_KEYS_SQL + ",\n  " + cols
            + "\nFROM geo WHERE g > 1 AND tk % 10 <> 3")


def _parse_county() -> str:
    def part(tag: int, short: bool) -> str:
        vals = ", ".join(f"CAST(s_suppkey*{k}+{tag} AS VARCHAR) AS {v}" for k, v in enumerate(ACS_VARS, start=1))
        county = f"lpad(CAST(s_suppkey AS VARCHAR),5,'0') || '{tag}'"
        if short:
            county = f"CASE WHEN s_suppkey % 5 = 0 THEN NULL ELSE {county} END"
        return (f"SELECT {vals}, s_name AS NAME, lpad(CAST(s_nationkey AS VARCHAR),2,'0') AS state, "
                f"{county} AS county FROM supplier")
    return part(0, False) + "\nUNION ALL\n" + part(1, True)


def _daily_cols() -> str:
    return ("CALENDAR_YEAR, CALENDAR_MONTH, CALENDAR_WEEK, CALENDAR_DATE, STORE_ID, CATEGORY, SUBCATEGORY, "
            "BRAND, SKUPOS_DESCRIPTION")


WEEKLY = (", wk AS (SELECT CALENDAR_WEEK, SKUPOS_DESCRIPTION, BRAND, sum(TOTAL_REVENUE_AMOUNT) AS r, "
          "sum(QUANTITY) AS u FROM daily WHERE CATEGORY <> 'FUEL' AND CALENDAR_WEEK IS NOT NULL AND "
          "SKUPOS_DESCRIPTION IN (SELECT SKUPOS_DESCRIPTION FROM top5) GROUP BY 1,2,3)\n")

PERIOD_SETS = "year(DATE_TIME)=1997 AND month(DATE_TIME) IN (1,2,3)"
PERIOD_DAILY = "CALENDAR_YEAR=1997 AND CALENDAR_MONTH IN (1,2,3)"


def n_unique_sql(c: str) -> str:
    return f"(count(DISTINCT {c}) + coalesce(max(CASE WHEN {c} IS NULL THEN 1 ELSE 0 END),0))"


TOP5_SELECTED = TOP5.replace("WHERE CATEGORY <> 'FUEL'", "WHERE CATEGORY <> 'FUEL' AND CATEGORY IN ('Energy Drinks','STANDARD')")
TOP5_PERIOD = TOP5.replace("WHERE CATEGORY <> 'FUEL'", "WHERE CATEGORY <> 'FUEL' AND CALENDAR_YEAR=1997 AND CALENDAR_MONTH IN (1,2,3)")
PAY_PERIOD = PAY.replace("WHERE s.PAYMENT_TYPE IN", "WHERE year(s.DATE_TIME)=1997 AND month(s.DATE_TIME) IN (1,2,3) AND s.PAYMENT_TYPE IN")

ORACLE: dict[str, str] = {
    "top_products_selected_categories": VIEWS + TOP5_SELECTED + "SELECT BRAND, SKUPOS_DESCRIPTION, CATEGORY, CAST(rev AS DOUBLE) AS total_revenue, CAST(units AS DOUBLE) AS total_units FROM top5",
    "weekly_top_products_period": VIEWS + TOP5_PERIOD + "SELECT CALENDAR_WEEK, SKUPOS_DESCRIPTION, BRAND, CAST(sum(TOTAL_REVENUE_AMOUNT) AS DOUBLE) AS weekly_revenue, CAST(sum(QUANTITY) AS DOUBLE) AS weekly_units FROM daily WHERE CATEGORY <> 'FUEL' AND CALENDAR_YEAR=1997 AND CALENDAR_MONTH IN (1,2,3) AND CALENDAR_WEEK IS NOT NULL AND SKUPOS_DESCRIPTION IN (SELECT SKUPOS_DESCRIPTION FROM top5) GROUP BY 1,2,3",
    "payment_summary_period": VIEWS + PAY_PERIOD + "SELECT PAYMENT_TYPE, count(DISTINCT TRANSACTION_SET_ID) AS num_transactions, CAST(sum(set_amount) AS DOUBLE) AS total_spend, round(CAST(sum(set_amount) AS DOUBLE)/count(set_amount),4) AS avg_ticket, CAST(sum(UNIT_QUANTITY) AS DOUBLE) AS total_items, round(CAST(sum(UNIT_QUANTITY) AS DOUBLE)/count(DISTINCT TRANSACTION_SET_ID),4) AS avg_items_per_txn FROM pay GROUP BY 1",
    "filter_year_month": VIEWS + f"SELECT count(*) AS n_rows, CAST(coalesce(sum(TOTAL_REVENUE_AMOUNT),0) AS DOUBLE) AS revenue FROM daily WHERE {PERIOD_DAILY}",
    "set_kpis": VIEWS + f"SELECT CAST(coalesce(sum(GRAND_TOTAL_AMOUNT),0) AS DOUBLE) AS total_revenue, count(*) AS total_transactions, {n_unique_sql('STORE_ID')} AS unique_stores FROM sets WHERE {PERIOD_SETS}",
    "items_in_period": VIEWS + "SELECT count(*) AS n_items FROM items i WHERE EXISTS (SELECT 1 FROM sets s WHERE s.TRANSACTION_SET_ID=i.TRANSACTION_SET_ID AND year(s.DATE_TIME)=1997)",
    "category_list": VIEWS + "SELECT DISTINCT CATEGORY FROM daily WHERE CATEGORY <> 'FUEL'",
    "category_list_head": VIEWS + "SELECT CATEGORY FROM (SELECT DISTINCT CATEGORY FROM daily) c ORDER BY CATEGORY NULLS FIRST LIMIT 20",
    "top_products": VIEWS + TOP5 + "SELECT BRAND, SKUPOS_DESCRIPTION, CATEGORY, CAST(rev AS DOUBLE) AS total_revenue, CAST(units AS DOUBLE) AS total_units, CAST(txns AS BIGINT) AS total_transactions, round(CAST(rev AS DOUBLE)/CAST(nullif(units,0) AS DOUBLE),4) AS avg_price FROM top5",
    "weekly_top_products": VIEWS + TOP5 + "SELECT CALENDAR_WEEK, SKUPOS_DESCRIPTION, BRAND, CAST(sum(TOTAL_REVENUE_AMOUNT) AS DOUBLE) AS weekly_revenue, CAST(sum(QUANTITY) AS DOUBLE) AS weekly_units FROM daily d WHERE CATEGORY <> 'FUEL' AND CALENDAR_WEEK IS NOT NULL AND SKUPOS_DESCRIPTION IN (SELECT SKUPOS_DESCRIPTION FROM top5) GROUP BY 1,2,3",
    "weekly_top_products_year_week": VIEWS + TOP5 + "SELECT CALENDAR_YEAR, CALENDAR_WEEK, SKUPOS_DESCRIPTION, BRAND, CAST(sum(TOTAL_REVENUE_AMOUNT) AS DOUBLE) AS weekly_revenue FROM daily WHERE CATEGORY <> 'FUEL' AND CALENDAR_WEEK IS NOT NULL AND SKUPOS_DESCRIPTION IN (SELECT SKUPOS_DESCRIPTION FROM top5) GROUP BY 1,2,3,4",
    "top_products_kpis": VIEWS + TOP5 + WEEKLY + "SELECT (SELECT CAST(coalesce(sum(rev),0) AS DOUBLE) FROM top5) AS total_revenue, (SELECT CAST(coalesce(sum(units),0) AS DOUBLE) FROM top5) AS total_units, (SELECT round(CAST(sum(r) AS DOUBLE)/count(r),4) FROM wk) AS avg_weekly_revenue, (SELECT " + n_unique_sql("CALENDAR_WEEK") + " FROM wk) AS n_weeks",
    "summary_text": VIEWS + TOP5 + "SELECT SKUPOS_DESCRIPTION AS Product, BRAND AS Brand, CATEGORY AS Category, printf('$%,.2f', CAST(rev AS DOUBLE)) AS Revenue, printf('%,.0f', CAST(units AS DOUBLE)) AS Units, printf('$%,.2f', CAST(rev AS DOUBLE)/CAST(nullif(units,0) AS DOUBLE)) AS Avg_Price, printf('%,.0f', CAST(txns AS DOUBLE)) AS Transactions FROM top5",
    "brand_performance": VIEWS + BEV + "SELECT BRAND, CAST(revenue AS DOUBLE) AS revenue, CAST(units AS DOUBLE) AS units, CAST(transactions AS BIGINT) AS transactions, round(CAST(revenue AS DOUBLE)/CAST(nullif(units,0) AS DOUBLE),4) AS rev_per_unit, round(CAST(revenue AS DOUBLE)/CAST(nullif(transactions,0) AS DOUBLE),4) AS rev_per_transaction FROM bev",
    "drop_candidates": VIEWS + BEV + "SELECT BRAND, CAST(revenue AS DOUBLE) AS revenue FROM bev ORDER BY bev.revenue, BRAND LIMIT 10",
    "drop_candidates_by_units": VIEWS + BEV + "SELECT BRAND, CAST(units AS DOUBLE) AS units FROM bev ORDER BY bev.units, BRAND LIMIT 10",
    "threshold_count": VIEWS + BEV + "SELECT count(*) AS brands, count(CASE WHEN revenue < 36000000 THEN 1 END) AS below, CAST(coalesce(sum(revenue),0) AS DOUBLE) AS total, round(coalesce(CAST(sum(revenue) AS DOUBLE)/count(revenue),0),4) AS avg_rev FROM bev",
    "below_threshold": VIEWS + BEV + "SELECT BRAND, CAST(revenue AS DOUBLE) AS revenue FROM bev WHERE revenue < 36000000",
    "payment_summary_published": VIEWS + PAY + "SELECT PAYMENT_TYPE, count(DISTINCT TRANSACTION_SET_ID) AS num_transactions, CAST(sum(set_amount) AS DOUBLE) AS total_spend, round(CAST(sum(set_amount) AS DOUBLE)/count(set_amount),4) AS avg_ticket, CAST(sum(UNIT_QUANTITY) AS DOUBLE) AS total_items, round(CAST(sum(UNIT_QUANTITY) AS DOUBLE)/count(DISTINCT TRANSACTION_SET_ID),4) AS avg_items_per_txn FROM pay GROUP BY 1",
    "payment_summary_per_basket": VIEWS + PAY + "SELECT PAYMENT_TYPE, count(*) AS num_transactions, CAST(sum(a) AS DOUBLE) AS total_spend, round(CAST(sum(a) AS DOUBLE)/count(a),4) AS avg_ticket FROM (SELECT PAYMENT_TYPE, TRANSACTION_SET_ID, max(set_amount) AS a FROM pay GROUP BY 1,2) b GROUP BY 1",
    "payment_summary_line": VIEWS + PAY + "SELECT PAYMENT_TYPE, CAST(sum(line_amount) AS DOUBLE) AS total_spend, round(CAST(sum(line_amount) AS DOUBLE)/count(line_amount),4) AS avg_line FROM pay GROUP BY 1",
    "payment_kpis": VIEWS + pay(("CASH", "CREDIT")) + "SELECT PAYMENT_TYPE, count(DISTINCT TRANSACTION_SET_ID) AS num_transactions, CAST(sum(set_amount) AS DOUBLE) AS total_spend, round(CAST(sum(set_amount) AS DOUBLE)/count(set_amount),4) AS avg_ticket, round(CAST(sum(UNIT_QUANTITY) AS DOUBLE)/count(DISTINCT TRANSACTION_SET_ID),4) AS avg_items_per_txn FROM pay GROUP BY 1",
    "product_by_payment": VIEWS + PAY + "SELECT PAYMENT_TYPE, SKUPOS_DESCRIPTION, CATEGORY, count(DISTINCT TRANSACTION_SET_ID) AS purchase_count, CAST(sum(set_amount) AS DOUBLE) AS revenue FROM pay WHERE CATEGORY IS NOT NULL GROUP BY 1,2,3",
    "top_products_by_payment": VIEWS + PAY + "SELECT PAYMENT_TYPE, SKUPOS_DESCRIPTION, CATEGORY, purchase_count, CAST(revenue AS DOUBLE) AS revenue FROM (SELECT *, row_number() OVER (PARTITION BY PAYMENT_TYPE ORDER BY purchase_count DESC, SKUPOS_DESCRIPTION ASC NULLS FIRST, CATEGORY ASC NULLS FIRST) AS rn FROM (SELECT PAYMENT_TYPE, SKUPOS_DESCRIPTION, CATEGORY, count(DISTINCT TRANSACTION_SET_ID) AS purchase_count, sum(set_amount) AS revenue FROM pay WHERE CATEGORY IS NOT NULL GROUP BY 1,2,3) a) b WHERE rn <= 5",
    "mean_of_group_means": VIEWS + PAY + "SELECT round(avg(t),3) AS overall_avg FROM (SELECT CAST(sum(set_amount) AS DOUBLE)/count(set_amount) AS t FROM pay GROUP BY PAYMENT_TYPE) z",
    "overall_mean_ticket": VIEWS + PAY + "SELECT round(CAST(sum(set_amount) AS DOUBLE)/count(set_amount),3) AS overall_avg FROM pay",
    "store_enriched": VIEWS + ENRICHED + "SELECT STORE_ID, STATE, STATEFP, COUNTYFP, TRACT, " + ", ".join(ACS_VARS) + ", county_NAME, " + ", ".join(f"county_{v}" for v in ACS_VARS) + ", CAST(revenue AS DOUBLE) AS revenue, CAST(transactions AS BIGINT) AS transactions FROM enriched",
    "store_performance": VIEWS + "SELECT CAST(STORE_ID AS VARCHAR) AS STORE_ID, CAST(sum(TOTAL_REVENUE_AMOUNT) AS DOUBLE) AS revenue, CAST(sum(TRANSACTION_COUNT) AS BIGINT) AS transactions FROM daily GROUP BY 1",
    "state_summary": _summary(False),
    "state_summary_clean": _summary(True),
    "demographic_points": VIEWS + ENRICHED + "SELECT STORE_ID, STATE, CITY, CAST(B01003_001E AS DOUBLE) AS population, CAST(B19019_001E AS DOUBLE) AS income, CAST(B17001_002E AS DOUBLE) AS poverty, CAST(B25077_001E AS DOUBLE) AS home_value FROM (" + VALID + ") z",
    "box_stats": VIEWS + ENRICHED + "SELECT STATE, CAST(q1 AS DOUBLE) AS q1, CAST(q2 AS DOUBLE) AS median, CAST(q3 AS DOUBLE) AS q3, CAST(q1-CAST(1.5 AS DECIMAL(2,1))*(q3-q1) AS DOUBLE) AS lower_fence, CAST(q3+CAST(1.5 AS DECIMAL(2,1))*(q3-q1) AS DOUBLE) AS upper_fence, mn AS min, mx AS max FROM (SELECT STATE, CAST(quantile_cont(x,0.25) AS DECIMAL(18,4)) AS q1, CAST(quantile_cont(x,0.5) AS DECIMAL(18,4)) AS q2, CAST(quantile_cont(x,0.75) AS DECIMAL(18,4)) AS q3, min(x) AS mn, max(x) AS mx FROM (SELECT STATE, CAST(B19019_001E AS DOUBLE) AS x FROM (" + VALID + ") v) w GROUP BY 1) z",
    "parse_geocode": VIEWS + GEO + "SELECT CAST(STORE_ID AS VARCHAR) AS STORE_ID, " + TRACT_KEYS_SQL + " FROM geo",
    "parse_tract_acs": _parse_tract(),
    "parse_county_acs": _parse_county(),
    "pending_keys": VIEWS + GEO + "SELECT DISTINCT " + TRACT_KEYS_SQL + " FROM geo WHERE g > 1 AND tk % 10 = 3",
    "year_bounds": VIEWS + "SELECT min(CALENDAR_YEAR) AS min_year, max(CALENDAR_YEAR) AS max_year FROM daily",
    "store_activity": VIEWS + f"SELECT (SELECT count(*) FROM stores) AS master, (SELECT {n_unique_sql('STORE_ID')} FROM daily) AS active_ever, (SELECT {n_unique_sql('STORE_ID')} FROM daily WHERE {PERIOD_DAILY}) AS active_in_period",
    "home_kpis": VIEWS + f"SELECT (SELECT count(*) FROM stores) AS total_stores, (SELECT {n_unique_sql('STORE_ID')} FROM daily WHERE {PERIOD_DAILY}) AS active_stores, (SELECT count(*) FROM gtin) AS total_products, (SELECT CAST(coalesce(sum(GRAND_TOTAL_AMOUNT),0) AS DOUBLE) FROM sets WHERE {PERIOD_SETS}) AS total_revenue, (SELECT count(*) FROM sets WHERE {PERIOD_SETS}) AS total_transactions",
    "table_profile": VIEWS + " UNION ALL ".join(
        f"SELECT '{t}' AS table_name, '{c}' AS column_name, count(*) AS n_rows, {n_unique_sql(c)} AS n_distinct FROM {t}"
        for t, c in (("stores", "STATE"), ("stores", "STORE_CHAIN_NAME"), ("gtin", "BRAND"),
                     ("sets", "PAYMENT_TYPE"), ("items", "GTIN"))),
    "daily_key_profile": VIEWS + "SELECT count(*) AS n_rows, count(DISTINCT GTIN) AS n_keys, count(*)-count(DISTINCT GTIN) AS duplicates FROM items",
    "gtin_key_profile": VIEWS + "SELECT count(*) AS n_rows, count(DISTINCT GTIN) AS n_keys, count(*)-count(DISTINCT GTIN) AS duplicates FROM (SELECT GTIN FROM gtin UNION ALL SELECT GTIN FROM gtin WHERE GTIN % 7 = 0) g",
    "parameter_values": VIEWS + "SELECT CAST(unnest(range(min(CALENDAR_YEAR), max(CALENDAR_YEAR)+1)) AS INTEGER) AS y FROM daily",
    "daily_rollup": VIEWS + f"SELECT {_daily_cols()}, CAST(TOTAL_REVENUE_AMOUNT AS DOUBLE) AS revenue, CAST(QUANTITY AS DOUBLE) AS quantity, TRANSACTION_COUNT FROM daily",
    "category_count": VIEWS + f"SELECT {n_unique_sql('CATEGORY')} AS n_categories FROM daily",
    "weekly_top_products_ranked": VIEWS + TOP5 + WEEKLY + "SELECT CALENDAR_WEEK, SKUPOS_DESCRIPTION, BRAND, CAST(row_number() OVER (ORDER BY CALENDAR_WEEK, r DESC NULLS FIRST, SKUPOS_DESCRIPTION NULLS FIRST, BRAND NULLS FIRST) AS INTEGER) AS position FROM wk",
    "weekly_top_products_target": VIEWS + TOP5 + WEEKLY + "SELECT CALENDAR_WEEK, SKUPOS_DESCRIPTION, BRAND, CAST(50000 AS DOUBLE) AS target FROM wk",
    "payment_table": VIEWS + PAY + "SELECT PAYMENT_TYPE AS Payment_Type, SKUPOS_DESCRIPTION AS Product, CATEGORY AS Category, printf('%,d', n) AS Purchase_Count, printf('$%,.2f', round(CAST(rev AS DOUBLE),2)) AS Revenue FROM (SELECT *, row_number() OVER (PARTITION BY PAYMENT_TYPE ORDER BY n DESC, SKUPOS_DESCRIPTION ASC NULLS FIRST, CATEGORY ASC NULLS FIRST) AS rn FROM (SELECT PAYMENT_TYPE, SKUPOS_DESCRIPTION, CATEGORY, count(DISTINCT TRANSACTION_SET_ID) AS n, sum(set_amount) AS rev FROM pay WHERE CATEGORY IS NOT NULL GROUP BY 1,2,3) g) z WHERE rn <= 5",
    "payment_summary_duplicate_gtin": VIEWS + ", twice AS (SELECT GTIN FROM gtin UNION ALL SELECT GTIN FROM gtin WHERE GTIN % 7 = 0) SELECT s.PAYMENT_TYPE, count(DISTINCT s.TRANSACTION_SET_ID) AS num_transactions, CAST(sum(s.GRAND_TOTAL_AMOUNT) AS DOUBLE) AS total_spend, CAST(sum(i.UNIT_QUANTITY) AS DOUBLE) AS total_items FROM sets s JOIN items i ON s.TRANSACTION_SET_ID = i.TRANSACTION_SET_ID LEFT JOIN twice g ON i.GTIN = g.GTIN WHERE s.PAYMENT_TYPE IN ('CASH','CREDIT','DEBIT') GROUP BY 1",
    "state_table": "SELECT CAST(row_number() OVER (ORDER BY store_count DESC, STATE) AS INTEGER) AS position, STATE AS State, printf('%,d', store_count) AS Stores, printf('%,d', CAST(round(avg_tract_pop) AS BIGINT)) AS Avg_Tract_Pop, CASE WHEN round(avg_income) < 0 THEN '$-' ELSE '$' END || printf('%,.2f', abs(round(avg_income))) AS Avg_Median_Income, printf('%,d', CAST(round(avg_poverty) AS BIGINT)) AS Avg_Below_Poverty, printf('$%,.2f', round(avg_home_value)) AS Avg_Home_Value FROM (" + _summary(False) + ") z",
    "parse_county_acs_reordered": _parse_county(),
    "pending_stores": VIEWS + "SELECT CAST(STORE_ID AS VARCHAR) AS STORE_ID FROM stores WHERE STORE_ID % 4 = 2 OR STORE_ID % 10 IN (0, 1)",
    "fresh_responses": VIEWS + "SELECT CAST(STORE_ID AS VARCHAR) AS STORE_ID FROM stores WHERE STORE_ID % 300 < 120",
    "table_counts": VIEWS + " UNION ALL ".join(f"SELECT '{t}' AS table_name, count(*) AS n_rows FROM {t}" for t in ("stores", "gtin", "sets", "items")),
    "months_subtitle": VIEWS + "SELECT 'Months: ' || string_agg(CAST(m AS VARCHAR), ', ' ORDER BY m) AS subtitle FROM (SELECT DISTINCT CALENDAR_MONTH AS m FROM daily) z",
}

TOP5_OF_PERIOD = TOP5_PERIOD + WEEKLY.replace("FROM daily WHERE", f"FROM daily WHERE {PERIOD_DAILY} AND")
BEV_PERIOD = BEV.replace("WHERE CATEGORY IS NOT NULL", f"WHERE {PERIOD_DAILY} AND CATEGORY IS NOT NULL")
TRACTS = "(SELECT DISTINCT nk, tk FROM geo WHERE g > 1)"

ORACLE.update({
    "items_in_period_landed": VIEWS + f"SELECT count(*) AS n_items, CAST(coalesce(sum(UNIT_QUANTITY),0) AS DOUBLE) AS units FROM items i WHERE EXISTS (SELECT 1 FROM sets s WHERE s.TRANSACTION_SET_ID=i.TRANSACTION_SET_ID AND {PERIOD_SETS})",
    "filter_year_month_landed": ORACLE["filter_year_month"],
    "payment_summary_period_landed": ORACLE["payment_summary_period"],
    "category_list_period_landed": VIEWS + f"SELECT DISTINCT CATEGORY FROM daily WHERE CATEGORY <> 'FUEL' AND {PERIOD_DAILY}",
    "refreshed_daily": VIEWS + "SELECT CALENDAR_YEAR, CALENDAR_MONTH, count(*) AS n_rows, CAST(sum(TOTAL_REVENUE_AMOUNT) AS DOUBLE) AS revenue FROM daily GROUP BY 1, 2",
    "top_products_cube": ORACLE["top_products"],
    "weekly_top_products_cube": ORACLE["weekly_top_products"],
    "top_products_kpis_cube": ORACLE["top_products_kpis"].replace(VIEWS + TOP5 + WEEKLY, VIEWS + TOP5_OF_PERIOD),
    "payment_cube": VIEWS + PAY + "SELECT FALSE AS PER_PRODUCT, PAYMENT_TYPE, NULL AS SKUPOS_DESCRIPTION, NULL AS CATEGORY, count(DISTINCT TRANSACTION_SET_ID) AS n_baskets, CAST(sum(set_amount) AS DOUBLE) AS spend, CAST(sum(UNIT_QUANTITY) AS DOUBLE) AS units FROM pay GROUP BY 2 UNION ALL SELECT TRUE, PAYMENT_TYPE, SKUPOS_DESCRIPTION, CATEGORY, count(DISTINCT TRANSACTION_SET_ID), CAST(sum(set_amount) AS DOUBLE), CAST(sum(UNIT_QUANTITY) AS DOUBLE) FROM pay WHERE CATEGORY IS NOT NULL GROUP BY 2, 3, 4",
    "quarantine_counts": VIEWS + GEO + f"SELECT 'geocode' AS source, CASE g WHEN 0 THEN 'no_tract' ELSE 'malformed' END AS reason, count(*) AS n FROM geo WHERE g < 2 GROUP BY 1, 2 UNION ALL SELECT 'tract', 'header_only', count(*) FROM {TRACTS} t WHERE tk % 10 = 3 HAVING count(*) > 0 UNION ALL SELECT 'county', 'short_row', count(*) FROM supplier WHERE s_suppkey % 5 = 0 HAVING count(*) > 0",
    "pending_stores_reasons": VIEWS + "SELECT CAST(STORE_ID AS VARCHAR) AS STORE_ID, CASE WHEN STORE_ID % 4 = 2 THEN 'never_fetched' WHEN STORE_ID % 10 = 0 THEN 'no_tract' ELSE 'malformed' END AS reason FROM stores WHERE STORE_ID % 4 = 2 OR STORE_ID % 10 IN (0, 1)",
    "distinct_sketch": VIEWS + ", sold AS (SELECT s.STORE_ID, s.TRANSACTION_SET_ID, i.GTIN FROM sets s JOIN items i ON s.TRANSACTION_SET_ID = i.TRANSACTION_SET_ID WHERE " + PERIOD_SETS.replace("DATE_TIME", "s.DATE_TIME") + ") "
        + " UNION ALL ".join(f"SELECT '{c}' AS key, {n_unique_sql(c)} AS exact, TRUE AS within_bound FROM sold" for c in ("STORE_ID", "TRANSACTION_SET_ID", "GTIN")),
    "load_items_parts": VIEWS + "SELECT count(*) AS n_items, CAST(coalesce(sum(UNIT_QUANTITY),0) AS DOUBLE) AS units, CAST(coalesce(sum(GRAND_TOTAL_AMOUNT),0) AS DOUBLE) AS amount FROM items",
    "materialized_daily": VIEWS + f"SELECT CALENDAR_MONTH, count(*) AS n_rows, CAST(sum(TOTAL_REVENUE_AMOUNT) AS DOUBLE) AS revenue, CAST(sum(TRANSACTION_COUNT) AS BIGINT) AS transactions FROM daily WHERE {PERIOD_DAILY} GROUP BY 1",
    "load_folder": VIEWS + " UNION ALL ".join(
        f"SELECT '{t}' AS table_name, '{c}' AS column_name, count(*) AS n_rows, {n_unique_sql(c)} AS n_distinct FROM {t}"
        for t, c in (("stores", "STORE_ID"), ("gtin", "GTIN"), ("sets", "TRANSACTION_SET_ID"), ("items", "GTIN"), ("daily", "CATEGORY"))),
    "page_home": VIEWS + f"SELECT (SELECT count(*) FROM stores) AS total_stores, (SELECT {n_unique_sql('STORE_ID')} FROM daily) AS active_ever, (SELECT {n_unique_sql('STORE_ID')} FROM daily WHERE {PERIOD_DAILY}) AS active_stores, (SELECT count(*) FROM gtin) AS total_products, (SELECT CAST(coalesce(sum(GRAND_TOTAL_AMOUNT),0) AS DOUBLE) FROM sets WHERE {PERIOD_SETS}) AS total_revenue, (SELECT count(*) FROM sets WHERE {PERIOD_SETS}) AS total_transactions",
    "page_top_products": VIEWS + TOP5_PERIOD + "SELECT SKUPOS_DESCRIPTION AS Product, BRAND AS Brand, CATEGORY AS Category, printf('$%,.2f', round(CAST(rev AS DOUBLE),2)) AS Revenue, printf('%,.0f', CAST(units AS DOUBLE)) AS Units, printf('$%,.2f', round(CAST(rev AS DOUBLE)/CAST(nullif(units,0) AS DOUBLE),2)) AS \"Avg Price\", printf('%,.0f', CAST(txns AS DOUBLE)) AS Transactions FROM top5",
    "page_brands": VIEWS + BEV_PERIOD + "SELECT count(*) AS brands, count(CASE WHEN revenue < 36000000 THEN 1 END) AS below, CAST(coalesce(sum(revenue),0) AS DOUBLE) AS total, round(coalesce(CAST(sum(revenue) AS DOUBLE)/count(revenue),0),4) AS avg_rev FROM bev",
    "page_payments": ORACLE["payment_summary_period"],
    "page_payments_table": ORACLE["payment_table"],
    "page_demographics": ORACLE["state_table"],
    "page_validation": VIEWS + " UNION ALL ".join(
        f"SELECT '{t}' AS table_name, '{c}' AS column_name, count(*) AS n_rows, {n_unique_sql(c)} AS n_distinct FROM {t}"
        for t, c in (("stores", "STATE"), ("stores", "STORE_CHAIN_NAME"), ("gtin", "GTIN"))),
})

