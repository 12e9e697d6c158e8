"""Question 4: store demographics from Census tract and county statistics.

P5 ``with_prefix``, J4-J7 ``enrich_stores``, A6 ``store_performance``,
P17 ``valid_stores``, A7 ``state_summary``, P18 ``demographic_points``,
A15 ``box_stats``.

All census-side frames are bounded by geography (about 85k US tracts and
3.2k counties), never by transaction volume; the store-level joins are left
joins that keep every store. Broadcasting is left to the planner, which
sizes each side (AQE uses the measured size at run time).
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tillroll.functions.exprs import id_text, zero_sum
from tillroll.operators.present import formatted, present, rounded
from tillroll.sources.schemas import ACS_VARS, HOME_VALUE, INCOME, POPULATION, POVERTY, TRACT_KEYS

# Display names of the four variables the summary reports.
SUMMARY_VARS = {"population": POPULATION, "income": INCOME, "poverty": POVERTY, "home_value": HOME_VALUE}


def with_prefix(df: DataFrame, cols: Sequence[str], prefix: str, keep: Sequence = ()) -> DataFrame:
    """P5: ``keep`` columns plus ``prefix``-renamed copies of ``cols`` in one
    projection (the county frame's variables become ``county_<var>``)."""
    return df.select(*keep, *[F.col(c).alias(f"{prefix}{c}") for c in cols])


def store_performance(daily: DataFrame) -> DataFrame:
    """Revenue and transactions per store; id normalised to text."""
    return daily.groupBy("STORE_ID").agg(
        zero_sum("TOTAL_REVENUE_AMOUNT").alias("revenue"),
        zero_sum("TRANSACTION_COUNT").alias("transactions"),
    ).select(id_text("STORE_ID").alias("STORE_ID"), "revenue", "transactions")


def enrich_stores(stores: DataFrame, store_tract: DataFrame, tract_acs: DataFrame,
                  county_acs: DataFrame | None, store_perf: DataFrame | None,
                  variables: Sequence[str] = ACS_VARS, store_cols: Sequence[str] = ("STATE", "CITY")) -> DataFrame:
    """Store -> tract keys -> tract ACS -> county ACS -> performance.

    Every join is a left join, so the store count is preserved when the
    lookup keys are unique. County keys are renamed before the join
    (``county_state``/``county_county``) so they cannot clash with the store's
    ``STATE``, and only the ``county_*`` copies of the county variables are
    joined, so tract and county values never share a name. A missing county
    frame behaves as an empty one.
    """
    keep = [c for c in store_cols if c in stores.columns]
    base = stores.select(id_text("STORE_ID").alias("STORE_ID"), *keep)
    # Both store-keyed joins first: they share one STORE_ID partitioning.
    out = base.join(store_tract.select("STORE_ID", *TRACT_KEYS), "STORE_ID", "left")
    if store_perf is not None:
        out = out.join(store_perf, "STORE_ID", "left")
    out = out.join(tract_acs.select(*TRACT_KEYS, *variables), list(TRACT_KEYS), "left")
    if county_acs is not None:
        county = with_prefix(county_acs, [*variables, "NAME"], "county_", keep=[
            F.col("state").alias("county_state"), F.col("county").alias("county_county")])
        out = out.join(
            county,
            (out["STATEFP"] == county["county_state"]) & (out["COUNTYFP"] == county["county_county"]),
            "left",
        ).drop("county_state", "county_county")
    else:
        out = out.select("*", *[F.lit(None).cast("string").alias(f"county_{v}") for v in variables],
                         F.lit(None).cast("string").alias("county_NAME"))
    return out


def valid_stores(enriched: DataFrame) -> DataFrame:
    """Stores with both population and income present."""
    return enriched.dropna(subset=[POPULATION, INCOME])


def clean_annotations(df: DataFrame, variables: Sequence[str] = ACS_VARS) -> DataFrame:
    """Optional: NULL out ACS annotation codes (large negative sentinels)
    instead of letting them into means (the published default keeps them)."""
    fixed = {v: F.when(F.col(v).try_cast("double") >= 0, F.col(v)) for v in variables if v in df.columns}
    return df.withColumns(fixed)


def demographic_points(valid: DataFrame, extra: Sequence[str] = ("STATE", "CITY")) -> DataFrame:
    """Per-store points for the scatter/box charts (values as double)."""
    keep = [c for c in extra if c in valid.columns]
    return valid.select(
        "STORE_ID", *keep, *[F.col(v).cast("double").alias(name) for name, v in SUMMARY_VARS.items()]
    )


def summary_order():
    """Display order of the state summary (most stores first)."""
    return [F.desc("store_count"), F.asc("STATE")]


def state_summary(valid: DataFrame) -> DataFrame:
    """Per state - stores with an id, and the mean of four variables."""
    pts = demographic_points(valid, extra=("STATE",))
    return pts.groupBy("STATE").agg(
        F.count("STORE_ID").alias("store_count"),
        F.avg("population").alias("avg_tract_pop"),
        F.avg("income").alias("avg_income"),
        F.avg("poverty").alias("avg_poverty"),
        F.avg("home_value").alias("avg_home_value"),
    )


def state_table(summary: DataFrame) -> DataFrame:
    """The state summary as displayed: means without decimals, incomes and home values as currency. O4: in the
    order of ``position`` (one row a state, so one task)."""
    money, counts = ["Avg_Median_Income", "Avg_Home_Value"], ["Stores", "Avg_Tract_Pop", "Avg_Below_Poverty"]
    shown = present(summary.withColumn("position", F.row_number().over(Window.orderBy(*summary_order()))), {
        "position": "position", "State": "STATE", "Stores": "store_count", "Avg_Tract_Pop": "avg_tract_pop",
        "Avg_Median_Income": "avg_income", "Avg_Below_Poverty": "avg_poverty", "Avg_Home_Value": "avg_home_value",
    })
    return formatted(rounded(shown, [*money, *counts[1:]], 0), money=money, counts=counts)


def quantiles(df: DataFrame, group: str, value: Column, probabilities: Sequence[float] = (0.25, 0.5, 0.75)) -> DataFrame:
    """Exact quantiles (linear interpolation) per group: (group, q0, q1, ..., min, max).

    Equal values of a group are counted first (map-side); running sums over the sorted counts, from below and from
    above, give each value's last rank and the group's total, and the values that hold the ranks asked for are
    picked. No task holds a group's values. Nulls don't count; a group of nulls only has null quantiles.
    """
    counts = df.select(group, value.alias("_v")).groupBy(group, "_v").agg(F.count("_v").alias("_n"))
    up = Window.partitionBy(group).orderBy(F.col("_v").asc_nulls_first()).rowsBetween(Window.unboundedPreceding, Window.currentRow)
    down = Window.partitionBy(group).orderBy(F.col("_v").desc_nulls_last()).rowsBetween(Window.unboundedPreceding, Window.currentRow)
    ranked = counts.withColumn("_last", F.sum("_n").over(up)).withColumn("_total", F.sum("_n").over(down) + F.col("_last") - F.col("_n"))
    holds = lambda rank: F.min(F.when((F.col("_n") > 0) & (F.col("_last") > rank), F.col("_v")))
    picked, out = [], []
    for i, p in enumerate(probabilities):
        at = (F.col("_total") - 1) * F.lit(float(p))
        picked += [holds(F.floor(at)).alias(f"_lo{i}"), holds(F.ceil(at)).alias(f"_hi{i}"), F.max(at - F.floor(at)).alias(f"_f{i}")]
        lo, hi, f = F.col(f"_lo{i}"), F.col(f"_hi{i}"), F.col(f"_f{i}")
        out.append(F.when(lo == hi, lo).otherwise((1 - f) * lo + f * hi).alias(f"q{i}"))
    return ranked.groupBy(group).agg(*picked, F.min("_v").alias("min"), F.max("_v").alias("max")).select(group, *out, "min", "max")


def box_stats(df: DataFrame, group: str, value: str, exact: bool = True, accuracy: int = 10000) -> DataFrame:
    """Quartiles (linear interpolation), min, max and 1.5 IQR fences.

    Quartiles are fixed at 4 decimal places before the fence arithmetic so
    the fences are exact decimals. ``exact=False`` uses a bounded-memory
    sketch (``percentile_approx``) for very large groups.
    """
    v = F.col(value).cast("double")
    d4 = "decimal(18,4)"
    if exact:
        found = quantiles(df, group, v)
        q1, q2, q3 = (F.col(f"q{i}").cast(d4) for i in range(3))
    else:
        q = F.percentile_approx(v, [0.25, 0.5, 0.75], accuracy)
        found = df.groupBy(group).agg(q.alias("_q"), F.min(v).alias("min"), F.max(v).alias("max"))
        q1, q2, q3 = (F.col("_q")[i].cast(d4) for i in range(3))
    iqr = q3 - q1
    k = F.lit(1.5).cast("decimal(2,1)")
    return found.select(
        group,
        q1.cast("double").alias("q1"), q2.cast("double").alias("median"), q3.cast("double").alias("q3"),
        (q1 - k * iqr).cast("double").alias("lower_fence"), (q3 + k * iqr).cast("double").alias("upper_fence"),
        "min", "max",
    )
