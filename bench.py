"""Bench: the dashboard pages (C1-C6) on the driver's tables.

Step 1 materialises the supporting ``daily`` aggregate (partitioned by year
and month, as the dashboard receives it) into the session's shared
checkpoint folder; steps 2.. time each page computing all of its result
frames (a no-op write: no row crosses to the driver). Each timing is the
median of ``BENCH_REPS`` runs after a warm-up. ``fixed_cost`` is what a page
takes over empty tables; only the rest grows with the data.

Env: BENCH_SF_DIR (default /root/testdata/sf0.1), BENCH_CPUS (default 8),
BENCH_REPS (default 3), BENCH_EVENT_LOG (optional folder for Spark's event
log). Prints one JSON line.
"""

from __future__ import annotations

import json
import os
import statistics
import sys
import time
import uuid

sys.path.insert(0, os.path.dirname(os.path.abspath(__file__)))

from tillroll.plans import pages  # noqa: E402
from tillroll.session import ensure_checkpoint_dir, local_session  # noqa: E402
from tillroll.sources import fixtures, tables  # noqa: E402

YEAR, MONTHS = 1997, (1, 2, 3)


def _pull(frames: dict) -> None:
    """Compute every frame in full; nothing crosses to the driver."""
    for df in frames.values():
        df.write.format("noop").mode("overwrite").save()
    if hasattr(frames, "release"):
        frames.release()


def _sf_number(sf_dir: str):
    tag = os.path.basename(sf_dir.rstrip("/")).replace("sf", "")
    try:
        return float(tag)
    except ValueError:
        return tag


def main() -> None:
    sf_dir = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    cpus = int(os.environ.get("BENCH_CPUS", "8"))
    reps = int(os.environ.get("BENCH_REPS", "3"))
    extra = {"spark.driver.memory": "16g"}
    if os.environ.get("BENCH_EVENT_LOG"):   # stage/task times without any UI
        extra.update({"spark.eventLog.enabled": "true", "spark.eventLog.dir": os.environ["BENCH_EVENT_LOG"]})
    spark = local_session(cpus, cpus * 2, app_name="tillroll-bench", extra=extra)
    root = ensure_checkpoint_dir(spark, "/tmp/tillroll-checkpoints")   # used only where none is set (local runs)
    out_dir = f"{root.rstrip('/')}/tillroll-bench-{uuid.uuid4().hex[:8]}"

    t = fixtures.retail_tables(spark, sf_dir)
    timings: dict[str, list[float]] = {}

    def timed(name: str, fn) -> None:
        fn()  # warm-up (JIT, file listing, broadcast build)
        runs = []
        for _ in range(reps):
            t0 = time.perf_counter()
            fn()
            runs.append(time.perf_counter() - t0)
        timings[name] = runs

    def build_daily():
        path = f"{out_dir}/daily-{uuid.uuid4().hex[:6]}"
        tables.materialize(t["daily"], path, partition_by=["CALENDAR_YEAR", "CALENDAR_MONTH"])
        return path

    timed("daily_rollup", build_daily)
    daily_path = build_daily()
    daily = spark.read.parquet(daily_path)
    pt = fixtures.retail_tables(spark, sf_dir, daily=daily)
    # The fetcher's landed responses are inputs: write them once, untimed.
    census_raw = {}
    for name, df in fixtures.census_tables(spark, sf_dir, pt["stores"]).items():
        tables.materialize(df, f"{out_dir}/landed/{name}")
        census_raw[name] = spark.read.parquet(f"{out_dir}/landed/{name}")
    timed("census_landing", lambda: pages.land_census(census_raw, f"{out_dir}/census-{uuid.uuid4().hex[:6]}"))
    census_parsed = pages.land_census(census_raw, f"{out_dir}/census")

    timed("home", lambda: _pull(pages.home_page(pt, YEAR, MONTHS)))
    timed("validation", lambda: _pull(pages.validation_page(pt)))
    timed("top_products", lambda: _pull(pages.top_products_page(pt, None, None)))
    timed("brands", lambda: _pull(pages.brands_page(pt, None, None)))
    timed("payments", lambda: _pull(pages.payments_page(pt, None, None, ("CASH", "CREDIT", "DEBIT"))))
    timed("demographics", lambda: _pull(pages.demographics_page(pt, census_parsed)))

    # What a page costs besides its data: the same pages over the same tables with no rows in them.
    empty = fixtures.retail_tables(spark, sf_dir, daily=daily.where("false"))
    for name in ("gtin", "sets", "items", "stores"):
        empty[name] = empty[name].where("false")
    fixed: dict[str, float] = {}
    for name, page in {"home": lambda x: pages.home_page(x, YEAR, MONTHS), "top_products": pages.top_products_page, "brands": pages.brands_page, "payments": pages.payments_page}.items():
        _pull(page(empty))
        t0 = time.perf_counter()
        _pull(page(empty))
        fixed[name] = round(time.perf_counter() - t0, 3)

    med = {k: round(statistics.median(v), 3) for k, v in timings.items()}
    print(json.dumps({
        "metric": "dashboard_pages_total_median",
        "value": round(sum(med.values()), 3),
        "unit": "sec",
        "queries": med,
        "fixed_cost": fixed,
        "sf": _sf_number(sf_dir),
        "cpus": cpus,
        "reps": reps,
        "spark": spark.version,
        "shuffle_partitions": int(spark.conf.get("spark.sql.shuffle.partitions")),
    }))
    spark.stop()


if __name__ == "__main__":
    main()
