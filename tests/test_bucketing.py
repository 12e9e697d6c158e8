"""Bucketed fact tables: the basket join needs no exchange at all."""

from tillroll.operators import payments
from tillroll.operators.rollup import daily_rollup
from tillroll.sources import tables


def _plan(df):
    return df._jdf.queryExecution().executedPlan().toString()


def test_bucketed_basket_join_has_no_exchange(spark, small_tables):
    old = {k: spark.conf.get(k) for k in ("spark.sql.autoBroadcastJoinThreshold", "spark.sql.adaptive.enabled")}
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    spark.conf.set("spark.sql.adaptive.enabled", "false")
    try:
        items = tables.write_bucketed(small_tables["items"], "items_b", "TRANSACTION_SET_ID", 4)
        sets = tables.write_bucketed(small_tables["sets"], "sets_b", "TRANSACTION_SET_ID", 4)
        lines = payments.payment_lines(sets, items, small_tables["gtin"])
        summary = payments.payment_summary(lines)
        plan = _plan(lines.baskets)
        below_join = plan.split("SortMergeJoin [TRANSACTION_SET_ID")[1]
        assert "Exchange hashpartitioning(TRANSACTION_SET_ID" not in below_join
        # same numbers as the unbucketed plan
        want = payments.payment_summary(payments.payment_lines(
            small_tables["sets"], small_tables["items"], small_tables["gtin"]))
        assert sorted(map(tuple, summary.collect())) == sorted(map(tuple, want.collect()))
        rolled = daily_rollup(items, sets, small_tables["gtin"])
        assert rolled.count() == small_tables["daily"].count()
    finally:
        for k, v in old.items():
            spark.conf.set(k, v)
