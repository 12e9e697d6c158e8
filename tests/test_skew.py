"""A hot key holding a third of the rows: results stay exact when AQE
splits the skewed join partition (checked against a pandas brute force)."""

from decimal import Decimal

import numpy as np
import pandas as pd
from pyspark.sql import functions as F

from tillroll.operators import payments
from tillroll.sources.schemas import ITEMS
from tillroll.sources.tables import load_items

SKEW_CONF = {
    "spark.sql.autoBroadcastJoinThreshold": "-1",
    "spark.sql.adaptive.enabled": "true",
    "spark.sql.adaptive.skewJoin.enabled": "true",
    "spark.sql.adaptive.forceOptimizeSkewedJoin": "true",
    "spark.sql.adaptive.skewJoin.skewedPartitionFactor": "2",
    "spark.sql.adaptive.skewJoin.skewedPartitionThresholdInBytes": "1k",
    "spark.sql.adaptive.advisoryPartitionSizeInBytes": "1k",
    "spark.sql.adaptive.coalescePartitions.enabled": "false",
    "spark.sql.shuffle.partitions": "8",
}


def _frames(spark):
    rng = np.random.default_rng(3)
    n_baskets, n_lines = 400, 6000
    basket = rng.integers(1, n_baskets, n_lines)
    basket[: n_lines // 3] = 7                       # one hot basket: a third of all lines
    items = pd.DataFrame({
        "TRANSACTION_SET_ID": basket.astype("int64"),
        "GTIN": rng.integers(1, 50, n_lines).astype("int64"),
        "UNIT_QUANTITY": [Decimal(int(x)) for x in rng.integers(1, 5, n_lines)],
        "GRAND_TOTAL_AMOUNT": [Decimal(int(x)) / 100 for x in rng.integers(100, 9999, n_lines)],
    })
    sets = pd.DataFrame({
        "TRANSACTION_SET_ID": np.arange(1, n_baskets, dtype="int64"),
        "PAYMENT_TYPE": rng.choice(["CASH", "CREDIT", "DEBIT"], n_baskets - 1),
        "GRAND_TOTAL_AMOUNT": [Decimal(int(x)) / 100 for x in rng.integers(100, 99999, n_baskets - 1)],
    })
    gtin = pd.DataFrame({"GTIN": np.arange(1, 50, dtype="int64"),
                         "CATEGORY": [f"C{i % 4}" for i in range(1, 50)],
                         "SKUPOS_DESCRIPTION": [f"P{i}" for i in range(1, 50)]})
    return items, sets, gtin


def test_hot_basket_summary_exact(spark, tmp_path):
    """Lines read through ``load_table``, products broadcast (by hint here, by AQE at run time otherwise)."""
    items, sets, gtin = _frames(spark)
    old = {k: spark.conf.get(k, None) for k in SKEW_CONF}
    for k, v in SKEW_CONF.items():
        spark.conf.set(k, v)
    try:
        s_items = spark.createDataFrame(items, "TRANSACTION_SET_ID bigint, GTIN bigint, UNIT_QUANTITY decimal(18,2), "
                                               "GRAND_TOTAL_AMOUNT decimal(18,2)").repartition(8)
        s_sets = spark.createDataFrame(sets, "TRANSACTION_SET_ID bigint, PAYMENT_TYPE string, "
                                             "GRAND_TOTAL_AMOUNT decimal(18,2)").repartition(8)
        s_gtin = spark.createDataFrame(gtin, "GTIN bigint, CATEGORY string, SKUPOS_DESCRIPTION string")
        s_items.write.parquet(str(tmp_path / "items"))
        s_items = load_items(spark, str(tmp_path / "items"), ITEMS)
        lines = payments.payment_lines(s_sets, s_items, F.broadcast(s_gtin))
        summary = payments.payment_summary(lines)
        got = {r.PAYMENT_TYPE: r for r in summary.collect()}
        final_plan = summary._jdf.queryExecution().executedPlan().toString()
        by_prod = {(r.PAYMENT_TYPE, r.SKUPOS_DESCRIPTION): r.purchase_count
                   for r in payments.product_by_payment(lines).collect()}
    finally:
        for k, v in old.items():
            if v is None:
                spark.conf.unset(k)
            else:
                spark.conf.set(k, v)

    j = items.merge(sets.rename(columns={"GRAND_TOTAL_AMOUNT": "set_amount"}), on="TRANSACTION_SET_ID")
    j = j.merge(gtin, on="GTIN", how="left")
    for ptype, g in j.groupby("PAYMENT_TYPE"):
        r = got[ptype]
        assert r.num_transactions == g.TRANSACTION_SET_ID.nunique()
        assert r.total_spend == sum(g.set_amount)
        assert r.total_items == sum(g.UNIT_QUANTITY)
    bp = j.groupby(["PAYMENT_TYPE", "SKUPOS_DESCRIPTION"]).TRANSACTION_SET_ID.nunique()
    assert by_prod == {k: int(v) for k, v in bp.items()}
    assert "skew=true" in final_plan or "isSkewJoin=true" in final_plan
