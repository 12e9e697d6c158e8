import os

from tillroll.session import cluster_conf, cut_lineage, ensure_checkpoint_dir
from tillroll.sources import client


def test_cut_lineage_writes_to_shared_checkpoint_dir(spark):
    root = ensure_checkpoint_dir(spark)
    df = spark.range(100).selectExpr("id", "id * 2 AS x")
    cut = cut_lineage(df)
    assert cut.count() == 100
    plan = cut._jdf.queryExecution().optimizedPlan().toString()
    assert "Range" not in plan                      # lineage is gone
    local_root = root.replace("file:", "")
    assert any(os.scandir(local_root))              # reliable checkpoint files exist


def test_to_client_sorts_and_keeps_every_row(spark):
    df = spark.createDataFrame([(3,), (1,), (2,)], "v int")
    assert client.to_client(df, order_by=["v"]).v.tolist() == [1, 2, 3]
    assert len(client.to_client(spark.range(24_000))) == 24_000
    assert client.scalar(df.groupBy().max("v")) == 3
    assert client.scalar(df.where("v > 9").groupBy().max("v"), default=0) == 0


def test_cluster_conf_scales_partitions():
    small = cluster_conf(10 << 30)
    big = cluster_conf(100 << 40)
    assert int(big["spark.sql.shuffle.partitions"]) > int(small["spark.sql.shuffle.partitions"])
    assert big["spark.sql.adaptive.enabled"] == "true"
    assert "spark.ui.showConsoleProgress" not in big


def test_local_session_starts_without_a_checkpoint_dir():
    """In a process of its own, as no other session may have set the folder."""
    import subprocess
    import sys

    code = "from tillroll.session import local_session; s = local_session(1, 1); print('rows', s.range(3).count())"
    env = {k: v for k, v in os.environ.items() if not k.startswith("SPARK_")} | {"PYTHONPATH": os.path.dirname(os.path.dirname(os.path.abspath(__file__)))}
    out = subprocess.run([sys.executable, "-c", code], env=env, capture_output=True, text=True, timeout=120)
    assert "rows 3" in out.stdout, out.stderr[-500:]
