import contextlib
import io
import os
import sys

ROOT = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))
sys.path.insert(0, ROOT)
from tillroll.plans.queries import QUERIES
from tillroll.session import local_session
spark = local_session(8, 8, extra={"spark.sql.autoBroadcastJoinThreshold": "-1", "spark.sql.adaptive.enabled": "false"})
names = ["daily_rollup", "payment_summary_published", "top_products_by_payment", "weekly_top_products", "items_in_period"]
out = ["# Physical plans at scale settings", "",
       "Generated by `python scripts/gen_plans_doc.py` (size-based broadcasts and AQE off, so",
       "every exchange a large cluster would run is visible). Only the operator trees are kept.", ""]
for n in names:
    buf = io.StringIO()
    with contextlib.redirect_stdout(buf):
        QUERIES[n](spark, "/root/testdata/sf0.01").explain("formatted")
    tree = buf.getvalue().split("\n\n")[0]
    out += [f"## {n}", "", "```", tree.strip(), "```", ""]
open(os.path.join(ROOT, "docs", "PLANS.md"), "w").write("\n".join(out))
