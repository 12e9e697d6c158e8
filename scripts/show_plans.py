"""Print the physical plan of registered queries.

usage: python scripts/show_plans.py [--scale] [--sf DIR] name [name ...]

``--scale`` disables size-based broadcasts and AQE so the plan shows the
shape a large cluster gets (sort-merge joins, every exchange visible).
"""

from __future__ import annotations

import argparse
import os
import sys

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))


def main() -> None:
    ap = argparse.ArgumentParser()
    ap.add_argument("names", nargs="+")
    ap.add_argument("--sf", default="/root/testdata/sf0.01")
    ap.add_argument("--scale", action="store_true")
    a = ap.parse_args()
    from tillroll.plans.queries import QUERIES
    from tillroll.session import local_session

    extra = {"spark.sql.autoBroadcastJoinThreshold": "-1", "spark.sql.adaptive.enabled": "false"} if a.scale else {}
    spark = local_session(8, 8, extra=extra)
    for name in a.names:
        print(f"===== {name}")
        QUERIES[name](spark, a.sf).explain("formatted")
    spark.stop()


if __name__ == "__main__":
    main()
