"""Write ``explain("formatted")`` of every registered query to docs/plans/<key>.txt.

Usage: python tools/dump_plans.py [sf_dir]
Eager keys (streams, loops, the stored backend output) are planned after
their writes, so their plans show the read of the written table.
"""

from __future__ import annotations

import os
import sys

sys.path.insert(0, ".")
from turnforge.plans.catalog import QUERIES  # noqa: E402
from turnforge.session import local_session  # noqa: E402


def main():
    sf = sys.argv[1] if len(sys.argv) > 1 else "/root/testdata/sf0.01"
    out = "docs/plans"
    os.makedirs(out, exist_ok=True)
    spark = local_session("plans", "8")
    util = spark._jvm.org.apache.spark.sql.api.python.PythonSQLUtils
    for key, fn in sorted(QUERIES.items()):
        df = fn(spark, sf)
        text = util.explainString(df._jdf.queryExecution(), "formatted")
        with open(f"{out}/{key}.txt", "w") as f:
            f.write(f"-- {key} @ {os.path.basename(sf)}\n{text}\n")
    print("wrote", len(QUERIES), "plans to", out)


if __name__ == "__main__":
    main()
