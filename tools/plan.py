"""Print the formatted plan of a registered query, or count its scans and exchanges.

    python tools/plan.py [--count] name ...
"""

from __future__ import annotations

import sys
from pathlib import Path

sys.path.insert(0, str(Path(__file__).resolve().parent.parent))
from hourgrid.session import build_session  # noqa: E402
from hourgrid.workload import REGISTRY  # noqa: E402


def main() -> None:
    args = sys.argv[1:]
    count = "--count" in args
    spark = build_session("local[8]", **{"spark.sql.shuffle.partitions": "8", "spark.ui.enabled": "false"})
    spark.sparkContext.setLogLevel("ERROR")
    for name in [a for a in args if a != "--count"] or list(REGISTRY):
        df = REGISTRY[name].run(spark, "/root/testdata/sf0.01")
        if not count:
            df.explain("formatted")
            continue
        df.collect()
        text = df._jdf.queryExecution().executedPlan().toString().split("== Initial Plan ==")[0]
        kinds = ("FileScan", "Exchange hashpartitioning", "Exchange SinglePartition", "BroadcastExchange", "ReusedExchange", "CartesianProduct",
                 "BroadcastNestedLoopJoin", "SortMergeJoin", "BroadcastHashJoin", "Window ", "PythonUDF", "ArrowEvalPython")
        print(name, {k: text.count(k) for k in kinds if text.count(k)}, flush=True)


if __name__ == "__main__":
    main()
