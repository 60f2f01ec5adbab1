"""Audit the physical plans of all registered queries (no execution).

Reports per query: shuffles (Exchange), sorts, window operators, joins by
kind, and flags nested-loop / cartesian joins and Python operators.
usage: python tools/plan_audit.py [sf_dir]
"""

from __future__ import annotations

import os
import re
import sys

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))

from tidemark.plans import registry  # noqa: E402
from tidemark.session import get_spark  # noqa: E402

# queries that run a stream or write a table while being built
EAGER = {"scan_whole_files", "stream_file_events", "stream_debounce", "stream_previous_version",
         "stream_commit_cursor", "quarantine", "upsert_results"}


def main() -> None:
    sf = sys.argv[1] if len(sys.argv) > 1 else "/root/testdata/sf0.001"
    spark = get_spark()
    rows = []
    for name, fn in registry.all_queries().items():
        if name in EAGER:
            continue
        plan = fn(spark, sf)._jdf.queryExecution().executedPlan().toString()
        c = lambda pat: len(re.findall(pat, plan))
        rows.append((name, c(r"Exchange "), c(r"\bWindow\b"), c(r"SortMergeJoin"), c(r"BroadcastHashJoin"),
                     c(r"BroadcastNestedLoopJoin|CartesianProduct"), c(r"ArrowEvalPython|FlatMapGroupsInPandas|MapInPandas|BatchEvalPython")))
    print("| query | exchanges | windows | SMJ | BHJ | nested-loop/cartesian | python |")
    print("| --- | --- | --- | --- | --- | --- | --- |")
    for r in rows:
        print("| " + " | ".join(str(x) for x in r) + " |")
    spark.stop()


if __name__ == "__main__":
    main()
