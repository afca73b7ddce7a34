"""Write PLANS.md: the physical-plan shape of each headline query (no execution).

Counts shuffle exchanges, broadcast exchanges, Python stages and lists the
columns each parquet scan reads.  Queries whose construction runs a job
(checkpoints, file round trips, streams) are built on the smallest tables.
"""

from __future__ import annotations

import os
import re
import sys

ROOT = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))
sys.path.insert(0, ROOT)

SF = os.environ.get("PLAN_SF_DIR", "/root/testdata/sf0.001")


def main() -> None:
    from bench import HEADLINE
    from scorelab.plans.catalog import QUERIES
    from scorelab.session import build_session
    spark = build_session(shuffle_partitions=8)
    lines = ["# PLANS", "", f"Physical plans of the headline queries (built on `{SF}`, not executed).",
             "Exchanges are shuffles; broadcasts are explicit or AQE-planned broadcast exchanges; Python",
             "stages are Arrow-batched pandas functions.  Generated by `python scripts/plan_report.py`.", "",
             "| query | shuffles | broadcasts | Python stages | scans (columns read) |", "| --- | --- | --- | --- | --- |"]
    for name in HEADLINE:
        plan = QUERIES[name](spark, SF)._jdf.queryExecution().executedPlan().toString()
        shuffles = len(re.findall(r"(?<!Broadcast)Exchange ", plan))
        broadcasts = plan.count("BroadcastExchange")
        python = sum(plan.count(n) for n in ("ArrowEvalPython", "BatchEvalPython", "MapInPandas"))
        scans = sorted({m.group(2) + "(" + ", ".join(c.split("#")[0] for c in m.group(1).split(",")) + ")"
                        for m in re.finditer(r"FileScan parquet[^\[]*\[([^\]]*)\].*?/(\w+)\.parquet", plan)})
        lines.append(f"| `{name}` | {shuffles} | {broadcasts} | {python} | {'; '.join(scans) or 'written intermediate tables only'} |")
    open(os.path.join(ROOT, "PLANS.md"), "w").write("\n".join(lines) + "\n")
    print("\n".join(lines))


if __name__ == "__main__":
    main()
