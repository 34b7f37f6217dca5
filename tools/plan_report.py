"""Physical-plan summary of the headline queries (for plan review).

Usage: python tools/plan_report.py [sf_dir] > PLANS.md
Per query: exchanges (shuffles), join strategies, windows, aggregates and
the columns each Parquet scan reads (column pruning) with pushed filters.
"""

from __future__ import annotations

import os
import re
import sys

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))


def summarize(plan: str) -> dict:
    scans = re.findall(r"FileScan parquet \[([^\]]*)\].*?PushedFilters: \[([^\]]*)\]", plan)
    return {
        "exchanges": len(re.findall(r"Exchange (?:hashpartitioning|rangepartitioning|SinglePartition|RoundRobin)", plan)),
        "single_partition": plan.count("SinglePartition"),
        "broadcast_joins": plan.count("BroadcastHashJoin"),
        "sort_merge_joins": plan.count("SortMergeJoin"),
        "windows": len(re.findall(r"\bWindow\b", plan)),
        "aggregates": len(re.findall(r"HashAggregate|ObjectHashAggregate|SortAggregate", plan)),
        "scans": [(len([c for c in cols.split(",") if c.strip()]), filt[:80]) for cols, filt in scans],
    }


def main():
    sf_dir = sys.argv[1] if len(sys.argv) > 1 else "/root/testdata/sf0.1"
    from bench import HEADLINE
    from exposa.plans.catalog import QUERIES
    from exposa.session import get_spark
    spark = get_spark()
    print(f"# Plan summary ({sf_dir})\n")
    print("Executed (AQE final) plans; stages read from the shared checkpoint folder.\n")
    print("| query | shuffles | single-partition | broadcast joins | sort-merge joins | windows | aggregates | scans (columns read; pushed filters) |")
    print("|---|---|---|---|---|---|---|---|")
    for name in (n for n in HEADLINE if n in QUERIES):
        df = QUERIES[name](spark, sf_dir)
        df.write.format("noop").mode("overwrite").save()
        plan = df._jdf.queryExecution().executedPlan().toString()
        s = summarize(plan)
        scans = "; ".join(f"{n} cols [{f}]" for n, f in s["scans"])
        print(f"| {name} | {s['exchanges']} | {s['single_partition']} | {s['broadcast_joins']} | "
              f"{s['sort_merge_joins']} | {s['windows']} | {s['aggregates']} | {scans} |")


if __name__ == "__main__":
    main()
