"""Summarise the final (post-AQE) physical plan of registered queries.

Usage: python tools/plan_report.py [sf_dir] [query ...]
Runs each query once (collecting into a no-op sink), then counts exchanges,
joins and windows in the final adaptive plan and prints one Markdown row per query.
"""

from __future__ import annotations

import os
import re
import sys

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))


def summarize(plan: str) -> dict:
    final = plan.split("== Initial Plan ==")[0]
    lines = [ln for ln in final.splitlines() if "ReusedExchange" not in ln]
    text = "\n".join(lines)
    return {
        "hash_exchanges": len(re.findall(r"Exchange hashpartitioning", text)),
        "range_exchanges": len(re.findall(r"Exchange rangepartitioning", text)),
        "single_partition": len(re.findall(r"Exchange SinglePartition", text)),
        "broadcasts": len(re.findall(r"BroadcastExchange", text)),
        "smj": len(re.findall(r"SortMergeJoin", text)),
        "bhj": len(re.findall(r"BroadcastHashJoin", text)),
        "partial_window_limit": len(re.findall(r"WindowGroupLimit .*Partial", text)),
        "partial_aggs": len(re.findall(r"HashAggregate\(keys=\[[^\]]*\], functions=\[partial_", text)),
        "reused": plan.split("== Initial Plan ==")[0].count("ReusedExchange"),
    }


def main() -> None:
    from pacewise.plans.catalog import QUERIES
    from pacewise.session import get_session

    args = sys.argv[1:]
    sf = args[0] if args and os.path.isdir(args[0]) else "/root/testdata/sf0.1"
    names = [a for a in args if a != sf] or ["campaign_performance", "daily_ops_summary", "platform_scorecard",
                                             "quality_report", "ticket_payloads", "qa_results", "alert_messages",
                                             "sla_breach_report", "conversion_dedup", "scd2_campaign_status"]
    spark = get_session("local[8]", shuffle_partitions=8)
    cols = None
    for n in names:
        df = QUERIES[n](spark, sf)
        df.write.format("noop").mode("overwrite").save()
        qe = df._jdf.queryExecution()
        qe.toRdd().count()  # runs this execution on the executors, so that its adaptive plan is the final one
        s = summarize(qe.executedPlan().toString())
        if cols is None:
            cols = list(s)
            print("| query | " + " | ".join(cols) + " |")
            print("|---" * (len(cols) + 1) + "|")
        print(f"| {n} | " + " | ".join(str(s[c]) for c in cols) + " |", flush=True)


if __name__ == "__main__":
    main()
