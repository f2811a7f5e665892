"""Command line: list / run registered queries and the pipeline runs.

  python -m pacewise list
  python -m pacewise run campaign_performance --sf /root/testdata/sf0.01 [--out PATH] [--show 20]
  python -m pacewise daily --sf DIR --out DIR [--tables campaigns,delivery]
  python -m pacewise hourly --sf DIR --out DIR

Without ``--master`` the session comes from the submitting environment
(``spark-submit`` on a cluster); ``--master local[8]`` runs locally.
"""

from __future__ import annotations

import argparse
import sys


def main(argv: list[str] | None = None) -> int:
    p = argparse.ArgumentParser(prog="pacewise")
    p.add_argument("command", choices=["list", "run", "daily", "hourly"])
    p.add_argument("name", nargs="?")
    p.add_argument("--sf", default="/root/testdata/sf0.01", help="folder holding the input tables")
    p.add_argument("--out", help="output folder (Parquet)")
    p.add_argument("--show", type=int, default=0, help="print the first N rows")
    p.add_argument("--tables", help="comma-separated subset for the daily run")
    p.add_argument("--master")
    args = p.parse_args(argv)

    from pacewise.plans.catalog import QUERIES

    if args.command == "list":
        print("\n".join(sorted(QUERIES)))
        return 0

    from pacewise.session import get_session

    spark = get_session(args.master)
    if args.command == "run":
        if args.name not in QUERIES:
            print(f"unknown query {args.name!r}; see `python -m pacewise list`", file=sys.stderr)
            return 2
        df = QUERIES[args.name](spark, args.sf)
        if args.out:
            df.write.mode("overwrite").parquet(args.out)
        if args.show or not args.out:
            df.show(args.show or 20, truncate=False)
        return 0

    from pacewise.plans import maintenance, pipeline

    if not args.out:
        print("--out is required", file=sys.stderr)
        return 2
    if args.command == "daily":
        tables = args.tables.split(",") if args.tables else None
        pipeline.layer_counts(pipeline.run_daily(spark, args.sf, args.out, tables)).show(truncate=False)
    else:
        print(maintenance.hourly_refresh_job(spark, args.sf, args.out).count(), "campaign rows refreshed")
    return 0


if __name__ == "__main__":
    raise SystemExit(main())
