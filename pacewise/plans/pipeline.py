"""Pipeline composition: the daily bronze → silver → gold → quality run and the table-scoped hourly run.

Plain ordered function calls in one session (the declarative dependency graph
of the original is just this composition). Each layer is written as Parquet
under ``out_dir`` and the next layer reads the written table, which also cuts
the lineage between stages (a lost executor recomputes from the last written
layer, not from the raw scan). Silver tables are read by several gold tables,
so reading them back once from storage replaces recomputation.
"""

from __future__ import annotations

import datetime as _dt
from functools import reduce

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from pacewise.config import AS_OF
from pacewise.functions.rules import QUALITY_SUITE, rules_for
from pacewise.operators import clean, quality
from pacewise.plans import delta_gold, gold
from pacewise.session import shuffles_dropped, written_once
from pacewise.sources import bindings as b
from pacewise.sources.steps import Steps
from pacewise.streaming import ingest

BRONZE = {"campaigns": b.campaigns_bronze, "delivery": b.delivery_bronze, "tickets": b.tickets_bronze,
          "qa_checks": b.qa_checks_bronze}
SILVER = {"campaigns": clean.silver_campaigns, "delivery": clean.silver_delivery, "tickets": clean.silver_tickets,
          "qa_checks": clean.silver_qa_checks}


def _write(df: DataFrame, path: str) -> DataFrame:
    df.write.mode("overwrite").parquet(path)
    return df.sparkSession.read.parquet(path)


def run_daily(spark: SparkSession, sf_dir: str, out_dir: str, tables: list[str] | None = None,
              as_of: _dt.datetime = AS_OF) -> dict[str, DataFrame]:
    """L-01: bronze → silver → gold → quality. ``tables`` limits bronze/silver to a subset (L-02)."""
    names = tables or list(BRONZE)
    out: dict[str, DataFrame] = {}
    for n in names:
        out[f"bronze.{n}"] = _write(BRONZE[n](spark, sf_dir), f"{out_dir}/bronze/{n}")
    for n in names:
        out[f"silver.{n}"] = _write(SILVER[n](out[f"bronze.{n}"], as_of), f"{out_dir}/silver/{n}")
    if {"campaigns", "delivery"} <= set(names):
        c, d = out["silver.campaigns"], out["silver.delivery"]
        # Three gold tables from one (campaign, day) aggregate of delivery, two of them from its totals per campaign.
        by_day = written_once(gold.delivery_by_campaign_day(d, as_of), "daily-days")
        totals = written_once(gold.totals_of_days(by_day), "daily-totals")
        out["gold.campaign_performance"] = _write(gold.performance_of_totals(c, totals, as_of),
                                                  f"{out_dir}/gold/campaign_performance")
        out["gold.daily_ops_summary"] = _write(gold.summary_of_days(by_day, c, as_of), f"{out_dir}/gold/daily_ops_summary")
        out["gold.platform_scorecard"] = _write(gold.scorecard_of_totals(c, totals, as_of),
                                                f"{out_dir}/gold/platform_scorecard")
    if "tickets" in names:
        t = out["silver.tickets"]
        out["gold.ops_efficiency"] = _write(gold.ops_efficiency(t, as_of), f"{out_dir}/gold/ops_efficiency")
        out["gold.assignee_workload"] = _write(gold.assignee_workload(t, as_of), f"{out_dir}/gold/assignee_workload")
    reports = [quality.quality_report(out[f"silver.{n}"], n, rules_for(n, QUALITY_SUITE))
               for n in names if rules_for(n, QUALITY_SUITE)]
    if reports:
        out["quality.report"] = _write(reduce(DataFrame.unionByName, reports), f"{out_dir}/quality/report")
    return out


def run_hourly(spark: SparkSession, landing: str, schema: StructType, campaigns: DataFrame, out_dir: str,
               as_of: _dt.datetime = AS_OF) -> DataFrame:
    """L-02: the table-scoped hourly run — newly landed delivery files → touched days of silver → campaign pacing.

    Bronze, silver, the gold tables and the stream's checkpoint live below
    ``out_dir``, so a run handles only the files that landed since the last one,
    and gold follows from the changed days (``plans/delta_gold.py``).
    """
    silver, base = f"{out_dir}/silver/delivery", f"{out_dir}/gold/pacing"

    def then(steps: Steps, days: list) -> None:
        delta_gold.refresh_performance(spark, campaigns, base, as_of, delta_gold.refresh_totals(spark, steps, days, base))

    ingest.refresh_delivery(spark, landing, schema, f"{out_dir}/bronze/delivery", silver, f"{out_dir}/checkpoint", as_of, then)
    with shuffles_dropped(spark):
        delta_gold.refresh_performance(spark, campaigns, base, as_of)
    return delta_gold.read_performance(spark, base)


def layer_counts(tables: dict[str, DataFrame]) -> DataFrame:
    """Row count per written table (one aggregate per table, unioned)."""
    parts = [df.agg(F.count(F.lit(1)).alias("row_count")).select(
        F.lit(name.split(".")[0]).alias("layer"), F.lit(name).alias("table_name"), "row_count")
        for name, df in sorted(tables.items())]
    return reduce(DataFrame.unionByName, parts)
