"""Campaign performance kept up to date from changed days only.

Below ``base`` lie three tables:

* ``partials``, partitioned by month: exact sums per (campaign, day);
* ``totals``, partitioned by bucket of the campaign: the sums of a campaign's
  partials, its number of days, its first and last day;
* ``performance``, in the same buckets: the finished gold rows.

When days of silver are rewritten, their old partials are taken off the totals and
their new ones added; sums are integers and decimals, so this is exact. Only the
buckets of campaigns with a changed day are rewritten, and of these only such rows
as changed are computed anew. First and last day need a second look only where a
day that was one of them lost its rows. Each change is made from a copy that the
job's ``Steps`` keep, so a job that died is simply run again.
"""

from __future__ import annotations

import datetime as _dt
from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from pacewise.config import AS_OF
from pacewise.functions.columns import as_of_date
from pacewise.plans import gold
from pacewise.session import written_once
from pacewise.sources.sinks import read_if_present, write_overwrite
from pacewise.sources.steps import Steps, replace_partitions

#: Sums that partials of a day and totals of a campaign share.
SUMS = ["impressions", "clicks", "spend", "vast_errors", "view_sum", "view_n", "cpm_sum", "cpm_n", "cpc_sum", "cpc_n",
        "zero_rows", "suspicious_rows"]
PARTIALS = ("campaign_id string, impressions bigint, clicks bigint, spend decimal(28,2), vast_errors bigint, view_sum decimal(38,10), "
            "view_n bigint, cpm_sum decimal(38,10), cpm_n bigint, cpc_sum decimal(38,10), cpc_n bigint, zero_rows bigint, "
            "suspicious_rows bigint, delivery_date date")
STORED_PARTIALS = PARTIALS + ", month string"
TOTALS = ("campaign_id string, days bigint, impressions bigint, clicks bigint, spend decimal(38,2), vast_errors bigint, view_sum decimal(38,10), "
          "view_n bigint, cpm_sum decimal(38,10), cpm_n bigint, cpc_sum decimal(38,10), cpc_n bigint, zero_rows bigint, "
          "suspicious_rows bigint, first_day date, last_day date, bucket int")
BUCKETS = 64
RECENT_DAYS = 7


def bucket_of(campaign: str, buckets: int) -> Column:
    return F.pmod(F.xxhash64(campaign), F.lit(buckets)).cast("int")


#: The columns of a delivery row that its sums come from.
MEASURES = ["impressions", "clicks", "spend_usd", "vast_errors", "viewability_rate", "cpm", "cpc", "_suspicious_ctr"]


def row_sums(row: Column) -> dict[str, Column]:
    """What a delivery row's MEASURES add to its (campaign, day), in the stored table's types; a missing value adds nothing."""
    given = {"impressions": row["impressions"], "clicks": row["clicks"], "spend": row["spend_usd"].cast(gold.MONEY), "vast_errors": row["vast_errors"],
             "zero_rows": (row["impressions"] == 0).cast("int"), "suspicious_rows": row["_suspicious_ctr"].cast("int")}
    for short, column in (("view", "viewability_rate"), ("cpm", "cpm"), ("cpc", "cpc")):
        given |= {f"{short}_sum": row[column].cast(gold.DEC), f"{short}_n": row[column].isNotNull().cast("int")}
    kinds = dict(c.split(" ") for c in PARTIALS.split(", "))
    return {c: F.coalesce(given[c].cast(kinds[c]), F.lit(0).cast(kinds[c])) for c in SUMS}


def among(column: str, values: list) -> Column:
    known = F.col(column).isin([v for v in values if v is not None])
    return F.coalesce(known, F.lit(None in values))


def day_changes(old: DataFrame, delivery: DataFrame) -> DataFrame:
    """Per (campaign, day) of ``old`` partials or ``delivery`` rows: the new sums, whether it is there and was, and what changes in one that was (null: nothing).

    Dealt out by range of day and campaign: old and new meet in the exchange that sums
    the rows, and a task's days lie in few months, which the rows are written by next.
    """
    kinds = dict(c.split(" ") for c in PARTIALS.split(", "))
    both = old.select("campaign_id", "delivery_date", F.struct(*SUMS).alias("_was")).unionByName(
        delivery.select("campaign_id", "delivery_date", F.struct(*MEASURES).alias("_row")), allowMissingColumns=True)
    was, adds = F.col("_was").isNotNull(), row_sums(F.col("_row"))
    by_day = both.repartitionByRange("delivery_date", "campaign_id").groupBy("campaign_id", "delivery_date").agg(
        F.bool_or(~was).alias("_there"), F.bool_or(was).alias("_held"),
        *[F.coalesce(F.sum(F.when(~was, adds[c])), F.lit(0)).cast(kinds[c]).alias(c) for c in SUMS],
        *[F.sum(F.when(was, -F.col("_was")[c]).otherwise(adds[c])).alias(f"_by_{c}") for c in SUMS])
    changed = reduce(Column.__or__, [F.col(f"_by_{c}") != 0 for c in SUMS], ~F.col("_there"))
    by = F.when(F.col("_held") & changed, F.struct(*[F.col(f"_by_{c}").alias(c) for c in SUMS])).alias("_by")
    return by_day.select("campaign_id", *SUMS, "delivery_date", "_there", "_held", by)


def partial_changes(by_day: DataFrame) -> DataFrame:
    """Per campaign with a change: what its sums and its number of days change by, its first and last changed day that is there and that is lost.

    Days without a change are in the totals already, so they move neither the sums nor the ends.
    """
    changed = by_day.where(~F.col("_held") | F.col("_by").isNotNull()).select(
        "campaign_id", "delivery_date", "_there", (F.col("_there").cast("int") - F.col("_held").cast("int")).alias("days"),
        *[F.when(F.col("_held"), F.col("_by")[c]).otherwise(F.col(c)).alias(c) for c in SUMS])
    here, lost = F.when(F.col("_there"), F.col("delivery_date")), F.when(~F.col("_there"), F.col("delivery_date"))
    return changed.groupBy("campaign_id").agg(
        F.sum("days").alias("days"), *[F.sum(c).alias(c) for c in SUMS], F.min(here).alias("first_new"), F.max(here).alias("last_new"),
        F.min(lost).alias("first_lost"), F.max(lost).alias("last_lost"))


def changed_totals(totals: DataFrame, changes: DataFrame, partials: DataFrame, buckets: int) -> DataFrame:
    """All rows of the changed campaigns' buckets: ``totals`` (of these buckets) with ``changes`` added in.

    ``partials`` is the table as changed; a campaign that lost its first or last
    day takes both from there. A campaign without days has no row.
    """
    none = F.lit(None).cast("date")
    both = (totals.select("campaign_id", "days", *SUMS, "first_day", "last_day", none.alias("first_lost"), none.alias("last_lost"))
            .unionByName(changes.select("campaign_id", "days", *SUMS, F.col("first_new").alias("first_day"), F.col("last_new").alias("last_day"),
                                        "first_lost", "last_lost")))
    first, last = F.min("first_day"), F.max("last_day")
    added = both.groupBy("campaign_id").agg(
        F.sum("days").alias("days"), *[F.sum(c).alias(c) for c in SUMS], first.alias("first_day"), last.alias("last_day"),
        (F.coalesce(F.min("first_lost") <= first, F.lit(False)) | F.coalesce(F.max("last_lost") >= last, F.lit(False))).alias("lost_end"))
    added = added.where(F.col("days") > 0)
    again = added.where("lost_end").select("campaign_id")
    ends = (partials.select("campaign_id", "delivery_date").join(again, "campaign_id", "left_semi")
            .groupBy("campaign_id").agg(F.min("delivery_date").alias("_first"), F.max("delivery_date").alias("_last"), F.lit(True).alias("_again")))
    kinds = dict(c.split(" ") for c in TOTALS.split(", "))
    end = lambda seen, kept: F.when(F.col("_again"), F.col(seen)).otherwise(F.col(kept)).alias(kept)
    return added.join(ends, "campaign_id", "left").select(
        "campaign_id", "days", *[F.col(c).cast(kinds[c]).alias(c) for c in SUMS], end("_first", "first_day"), end("_last", "last_day"),
        bucket_of("campaign_id", buckets).alias("bucket"))


def finished(campaigns: DataFrame, totals: DataFrame, partials: DataFrame, as_of: _dt.datetime) -> DataFrame:
    """Gold rows of ``campaigns`` from their totals, and from the partials of the last days only."""
    since = F.date_sub(as_of_date(as_of), RECENT_DAYS)
    recent = partials.where((F.col("delivery_date") >= since) & (F.col("month") >= F.date_format(since, "yyyy-MM"))).groupBy("campaign_id").agg(
        F.sum("impressions").alias("imp_7d"), F.sum("spend").alias("spend_7d_dec"), F.sum("clicks").alias("clicks_7d"))
    t = totals.join(recent, "campaign_id", "left")
    named = t.select(
        "campaign_id", F.col("days").alias("days_with_delivery"), F.col("impressions").alias("total_impressions"),
        F.col("clicks").alias("total_clicks"), F.col("spend").alias("spend_dec"), F.col("vast_errors").alias("total_vast_errors"),
        "view_sum", "view_n", "cpm_sum", "cpm_n", "cpc_sum", "cpc_n",
        F.col("last_day").alias("last_delivery_date"), F.col("first_day").alias("first_delivery_date"),
        F.coalesce("imp_7d", F.lit(0)).alias("impressions_last_7d"), F.coalesce("spend_7d_dec", F.lit(0).cast("decimal(38,2)")).alias("spend_7d_dec"),
        F.coalesce("clicks_7d", F.lit(0)).alias("clicks_last_7d"), F.col("zero_rows").alias("zero_delivery_days"),
        F.col("suspicious_rows").alias("suspicious_ctr_days"))
    return gold.performance_of_totals(campaigns, gold.totals_columns(named), as_of)


def refresh_totals(spark: SparkSession, steps: Steps, days: list, base: str, buckets: int = BUCKETS) -> list[int]:
    """Carry the rewritten ``days`` (``steps`` has their merged rows) into partials and totals; returns the changed buckets."""
    merged = spark.read.parquet(f"{steps.folder}/merged")
    stored, months = f"{base}/partials", sorted({d and f"{d:%Y-%m}" for d in days}, key=str)
    held = read_if_present(spark, stored, STORED_PARTIALS).where(among("month", months))
    of_days = among("delivery_date", days)
    kept = held.where(~of_days).drop("month").withColumns({"_there": F.lit(True), "_held": F.lit(True)})

    def by_day() -> DataFrame:
        made = day_changes(held.where(of_days), merged).unionByName(kept, allowMissingColumns=True)
        return made.withColumn("month", F.date_format("delivery_date", "yyyy-MM"))

    steps.layout["partials"] = "month"
    made = steps.table("partials", by_day).withColumn("month", F.date_format("delivery_date", "yyyy-MM"))  # folder names alone could pass for dates
    changes = steps.table("changes", lambda: partial_changes(made))
    replace_partitions(made.where("_there").select("campaign_id", *SUMS, "delivery_date", "month"), stored, "month", months)
    changed = sorted(r[0] for r in changes.select(bucket_of("campaign_id", buckets)).distinct().collect())  # at most ``buckets``
    before = read_if_present(spark, f"{base}/totals", TOTALS).where(F.col("bucket").isin(changed))
    totals = steps.table("totals", lambda: changed_totals(before, changes, read_if_present(spark, stored, STORED_PARTIALS), buckets))
    replace_partitions(totals, f"{base}/totals", "bucket", changed)
    return changed


def refresh_performance(spark: SparkSession, campaigns: DataFrame, base: str, as_of: _dt.datetime = AS_OF, changed: list[int] | None = None,
                        buckets: int = BUCKETS) -> list[int]:
    """Finish the gold rows of the ``changed`` buckets, of those whose campaigns changed, and of all on a new day.

    Elapsed time and the last seven days depend on the day alone, so a bucket
    without a change has the rows that a rebuild would give. Returns the buckets.
    """
    path, today = f"{base}/performance", as_of.date()
    state = read_if_present(spark, f"{base}/state", "finished_on date, buckets int").collect()  # one row
    dims = F.xxhash64(*gold.CAMPAIGN_PERF_DIMS)
    here = campaigns.select(*gold.CAMPAIGN_PERF_DIMS, dims.alias("_dims"), bucket_of("campaign_id", buckets).alias("bucket"))
    if [tuple(r) for r in state] != [(today, buckets)]:
        wanted = list(range(buckets))
    else:
        stored = read_if_present(spark, path, "campaign_id string, _dims bigint, bucket int")
        now = here.select("campaign_id", "_dims", "bucket")
        moved = now.join(stored, ["campaign_id", "_dims"], "left_anti").select("bucket").union(
            stored.join(now, "campaign_id", "left_anti").select("bucket"))
        wanted = sorted(set(changed or []) | {r[0] for r in moved.distinct().collect()})
    if wanted:
        own = F.col("bucket").isin(wanted)
        totals = read_if_present(spark, f"{base}/totals", TOTALS).where(own).drop("bucket")
        rows = finished(campaigns.join(here.where(own).select("campaign_id"), "campaign_id", "left_semi"), totals,
                        read_if_present(spark, f"{base}/partials", STORED_PARTIALS), as_of)
        rows = rows.withColumns({"_dims": dims, "bucket": bucket_of("campaign_id", buckets)})
        # Nothing that is read here is replaced, so a run that dies needs no copy: the next one finds the rows stale again.
        replace_partitions(written_once(rows, "finished-performance"), path, "bucket", wanted)
        write_overwrite(spark.createDataFrame([(today, buckets)], "finished_on date, buckets int").coalesce(1), f"{base}/state")
    return wanted


def read_performance(spark: SparkSession, base: str) -> DataFrame:
    return spark.read.parquet(f"{base}/performance").drop("_dims", "bucket")
