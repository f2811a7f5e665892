"""Validity histories that grow by batches, are counted day by day and joined to facts as of their time."""

from __future__ import annotations

import datetime as _dt

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from pacewise.operators.dedup import dedup_latest, scd2_history
from pacewise.operators.sequence import running_sums
from pacewise.session import written_once
from pacewise.sources.sinks import read_if_present
from pacewise.sources.steps import Steps, replace_partitions

BUCKETS = 64


def bucket_of(key: str, buckets: int) -> Column:
    return F.pmod(F.xxhash64(key), F.lit(buckets)).cast("int")


def stored(spark: SparkSession, path: str, columns: list[T.StructField]) -> DataFrame:
    names = ", ".join(f"`{c.name}` {c.dataType.simpleString()}" for c in columns)
    return read_if_present(spark, path, f"{names}, bucket int")


def read_history(spark: SparkSession, base: str, versions: DataFrame, key: str, tracked: str, ts: str = "_ingested_at",
                 tie_breakers: tuple[str, ...] = ()) -> DataFrame:
    """The history below ``base``; ``versions`` tells its columns' types."""
    return stored(spark, f"{base}/history", history_fields(versions, [key, tracked, ts, *tie_breakers], ts))


def history_fields(versions: DataFrame, columns: list[str], ts: str) -> list[T.StructField]:
    when = versions.schema[ts].dataType
    return [*[versions.schema[c] for c in columns], T.StructField("_valid_from", when), T.StructField("_valid_to", when),
            T.StructField("_is_current", T.BooleanType())]


def merge_versions(batch: DataFrame, base: str, steps: Steps, key: str, tracked: str, ts: str = "_ingested_at",
                   tie_breakers: tuple[str, ...] = (), buckets: int = BUCKETS) -> DataFrame:
    """W-03 by batches: the history below ``base`` after ``batch``, equal to ``scd2_history`` of all versions so far.

    Two tables, partitioned by bucket of the key: ``versions`` (all that arrived, since a
    late version may turn one that changed nothing into a change) and ``history``. Only
    buckets of the batch's keys are read and rewritten, and of these only the batch's keys
    are computed anew: an open version is closed, a late one splits an interval. A version
    that arrives twice counts once; a NULL key is a key. Every change is made from a
    copy that ``steps`` keep, so a merge that died is simply run again.
    """
    spark, columns = batch.sparkSession, [key, tracked, ts, *tie_breakers]
    fields = history_fields(batch, columns, ts)
    if not steps.done():
        new = steps.table("batch", lambda: batch.select(*columns).distinct().withColumn("bucket", bucket_of(key, buckets)))
        touched = [r[0] for r in new.select("bucket").distinct().collect()]  # at most ``buckets``
        here = F.col("bucket").isin(touched)
        versions = steps.table("versions", lambda: stored(spark, f"{base}/versions", [batch.schema[c] for c in columns])
                               .where(here).unionByName(new).distinct())

        def rebuilt() -> DataFrame:
            keys = new.select(F.col(key).alias("_touched")).distinct()
            match = F.col(key).eqNullSafe(F.col("_touched"))
            fresh = scd2_history(versions.join(keys, match, "left_semi").select(*columns), key, tracked, ts, list(tie_breakers))
            kept = stored(spark, f"{base}/history", fields).where(here).join(keys, match, "left_anti")
            return fresh.withColumn("bucket", bucket_of(key, buckets)).unionByName(kept)

        history = steps.table("history", rebuilt)
        replace_partitions(versions, f"{base}/versions", "bucket", touched)
        replace_partitions(history, f"{base}/history", "bucket", touched)
        steps.finish()
    return stored(spark, f"{base}/history", fields).drop("bucket")


def active_by_day(history: DataFrame, tracked: str, first: _dt.date, last: _dt.date, count: str = "active") -> DataFrame:
    """W-04 for a calendar: versions per ``tracked`` value that are valid at the start of each day from ``first`` to ``last``.

    A sweep line: a version adds one on the first day that starts in it and takes one off
    on the first day that starts after it. These changes are summed per value and day, and
    their running sums are taken over ranges, so no value is gathered in one task. Values
    that never hold on a day still get a row per day, with zero.
    """
    def first_start(instant: str) -> Column:
        day = F.to_date(instant)
        return F.greatest(F.when(F.col(instant) == day.cast("timestamp"), day).otherwise(F.date_add(day, 1)), F.lit(first))

    opened = history.where(F.col("_valid_from").isNotNull()).select(tracked, first_start("_valid_from").alias("day"), F.lit(1).alias("_change"))
    closed = history.where(F.col("_valid_from").isNotNull() & F.col("_valid_to").isNotNull()).select(
        tracked, first_start("_valid_to").alias("day"), F.lit(-1).alias("_change"))
    changes = opened.unionByName(closed).groupBy(tracked, "day").agg(F.sum("_change").alias("_change"))
    days = changes.select(tracked).distinct().select(tracked, F.explode(F.sequence(F.lit(first), F.lit(last))).alias("day"), F.lit(0).cast("long").alias("_change"))
    line = changes.where(F.col("day") <= F.lit(last)).unionByName(days).groupBy(tracked, "day").agg(F.sum("_change").alias("_change"))
    return running_sums(line, [tracked], ["day"], "_change", count).drop("_change")


def as_of_join(facts: DataFrame, versions: DataFrame, key: str, fact_ts: str, version_ts: str, take: dict[str, str],
               latest: list[Column] | None = None) -> DataFrame:
    """Every fact with the columns ``take`` (version column -> new name) of the last version of its key at or before its time.

    Both sides are merged in ranges of (key, time), so a hot key spans many tasks; within
    a range the last version is carried along its key, and a range's first facts take the
    last version of the ranges before it. Facts without a key, a time or an earlier version get
    NULLs; versions without a key or a time are left out. Of versions of one key and time the
    first by ``latest`` counts.
    """
    dated = versions.where(F.col(key).isNotNull() & F.col(version_ts).isNotNull())
    one = dedup_latest(dated, [key, version_ts], latest or [F.xxhash64(*[F.col(f"`{c}`") for c in sorted(versions.columns)])])
    kind = facts.select(F.struct("*")).schema[0].dataType
    version = F.struct(*[F.col(c).alias(n) for c, n in take.items()])
    left = facts.select(F.col(key).alias("_key"), F.col(fact_ts).cast("timestamp").alias("_at"), F.lit(1).alias("_side"),
                        F.xxhash64(F.struct("*")).alias("_tie"), F.struct("*").alias("_fact"))
    right = one.select(F.col(key).alias("_key"), F.col(version_ts).cast("timestamp").alias("_at"), F.lit(0).alias("_side"),
                       F.lit(0).cast("long").alias("_tie"), F.lit(None).cast(kind).alias("_fact"), version.alias("_version"))
    both = left.withColumn("_version", F.lit(None).cast(right.schema["_version"].dataType)).unionByName(right)
    ranged = written_once(both.repartitionByRange("_key", "_at", "_side", "_tie").withColumn("_pid", F.spark_partition_id()), "as-of")
    along = Window.partitionBy("_pid", "_key").orderBy("_at", "_side").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    carried = ranged.withColumn("_version", F.last("_version", ignorenulls=True).over(along)).where("_side = 1")
    earlier = Window.partitionBy("_last_key").orderBy("_last_pid").rowsBetween(Window.unboundedPreceding, -1)
    ends = (ranged.groupBy(F.col("_pid").alias("_last_pid"), F.col("_key").alias("_last_key"))
            .agg(F.max_by("_version", F.when(F.col("_side") == 0, F.col("_at"))).alias("_last"))
            .withColumn("_before", F.last("_last", ignorenulls=True).over(earlier)).drop("_last"))
    # One row per range and key; facts without a key match nothing and stay.
    out = carried.join(ends, (F.col("_pid") == F.col("_last_pid")) & (F.col("_key") == F.col("_last_key")), "left")
    found = F.when(F.col("_key").isNotNull() & F.col("_at").isNotNull(), F.coalesce("_version", "_before"))
    return out.withColumn("_version", found).select("_fact.*", *[F.col(f"_version.{n}").alias(n) for n in take.values()])
