"""Structured Streaming jobs.

* ``stream_files``: incremental file ingestion — each landed file is
  processed once (the checkpoint remembers it), ``availableNow`` processes
  what is there and stops; a rerun on the same checkpoint sees only new files.
* ``refresh_delivery``: the hourly job. Each micro-batch is appended to
  bronze and merged into silver by day: only the batch's days and the days
  where its keys lived are read and rewritten. Each epoch keeps its steps
  (``sources/steps.py``), so one that died is finished from its own copies.
* ``dedup_events``: event-id dedup with a watermark, so dedup state is
  bounded by the watermark delay instead of growing forever.
"""

from __future__ import annotations

import datetime as _dt
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from pacewise.config import AS_OF
from pacewise.operators.clean import delivery_order, delivery_rows, named_delivery
from pacewise.operators.dedup import dedup_latest
from pacewise.session import scratch_path, shuffles_dropped
from pacewise.sources.sinks import read_if_present
from pacewise.sources.steps import Steps, replace_partitions


def stream_files(spark: SparkSession, landing: str, schema: T.StructType, sink: str, checkpoint: str,
                 fmt: str = "parquet", max_files_per_trigger: int | None = None) -> None:
    """Append every not-yet-seen file under ``landing`` to the Parquet ``sink``; stop when caught up."""
    reader = spark.readStream.format(fmt).schema(schema)
    if fmt == "csv":
        from pacewise.sources.csv import CSV_OPTIONS

        # enforceSchema=false: the header must name the schema's columns, so a file whose columns are in
        # another order or have an extra column fails the batch instead of shifting values silently.
        reader = reader.options(**CSV_OPTIONS).option("enforceSchema", "false")
    if max_files_per_trigger:
        reader = reader.option("maxFilesPerTrigger", str(max_files_per_trigger))
    src = reader.load(landing).select("*", F.col("_metadata.file_path").alias("_source_file_path"))
    q = (src.writeStream.format("parquet").option("path", sink).option("checkpointLocation", checkpoint)
         .outputMode("append").trigger(availableNow=True).start())
    q.awaitTermination()


ORDER_COLUMNS = ["_src_partkey", "_src_suppkey"]
#: Tells a merge's new rows from those that silver had.
ARRIVED = "_arrived"


def key_days(spark: SparkSession, path: str) -> DataFrame:
    """(delivery_id, delivery_date): the days on which keys live or have lived."""
    return read_if_present(spark, path, "delivery_id string, delivery_date date")


def merge_delivery(spark: SparkSession, batch: DataFrame, silver: str, as_of: _dt.datetime = AS_OF,
                   steps: Steps | None = None) -> list:
    """Merge raw delivery rows into the silver table at ``silver``, partitioned by day; returns the days rewritten.

    Touched are the batch's days and the days on which its keys have lived, which
    a table of keys beside silver tells (appended to by every merge; a folder per
    job). Their rows and the batch's are reduced to the newest version per key and
    replace those days only; other days of silver are not read. All versions meet
    in one dedup, so a batch is dealt out by its keys once. A day that loses its
    last row to another is removed. A merge that died is run again with the same
    ``batch`` and ``steps``: days, keys and merged rows come from its copies once
    they are complete, so a half-replaced day is never read.
    """
    steps = steps or Steps(spark, scratch_path(spark, "merge"))
    new = delivery_rows(named_delivery(batch), as_of, keep_order=True)
    keys = f"{silver.rstrip('/')}-keys"

    def touched_days() -> DataFrame:
        ends = new.agg(F.min("delivery_id"), F.max("delivery_id")).first()
        near = key_days(spark, keys).where(F.col("delivery_id").between(*ends)) if ends[0] is not None else key_days(spark, keys)
        held = near.join(new.select("delivery_id"), "delivery_id", "left_semi")
        return held.select("delivery_date").union(new.select("delivery_date")).distinct()

    days = [r[0] for r in steps.table("days", touched_days).collect()]  # the calendar bounds them

    def merged_rows() -> DataFrame:
        old = read_if_present(spark, silver, new.schema.simpleString()[7:-1].replace(":", " "))
        touched = F.col("delivery_date").isin([d for d in days if d is not None])
        if None in days:
            touched = touched | F.col("delivery_date").isNull()
        versions = old.where(touched).select(*new.columns, F.lit(False).alias(ARRIVED)).unionByName(new.withColumn(ARRIVED, F.lit(True)))
        return dedup_latest(versions, "delivery_id", delivery_order())

    merged = steps.table("merged", merged_rows)
    merged.where(ARRIVED).select("delivery_id", "delivery_date").write.mode("overwrite").parquet(f"{keys}/_job={steps.folder.rsplit('/', 1)[1].replace('=', '-')}")
    replace_partitions(merged.drop(ARRIVED), silver, "delivery_date", days)
    return days


def read_delivery(spark: SparkSession, silver: str) -> DataFrame:
    """The silver delivery table that ``merge_delivery`` keeps, without the columns that only order versions."""
    return spark.read.parquet(silver).drop(*ORDER_COLUMNS)


def refresh_delivery(spark: SparkSession, landing: str, schema: T.StructType, bronze: str, silver: str,
                     checkpoint: str, as_of: _dt.datetime = AS_OF, then: Callable[[Steps, list], None] | None = None) -> None:
    """Hourly refresh: newly landed delivery files → bronze (append) → silver for the touched days (overwrite).

    ``then(steps, days)`` goes on from an epoch's merge (``steps.folder`` has the
    merged rows); it is repeated with the epoch if that dies.
    """

    def process(batch: DataFrame, epoch_id: int) -> None:
        steps = Steps(spark, f"{checkpoint.rstrip('/')}-steps/epoch={epoch_id}")
        if steps.done():
            return
        # One folder per epoch, overwritten: a replayed epoch rewrites the same rows instead of appending twice.
        folder = f"{bronze}/_epoch={epoch_id}"
        batch.write.mode("overwrite").parquet(folder)
        days = merge_delivery(spark, spark.read.schema(batch.schema).parquet(folder), silver, as_of, steps)
        if then:
            then(steps, days)
        steps.finish()

    with shuffles_dropped(spark):
        q = (spark.readStream.format("parquet").schema(schema).load(landing).writeStream
             .foreachBatch(process).option("checkpointLocation", checkpoint).trigger(availableNow=True).start())
        q.awaitTermination()


def dedup_events(spark: SparkSession, landing: str, schema: T.StructType, sink: str, checkpoint: str,
                 keys: list[str], event_time: str, delay: str = "10 minutes") -> None:
    """Drop repeated event ids that arrive within ``delay`` of each other (state bounded by the watermark)."""
    src = spark.readStream.format("parquet").schema(schema).load(landing)
    out = src.withWatermark(event_time, delay).dropDuplicatesWithinWatermark(keys)
    q = (out.writeStream.format("parquet").option("path", sink).option("checkpointLocation", checkpoint)
         .outputMode("append").trigger(availableNow=True).start())
    q.awaitTermination()
