"""Registered source / sink / streaming jobs.

Each job writes under a fresh folder below the session's checkpoint dir (the
shared folder named by ``spark.checkpoint.dir`` on a cluster), then returns
the table read back, so the result can be compared with the batch oracle.
"""

from __future__ import annotations

import datetime as _dt
from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from pacewise.config import AS_OF
from pacewise.operators import clean
from pacewise.operators.dedup import active_on, scd2_history
from pacewise.operators.history import active_by_day, as_of_join, merge_versions
from pacewise.functions.columns import allowed_or_default
from pacewise.functions.rules import DECLARATIVE_EXPECTATIONS
from pacewise.operators.clean import CAMPAIGN_STATUSES
from pacewise.plans import lookup
from pacewise.session import scratch_path, shuffles_dropped, written_once
from pacewise.sources import bindings as b
from pacewise.sources import csv as csvsrc
from pacewise.sources import sinks
from pacewise.sources.audited import AuditedTable
from pacewise.sources.files import rename_new
from pacewise.sources.steps import Steps
from pacewise.sources.tables import table_path
from pacewise.streaming import evolving, ingest


def _land_delivery(spark: SparkSession, sf: str, name: str) -> tuple[str, T.StructType]:
    """Bronze delivery landed as one folder of Parquet files per ship year (the stream's input)."""
    landing = scratch_path(spark, name)
    d = b.delivery_bronze(spark, sf)
    with shuffles_dropped(spark):
        d.withColumn("ship_year", F.year("date")).write.mode("overwrite").partitionBy("ship_year").parquet(landing)
    return landing, d.schema


def _years(spark: SparkSession, landing: str) -> list[str]:
    return sorted(r.path for r in sinks.list_files(spark, landing).select(
        F.regexp_extract("path", r"^(.*ship_year=[^/]+)/", 1).alias("path")).distinct().collect())


CAMPAIGN_SCHEMA = T.StructType([
    T.StructField("campaign_id", T.StringType()), T.StructField("title_id", T.StringType()),
    T.StructField("title_name", T.StringType()), T.StructField("brand", T.StringType()),
    T.StructField("brand_code", T.StringType()), T.StructField("segment", T.StringType()),
    T.StructField("product", T.StringType()), T.StructField("campaign_name", T.StringType()),
    T.StructField("campaign_objective", T.StringType()), T.StructField("targeting_geo", T.StringType()),
    T.StructField("country", T.StringType()), T.StructField("language", T.StringType()),
    T.StructField("geo_cluster", T.StringType()), T.StructField("region", T.StringType()),
    T.StructField("channel", T.StringType()), T.StructField("channel_mapped", T.StringType()),
    T.StructField("platform", T.StringType()), T.StructField("budget_usd", T.DoubleType()),
    T.StructField("start_date", T.DateType()), T.StructField("end_date", T.DateType()),
    T.StructField("status", T.StringType()), T.StructField("impressions_goal", T.IntegerType()),
    T.StructField("flight_priority", T.IntegerType()), T.StructField("audience_tactic", T.StringType()),
    T.StructField("audience_strategy", T.StringType()), T.StructField("audience_detailed", T.StringType()),
    T.StructField("landing_page", T.StringType()), T.StructField("_ingested_at", T.TimestampType()),
    T.StructField("_source_file", T.StringType()), T.StructField("_batch_id", T.StringType()),
])


def read_csv_by_name_job(spark: SparkSession, sf: str) -> DataFrame:
    """S-01: campaigns land as CSV whose column order differs from the schema; bound by name."""
    path = scratch_path(spark, "campaigns-csv")
    bronze = b.campaigns_bronze(spark, sf)
    shuffled = bronze.select(*reversed(bronze.columns))  # header order differs from the schema order
    csvsrc.write_csv(shuffled, path)
    return csvsrc.read_csv_by_name(spark, path, CAMPAIGN_SCHEMA)


def csv_header_report_job(spark: SparkSession, sf: str) -> DataFrame:
    """S-01: campaigns land with an extra column, without a landing page and with a budget that is no number for k % 50 = 0."""
    path = scratch_path(spark, "campaigns-csv-odd")
    bronze = b.campaigns_bronze(spark, sf)
    number = F.regexp_extract("campaign_id", r"(\d+)$", 1).cast("long")
    odd = bronze.drop("landing_page").withColumn("reviewed_by", F.lit("nobody")).withColumn(
        "budget_usd", F.when(number % 50 == 0, F.lit("n/a")).otherwise(F.col("budget_usd").cast("string")))
    csvsrc.write_csv(odd, path)
    return csvsrc.csv_header_report(spark, path, CAMPAIGN_SCHEMA)


def read_csv_inferred_job(spark: SparkSession, sf: str) -> DataFrame:
    """S-02: tickets land as CSV and are read with an inferred schema."""
    path = scratch_path(spark, "tickets-csv")
    csvsrc.write_csv(b.tickets_bronze(spark, sf), path)
    return csvsrc.read_csv_inferred(spark, path)


def bronze_stamp_job(spark: SparkSession, sf: str) -> DataFrame:
    """S-03: stamp the given orders table with ingestion time, source file and batch id."""
    return sinks.bronze_stamp(spark.read.parquet(table_path(sf, "orders")), "b-19990701", AS_OF)


def sink_overwrite_job(spark: SparkSession, sf: str) -> DataFrame:
    """S-04: overwrite twice; the table holds the last snapshot only."""
    path = scratch_path(spark, "silver-campaigns")
    c = clean.silver_campaigns(b.campaigns_bronze(spark, sf), AS_OF)
    sinks.write_overwrite(c.where(F.col("status") == "Active"), path)
    sinks.write_overwrite(c, path)
    return spark.read.parquet(path)


def sink_append_job(spark: SparkSession, sf: str) -> DataFrame:
    """S-05: two appended batches (before 1998 / the rest, rows without a date included) hold every bronze row once."""
    path = scratch_path(spark, "bronze-delivery")
    d = b.delivery_bronze(spark, sf)
    early = F.coalesce(F.col("date") < F.lit("1998-01-01").cast("date"), F.lit(False))
    sinks.write_append(d.where(early), path)
    sinks.write_append(d.where(~early), path)
    return spark.read.parquet(path)


def sink_partitioned_job(spark: SparkSession, sf: str) -> DataFrame:
    """S-06: silver delivery partitioned by day; a re-load of some days replaces only those partitions."""
    path = scratch_path(spark, "silver-delivery-by-day")
    # Both loads take one written copy of silver: its join and dedup run once.
    s = written_once(clean.silver_delivery(b.delivery_bronze(spark, sf), AS_OF), "silver-delivery")
    sinks.write_partitioned(s, path, "delivery_date")
    reload = s.where(F.year("delivery_date") == 1998)
    sinks.write_partitioned(reload, path, "delivery_date")
    return spark.read.parquet(path)


def bulk_load_once_job(spark: SparkSession, sf: str) -> DataFrame:
    """S-08: load the landed files, land nothing new, load again: every row arrives once."""
    landing, _ = _land_delivery(spark, sf, "delivery-landing")
    target, manifest = scratch_path(spark, "delivery-bronze"), scratch_path(spark, "delivery-manifest")
    sinks.bulk_load_once(spark, landing, target, manifest, "delivery")
    sinks.bulk_load_once(spark, landing, target, manifest, "delivery")
    return sinks.loaded_rows(spark, target, manifest, "delivery").drop("ship_year")


def ingest_manifest_job(spark: SparkSession, sf: str) -> DataFrame:
    """S-14: manifest rows after a bulk load, one per landed folder (ship year)."""
    landing, _ = _land_delivery(spark, sf, "delivery-landing")
    target, manifest = scratch_path(spark, "delivery-bronze"), scratch_path(spark, "delivery-manifest")
    sinks.bulk_load_once(spark, landing, target, manifest, "delivery")
    m = sinks.ingest_manifest(spark, manifest)
    return m.groupBy("table_name", F.regexp_extract("file_path", r"(ship_year=\d+)", 1).alias("source_folder"),
                     "status").agg(F.sum("rows_loaded").alias("rows_loaded"))


def schema_evolve_job(spark: SparkSession, sf: str) -> DataFrame:
    """S-09: batch b1 lacks landing_page, batch b2 has it; read back with schema merging."""
    bronze = b.campaigns_bronze(spark, sf)
    p1, p2 = scratch_path(spark, "campaigns-b1"), scratch_path(spark, "campaigns-b2")
    sinks.write_overwrite(bronze.where(F.col("_batch_id") == "b1").drop("landing_page"), p1)
    sinks.write_overwrite(bronze.where(F.col("_batch_id") == "b2"), p2)
    return sinks.read_merged(spark, p1, p2)


def create_bronze_tables_job(spark: SparkSession, sf: str) -> DataFrame:
    """S-11/S-12/S-13: database + typed partitioned tables created if absent, loaded, listed, counted."""
    import uuid

    suffix = uuid.uuid4().hex[:8]
    base = scratch_path(spark, "warehouse")
    for layer in ("bronze", "silver", "gold", "quarantine"):  # S-12: one database per layer
        spark.sql(f"CREATE DATABASE IF NOT EXISTS {layer}_{suffix} LOCATION '{base}/{layer}'")
    db = f"bronze_{suffix}"
    tables = {"campaigns": b.campaigns_bronze(spark, sf), "delivery": b.delivery_bronze(spark, sf),
              "tickets": b.tickets_bronze(spark, sf)}
    for name, df in tables.items():
        cols = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in df.schema.fields)
        part = " PARTITIONED BY (date)" if name == "delivery" else ""
        spark.sql(f"CREATE TABLE IF NOT EXISTS {db}.{name} ({cols}) USING parquet{part} "
                  f"TBLPROPERTIES ('layer' = 'bronze', 'source_table' = '{name}')")
        ordered = df.select(*[F.col(c) for c in spark.table(f"{db}.{name}").columns])
        if part:
            ordered = ordered.hint("rebalance", "date")  # few files per day; AQE splits a hot day
        ordered.write.insertInto(f"{db}.{name}")
    listed = [t.name for t in spark.catalog.listTables(db)]
    parts = [spark.table(f"{db}.{n}").agg(F.count(F.lit(1)).alias("row_count")).select(
        F.lit(n).alias("table_name"), "row_count") for n in sorted(listed)]
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    counts = written_once(out, "table-counts")
    for layer in ("bronze", "silver", "gold", "quarantine"):  # the demonstration leaves no databases behind
        spark.sql(f"DROP DATABASE IF EXISTS {layer}_{suffix} CASCADE")
    return counts


def compact_cluster_job(spark: SparkSession, sf: str) -> DataFrame:
    """S-15: bronze delivery rewritten in files range-clustered on campaign, day and id; content unchanged."""
    source, path = scratch_path(spark, "delivery-small-files"), scratch_path(spark, "delivery-compacted")
    sinks.write_overwrite(b.delivery_bronze(spark, sf), source)
    sinks.compact_cluster(spark, source, path, ["campaign_id", "date", "delivery_id"])
    return spark.read.parquet(path)


def as_of_snapshot_job(spark: SparkSession, sf: str) -> DataFrame:
    """S-16: campaigns as of 1999-03-01 (before batch b2)."""
    at = F.lit(_dt.datetime(1999, 3, 1)).cast("timestamp")
    return sinks.as_of_snapshot(b.campaigns_bronze(spark, sf), "campaign_id", at)


def batch_history_job(spark: SparkSession, sf: str) -> DataFrame:
    return sinks.batch_history(b.campaigns_bronze(spark, sf))


def status_versions(spark: SparkSession, sf: str, *columns: str) -> DataFrame:
    bronze = b.campaigns_bronze(spark, sf).withColumn("status", allowed_or_default("status", CAMPAIGN_STATUSES,
                                                                                   "Unknown"))
    return bronze.select("campaign_id", "status", "_ingested_at", "_batch_id", *columns)


def scd2_campaign_status(spark: SparkSession, sf: str) -> DataFrame:
    """W-03: status history (first version and every change) with validity intervals."""
    return scd2_history(status_versions(spark, sf), "campaign_id", "status", tie_breakers=["_batch_id"])


def scd2_merged_job(spark: SparkSession, sf: str) -> DataFrame:
    """W-03 by batches: the second batch arrives first, then the first one in two parts, the last of them twice."""
    versions, base = status_versions(spark, sf), scratch_path(spark, "status-history")
    odd = F.pmod(F.xxhash64("campaign_id"), F.lit(2)) == 1
    first = F.col("_batch_id") == "b1"
    for n, part in enumerate((~first, first & odd, first & ~odd, first & ~odd)):
        steps = Steps(spark, scratch_path(spark, f"status-merge-{n}"))
        history = merge_versions(versions.where(part), base, steps, "campaign_id", "status", tie_breakers=("_batch_id",))
    return history


def flight_statuses(spark: SparkSession, sf: str) -> DataFrame:
    """Status versions by the time they take effect: the first batch's at the flight's start, the second's at its end."""
    effective = F.when(F.col("_batch_id") == "b1", F.col("start_date")).otherwise(F.col("end_date")).cast("timestamp")
    return status_versions(spark, sf, "start_date", "end_date").withColumn("effective_at", effective).select(
        "campaign_id", "status", "effective_at", "_batch_id")


def active_by_day_job(spark: SparkSession, sf: str) -> DataFrame:
    """W-04 over a calendar: campaigns per status in effect at the start of every day of 1998 and 1999."""
    history = scd2_history(flight_statuses(spark, sf), "campaign_id", "status", "effective_at", ["_batch_id"])
    return active_by_day(history, "status", _dt.date(1998, 1, 1), _dt.date(1999, 12, 31), "campaigns")


def delivery_by_status_then_job(spark: SparkSession, sf: str) -> DataFrame:
    """W-04/J-07: delivery summed by the campaign's status in effect on the day of delivery."""
    facts = clean.silver_delivery(b.delivery_bronze(spark, sf), AS_OF).select("campaign_id", "delivery_date", "impressions", "spend_usd")
    then = as_of_join(facts, flight_statuses(spark, sf), "campaign_id", "delivery_date", "effective_at", {"status": "status_then"},
                      [F.col("_batch_id").desc()])
    return then.groupBy("status_then").agg(
        F.count(F.lit(1)).alias("delivery_rows"), F.sum("impressions").cast("long").alias("impressions"),
        F.sum(F.col("spend_usd").cast("decimal(18,2)")).cast("double").alias("spend"))


def active_on_date(spark: SparkSession, sf: str, at: _dt.datetime = _dt.datetime(1999, 3, 1)) -> DataFrame:
    """W-04: campaigns per status valid at an instant."""
    h = active_on(scd2_campaign_status(spark, sf), F.lit(at).cast("timestamp"))
    return h.groupBy("status").agg(F.count(F.lit(1)).alias("campaigns"))


def stream_ingest_job(spark: SparkSession, sf: str) -> DataFrame:
    """S-07/X-01: file stream, availableNow, checkpointed; sink read back."""
    landing, schema = _land_delivery(spark, sf, "stream-landing")
    sink, ckpt = scratch_path(spark, "stream-sink"), scratch_path(spark, "stream-ckpt")
    ingest.stream_files(spark, landing, schema.add("ship_year", T.IntegerType()), sink, ckpt)
    return spark.read.parquet(sink).drop("ship_year", "_source_file_path")


def stream_ingest_csv_job(spark: SparkSession, sf: str) -> DataFrame:
    """S-07 with CSV files (the original's landing format): header checked against the schema, availableNow."""
    landing = scratch_path(spark, "stream-csv-landing")
    d = b.delivery_bronze(spark, sf)
    csvsrc.write_csv(d, landing)  # as the join deals the rows out: no further shuffle of whole rows
    sink, ckpt = scratch_path(spark, "stream-csv-sink"), scratch_path(spark, "stream-csv-ckpt")
    ingest.stream_files(spark, landing, d.schema, sink, ckpt, fmt="csv")
    return spark.read.parquet(sink).drop("_source_file_path")


def stream_ingest_incremental_job(spark: SparkSession, sf: str) -> DataFrame:
    """X-02: first run sees the early years; the rerun on the same checkpoint adds only the new files."""
    src, schema = _land_delivery(spark, sf, "stream-source")
    landing = scratch_path(spark, "stream-landing")
    years = _years(spark, src)
    half = max(1, len(years) // 2)
    schema = schema.add("ship_year", T.IntegerType())
    sink, ckpt = scratch_path(spark, "stream-sink"), scratch_path(spark, "stream-ckpt")
    for chunk in (years[:half], years[half:]):
        for y in chunk:
            spark.read.parquet(y).write.mode("append").parquet(f"{landing}/{y.rsplit('/', 1)[1]}")
        ingest.stream_files(spark, landing, schema, sink, ckpt)
    return spark.read.parquet(sink).drop("ship_year", "_source_file_path")


def _land_years(spark: SparkSession, years: list[str], landing: str) -> None:
    """The written folders of ``years`` move into ``landing``, as files arrive there: whole, by one rename each."""
    for y in years:
        if not rename_new(spark, y, f"{landing}/{y.rsplit('/', 1)[1]}"):
            raise FileExistsError(f"{landing} has {y.rsplit('/', 1)[1]} already")


def stream_delivery_refresh_job(spark: SparkSession, sf: str) -> DataFrame:
    """X-03: hourly refresh — stream into bronze, silver for the touched days, then campaign pacing over the silver table."""
    from pacewise.plans import gold

    src, schema = _land_delivery(spark, sf, "refresh-source")
    landing = scratch_path(spark, "refresh-landing")
    bronze, silver, ckpt = (scratch_path(spark, n) for n in ("refresh-bronze", "refresh-silver", "refresh-ckpt"))
    years = _years(spark, src)
    half = max(1, len(years) // 2)
    schema = schema.add("ship_year", T.IntegerType())
    for chunk in (years[:half], years[half:]):
        _land_years(spark, chunk, landing)
        ingest.refresh_delivery(spark, landing, schema, bronze, silver, ckpt)
    s = ingest.read_delivery(spark, silver)
    return gold.campaign_performance(clean.silver_campaigns(b.campaigns_bronze(spark, sf), AS_OF), s, AS_OF)


def hourly_refresh_job(spark: SparkSession, sf: str, out: str | None = None) -> DataFrame:
    """L-02: the table-scoped hourly run, once over all delivery years but the last and once more when that has landed."""
    from pacewise.plans import pipeline

    src, schema = _land_delivery(spark, sf, "hourly-source")
    landing, out = scratch_path(spark, "hourly-landing"), out or scratch_path(spark, "hourly-run")
    campaigns = clean.silver_campaigns(b.campaigns_bronze(spark, sf), AS_OF)
    years, schema = _years(spark, src), schema.add("ship_year", T.IntegerType())
    for chunk in (years[:-1], years[-1:]):
        _land_years(spark, chunk, landing)
        performance = pipeline.run_hourly(spark, landing, schema, campaigns, out)
    return performance


def stream_conversion_dedup_job(spark: SparkSession, sf: str) -> DataFrame:
    """X-04: event-id dedup in a stream with a 10-minute watermark (copies arrive 2 minutes apart)."""
    landing = scratch_path(spark, "events-landing")
    ev = b.conversion_events(spark, sf)
    ev.write.mode("overwrite").parquet(landing)
    sink, ckpt = scratch_path(spark, "events-dedup"), scratch_path(spark, "events-ckpt")
    ingest.dedup_events(spark, landing, ev.schema, sink, ckpt, ["publisher", "event_id"], "event_time")
    return spark.read.parquet(sink).select("publisher", "event_id", "event_name", "value", "currency")


def _campaign_number() -> Column:
    return F.regexp_extract("campaign_id", r"(\d+)$", 1).cast("long")


def evolving_drops(spark: SparkSession, sf: str) -> list[DataFrame]:
    """Campaigns as three drops of text columns whose headers grow.

    The first third (by campaign number) lacks the landing page; the second has it and budgets that are no numbers where 50
    divides the number; the third has its columns in reverse order and a reviewer too.
    """
    bronze = b.campaigns_bronze(spark, sf)
    third = F.pmod(_campaign_number(), F.lit(3))
    odd = F.when(_campaign_number() % 50 == 0, F.concat(F.lit("about "), F.col("campaign_id"))).otherwise(F.col("budget_usd").cast("string"))
    reviewed = bronze.where(third == 2).withColumn("reviewed_by", F.concat(F.lit("user_"), F.pmod(_campaign_number(), F.lit(7)).cast("string")))
    return [bronze.where(third == 0).drop("landing_page"), bronze.where(third == 1).withColumn("budget_usd", odd),
            reviewed.select(*reversed(reviewed.columns))]


def run_evolving(spark: SparkSession, sf: str) -> str:
    """The three drops through the evolving stream, a run of the stream after each; returns the table's path."""
    landing, table, ckpt = (scratch_path(spark, n) for n in ("evolving-landing", "evolving-table", "evolving-ckpt"))
    for n, drop in enumerate(evolving_drops(spark, sf)):
        csvsrc.write_csv(drop.hint("rebalance"), f"{landing}/drop-{n}")
        evolving.stream_evolving(spark, landing, table, ckpt, CAMPAIGN_SCHEMA)
    return table


def stream_evolving_job(spark: SparkSession, sf: str) -> DataFrame:
    """S-07/S-09: three CSV drops with growing headers; every value is in its column or in the rescued map."""
    rows = evolving.read_evolving(spark, run_evolving(spark, sf))
    return rows.select("*", F.map_keys(evolving.RESCUED)[0].alias("rescued_column"),
                       F.col(evolving.RESCUED)["budget_usd"].alias("rescued_budget")).drop(evolving.RESCUED)


def schema_log_job(spark: SparkSession, sf: str) -> DataFrame:
    """S-09: the schemas that the evolving stream's table has had: each column with the version that brought it."""
    return evolving.schema_log(spark, run_evolving(spark, sf)).select("version", "column_name", "type")


def audited_delivery(spark: SparkSession, sf: str) -> AuditedTable:
    """Bronze delivery in audited loads: the early years; the rest with ids missing where 97 divides the supplier; the rest whole.

    Rules are the declared ones, of which the counting ones leave rows out here; the second load breaks a ``fail`` rule.
    """
    table = AuditedTable(spark, scratch_path(spark, "audited-delivery"))
    rules = [(n, p, "drop" if a == "keep" else a) for n, p, a in DECLARATIVE_EXPECTATIONS["delivery"]]
    d = b.delivery_bronze(spark, sf)
    early = F.coalesce(F.col("date") < F.lit("1998-01-01").cast("date"), F.lit(False))
    lost = F.when(F.col("_src_suppkey") % 97 == 0, F.lit(None)).otherwise(F.col("delivery_id"))
    table.append(d.where(early), "early", rules)
    table.append(d.where(~early).withColumn("delivery_id", lost), "late-broken", rules)
    table.append(d.where(~early), "late", rules)
    table.append(d.where(~early), "late", rules)  # repeated: nothing is written twice
    return table


def expect_audited_job(spark: SparkSession, sf: str) -> DataFrame:
    """Q-02/Q-03: what each audited load counted while it was written, with refused loads."""
    return audited_delivery(spark, sf).report()


def expect_published_job(spark: SparkSession, sf: str) -> DataFrame:
    """Q-03: the rows that audited loads made visible."""
    return audited_delivery(spark, sf).rows()


def lookup_job(spark: SparkSession, sf: str, path: str | None = None, ids: tuple[str, ...] = ("CMP-0000007", "CMP-0000050", "CMP-0000149")) -> DataFrame:
    """S-17 over an existing table: performance published once without its newest states, refreshed with them, then looked up by id."""
    from pacewise.plans import gold

    path = path or scratch_path(spark, "published-performance")
    d, c = clean.silver_delivery(b.delivery_bronze(spark, sf), AS_OF), clean.silver_campaigns(b.campaigns_bronze(spark, sf), AS_OF)
    performance = written_once(gold.campaign_performance(c, d, AS_OF), "performance")
    newest = _campaign_number() % 50 == 0
    stale = performance.where((_campaign_number() % 25 != 0) | newest).withColumn("status", F.when(newest, F.lit("Draft")).otherwise(F.col("status")))
    lookup.publish(stale, path, "campaign_id", buckets=16)
    lookup.refresh(performance.where(_campaign_number() % 25 == 0), path, "campaign_id", Steps(spark, scratch_path(spark, "refresh-lookup")))
    columns = ["campaign_id", "campaign_name", "status", "delivery_pct", "time_elapsed_pct", "pacing_status", "pacing_ratio"]
    found = [lookup.look_up(spark, path, "campaign_id", i).select(*columns) for i in ids]
    return reduce(DataFrame.unionByName, found)
