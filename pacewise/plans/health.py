"""Pipeline health, freshness, volume trend and alert tables.

Everything stays a DataFrame: row counts are aggregates unioned into one
frame (no driver-side loop of ``count()`` calls), and alert texts are one row
per alert line instead of a string concatenated from a collected list, so no
assignee or campaign group is ever gathered into a single value.
"""

from __future__ import annotations

import datetime as _dt
from functools import reduce

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from pacewise.config import AS_OF
from pacewise.functions.columns import as_of_date, as_of_ts, rank_of
from pacewise.operators.skew import spread_join
from pacewise.plans.gold import ALERT_ORDER


def pipeline_health(tables: list[tuple[str, str, DataFrame | None]]) -> DataFrame:
    """H-01: one row per (layer, table) with row count and OK / EMPTY / MISSING; all_healthy over all rows.

    ``tables`` holds (layer, name, frame); a frame of None is a missing table.
    The final window has no partition key but runs on one row per table.
    """
    parts = []
    for layer, name, df in tables:
        if df is None:
            parts.append(df_missing(layer, name))
            continue
        parts.append(df.agg(F.count(F.lit(1)).alias("row_count")).select(
            F.lit(layer).alias("layer"), F.lit(name).alias("table_name"), "row_count"))
    union = reduce(DataFrame.unionByName, parts)
    status = (F.when(F.col("row_count").isNull(), F.lit("MISSING"))
              .when(F.col("row_count") == 0, F.lit("EMPTY")).otherwise(F.lit("OK")))
    out = union.withColumn("status", status)
    ok = F.min(F.when(F.col("status") == "OK", F.lit(1)).otherwise(F.lit(0))).over(Window.partitionBy())
    return out.withColumn("all_healthy", ok == 1)


def df_missing(layer: str, name: str) -> DataFrame:
    from pyspark.sql import SparkSession

    spark = SparkSession.getActiveSession()
    return spark.createDataFrame([(layer, name, None)], "layer string, table_name string, row_count bigint")


def data_freshness(tables: list[tuple[str, DataFrame]], as_of: _dt.datetime = AS_OF) -> DataFrame:
    """H-02: last processing time, newest ingested row and whole hours from that row to ``as_of``, per silver table.

    The age is that of the newest data, so a table whose processing ran on time over old data shows as old.
    """
    parts = [
        df.agg(F.max("_silver_processed_at").alias("last_processed"), F.max("_ingested_at").alias("last_ingested")).select(
            F.lit(name).alias("table_name"), "last_processed", "last_ingested",
            F.timestamp_diff("HOUR", F.col("last_ingested"), as_of_ts(as_of)).alias("hours_since_refresh"))
        for name, df in tables
    ]
    return reduce(DataFrame.unionByName, parts)


def volume_trend(delivery: DataFrame, drop_ratio: float = 0.5) -> DataFrame:
    """H-03: delivery rows and impressions per day, flagging a day below ``drop_ratio`` × the previous day.

    The un-partitioned LAG runs after the daily aggregate (one row per day).
    """
    daily = delivery.groupBy("delivery_date").agg(
        F.count(F.lit(1)).alias("row_count"),
        F.sum(F.col("impressions").cast("long")).alias("total_impressions"),
    )
    prev = F.lag("row_count", 1).over(Window.orderBy("delivery_date"))
    return daily.withColumn("prev_row_count", prev).withColumn(
        "is_sudden_drop", F.coalesce(F.col("row_count") < F.col("prev_row_count") * F.lit(drop_ratio), F.lit(False))
    ).orderBy("delivery_date")


def campaign_alerts(performance: DataFrame) -> DataFrame:
    """H-04: active campaigns with a non-Normal alert, by alert rank."""
    return performance.where((F.col("alert_priority") != "Normal") & (F.col("status") == "Active")).select(
        "campaign_id", "campaign_name", "brand", "platform", "pacing_status", "alert_priority", "delivery_pct",
        "time_elapsed_pct", "budget_utilization_pct",
        rank_of("alert_priority", ALERT_ORDER, 5).alias("alert_rank"),
    ).orderBy("alert_rank", "campaign_id")


def sla_breach_report(tickets: DataFrame) -> DataFrame:
    """H-05: breached tickets per assignee, in long form (assignee, breached_count, ticket_id).

    The count is a partial/final aggregate; it is joined back to the breached
    rows, so a hot assignee (NULL holds a large share) never becomes one
    collected list, and the join goes by assignee and salt, so it never becomes
    one task either.
    """
    breached = tickets.where(F.col("is_breached")).select("assignee", "ticket_id")
    counts = breached.groupBy("assignee").agg(F.count(F.lit(1)).alias("breached_count"))
    # A NULL assignee is a group like any other: the join goes by an array, whose equality holds for a NULL element.
    one = F.array("assignee").alias("_who")
    return spread_join(breached.select("*", one), counts.select(one, "breached_count"), "_who", "ticket_id", "inner").select(
        "assignee", "breached_count", "ticket_id")


# Alert headers.
ALERT_TITLES = {
    "zero_delivery": "Zero Delivery Alert: the following campaigns had 0 impressions yesterday",
    "sla_breach": "SLA Breach Alert: the following tickets missed their SLA deadline",
    "pacing_summary": "Weekly Pacing Summary",
    "qa_failure": "QA Failed",
}


def alert_messages(by_day: DataFrame, campaigns: DataFrame, tickets: DataFrame, performance: DataFrame,
                   qa_results: DataFrame | None = None, as_of: _dt.datetime = AS_OF) -> DataFrame:
    """H-06: alert lines (alert_type, channel, title, subject_id, line); sending is not built.

    ``by_day`` has a row per campaign and day with its number of rows without impressions (``zero_rows``).
    """
    yesterday = F.date_sub(as_of_date(as_of), 1)
    z = (by_day.where((F.col("delivery_date") == yesterday) & (F.col("zero_rows") > 0)).select("campaign_id")
         .join(campaigns.where(F.col("status") == "Active").select("campaign_id", "campaign_name", "platform"),
               "campaign_id"))
    zero = z.select(
        F.lit("zero_delivery").alias("alert_type"), F.lit("slack").alias("channel"),
        F.lit(ALERT_TITLES["zero_delivery"]).alias("title"), F.col("campaign_id").alias("subject_id"),
        F.concat(F.lit("- "), F.coalesce("campaign_name", F.lit("")), F.lit(" | Platform: "),
                 F.coalesce("platform", F.lit("N/A"))).alias("line"))
    sla = tickets.where(F.col("is_breached")).select(
        F.lit("sla_breach").alias("alert_type"), F.lit("slack").alias("channel"),
        F.lit(ALERT_TITLES["sla_breach"]).alias("title"), F.col("ticket_id").alias("subject_id"),
        F.concat(F.lit("- "), F.col("ticket_id"), F.lit(" | Priority: "), F.coalesce("urgency", F.lit("N/A")),
                 F.lit(" | Assignee: "),
                 F.when(F.col("assignee").isNull() | (F.col("assignee") == ""), F.lit("Unassigned"))
                 .otherwise(F.col("assignee"))).alias("line"))
    counts = performance.agg(
        F.sum(F.when(F.col("pacing_status") == "Under-Pacing", 1).otherwise(0)).cast("long").alias("u"),
        F.sum(F.when(F.col("pacing_status") == "Over-Pacing", 1).otherwise(0)).cast("long").alias("o"),
    )
    pacing = counts.select(F.explode(F.array(
        F.struct(F.lit("under").alias("k"), F.concat(F.lit("Under-pacing Campaigns: "), F.col("u").cast("string")).alias("v")),
        F.struct(F.lit("over").alias("k"), F.concat(F.lit("Over-pacing Campaigns: "), F.col("o").cast("string")).alias("v")),
    )).alias("p")).select(
        F.lit("pacing_summary").alias("alert_type"), F.lit("slack").alias("channel"),
        F.lit(ALERT_TITLES["pacing_summary"]).alias("title"), F.col("p.k").alias("subject_id"),
        F.col("p.v").alias("line"))
    out = zero.unionByName(sla).unionByName(pacing)
    if qa_results is not None:
        qa = qa_results.where(F.col("result").isin("Fail", "Needs Review")).select(
            F.lit("qa_failure").alias("alert_type"), F.lit("teams").alias("channel"),
            F.concat(F.lit(ALERT_TITLES["qa_failure"] + " for Ticket "), F.col("ticket_id"), F.lit(" (Assignee: "),
                     F.when(F.col("assignee").isNull() | (F.col("assignee") == ""), F.lit("Unassigned"))
                     .otherwise(F.col("assignee")), F.lit(")")).alias("title"),
            F.col("ticket_id").alias("subject_id"),
            F.concat(F.lit("- "), F.col("check_name"), F.lit(": "), F.col("details")).alias("line"))
        out = out.unionByName(qa)
    return out
