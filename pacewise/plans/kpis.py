"""Dashboard KPIs over the joined performance frame.

Delivery is summed per campaign before it meets the campaign dimension, so a
hot campaign is one row in the join; optional filters (None = "All") sit above
the join so Catalyst pushes them to the campaign side.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

MONEY = "decimal(18,2)"


def performance_frame(delivery: DataFrame, campaigns: DataFrame, segment: str | None = None,
                      brand: str | None = None, channel: str | None = None) -> DataFrame:
    per_campaign = delivery.groupBy("campaign_id").agg(
        F.sum(F.col("impressions").cast("long")).alias("impressions"), F.sum(F.col("clicks").cast("long")).alias("clicks"),
        F.sum(F.col("spend_usd").cast(MONEY)).alias("spend_usd"))
    perf = per_campaign.join(campaigns.select("campaign_id", "segment", "brand_code", "channel_mapped"), "campaign_id", "left")
    if segment is not None:
        perf = perf.where(F.col("segment") == segment)
    if brand is not None:
        perf = perf.where(F.col("brand_code") == brand)
    if channel is not None:
        perf = perf.where(F.col("channel_mapped") == channel)
    return perf


def dashboard_kpis(perf: DataFrame) -> DataFrame:
    """K-01: spend, impressions, clicks, CTR %, CPC, estimated conversions = int(clicks × 0.15); zero-safe."""
    g = perf.agg(
        F.coalesce(F.sum("spend_usd").cast("double"), F.lit(0.0)).alias("total_spend"),
        F.coalesce(F.sum(F.col("impressions").cast("long")), F.lit(0).cast("long")).alias("total_impressions"),
        F.coalesce(F.sum(F.col("clicks").cast("long")), F.lit(0).cast("long")).alias("total_clicks"),
    )
    imp, clk, spend = F.col("total_impressions"), F.col("total_clicks"), F.col("total_spend")
    return g.select(
        "total_spend", "total_impressions", "total_clicks",
        F.when(imp > 0, clk.cast("double") / imp * 100).otherwise(F.lit(0.0)).alias("ctr_pct"),
        F.when(clk > 0, spend / clk).otherwise(F.lit(0.0)).alias("cpc"),
        F.floor(clk.cast("double") * F.lit(0.15)).cast("long").alias("est_conversions"),
    )


def spend_by_segment(perf: DataFrame) -> DataFrame:
    """K-02: spend per segment (rows without a segment are dropped, as a pandas groupby does)."""
    return perf.where(F.col("segment").isNotNull()).groupBy("segment").agg(
        F.sum("spend_usd").cast("double").alias("spend_usd"))


def tickets_by_status(tickets: DataFrame) -> DataFrame:
    """K-03: ticket count per stage."""
    return tickets.groupBy(F.col("stage").alias("status")).agg(F.count(F.lit(1)).alias("tickets"))


def recent_jobs(tickets: DataFrame, n: int = 10) -> DataFrame:
    """K-04: the first ``n`` tickets by ticket id — a top-n, so the limit is the feature
    (Spark plans TakeOrderedAndProject: a per-task top-n, then one merge of n rows per task)."""
    return tickets.select(F.col("ticket_id").alias("id"), "campaign_id", "request_type", "platform",
                          F.col("stage").alias("status")).orderBy("id").limit(n)


def _long(one_row: DataFrame, names: list[str]) -> DataFrame:
    items = F.array(*[F.struct(F.lit(n).alias("metric"), F.col(n).cast("long").alias("value")) for n in names])
    return one_row.select(F.explode(items).alias("m")).select("m.metric", "m.value")


def load_summary(campaigns: DataFrame, tickets: DataFrame, delivery: DataFrame, qa_log: DataFrame) -> DataFrame:
    """K-05: distinct regions / markets / brands / platforms and event counts, as (metric, value) rows.

    One global aggregate per table (partial + final), unpivoted and unioned;
    no joins between the one-row results.
    """
    c = campaigns.agg(
        F.countDistinct("region").alias("regions"), F.countDistinct("targeting_geo").alias("markets"),
        F.countDistinct("brand_code").alias("brands"), F.countDistinct("platform").alias("platforms"))
    t = tickets.agg(
        F.sum(F.when(F.col("auto_eligible") == True, 1).otherwise(0)).alias("eligible_tickets"),  # noqa: E712
        F.sum(F.when(F.col("routed_to_role") == "Engineer", 1).otherwise(0)).alias("engineer_tickets"),
        F.sum(F.when(F.col("routed_to_role") == "Trafficker", 1).otherwise(0)).alias("trafficker_tickets"))
    d = delivery.agg(
        F.sum(F.when(F.col("impressions") == 0, 1).otherwise(0)).alias("zero_delivery_events"),
        F.sum(F.when(F.col("vast_errors") > 0, 1).otherwise(0)).alias("vast_error_events"))
    q = qa_log.agg(
        F.sum(F.when(F.col("result") == "Fail", 1).otherwise(0)).alias("qa_failures"),
        F.sum(F.when(F.col("result") == "Needs Review", 1).otherwise(0)).alias("qa_needs_review"))
    return (_long(c, ["regions", "markets", "brands", "platforms"])
            .unionByName(_long(t, ["eligible_tickets", "engineer_tickets", "trafficker_tickets"]))
            .unionByName(_long(d, ["zero_delivery_events", "vast_error_events"]))
            .unionByName(_long(q, ["qa_failures", "qa_needs_review"])))
