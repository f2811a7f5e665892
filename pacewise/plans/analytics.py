"""Ad-hoc analytics (campaign health and ticket SLA views) over the silver tables.

Delivery is reduced per campaign before any join with campaigns, so joins see
one row per campaign instead of one per delivery row; filters sit below the
aggregations so Catalyst pushes them into the scans.
"""

from __future__ import annotations

import datetime as _dt

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from pacewise.config import AS_OF
from pacewise.functions.columns import as_of_date, as_of_ts, count_if, round_half_up
from pacewise.operators.skew import spread_join

MONEY = "decimal(18,2)"


def campaign_distribution(campaigns: DataFrame) -> DataFrame:
    """A-01: campaigns and budget by objective and platform."""
    return campaigns.groupBy("campaign_objective", "platform").agg(
        F.count(F.lit(1)).alias("num_campaigns"),
        F.sum(F.col("budget_usd").cast(MONEY)).cast("double").alias("total_budget"),
    ).orderBy(F.col("total_budget").desc_nulls_last(), "campaign_objective", "platform")


def zero_delivery_all(delivery: DataFrame, campaigns: DataFrame) -> DataFrame:
    """A-02: zero-impression delivery rows of Active campaigns, newest first."""
    d = delivery.where(F.col("impressions") == 0).select("delivery_id", "campaign_id", "delivery_date",
                                                          "impressions", "clicks")
    c = campaigns.where(F.col("status") == "Active").select("campaign_id", "campaign_name", "platform", "status")
    return spread_join(d, c, "campaign_id", "delivery_id", "inner").select(
        F.col("delivery_date").alias("date"), "campaign_name", "platform", "status", "impressions", "clicks",
        "delivery_id",
    ).orderBy(F.col("date").desc(), "delivery_id")


def zero_delivery_latest(delivery: DataFrame, campaigns: DataFrame) -> DataFrame:
    """A-03: Active campaigns with a zero-impression row on the latest delivery day.

    The latest day is a one-row global aggregate (partial max per task), so
    broadcasting it is bounded by construction.
    """
    last = delivery.agg(F.max("delivery_date").alias("last_date"))
    d = delivery.where(F.col("impressions") == 0).join(
        F.broadcast(last), F.col("delivery_date") == F.col("last_date")).select("campaign_id", "delivery_id")
    c = campaigns.where(F.col("status") == "Active").select(
        "campaign_id", "campaign_name", F.col("brand").alias("advertiser"), "platform", "budget_usd")
    return spread_join(d, c, "campaign_id", "delivery_id", "inner").select("campaign_name", "advertiser", "platform", "budget_usd",
                                           "delivery_id").orderBy(F.col("budget_usd").desc_nulls_last())


def vast_errors_by_campaign(delivery: DataFrame, campaigns: DataFrame) -> DataFrame:
    """A-04: VAST errors summed by campaign name and platform (rows with errors only)."""
    per_campaign = delivery.where(F.col("vast_errors") > 0).groupBy("campaign_id").agg(
        F.sum(F.col("vast_errors").cast("long")).alias("errs"))
    j = per_campaign.join(campaigns.select("campaign_id", "campaign_name", "platform"), "campaign_id")
    return j.groupBy("campaign_name", "platform").agg(F.sum("errs").alias("total_vast_errors")).orderBy(
        F.col("total_vast_errors").desc())


def vast_error_rate(delivery: DataFrame, campaigns: DataFrame) -> DataFrame:
    """A-05: per-campaign VAST error rate % = errors / (impressions + errors) * 100."""
    agg = delivery.groupBy("campaign_id").agg(
        F.sum(F.col("vast_errors").cast("long")).alias("total_errors"),
        F.sum(F.col("impressions").cast("long")).alias("total_imps"),
    ).where(F.col("total_errors") > 0)
    j = agg.join(campaigns.select("campaign_id", "campaign_name", "platform"), "campaign_id")
    den = F.col("total_imps") + F.col("total_errors")
    return j.select(
        "campaign_id", "campaign_name", "platform",
        F.col("total_errors").alias("vast_errors"),
        F.when(den > 0, round_half_up(F.col("total_errors") / den.cast("double") * 100, 2))
        .otherwise(F.lit(0.0)).alias("error_rate_pct"),
    ).orderBy(F.col("vast_errors").desc())


def pacing_analysis(delivery: DataFrame, campaigns: DataFrame) -> DataFrame:
    """A-06: delivered % against time elapsed up to the last delivery day (Active, positive flight)."""
    d = delivery.groupBy("campaign_id").agg(
        F.sum(F.col("impressions").cast("long")).alias("delivered_impressions"),
        F.max("delivery_date").alias("last_delivery_date"),
    )
    flight = F.datediff("end_date", "start_date")
    c = campaigns.where((F.col("status") == "Active") & (flight > 0))
    j = c.join(d, "campaign_id")
    goal = F.col("impressions_goal")
    pacing = F.when(goal != 0, F.col("delivered_impressions") / goal.cast("double")) * 100
    expected = F.when(flight != 0, F.datediff("last_delivery_date", "start_date") / flight.cast("double")) * 100
    p = j.select("campaign_id", "campaign_name", "brand", "platform", "budget_usd", "impressions_goal",
                 "delivered_impressions", flight.alias("flight_days"),
                 F.datediff("last_delivery_date", "start_date").alias("days_elapsed"),
                 pacing.alias("_pacing"), expected.alias("_expected"))
    pc, ex = F.col("_pacing"), F.col("_expected")
    return p.select(
        "campaign_id", "campaign_name", "brand", "platform", "budget_usd", "impressions_goal",
        "delivered_impressions", "flight_days", "days_elapsed",
        round_half_up(pc, 2).alias("pacing_pct"),
        round_half_up(ex, 2).alias("expected_pacing_pct"),
        F.when(pc < ex * 0.8, F.lit("Under-pacing")).when(pc > ex * 1.2, F.lit("Over-pacing"))
        .otherwise(F.lit("On Track")).alias("pacing_status"),
    ).orderBy("pacing_status", "campaign_id")


def sla_analysis(tickets: DataFrame, as_of: _dt.datetime = AS_OF) -> DataFrame:
    """A-07: date-level days to due and Overdue/On Track (stage other than Completed)."""
    due_day = F.to_date("due_date")
    today = as_of_date(as_of)
    return tickets.select(
        "ticket_id", "title", "request_type", "urgency", "due_date", "assignee",
        F.datediff(due_day, today).alias("days_to_due"),
        F.when((due_day < today) & (F.col("stage") != "Completed"), F.lit("Overdue"))
        .otherwise(F.lit("On Track")).alias("sla_status"),
    ).orderBy(F.col("days_to_due").asc_nulls_first(), "ticket_id")


def ticket_distribution(tickets: DataFrame) -> DataFrame:
    """A-08: tickets by request type and routed role."""
    return tickets.groupBy("request_type", "routed_to_role").agg(F.count(F.lit(1)).alias("num_tickets")).orderBy(
        F.col("num_tickets").desc(), "request_type")


def request_volume(tickets: DataFrame) -> DataFrame:
    """A-08: tickets by request type."""
    return tickets.groupBy("request_type").agg(F.count(F.lit(1)).alias("volume")).orderBy(
        F.col("volume").desc(), "request_type")


def eligible_by_stage(tickets: DataFrame) -> DataFrame:
    """A-09: automation-eligible tickets by stage."""
    return tickets.where(F.col("auto_eligible") == True).groupBy("stage").agg(  # noqa: E712
        F.count(F.lit(1)).alias("eligible_tickets"))


def urgency_by_stage(tickets: DataFrame) -> DataFrame:
    """A-09: urgency × stage counts."""
    return tickets.groupBy("urgency", "stage").agg(F.count(F.lit(1)).alias("ticket_count")).orderBy(
        "urgency", "stage")


def breach_rate_by_assignee(tickets: DataFrame, as_of: _dt.datetime = AS_OF) -> DataFrame:
    """A-10: open tickets per assignee, overdue by timestamp, breach rate %."""
    t = tickets.where(~F.col("stage").isin("Completed", "Live") & F.col("assignee").isNotNull()
                      & (F.col("assignee") != ""))
    g = t.groupBy("assignee").agg(
        F.count(F.lit(1)).alias("total_open_tickets"),
        count_if(F.col("due_date") < as_of_ts(as_of)).alias("overdue_tickets"),
    )
    return g.select(
        "assignee", "total_open_tickets", "overdue_tickets",
        round_half_up(F.col("overdue_tickets") / F.col("total_open_tickets").cast("double") * 100, 2)
        .alias("breach_rate"),
    ).orderBy(F.col("breach_rate").desc(), "assignee")


# -- silver quality checks (displayed gates) -----------------------------------


def dq_campaigns(campaigns: DataFrame) -> DataFrame:
    """Q-09: campaign silver check."""
    return campaigns.agg(
        F.count(F.lit(1)).alias("total_rows"),
        count_if(F.col("budget_usd").isNotNull()).alias("valid_budget"),
        count_if(F.col("_budget_flagged")).alias("flagged_budget"),
        count_if(F.col("status") == "Unknown").alias("unknown_status"),
        count_if(F.col("impressions_goal").isNull()).alias("missing_goal"),
        count_if(F.col("flight_duration_days") <= 0).alias("invalid_flight_dates"),
    ).select(F.lit("campaigns").alias("table_name"), "*")


def dq_delivery(delivery: DataFrame) -> DataFrame:
    """Q-10: delivery anomalies."""
    dec = "decimal(28,10)"
    g = delivery.agg(
        F.count(F.lit(1)).alias("total_rows"),
        count_if(F.col("_suspicious_ctr")).alias("suspicious_ctr_rows"),
        count_if(F.col("_zero_delivery_spend")).alias("zero_delivery_with_spend"),
        count_if(F.col("cpm") > 100).alias("high_cpm_rows"),
        F.sum(F.col("ctr").cast(dec)).alias("ctr_sum"), F.count("ctr").alias("ctr_n"),
        F.sum(F.col("viewability_rate").cast(dec)).alias("v_sum"), F.count("viewability_rate").alias("v_n"),
    )
    avg = lambda s, n: F.when(F.col(n) > 0, F.col(s).cast("double") / F.col(n))
    return g.select(
        F.lit("delivery").alias("table_name"), "total_rows", "suspicious_ctr_rows", "zero_delivery_with_spend",
        "high_cpm_rows",
        round_half_up(avg("ctr_sum", "ctr_n") * 100, 4).alias("avg_ctr_pct"),
        round_half_up(avg("v_sum", "v_n") * 100, 2).alias("avg_viewability_pct"),
    )


def dq_sla(tickets: DataFrame) -> DataFrame:
    """Q-11: SLA health over open tickets."""
    g = tickets.where(~F.col("stage").isin("Completed", "Live")).agg(
        F.count(F.lit(1)).alias("total_tickets"),
        count_if(F.col("is_breached")).alias("breached"),
        count_if((F.col("hours_until_due") < 4) & ~F.col("is_breached")).alias("at_risk"),
    )
    n = F.col("total_tickets")
    return g.select("total_tickets", "breached",
                    F.when(n > 0, round_half_up(F.col("breached") * F.lit(100.0) / n, 2)).alias("breach_rate_pct"),
                    "at_risk")
