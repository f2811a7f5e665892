"""Gold tables: campaign performance, daily summary, platform scorecard, ticket efficiency.

Scale notes
-----------
* Delivery is always pre-aggregated before it meets campaigns. Aggregation is
  two-level — (campaign, day) first, then campaign — so COUNT(DISTINCT day)
  becomes a plain count of the first level instead of an Expand-based distinct
  aggregate, and partial (map-side) aggregation collapses hot campaigns before
  the shuffle.
* Money sums and averages go through fixed-scale decimals: exact, and the same
  whatever the task order.
* Campaigns are never force-broadcast: at cluster scale the campaign dimension
  grows with the customer table. AQE converts the join to a broadcast at
  runtime only when the measured side is under the threshold.
"""

from __future__ import annotations

import datetime as _dt

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from pacewise.config import AS_OF
from pacewise.functions.columns import as_of_date, as_of_ts, count_if, pct_text, rank_of, round_half_up

DEC = "decimal(28,10)"
MONEY = "decimal(18,2)"

# Alert labels, in alert-rank order.
ALERT_ORDER = [
    "Critical: No Delivery",
    "Critical: Severe Under-Pacing",
    "High: Budget Draining Fast",
    "High: Under-Pacing",
]
ALERT_OVER = "High: Severe Over-Pacing"
ALERT_NORMAL = "Normal"


def _avg_from(sum_col: str, cnt_col: str) -> Column:
    return F.when(F.col(cnt_col) > 0, F.col(sum_col).cast("double") / F.col(cnt_col))


def delivery_by_campaign_day(delivery: DataFrame, as_of: _dt.datetime = AS_OF) -> DataFrame:
    """First aggregation level: one row per (campaign, day) with additive partial sums."""
    since = F.date_sub(as_of_date(as_of), 7)
    recent = F.col("delivery_date") >= since
    return delivery.groupBy("campaign_id", "delivery_date").agg(
        F.count(F.lit(1)).alias("rows"),
        F.sum(F.col("impressions").cast("long")).alias("impressions"),
        F.sum(F.col("clicks").cast("long")).alias("clicks"),
        F.sum(F.col("spend_usd").cast(MONEY)).alias("spend"),
        F.sum(F.col("vast_errors").cast("long")).alias("vast_errors"),
        F.sum(F.col("viewability_rate").cast(DEC)).alias("view_sum"),
        F.count("viewability_rate").alias("view_n"),
        F.sum(F.col("cpm").cast(DEC)).alias("cpm_sum"),
        F.count("cpm").alias("cpm_n"),
        F.sum(F.col("cpc").cast(DEC)).alias("cpc_sum"),
        F.count("cpc").alias("cpc_n"),
        F.sum(F.col("ctr").cast(DEC)).alias("ctr_sum"),
        F.count("ctr").alias("ctr_n"),
        F.sum(F.when(recent, F.col("impressions")).otherwise(0).cast("long")).alias("imp_7d"),
        F.sum(F.when(recent, F.col("spend_usd")).otherwise(0).cast(MONEY)).alias("spend_7d"),
        F.sum(F.when(recent, F.col("clicks")).otherwise(0).cast("long")).alias("clicks_7d"),
        count_if(F.col("impressions") == 0).alias("zero_rows"),
        count_if(F.col("_suspicious_ctr")).alias("suspicious_rows"),
    )


def delivery_totals(delivery: DataFrame, as_of: _dt.datetime = AS_OF) -> DataFrame:
    """Second level: one row per campaign."""
    return totals_of_days(delivery_by_campaign_day(delivery, as_of))


def totals_of_days(by_day: DataFrame) -> DataFrame:
    """``delivery_totals`` from the rows of ``delivery_by_campaign_day``."""
    agg = by_day.groupBy("campaign_id").agg(
        F.count(F.lit(1)).alias("days_with_delivery"),
        F.sum("impressions").alias("total_impressions"),
        F.sum("clicks").alias("total_clicks"),
        F.sum("spend").alias("spend_dec"),
        F.sum("vast_errors").alias("total_vast_errors"),
        F.sum("view_sum").alias("view_sum"), F.sum("view_n").alias("view_n"),
        F.sum("cpm_sum").alias("cpm_sum"), F.sum("cpm_n").alias("cpm_n"),
        F.sum("cpc_sum").alias("cpc_sum"), F.sum("cpc_n").alias("cpc_n"),
        F.max("delivery_date").alias("last_delivery_date"),
        F.min("delivery_date").alias("first_delivery_date"),
        F.sum("imp_7d").alias("impressions_last_7d"),
        F.sum("spend_7d").alias("spend_7d_dec"),
        F.sum("clicks_7d").alias("clicks_last_7d"),
        F.sum("zero_rows").alias("zero_delivery_days"),
        F.sum("suspicious_rows").alias("suspicious_ctr_days"),
    )
    return totals_columns(agg)


def totals_columns(agg: DataFrame) -> DataFrame:
    """Sums and averages per campaign from exact partial sums."""
    return agg.select(
        "campaign_id",
        "days_with_delivery",
        "total_impressions",
        "total_clicks",
        F.col("spend_dec").cast("double").alias("total_spend"),
        "total_vast_errors",
        _avg_from("view_sum", "view_n").alias("avg_viewability_raw"),
        _avg_from("cpm_sum", "cpm_n").alias("avg_cpm_raw"),
        _avg_from("cpc_sum", "cpc_n").alias("avg_cpc_raw"),
        "last_delivery_date",
        "first_delivery_date",
        "impressions_last_7d",
        F.col("spend_7d_dec").cast("double").alias("spend_last_7d"),
        "clicks_last_7d",
        "zero_delivery_days",
        "suspicious_ctr_days",
    )


CAMPAIGN_PERF_DIMS = ["campaign_id", "campaign_name", "brand", "brand_code", "product", "title_name",
                      "campaign_objective", "platform", "region", "targeting_geo", "country", "channel_mapped",
                      "status", "budget_usd", "impressions_goal", "start_date", "end_date", "flight_duration_days",
                      "target_cpm", "audience_tactic"]


def campaign_performance(campaigns: DataFrame, delivery: DataFrame, as_of: _dt.datetime = AS_OF) -> DataFrame:
    """G-01: per-campaign delivery, pacing, alert priority and forecast."""
    return performance_of_totals(campaigns, delivery_totals(delivery, as_of), as_of)


def performance_of_totals(campaigns: DataFrame, totals: DataFrame, as_of: _dt.datetime = AS_OF) -> DataFrame:
    """``campaign_performance`` from the columns of ``delivery_totals``."""
    c = campaigns.select(*CAMPAIGN_PERF_DIMS)
    j = c.join(totals, "campaign_id", "left")
    today = as_of_date(as_of)
    imp = F.coalesce(F.col("total_impressions"), F.lit(0).cast("long"))
    spend = F.coalesce(F.col("total_spend"), F.lit(0.0))
    goal, flight, budget = F.col("impressions_goal"), F.col("flight_duration_days"), F.col("budget_usd")
    elapsed_days = F.greatest(F.datediff(F.least(today, F.col("end_date")), F.col("start_date")), F.lit(0))
    base = j.select(
        *CAMPAIGN_PERF_DIMS,
        imp.alias("total_impressions"),
        F.coalesce(F.col("total_clicks"), F.lit(0).cast("long")).alias("total_clicks"),
        spend.alias("total_spend"),
        F.coalesce(F.col("total_vast_errors"), F.lit(0).cast("long")).alias("total_vast_errors"),
        round_half_up("avg_viewability_raw", 4).alias("avg_viewability"),
        round_half_up("avg_cpm_raw", 2).alias("avg_cpm"),
        round_half_up("avg_cpc_raw", 2).alias("avg_cpc"),
        "last_delivery_date",
        "first_delivery_date",
        "days_with_delivery",
        F.coalesce(F.col("zero_delivery_days"), F.lit(0).cast("long")).alias("zero_delivery_days"),
        F.coalesce(F.col("suspicious_ctr_days"), F.lit(0).cast("long")).alias("suspicious_ctr_days"),
        F.coalesce(F.col("impressions_last_7d"), F.lit(0).cast("long")).alias("impressions_last_7d"),
        F.coalesce(F.col("spend_last_7d"), F.lit(0.0)).alias("spend_last_7d"),
        F.coalesce(F.col("clicks_last_7d"), F.lit(0).cast("long")).alias("clicks_last_7d"),
        F.when(goal > 0, round_half_up(imp * F.lit(100.0) / goal, 2)).alias("delivery_pct"),
        F.when(flight > 0, round_half_up(elapsed_days * F.lit(100.0) / flight, 2)).alias("time_elapsed_pct"),
        F.when(budget > 0, round_half_up(spend * F.lit(100.0) / budget, 2)).alias("budget_utilization_pct"),
    )
    dp, tp = F.col("delivery_pct"), F.col("time_elapsed_pct")
    active = F.col("status") == "Active"
    ratio = F.when(tp > 0, dp / tp)
    has_ratio = dp.isNotNull() & (tp > 0)
    pacing_status = (
        F.when(F.col("status") != "Active", F.lit("N/A"))
        .when(dp.isNull() | tp.isNull(), F.lit("Unknown"))
        .when(tp == 0, F.lit("Not Started"))
        .when(ratio < 0.8, F.lit("Under-Pacing"))
        .when(ratio > 1.2, F.lit("Over-Pacing"))
        .otherwise(F.lit("On Track"))
    )
    alert = (
        F.when(active & (F.col("zero_delivery_days") >= 3), F.lit(ALERT_ORDER[0]))
        .when(active & has_ratio & (ratio < 0.5), F.lit(ALERT_ORDER[1]))
        .when(active & (F.col("budget_utilization_pct") > 90) & (dp < 80), F.lit(ALERT_ORDER[2]))
        .when(active & has_ratio & (ratio < 0.8), F.lit(ALERT_ORDER[3]))
        .when(active & has_ratio & (ratio > 1.5), F.lit(ALERT_OVER))
        .otherwise(F.lit(ALERT_NORMAL))
    )
    days = F.col("days_with_delivery")
    forecast = F.when((days > 0) & (flight > 0),
                      round_half_up(F.col("total_impressions") / F.greatest(days, F.lit(1)).cast("double") * flight, 0))
    return base.select(
        "*",
        pacing_status.alias("pacing_status"),
        F.when(tp > 0, round_half_up(dp / tp, 3)).alias("pacing_ratio"),
        alert.alias("alert_priority"),
        forecast.alias("forecasted_total_impressions"),
        as_of_ts(as_of).alias("_gold_refreshed_at"),
    )


def daily_ops_summary(delivery: DataFrame, campaigns: DataFrame, as_of: _dt.datetime = AS_OF,
                      calendar: bool = False) -> DataFrame:
    """G-02: one row per delivery day.

    The distinct-campaign counts are taken after grouping by (day, campaign),
    so the campaign join sees one row per (day, campaign) instead of every
    delivery row. Week-over-week is LAG 7 *rows* as in the original; with
    ``calendar=True`` it is the value of the calendar day 7 days earlier.
    The un-partitioned window runs on the daily aggregate (one row per day,
    bounded by the calendar), never on raw rows.
    """
    return summary_of_days(delivery_by_campaign_day(delivery, as_of), campaigns, as_of, calendar)


def summary_of_days(by_day: DataFrame, campaigns: DataFrame, as_of: _dt.datetime = AS_OF, calendar: bool = False) -> DataFrame:
    """``daily_ops_summary`` from the rows of ``delivery_by_campaign_day``."""
    plat = campaigns.select("campaign_id", "platform")
    j = by_day.join(plat, "campaign_id", "left")
    p = F.col("platform")
    daily = j.groupBy("delivery_date").agg(
        F.count(F.lit(1)).alias("active_campaigns"),
        F.sum("impressions").alias("total_impressions"),
        F.sum("clicks").alias("total_clicks"),
        F.sum("spend").cast("double").alias("total_spend"),
        F.sum("ctr_sum").alias("ctr_sum"), F.sum("ctr_n").alias("ctr_n"),
        F.sum("cpm_sum").alias("cpm_sum"), F.sum("cpm_n").alias("cpm_n"),
        F.sum("view_sum").alias("view_sum"), F.sum("view_n").alias("view_n"),
        F.sum("vast_errors").alias("total_vast_errors"),
        F.sum("zero_rows").alias("zero_delivery_count"),
        count_if(p == "Meta").alias("meta_campaigns"),
        count_if(p == "CM360").alias("cm360_campaigns"),
        count_if(p == "TikTok").alias("tiktok_campaigns"),
        count_if(p == "Amazon DSP").alias("amazon_campaigns"),
    )
    imp, vast = F.col("total_impressions"), F.col("total_vast_errors")
    daily = daily.select(
        "delivery_date", "active_campaigns", "total_impressions", "total_clicks", "total_spend",
        round_half_up(_avg_from("ctr_sum", "ctr_n") * 100, 4).alias("avg_ctr_pct"),
        round_half_up(_avg_from("cpm_sum", "cpm_n"), 2).alias("avg_cpm"),
        round_half_up(_avg_from("view_sum", "view_n") * 100, 2).alias("avg_viewability_pct"),
        "total_vast_errors",
        F.when(imp + vast != 0, round_half_up(vast * F.lit(100.0) / (imp + vast), 4)).alias("vast_error_rate_pct"),
        "zero_delivery_count", "meta_campaigns", "cm360_campaigns", "tiktok_campaigns", "amazon_campaigns",
    )
    if calendar:
        # A day number as the window's order: the frame holds the one day 7 days earlier, and delivery is read once.
        week_ago = F.max("total_impressions").over(Window.orderBy(F.unix_date("delivery_date")).rangeBetween(-7, -7))
        # Rows without a date are their own frame, but have no day a week ago.
        daily = daily.withColumn("impressions_7d_ago", F.when(F.col("delivery_date").isNotNull(), week_ago))
    else:
        daily = daily.withColumn("impressions_7d_ago",
                                 F.lag("total_impressions", 7).over(Window.orderBy("delivery_date")))
    ago = F.col("impressions_7d_ago")
    return daily.select(
        "*",
        F.when(ago != 0, round_half_up((imp - ago) * F.lit(100.0) / ago, 2)).alias("impressions_wow_change_pct"),
        as_of_ts(as_of).alias("_gold_refreshed_at"),
    )


def platform_scorecard(campaigns: DataFrame, delivery: DataFrame, as_of: _dt.datetime = AS_OF) -> DataFrame:
    """G-03: platform × region, delivery pre-aggregated per campaign (no budget fan-out).

    Silver campaigns are unique on campaign_id, so the distinct campaign counts
    are plain counts. Viewability is the average of per-campaign averages.
    """
    return scorecard_of_totals(campaigns, delivery_totals(delivery, as_of), as_of)


def scorecard_of_totals(campaigns: DataFrame, totals: DataFrame, as_of: _dt.datetime = AS_OF) -> DataFrame:
    """``platform_scorecard`` from the columns of ``delivery_totals``."""
    d = totals.select(
        "campaign_id", "total_impressions", "total_clicks", "total_spend", "total_vast_errors",
        "avg_viewability_raw")
    j = campaigns.select("campaign_id", "platform", "region", "status", "budget_usd").join(d, "campaign_id", "left")
    g = j.groupBy("platform", "region").agg(
        F.count("campaign_id").alias("total_campaigns"),
        count_if(F.col("status") == "Active").alias("active_campaigns"),
        F.sum(F.col("budget_usd").cast(MONEY)).cast("double").alias("budget_sum"),
        F.coalesce(F.sum("total_impressions"), F.lit(0).cast("long")).alias("total_impressions"),
        F.coalesce(F.sum("total_clicks"), F.lit(0).cast("long")).alias("total_clicks"),
        F.coalesce(F.sum(F.col("total_spend").cast(MONEY)).cast("double"), F.lit(0.0)).alias("total_spend"),
        F.sum(F.col("avg_viewability_raw").cast(DEC)).alias("view_sum"),
        F.count("avg_viewability_raw").alias("view_n"),
        F.coalesce(F.sum("total_vast_errors"), F.lit(0).cast("long")).alias("total_vast_errors"),
    )
    imp, spend, budget = F.col("total_impressions"), F.col("total_spend"), F.col("budget_sum")
    return g.select(
        "platform", "region", "total_campaigns", "active_campaigns",
        round_half_up(budget, 2).alias("total_budget"),
        "total_impressions", "total_clicks", "total_spend",
        F.when(budget != 0, round_half_up(spend * F.lit(100.0) / budget, 2)).alias("budget_utilization_pct"),
        F.when(imp != 0, round_half_up(spend / (imp / F.lit(1000.0)), 2)).alias("blended_cpm"),
        F.when(imp != 0, round_half_up(F.col("total_clicks") * F.lit(100.0) / imp, 4)).alias("blended_ctr_pct"),
        round_half_up(_avg_from("view_sum", "view_n") * 100, 2).alias("avg_viewability_pct"),
        "total_vast_errors",
        as_of_ts(as_of).alias("_gold_refreshed_at"),
    )


def ops_efficiency(tickets: DataFrame, as_of: _dt.datetime = AS_OF) -> DataFrame:
    """G-04: one-row ticket automation / SLA / urgency / stage mix (global partial+final aggregate)."""
    u, s = F.col("urgency"), F.col("stage")
    g = tickets.agg(
        F.count(F.lit(1)).alias("total_tickets"),
        count_if(F.col("auto_eligible")).alias("auto_eligible_tickets"),
        count_if(F.col("is_breached")).alias("breached_tickets"),
        count_if(u == "Critical").alias("critical_tickets"),
        count_if(u == "High").alias("high_tickets"),
        count_if(u == "Medium").alias("medium_tickets"),
        count_if(u == "Low").alias("low_tickets"),
        count_if(s == "Completed").alias("completed_tickets"),
        count_if(s == "Live").alias("live_tickets"),
        count_if(s.isin("QA", "Pending", "In Progress")).alias("in_progress_tickets"),
    )
    n = F.col("total_tickets")
    return g.select(
        "total_tickets", "auto_eligible_tickets",
        F.when(n > 0, round_half_up(F.col("auto_eligible_tickets") * F.lit(100.0) / n, 2)).alias("automation_rate_pct"),
        "breached_tickets",
        F.when(n > 0, round_half_up(F.col("breached_tickets") * F.lit(100.0) / n, 2)).alias("breach_rate_pct"),
        "critical_tickets", "high_tickets", "medium_tickets", "low_tickets",
        "completed_tickets", "live_tickets", "in_progress_tickets",
        as_of_ts(as_of).alias("_gold_refreshed_at"),
    )


def assignee_workload(tickets: DataFrame, as_of: _dt.datetime = AS_OF) -> DataFrame:
    """G-05: per (assignee, role); NULL/empty assignees (a likely hot key) are filtered before grouping."""
    t = tickets.where(F.col("assignee").isNotNull() & (F.col("assignee") != ""))
    g = t.groupBy("assignee", "assignee_role").agg(
        F.count(F.lit(1)).alias("total_tickets"),
        count_if(F.col("is_breached")).alias("breached_tickets"),
        count_if(F.col("urgency").isin("Critical", "High")).alias("urgent_tickets"),
        count_if(~F.col("stage").isin("Completed", "Live")).alias("open_tickets"),
        F.sum(F.col("hours_until_due").cast(DEC)).alias("h_sum"),
        F.count("hours_until_due").alias("h_n"),
    )
    return g.select(
        "assignee", "assignee_role", "total_tickets", "breached_tickets", "urgent_tickets", "open_tickets",
        round_half_up(_avg_from("h_sum", "h_n"), 1).alias("avg_hours_until_due"),
        as_of_ts(as_of).alias("_gold_refreshed_at"),
    ).orderBy(F.col("breached_tickets").desc(), F.col("urgent_tickets").desc())


def alert_rank(c: str = "alert_priority") -> Column:
    return rank_of(c, ALERT_ORDER, 5)


def attention_list(performance: DataFrame) -> DataFrame:
    """G-06: active campaigns with percent strings, sorted by alert rank."""
    return performance.where(F.col("status") == "Active").select(
        "campaign_id", "campaign_name", "brand", "platform", "region", "pacing_status", "alert_priority",
        pct_text("delivery_pct").alias("delivery_pct"),
        pct_text("budget_utilization_pct").alias("budget_used"),
        "total_impressions", "total_spend", "avg_cpm",
        alert_rank().alias("alert_rank"),
    ).orderBy("alert_rank", "campaign_id")


def daily_trend(summary: DataFrame) -> DataFrame:
    """G-07: projection of the daily summary for the trend chart."""
    return summary.select("delivery_date", "total_impressions", "total_spend", "avg_cpm", "avg_viewability_pct",
                          "impressions_wow_change_pct").orderBy("delivery_date")


def scorecard_view(scorecard: DataFrame) -> DataFrame:
    return scorecard.orderBy(F.col("total_budget").desc_nulls_last(), "platform", "region")
