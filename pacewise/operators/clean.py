"""Silver cleaning: dedup + conformed projections of the four bronze tables.

Each function is lazy, free of actions, and takes ``as_of`` instead of reading
the clock. Rules follow the original SQL notebook (raw metric values for the
recomputed ratios); ``clamped=True`` switches delivery metrics to the
clamped-input variant of the declarative pipeline.
"""

from __future__ import annotations

import datetime as _dt

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from pacewise.config import AS_OF
from pacewise.functions.columns import (
    TICKET_PLATFORM_ALIASES,
    allowed_or_default,
    as_of_ts,
    canonical_platform,
    flag,
    round_half_up,
)
from pacewise.operators.dedup import dedup_latest

# Allowed status / urgency sets and their defaults.
CAMPAIGN_STATUSES = ["Active", "Paused", "Completed", "Cancelled", "Draft"]
URGENCIES = ["Low", "Medium", "High", "Critical"]
CLOSED_STAGES = ["Completed", "Live"]


def _t(c: str):
    return F.trim(F.col(c))


def silver_campaigns(bronze: DataFrame, as_of: _dt.datetime = AS_OF) -> DataFrame:
    d = dedup_latest(bronze.where(F.col("campaign_id").isNotNull()), "campaign_id")
    budget, goal = F.col("budget_usd"), F.col("impressions_goal")
    return d.select(
        "campaign_id",
        "title_id",
        _t("title_name").alias("title_name"),
        _t("brand").alias("brand"),
        F.upper(_t("brand_code")).alias("brand_code"),
        _t("segment").alias("segment"),
        _t("product").alias("product"),
        _t("campaign_name").alias("campaign_name"),
        _t("campaign_objective").alias("campaign_objective"),
        F.upper(_t("targeting_geo")).alias("targeting_geo"),
        _t("country").alias("country"),
        F.upper(_t("language")).alias("language"),
        _t("geo_cluster").alias("geo_cluster"),
        _t("region").alias("region"),
        _t("channel").alias("channel"),
        _t("channel_mapped").alias("channel_mapped"),
        canonical_platform("platform").alias("platform"),
        F.when(budget > 0, budget).alias("budget_usd"),
        flag(budget <= 0).alias("_budget_flagged"),
        "start_date",
        "end_date",
        allowed_or_default("status", CAMPAIGN_STATUSES, "Unknown").alias("status"),
        F.when(goal > 0, goal).alias("impressions_goal"),
        "flight_priority",
        _t("audience_tactic").alias("audience_tactic"),
        _t("audience_strategy").alias("audience_strategy"),
        _t("audience_detailed").alias("audience_detailed"),
        _t("landing_page").alias("landing_page"),
        F.datediff("end_date", "start_date").alias("flight_duration_days"),
        F.when((goal > 0) & (budget > 0), round_half_up(budget / (goal / F.lit(1000.0)), 4)).alias("target_cpm"),
        "_ingested_at",
        "_source_file",
        as_of_ts(as_of).alias("_silver_processed_at"),
    )


def delivery_order():
    """Latest ingestion first; the source part/supplier keys make the order total."""
    return [F.col("_ingested_at").desc(), F.col("_src_partkey").asc(), F.col("_src_suppkey").asc()]


def silver_delivery(bronze: DataFrame, as_of: _dt.datetime = AS_OF, clamped: bool = False,
                    keep_order: bool = False) -> DataFrame:
    """``keep_order`` also keeps the columns that order a key's versions, for tables that are merged into."""
    order = delivery_order() if "_src_partkey" in bronze.columns else None
    return delivery_rows(dedup_latest(named_delivery(bronze), "delivery_id", order), as_of, clamped, keep_order)


def named_delivery(bronze: DataFrame) -> DataFrame:
    """Rows that silver delivery takes: those with both ids."""
    return bronze.where(F.col("delivery_id").isNotNull() & F.col("campaign_id").isNotNull())


def delivery_rows(d: DataFrame, as_of: _dt.datetime = AS_OF, clamped: bool = False, keep_order: bool = False) -> DataFrame:
    """The silver columns of delivery rows, all versions of a key."""
    raw_imp, raw_clk, raw_spend, raw_vast = (F.col(c) for c in ("impressions", "clicks", "spend_usd", "vast_errors"))
    imp = F.greatest(raw_imp, F.lit(0))
    clk = F.greatest(raw_clk, F.lit(0))
    spend = F.greatest(raw_spend, F.lit(0.0))
    vast = F.greatest(raw_vast, F.lit(0))
    m_imp, m_clk, m_spend, m_vast = (imp, clk, spend, vast) if clamped else (raw_imp, raw_clk, raw_spend, raw_vast)
    v = F.col("viewability_rate")
    return d.select(
        "delivery_id",
        "campaign_id",
        F.col("date").alias("delivery_date"),
        imp.alias("impressions"),
        clk.alias("clicks"),
        spend.alias("spend_usd"),
        vast.alias("vast_errors"),
        F.when(m_imp > 0, round_half_up(m_clk.cast("double") / m_imp, 6)).otherwise(F.lit(0.0)).alias("ctr"),
        F.when(v.between(0, 1), v).when(v > 1, F.lit(1.0)).otherwise(F.lit(0.0)).alias("viewability_rate"),
        F.when(m_imp > 0, round_half_up(m_spend / (m_imp / F.lit(1000.0)), 4)).alias("cpm"),
        F.when(m_clk > 0, round_half_up(m_spend / m_clk, 4)).alias("cpc"),
        F.when(m_imp + m_vast > 0, round_half_up(m_vast.cast("double") / (m_imp + m_vast), 6))
        .otherwise(F.lit(0.0)).alias("vast_error_rate"),
        flag(m_clk > m_imp).alias("_suspicious_ctr"),
        flag((m_imp == 0) & (m_spend > 0)).alias("_zero_delivery_spend"),
        "_ingested_at",
        "_source_file",
        as_of_ts(as_of).alias("_silver_processed_at"),
        *(["_src_partkey", "_src_suppkey"] if keep_order else []),
    )


def silver_tickets(bronze: DataFrame, as_of: _dt.datetime = AS_OF) -> DataFrame:
    d = dedup_latest(bronze.where(F.col("ticket_id").isNotNull()), "ticket_id")
    due = F.col("due_date").try_cast("timestamp")
    now = as_of_ts(as_of)
    open_stage = ~_t("stage").isin(*CLOSED_STAGES)
    return d.select(
        "ticket_id",
        "campaign_id",
        _t("title").alias("title"),
        _t("request_type").alias("request_type"),
        _t("routed_to_role").alias("routed_to_role"),
        "auto_eligible",
        allowed_or_default("urgency", URGENCIES, "Medium").alias("urgency"),
        _t("stage").alias("stage"),
        canonical_platform("platform", TICKET_PLATFORM_ALIASES).alias("platform"),
        F.upper(_t("targeting_geo")).alias("targeting_geo"),
        _t("brand").alias("brand"),
        _t("requested_by").alias("requested_by"),
        "created_date",
        due.alias("due_date"),
        _t("assignee").alias("assignee"),
        _t("assignee_role").alias("assignee_role"),
        F.greatest(F.col("sla_hours"), F.lit(1)).alias("sla_hours"),
        "notes",
        flag((due < now) & open_stage).alias("is_breached"),
        F.when(due.isNotNull(),
               round_half_up((F.unix_timestamp(due) - F.unix_timestamp(now)) / F.lit(3600.0), 1)
               ).alias("hours_until_due"),
        "_ingested_at",
        as_of_ts(as_of).alias("_silver_processed_at"),
    )


def silver_qa_checks(bronze: DataFrame, as_of: _dt.datetime = AS_OF) -> DataFrame:
    d = dedup_latest(bronze.where(F.col("qa_id").isNotNull()), "qa_id")
    return d.select(
        "qa_id",
        "ticket_id",
        _t("check_name").alias("check_name"),
        _t("check_details").alias("check_details"),
        _t("result").alias("result"),
        _t("checked_by").alias("checked_by"),
        F.col("checked_at").try_cast("timestamp").alias("checked_at"),
        "_ingested_at",
        as_of_ts(as_of).alias("_silver_processed_at"),
    )


def standardize_platform(bronze_campaigns: DataFrame) -> DataFrame:
    """C-03 on its own: raw platform value → canonical name (one row per bronze row)."""
    return bronze_campaigns.select("campaign_id", "_batch_id", F.col("platform").alias("raw_platform"),
                                   canonical_platform("platform").alias("platform"))
