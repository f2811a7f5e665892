"""Registry of named queries: name -> fn(spark, sf_dir) -> DataFrame.

Every query reads the given tables through the bindings (its work grows with
them) and is lazy: nothing runs until the caller acts on the result.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from pacewise.config import AS_OF
from pacewise.operators import clean
from pacewise.plans import gold
from pacewise.session import scratch_path, written_once
from pacewise.sources import bindings as b

QueryFn = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, QueryFn] = {}


def query(name: str):
    def deco(fn: QueryFn) -> QueryFn:
        QUERIES[name] = fn
        return fn

    return deco


# -- silver ------------------------------------------------------------------
#
# Shared frames are built once per (session, tables, scan setting) and reused:
# a composite query (e.g. alert lines over delivery, tickets and campaign
# performance) then holds ONE plan per silver table, so Spark can reuse its
# exchanges, and the driver does not rebuild and re-analyse the same plan.

_MEMO: dict[tuple, DataFrame] = {}


def _memo(kind: str, spark, sf, build):
    from pacewise.sources.tables import SCAN_PARTITIONS_CONF

    key = (kind, id(spark), sf, spark.conf.get(SCAN_PARTITIONS_CONF, "0"))
    df = _MEMO.get(key)
    if df is None or df.sparkSession is not spark:
        df = _MEMO[key] = build()
    return df


def campaigns(spark, sf):
    return _memo("campaigns", spark, sf, lambda: clean.silver_campaigns(b.campaigns_bronze(spark, sf), AS_OF))


def delivery(spark, sf):
    return _memo("delivery", spark, sf, lambda: clean.silver_delivery(b.delivery_bronze(spark, sf), AS_OF))


def tickets(spark, sf):
    return _memo("tickets", spark, sf, lambda: clean.silver_tickets(b.tickets_bronze(spark, sf), AS_OF))


def qa_checks(spark, sf):
    return _memo("qa_checks", spark, sf, lambda: clean.silver_qa_checks(b.qa_checks_bronze(spark, sf), AS_OF))


query("silver_campaigns")(campaigns)
query("silver_delivery")(delivery)
query("silver_tickets")(tickets)
query("silver_qa_checks")(qa_checks)


@query("delivery_metrics")
def _delivery_metrics(spark, sf):
    return clean.silver_delivery(b.delivery_bronze(spark, sf), AS_OF, clamped=True).drop(
        "_ingested_at", "_source_file", "_silver_processed_at")


# -- gold --------------------------------------------------------------------


def performance(spark, sf):
    return _memo("performance", spark, sf,
                 lambda: gold.campaign_performance(campaigns(spark, sf), delivery(spark, sf), AS_OF))


query("campaign_performance")(performance)


@query("daily_ops_summary")
def daily_summary(spark, sf):
    return gold.daily_ops_summary(delivery(spark, sf), campaigns(spark, sf), AS_OF)


@query("daily_ops_summary_calendar")
def _daily_calendar(spark, sf):
    return gold.daily_ops_summary(delivery(spark, sf), campaigns(spark, sf), AS_OF, calendar=True)


@query("platform_scorecard")
def scorecard(spark, sf):
    return gold.platform_scorecard(campaigns(spark, sf), delivery(spark, sf), AS_OF)


@query("ops_efficiency")
def _ops_efficiency(spark, sf):
    return gold.ops_efficiency(tickets(spark, sf), AS_OF)


@query("assignee_workload")
def _assignee_workload(spark, sf):
    return gold.assignee_workload(tickets(spark, sf), AS_OF)


@query("attention_list")
def _attention_list(spark, sf):
    return gold.attention_list(performance(spark, sf))


@query("daily_trend")
def _daily_trend(spark, sf):
    return gold.daily_trend(daily_summary(spark, sf))


@query("scorecard_view")
def _scorecard_view(spark, sf):
    return gold.scorecard_view(scorecard(spark, sf))


# -- ad-hoc analytics -----------------------------------------------------------

from pacewise.plans import analytics as an  # noqa: E402

query("campaign_distribution")(lambda spark, sf: an.campaign_distribution(campaigns(spark, sf)))
query("zero_delivery_all")(lambda spark, sf: an.zero_delivery_all(delivery(spark, sf), campaigns(spark, sf)))
query("zero_delivery_latest")(lambda spark, sf: an.zero_delivery_latest(delivery(spark, sf), campaigns(spark, sf)))
query("vast_errors_by_campaign")(
    lambda spark, sf: an.vast_errors_by_campaign(delivery(spark, sf), campaigns(spark, sf)))
query("vast_error_rate")(lambda spark, sf: an.vast_error_rate(delivery(spark, sf), campaigns(spark, sf)))
query("pacing_analysis")(lambda spark, sf: an.pacing_analysis(delivery(spark, sf), campaigns(spark, sf)))
query("sla_analysis")(lambda spark, sf: an.sla_analysis(tickets(spark, sf), AS_OF))
query("ticket_distribution")(lambda spark, sf: an.ticket_distribution(tickets(spark, sf)))
query("request_volume")(lambda spark, sf: an.request_volume(tickets(spark, sf)))
query("eligible_by_stage")(lambda spark, sf: an.eligible_by_stage(tickets(spark, sf)))
query("urgency_by_stage")(lambda spark, sf: an.urgency_by_stage(tickets(spark, sf)))
query("breach_rate_by_assignee")(lambda spark, sf: an.breach_rate_by_assignee(tickets(spark, sf), AS_OF))
query("dq_campaigns")(lambda spark, sf: an.dq_campaigns(campaigns(spark, sf)))
query("dq_delivery")(lambda spark, sf: an.dq_delivery(delivery(spark, sf)))
query("dq_sla")(lambda spark, sf: an.dq_sla(tickets(spark, sf)))

# -- health and alerts -----------------------------------------------------------

from pacewise.plans import health as hl  # noqa: E402


@query("pipeline_health")
def _pipeline_health(spark, sf):
    """H-01 over the layers that a daily run writes: counts come from the written tables."""
    from pacewise.plans import pipeline

    tables = pipeline.run_daily(spark, sf, scratch_path(spark, "health-run"), ["campaigns", "delivery", "tickets"])
    names = [n for n in tables if n != "gold.assignee_workload" and not n.startswith("quality")]
    return hl.pipeline_health([(n.split(".")[0].capitalize(), n, tables[n]) for n in names])


query("data_freshness")(lambda spark, sf: hl.data_freshness(
    [("campaigns", campaigns(spark, sf)), ("delivery", delivery(spark, sf)), ("tickets", tickets(spark, sf))],
    AS_OF))
query("volume_trend")(lambda spark, sf: hl.volume_trend(delivery(spark, sf)))
query("campaign_alerts")(lambda spark, sf: hl.campaign_alerts(performance(spark, sf)))
query("sla_breach_report")(lambda spark, sf: hl.sla_breach_report(tickets(spark, sf)))

# -- data quality ------------------------------------------------------------------

from pacewise.functions.rules import DECLARATIVE_EXPECTATIONS, QUALITY_SUITE, rules_for  # noqa: E402
from pacewise.operators import quality as qa  # noqa: E402
from functools import reduce as _reduce  # noqa: E402


def _silver_tables(spark, sf):
    return {"campaigns": campaigns(spark, sf), "delivery": delivery(spark, sf), "tickets": tickets(spark, sf)}


def _bronze_tables(spark, sf):
    return {"campaigns": b.campaigns_bronze(spark, sf), "delivery": b.delivery_bronze(spark, sf),
            "tickets": b.tickets_bronze(spark, sf)}


@query("quality_report")
def _quality_report(spark, sf):
    parts = [qa.quality_report(df, t, rules_for(t, QUALITY_SUITE)) for t, df in _silver_tables(spark, sf).items()]
    return _reduce(lambda a, c: a.unionByName(c), parts)


@query("quality_report_bronze")
def _quality_report_bronze(spark, sf):
    parts = [qa.quality_report(df, t, rules_for(t, QUALITY_SUITE)) for t, df in _bronze_tables(spark, sf).items()]
    return _reduce(lambda a, c: a.unionByName(c), parts)


@query("table_health")
def _table_health(spark, sf):
    parts = [qa.table_health(df, t, rules_for(t, QUALITY_SUITE)) for t, df in _silver_tables(spark, sf).items()]
    return _reduce(lambda a, c: a.unionByName(c), parts)


query("quality_scoreboard")(lambda spark, sf: qa.quality_scoreboard(_silver_tables(spark, sf), AS_OF))
query("quarantine_campaigns")(lambda spark, sf: qa.quarantine(b.campaigns_bronze(spark, sf), "campaigns", AS_OF))
query("quarantine_delivery")(lambda spark, sf: qa.quarantine(b.delivery_bronze(spark, sf), "delivery", AS_OF))
query("quarantine_tickets")(lambda spark, sf: qa.quarantine(b.tickets_bronze(spark, sf), "tickets", AS_OF))
query("quarantine_split")(lambda spark, sf: qa.quarantine_split(b.delivery_bronze(spark, sf), "delivery"))


@query("expect_metrics")
def _expect_metrics(spark, sf):
    parts = [qa.expectation_metrics(df, t, DECLARATIVE_EXPECTATIONS[t])
             for t, df in _silver_tables(spark, sf).items()]
    return _reduce(lambda a, c: a.unionByName(c), parts)


query("expect_drop")(lambda spark, sf: qa.expect_or_drop(b.delivery_bronze(spark, sf),
                                                         DECLARATIVE_EXPECTATIONS["delivery"]))
query("expect_fail")(lambda spark, sf: qa.expect_or_fail(
    delivery(spark, sf), [e for e in DECLARATIVE_EXPECTATIONS["delivery"] if e[2] == "fail"]))

# -- tickets -------------------------------------------------------------------------

from pacewise.operators import tickets as tk  # noqa: E402


def _with_payloads(spark, sf):
    return tk.with_payloads(tickets(spark, sf), campaigns(spark, sf))


query("ticket_queues")(lambda spark, sf: tk.ticket_queues(tickets(spark, sf), AS_OF))
query("route_tickets")(lambda spark, sf: tk.route_by_rule(tickets(spark, sf)))
query("route_tickets_by_type")(lambda spark, sf: tk.route_by_type(tickets(spark, sf), b.ticket_types_dim(spark)))
query("sla_status")(lambda spark, sf: tk.sla_status(tickets(spark, sf), AS_OF))
query("automation_version")(lambda spark, sf: tk.campaign_versions(campaigns(spark, sf)))
query("placement_name")(lambda spark, sf: campaigns(spark, sf).select("campaign_id", tk.placement_name().alias(
    "placement_name")))
query("campaign_name_taxonomy")(lambda spark, sf: tk.campaign_name_taxonomy(campaigns(spark, sf)))
query("ticket_payloads")(lambda spark, sf: tk.ticket_payloads(_with_payloads(spark, sf)))
query("payload_bodies")(lambda spark, sf: tk.payload_fields(tk.payload_json(_with_payloads(spark, sf))))
query("qa_results")(lambda spark, sf: tk.qa_results(_with_payloads(spark, sf)))
query("next_stage")(lambda spark, sf: tk.next_stage(
    tk.with_payloads(tk.pending_tickets(tickets(spark, sf)), campaigns(spark, sf))))
query("qa_gate")(lambda spark, sf: tk.qa_gate(tickets(spark, sf), qa_checks(spark, sf)))
query("row_tags")(lambda spark, sf: tk.row_tags(tickets(spark, sf), AS_OF))
query("qa_mix")(lambda spark, sf: tk.qa_mix(qa_checks(spark, sf)))
query("tracking_links")(lambda spark, sf: tk.tracking_links(campaigns(spark, sf)))
query("platform_requests")(lambda spark, sf: tk.platform_requests(
    tk.ticket_payloads(_with_payloads(spark, sf)), tickets(spark, sf)))
query("view_my_queue")(lambda spark, sf: tk.view_my_queue(tickets(spark, sf), "user_05"))
query("view_sla_dashboard")(lambda spark, sf: tk.view_sla_dashboard(tickets(spark, sf), AS_OF))
query("view_eligible")(lambda spark, sf: tk.view_eligible(tickets(spark, sf)))
query("view_engineer_backlog")(lambda spark, sf: tk.view_engineer_backlog(tickets(spark, sf)))
query("view_tickets_by_region")(lambda spark, sf: tk.view_tickets_by_region(tickets(spark, sf), campaigns(spark, sf)))
query("view_qa_gate")(lambda spark, sf: tk.view_qa_gate(tickets(spark, sf),
                                                       tk.qa_gate(tickets(spark, sf), qa_checks(spark, sf))))
query("view_campaign_calendar")(lambda spark, sf: tk.view_campaign_calendar(campaigns(spark, sf)))
query("view_release_slate")(lambda spark, sf: tk.view_release_slate(campaigns(spark, sf)))
query("view_group_counts")(lambda spark, sf: tk.view_group_counts(tickets(spark, sf), campaigns(spark, sf)))
query("assign_round_robin")(lambda spark, sf: tk.round_robin_assignments(
    tickets(spark, sf), tk.roster_from_tickets(tickets(spark, sf))))

# alert lines including QA failures
@query("alert_messages")
def _alert_messages(spark, sf):
    """H-06: one written (campaign, day) aggregate feeds the list of zero days and the performance; the rest comes from silver."""
    by_day = written_once(gold.delivery_by_campaign_day(delivery(spark, sf), AS_OF), "alert-days")
    c, t = campaigns(spark, sf), tickets(spark, sf)
    performance = gold.performance_of_totals(c, gold.totals_of_days(by_day), AS_OF)
    return hl.alert_messages(by_day, c, t, performance, tk.qa_results(tk.with_payloads(tk.pending_tickets(t), c)), AS_OF)

# -- conversions ---------------------------------------------------------------------

from pacewise.operators import conversions as cv  # noqa: E402

query("hash_pii")(lambda spark, sf: cv.hashed_events(b.conversion_events(spark, sf)))
query("conversion_payloads")(lambda spark, sf: cv.conversion_payloads(b.conversion_events(spark, sf)))
query("conversion_bodies")(lambda spark, sf: cv.body_fields(cv.conversion_bodies(cv.conversion_payloads(
    b.conversion_events(spark, sf)))))
query("conversion_dedup")(lambda spark, sf: cv.conversion_dedup(b.conversion_events(spark, sf)))
query("url_attribution")(lambda spark, sf: cv.url_attribution(b.landing_urls(spark, sf)))

# -- dashboard KPIs ------------------------------------------------------------------

from pacewise.plans import kpis as kp  # noqa: E402

query("dashboard_kpis")(lambda spark, sf: kp.dashboard_kpis(kp.performance_frame(delivery(spark, sf),
                                                                                 campaigns(spark, sf))))
query("dashboard_kpis_filtered")(lambda spark, sf: kp.dashboard_kpis(kp.performance_frame(
    delivery(spark, sf), campaigns(spark, sf), segment="AUTOMOBILE", channel="Social")))
query("spend_by_segment")(lambda spark, sf: kp.spend_by_segment(kp.performance_frame(delivery(spark, sf),
                                                                                     campaigns(spark, sf))))
query("tickets_by_status")(lambda spark, sf: kp.tickets_by_status(tickets(spark, sf)))
query("recent_jobs")(lambda spark, sf: kp.recent_jobs(tickets(spark, sf)))
query("load_summary")(lambda spark, sf: kp.load_summary(campaigns(spark, sf), tickets(spark, sf),
                                                        delivery(spark, sf), qa_checks(spark, sf)))

# -- sources, sinks, history, streaming ------------------------------------------------

from pacewise.plans import maintenance as mt  # noqa: E402

query("read_csv_by_name")(mt.read_csv_by_name_job)
query("csv_header_report")(mt.csv_header_report_job)
query("read_csv_inferred")(mt.read_csv_inferred_job)
query("bronze_stamp")(mt.bronze_stamp_job)
query("sink_overwrite")(mt.sink_overwrite_job)
query("sink_append")(mt.sink_append_job)
query("sink_partitioned")(mt.sink_partitioned_job)
query("bulk_load_once")(mt.bulk_load_once_job)
query("ingest_manifest")(mt.ingest_manifest_job)
query("schema_evolve")(mt.schema_evolve_job)
query("create_bronze_tables")(mt.create_bronze_tables_job)
query("compact_cluster")(mt.compact_cluster_job)
query("as_of_snapshot")(mt.as_of_snapshot_job)
query("batch_history")(mt.batch_history_job)
query("scd2_campaign_status")(mt.scd2_campaign_status)
query("scd2_merged_batches")(mt.scd2_merged_job)
query("active_by_day")(mt.active_by_day_job)
query("delivery_by_status_then")(mt.delivery_by_status_then_job)
query("active_on_date")(lambda spark, sf: mt.active_on_date(spark, sf))
query("stream_ingest")(mt.stream_ingest_job)
query("stream_ingest_csv")(mt.stream_ingest_csv_job)
query("stream_ingest_incremental")(mt.stream_ingest_incremental_job)
query("stream_delivery_refresh")(mt.stream_delivery_refresh_job)
query("stream_conversion_dedup")(mt.stream_conversion_dedup_job)
query("stream_evolving_csv")(mt.stream_evolving_job)
query("stream_schema_log")(mt.schema_log_job)
query("expect_audited")(mt.expect_audited_job)
query("expect_published")(mt.expect_published_job)
query("published_lookup")(mt.lookup_job)


@query("pacing_lookup")
def _pacing_lookup(spark, sf):
    """S-17: parameterised point lookup in the written pacing table (named parameter, no string splicing).

    The table is sorted by campaign, so the lookup's filter skips by the files' statistics.
    """
    p = performance(spark, sf)
    pacing = written_once(p.repartitionByRange("campaign_id").sortWithinPartitions("campaign_id"), "gold-performance")
    return spark.sql(
        "SELECT campaign_id, campaign_name, status, delivery_pct, time_elapsed_pct, pacing_status, pacing_ratio "
        "FROM {pacing} WHERE campaign_id = :campaign_id",
        args={"campaign_id": "CMP-0000007"}, pacing=pacing)

# -- conformance, QA log, pipeline composition ---------------------------------------

from pacewise.operators import conform as cf  # noqa: E402
from pacewise.plans import pipeline as pl  # noqa: E402

query("standardize_platform")(lambda spark, sf: clean.standardize_platform(b.campaigns_bronze(spark, sf)))
query("conform_campaigns")(lambda spark, sf: cf.conform_campaigns(campaigns(spark, sf), cf.markets_dim(spark, sf)))
query("orphan_keys")(lambda spark, sf: cf.orphan_keys(campaigns(spark, sf), delivery(spark, sf), tickets(spark, sf),
                                                      cf.markets_dim(spark, sf)))


@query("link_report")
def _link_report(spark, sf):
    c, t = campaigns(spark, sf), tickets(spark, sf)
    return cf.link_report([
        ("campaigns", "brand_code", c, cf.brands_dim(spark, sf)), ("campaigns", "title_id", c, cf.titles_dim(spark)),
        ("campaigns", "channel", c, cf.channels_dim(spark)), ("campaigns", "targeting_geo", c, cf.markets_dim(spark, sf).select("market_code")),
        ("tickets", "campaign_id", t, c.select("campaign_id")), ("tickets", "request_type", t, b.ticket_types_dim(spark).select("type")),
        ("tickets", "assignee", t, cf.users_dim(spark)), ("qa_checks", "ticket_id", qa_checks(spark, sf), t.select("ticket_id"))])


@query("qa_log_append")
def _qa_log_append(spark, sf):
    """T-16: QA rows appended to the QA log, one append per processing run (here: pending, then the rest)."""
    path = scratch_path(spark, "qa-log")
    w = _with_payloads(spark, sf)
    pending = (F.col("stage") == "Trafficking") & F.col("assignee").isNotNull() & (F.col("assignee") != "")
    tk.qa_results(w.where(pending)).write.mode("append").parquet(path)
    tk.qa_results(w.where(~pending | pending.isNull())).write.mode("append").parquet(path)
    return spark.read.parquet(path)


@query("daily_pipeline")
def _daily_pipeline(spark, sf):
    return pl.layer_counts(pl.run_daily(spark, sf, scratch_path(spark, "daily-run")))


query("hourly_refresh")(mt.hourly_refresh_job)


def materialize_silver(spark, sf, tables=("campaigns", "delivery", "tickets", "qa_checks")) -> dict[str, DataFrame]:
    """Silver tables written once under the shared checkpoint folder, by name, to build reports on.

    For sessions that run many reports: ``gold.*``, ``analytics.*`` and the
    ticket operators take these frames and start from the written tables
    (lineage cut, no repeated dedup). Registered queries never read them.
    """
    builders = {"campaigns": campaigns, "delivery": delivery, "tickets": tickets, "qa_checks": qa_checks}
    return {t: written_once(builders[t](spark, sf), f"silver-{t}") for t in tables}
