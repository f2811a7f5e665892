"""Data-quality rule registries (plain data; predicates are Spark SQL text for ``F.expr``).

Fixed values: rule names, predicates and severities must equal the original
suites for results to match. Each entry is (name, table, column, predicate, severity).
"""

from __future__ import annotations

from typing import NamedTuple


class Rule(NamedTuple):
    name: str
    table: str
    column: str
    predicate: str
    severity: str  # error | warn | info


# Quality suite checked on silver tables (15 expectations).
QUALITY_SUITE = [
    Rule("campaign_has_id", "campaigns", "campaign_id", "campaign_id IS NOT NULL", "error"),
    Rule("campaign_positive_budget", "campaigns", "budget_usd", "budget_usd > 0", "error"),
    Rule("campaign_valid_dates", "campaigns", "end_date", "end_date >= start_date", "error"),
    Rule("campaign_valid_status", "campaigns", "status",
         "status IN ('Active','Paused','Completed','Cancelled','Draft')", "warn"),
    Rule("campaign_has_goal", "campaigns", "impressions_goal", "impressions_goal > 0", "warn"),
    Rule("delivery_has_id", "delivery", "delivery_id", "delivery_id IS NOT NULL", "error"),
    Rule("delivery_non_negative_imps", "delivery", "impressions", "impressions >= 0", "error"),
    Rule("delivery_non_negative_clicks", "delivery", "clicks", "clicks >= 0", "error"),
    Rule("delivery_non_negative_spend", "delivery", "spend_usd", "spend_usd >= 0", "error"),
    Rule("delivery_valid_ctr", "delivery", "ctr", "ctr >= 0 AND ctr <= 1.0", "warn"),
    Rule("delivery_clicks_leq_imps", "delivery", "clicks", "clicks <= impressions", "warn"),
    Rule("delivery_valid_viewability", "delivery", "viewability_rate",
         "viewability_rate >= 0 AND viewability_rate <= 1.0", "warn"),
    Rule("ticket_has_id", "tickets", "ticket_id", "ticket_id IS NOT NULL", "error"),
    Rule("ticket_positive_sla", "tickets", "sla_hours", "sla_hours > 0", "error"),
    Rule("ticket_valid_urgency", "tickets", "urgency", "urgency IN ('Low','Medium','High','Critical')", "warn"),
]

# Quarantine rules checked on bronze tables (13 rules; error-level ones route rows to quarantine).
QUARANTINE_RULES = [
    Rule("budget_positive", "campaigns", "budget_usd", "budget_usd > 0", "error"),
    Rule("valid_status", "campaigns", "status", "status IN ('Active', 'Paused', 'Completed', 'Cancelled', 'Draft')",
         "error"),
    Rule("end_after_start", "campaigns", "end_date", "end_date >= start_date", "error"),
    Rule("valid_objective", "campaigns", "campaign_objective",
         "campaign_objective IN ('Acq', 'Awareness', 'Engagement', 'Retention', 'Conversion')", "warn"),
    Rule("has_impressions_goal", "campaigns", "impressions_goal", "impressions_goal > 0", "warn"),
    Rule("non_negative_impressions", "delivery", "impressions", "impressions >= 0", "error"),
    Rule("non_negative_clicks", "delivery", "clicks", "clicks >= 0", "error"),
    Rule("clicks_leq_impressions", "delivery", "clicks", "clicks <= impressions", "warn"),
    Rule("valid_ctr", "delivery", "ctr", "ctr >= 0 AND ctr <= 1.0", "warn"),
    Rule("valid_viewability", "delivery", "viewability_rate", "viewability_rate >= 0 AND viewability_rate <= 1.0",
         "warn"),
    Rule("non_negative_spend", "delivery", "spend_usd", "spend_usd >= 0", "error"),
    Rule("valid_urgency", "tickets", "urgency", "urgency IN ('Low', 'Medium', 'High', 'Critical')", "warn"),
    Rule("positive_sla", "tickets", "sla_hours", "sla_hours > 0", "error"),
]

# Declarative-pipeline expectations on the silver outputs: (name, predicate, action keep|drop|fail).
DECLARATIVE_EXPECTATIONS = {
    "campaigns": [
        ("valid_campaign_id", "campaign_id IS NOT NULL", "keep"),
        ("positive_budget", "budget_usd > 0 OR budget_usd IS NULL", "keep"),
        ("valid_dates", "end_date >= start_date", "keep"),
        ("valid_status", "status IN ('Active','Paused','Completed','Cancelled','Draft','Unknown')", "keep"),
    ],
    "delivery": [
        ("valid_delivery_id", "delivery_id IS NOT NULL", "fail"),
        ("valid_campaign_id", "campaign_id IS NOT NULL", "fail"),
        ("non_negative_impressions", "impressions >= 0", "keep"),
        ("non_negative_clicks", "clicks >= 0", "keep"),
        ("non_negative_spend", "spend_usd >= 0", "keep"),
        ("clicks_leq_impressions", "clicks <= impressions", "keep"),
        ("valid_viewability", "viewability_rate BETWEEN 0 AND 1", "keep"),
    ],
    "tickets": [
        ("valid_ticket_id", "ticket_id IS NOT NULL", "fail"),
        ("positive_sla", "sla_hours > 0", "keep"),
        ("valid_urgency", "urgency IN ('Low','Medium','High','Critical')", "keep"),
    ],
}

# Scoreboard checks per table: (check_name, predicate), counted as rows where the predicate is true.
SCOREBOARD_CHECKS = {
    "campaigns": [("budget_valid", "budget_usd > 0"), ("dates_valid", "end_date >= start_date"),
                  ("goals_set", "impressions_goal > 0")],
    "delivery": [("impressions_valid", "impressions >= 0"), ("clicks_valid", "clicks <= impressions"),
                 ("spend_valid", "spend_usd >= 0")],
    "tickets": [("sla_valid", "sla_hours > 0"), ("not_breached", "NOT is_breached"),
                ("urgency_valid", "urgency IN ('Low','Medium','High','Critical')")],
}


def rules_for(table: str, registry=QUALITY_SUITE, severity: str | None = None) -> list[Rule]:
    return [r for r in registry if r.table == table and (severity is None or r.severity == severity)]
