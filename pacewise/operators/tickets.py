"""Ticket work: queues, routing, SLA states, payload generation, automated QA, gates, views.

The original processed one ticket at a time with a lookup per ticket. Here it
is one set-based job: tickets ⟕ campaigns (one shuffle join on campaign and
salt, so a hot campaign spans tasks) → a per-ticket payload ARRAY built by CASE → payload rows by
``posexplode`` → QA results computed from the same array (at most three
elements per ticket, so no regrouping is needed) → QA rows by ``posexplode``.
"""

from __future__ import annotations

import datetime as _dt

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from pacewise.config import AS_OF
from pacewise.functions.columns import as_of_ts, rank_of
from pacewise.operators.skew import spread_join

# ---------------------------------------------------------------------------
# Fixed values (must equal the original automation for results to match).
# ---------------------------------------------------------------------------
NATIVE_CHANNELS = ["ProgNative", "ProgNativeDisplay", "ProgNativeVideo"]
V22_CHANNELS = ["ProgAudio", "ProgCTV", "ProgNative", "ProgNativeDisplay", "ProgNativeVideo"]
# Version routing, checked in order: (dsp, version, description); base platform CM360.
VERSION_ROUTES = [
    ("DV360", "V1", "CM360 x DV360"),
    ("Yahoo DSP", "V2", "CM360 x Yahoo"),
    ("YouTube", "V2.1", "CM360 x YouTube"),
    ("Amazon DSP", "V3", "CM360 x Amazon"),
]
ENGINEER_TYPES = ["Automation Bug", "Feature", "Product Bug"]
PM_TYPES = ["Login", "CM Site Request"]
ROTATION_ASSETS = ["asset_1.mp4", "asset_2.jpg"]
# Placement-name part defaults when a value is missing.
TAXONOMY_DEFAULTS = {
    "campaign_name": "UNKNOWN_CAMP", "targeting_geo": "UNKNOWN_GEO", "language": "ENG",
    "brand_code": "UNKNOWN_BRAND", "title_name": "UNKNOWN_TITLE", "campaign_objective": "Acq",
    "channel_mapped": "ProgDisplay",
}
DEFAULT_TICKET_PLATFORM = "DV360"
DEFAULT_LANDING_PAGE = "https://www.example.com"
# Native-ad components when the ticket supplies none (the headline falls back to the title).
NATIVE_DEFAULTS = {"main_image": "1200x627_default.jpg", "logo": "logo_200x200.jpg", "headline": "Original",
                   "body": "Stream now.", "call_to_action": "Sign Up Now", "caption_url": "example.com"}
QA_ISSUES = ["Fail", "Needs Review"]
# Checks in order: (text, result where the check finds something, text then).
QA_TEXTS = {
    "Spec Compliance": ("Creative matches spec.", None, None),
    "Tracking": ("Tracking tags configured.", None, None),
    "Targeting": ("Geo targeting found: ", "Fail", "Missing geo targeting."),
    "Frequency Cap": ("Frequency cap standard.", "Pass", "Frequency cap set for Sponsorship."),
    "Content Exclusions": ("Standard exclusions applied.", "Needs Review", "Sponsorship requires S&P review."),
    "Landing Page": ("Click-through URLs act recursively.", "Fail", "Non-HTTPS URL provided: "),
    "Taxonomy Validation": ("Taxonomy valid.", "Fail", "Placement name does not follow pipe-delimited convention."),
    "Floodlight Tags": ("Conversion tags correctly assigned.", None, None),
    "Privacy Compliance": ("GDPR & US_Privacy macros enforced in tags.", None, None),
}
NOTHING_TO_QA = ("Spec Compliance", "Fail", "No payloads to QA.")
# What stands in for a campaign that the ticket's id does not resolve to.
ABSENT_CAMPAIGN = {"campaign_name": "Demo Campaign", "targeting_geo": "US", "budget_usd": 1000.0}
COUNTING_METHOD = "STANDARD"


# -- routing / SLA -------------------------------------------------------------------


def route_by_rule(tickets: DataFrame) -> DataFrame:
    """T-02: role from the request type name, SLA hours from urgency and role."""
    rt, u = F.col("request_type"), F.col("urgency")
    role = (F.when(rt.isin(*ENGINEER_TYPES), F.lit("Engineer"))
            .when(rt.isin(*PM_TYPES), F.lit("Project Manager")).otherwise(F.lit("Trafficker")))
    eng = role == "Engineer"
    sla = (F.when(u == "Critical", F.least(F.when(eng, 48).otherwise(24), F.lit(4)))
           .when(u == "High", F.least(F.when(eng, 48).otherwise(24), F.lit(8)))
           .when(eng, F.lit(48)).when(role == "Project Manager", F.lit(72)).otherwise(F.lit(24)))
    return tickets.select("ticket_id", "request_type", "urgency", role.alias("routed_to_role"),
                          sla.cast("int").alias("sla_hours"))


def route_by_type(tickets: DataFrame, ticket_types: DataFrame) -> DataFrame:
    """T-03/T-04: role, SLA (capped by urgency) and eligibility from the ticket-type dimension.

    The catalogue is a fixed 23-row dimension, so the broadcast is bounded.
    Types outside the catalogue get no role/SLA and are not eligible.
    """
    tt = F.broadcast(ticket_types.select(F.col("type").alias("_type"), F.col("routed_to").alias("_role"),
                                         F.col("sla_hours").alias("_sla"), F.col("auto_eligible").alias("_elig")))
    j = tickets.select("ticket_id", "request_type", "urgency").join(tt, F.col("request_type") == F.col("_type"), "left")
    u = F.col("urgency")
    sla = (F.when(u == "Critical", F.least(F.col("_sla"), F.lit(4)))
           .when(u == "High", F.least(F.col("_sla"), F.lit(8))).otherwise(F.col("_sla")))
    return j.select("ticket_id", "request_type", "urgency", F.col("_role").alias("routed_to_role"),
                    sla.cast("int").alias("sla_hours"),
                    F.coalesce(F.col("_elig"), F.lit(False)).alias("auto_eligible"))


def sla_status_col(as_of: _dt.datetime = AS_OF) -> Column:
    """T-05: Breached after created + sla_hours, At Risk after created + 0.75 × sla_hours, else On Track."""
    created = F.col("created_date").cast("timestamp")
    now = as_of_ts(as_of)
    secs = F.col("sla_hours").cast("long") * 3600
    due = F.timestamp_seconds(F.unix_timestamp(created) + secs)
    risk = F.timestamp_seconds(F.unix_timestamp(created) + F.floor(secs * 0.75))
    return (F.when(now > due, F.lit("Breached")).when(now > risk, F.lit("At Risk")).otherwise(F.lit("On Track")))


def sla_status(tickets: DataFrame, as_of: _dt.datetime = AS_OF) -> DataFrame:
    return tickets.select("ticket_id", "created_date", "sla_hours", "stage", sla_status_col(as_of).alias("sla_status"))


def _blank(c: str) -> Column:
    return F.col(c).isNull() | (F.col(c) == "")


def ticket_queues(tickets: DataFrame, as_of: _dt.datetime = AS_OF) -> DataFrame:
    """T-01: queue memberships in one pass — an array of tags per ticket, exploded."""
    stage = F.col("stage")
    tags = F.array(
        F.when((stage == "Trafficking") & ~_blank("assignee"), F.lit("pending")),
        F.when(stage == "QA", F.lit("needs_qa")),
        F.when(F.coalesce(F.col("auto_eligible"), F.lit(False)) & (stage == "Trafficking"), F.lit("eligible")),
        F.when((sla_status_col(as_of) == "Breached") & (stage != "Completed"), F.lit("breached")),
        F.when(_blank("assignee"), F.lit("unassigned")),
    )
    return tickets.select("ticket_id", F.explode(tags).alias("queue")).where(F.col("queue").isNotNull())


def pending_tickets(tickets: DataFrame) -> DataFrame:
    return tickets.where((F.col("stage") == "Trafficking") & ~_blank("assignee"))


# -- automation version, names -----------------------------------------------------------


def automation_version(platform: Column, channel: Column) -> tuple[Column, Column]:
    """T-06: (version, description) for a platform and mapped channel."""
    ver = F.when((platform == "CM360") & channel.isin(*V22_CHANNELS), F.lit("V2.2"))
    desc = F.when((platform == "CM360") & channel.isin(*V22_CHANNELS), F.lit("Prog Audio/CTV/Native"))
    for dsp, v, d in VERSION_ROUTES:
        cond = (platform == dsp) | ((platform == "CM360") & (channel == dsp))
        ver, desc = ver.when(cond, F.lit(v)), desc.when(cond, F.lit(d))
    ver = ver.when(platform == "CM360", F.lit("V1")).otherwise(F.lit("Manual"))
    desc = desc.when(platform == "CM360", F.lit("CM360 x DV360")).otherwise(F.lit("No version - manual trafficking"))
    return ver, desc


def campaign_versions(campaigns: DataFrame) -> DataFrame:
    v, d = automation_version(F.col("platform"), F.col("channel_mapped"))
    return campaigns.select("campaign_id", "platform", "channel_mapped", v.alias("version"), d.alias("version_desc"))


def placement_name(geo_fallback: Column | None = None, brand_fallback: Column | None = None) -> Column:
    """T-08: name|geo|language|brand code|title|objective|channel, each part defaulted before joining."""
    d = TAXONOMY_DEFAULTS

    def part(c: str, fallback: Column | None = None) -> Column:
        cols = [F.col(c)] + ([fallback] if fallback is not None else []) + [F.lit(d[c])]
        return F.coalesce(*cols)

    return F.concat_ws("|", part("campaign_name"), part("targeting_geo", geo_fallback), part("language"),
                       part("brand_code", brand_fallback), part("title_name"), part("campaign_objective"),
                       part("channel_mapped"))


def campaign_name_taxonomy(campaigns: DataFrame) -> DataFrame:
    """T-09: brand code _ title _ objective _ geo _ channel."""
    return campaigns.select("campaign_id", F.concat_ws("_", "brand_code", "title_name", "campaign_objective",
                                                       "targeting_geo", "channel_mapped").alias("taxonomy_name"))


# -- payloads -----------------------------------------------------------------------------

_CAMPAIGN_COLS = ["campaign_name", "targeting_geo", "language", "brand_code", "title_name", "campaign_objective",
                  "channel_mapped", "start_date", "budget_usd", "audience_detailed", "landing_page"]


def native_components(supplied: list[str] | None = None) -> Column:
    """Native-ad components: the ticket's own (columns ``_own_<name>`` for the names in ``supplied``), else fixed
    defaults, with the campaign's title as the headline when present."""
    parts = {k: F.lit(v) for k, v in NATIVE_DEFAULTS.items()}
    parts["headline"] = F.coalesce(F.col("title_name"), F.lit(NATIVE_DEFAULTS["headline"]))
    for k in supplied or ():
        parts[k] = F.coalesce(F.col(f"_own_{k}"), parts[k])
    return F.struct(*[c.alias(k) for k, c in parts.items()])


def _payload(platform: Column, action: str, **fields) -> Column:
    cols = {"placement_name": None, "site": None, "budget": None, "targeting": None, "geo": None,
            "name": None, "start_date": None, "new_assets": None, "native_components": None, "conversion_type": None,
            "counting_method": None}
    cols.update(fields)
    typed = {"placement_name": "string", "site": "string", "budget": "double", "targeting": "string",
             "geo": "string", "name": "string", "start_date": "date", "new_assets": "array<string>",
             "native_components": ", ".join(f"{k}: string" for k in NATIVE_DEFAULTS).join(("struct<", ">")),
             "conversion_type": "string", "counting_method": "string"}
    parts = [platform.alias("platform"), F.lit(action).alias("action")]
    for k, t in typed.items():
        v = cols[k]
        parts.append((v if v is not None else F.lit(None)).cast(t).alias(k))
    return F.struct(*parts)


def with_payloads(tickets: DataFrame, campaigns: DataFrame) -> DataFrame:
    """Tickets ⟕ campaigns with a ``payloads`` array (0, 1 or 3 structs) built by request type.

    Every campaign column is passed through; a missing or NULL part of the
    placement name falls back to the ticket's value where it has one, then to
    a fixed default. A campaign id that resolves to no campaign gets the
    values of ABSENT_CAMPAIGN, and a missing budget is 0. Native components
    that the tickets carry as columns win over the defaults.
    """
    supplied = [k for k in NATIVE_DEFAULTS if k in tickets.columns]
    t = tickets.select("ticket_id", "campaign_id", "request_type", "platform", "stage", "assignee",
                       F.col("targeting_geo").alias("ticket_geo"), F.col("brand").alias("ticket_brand"),
                       *[F.col(k).alias(f"_own_{k}") for k in supplied])
    known = campaigns.select("campaign_id", *_CAMPAIGN_COLS, F.lit(True).alias("_known"))
    t = spread_join(t, known, "campaign_id", "ticket_id")
    t = t.withColumns({c: F.when(F.col("_known"), F.col(c)).otherwise(F.lit(v)) for c, v in ABSENT_CAMPAIGN.items()}).drop("_known")
    rt = F.coalesce(F.col("request_type"), F.lit(""))
    plat = F.coalesce(F.col("platform"), F.lit(DEFAULT_TICKET_PLATFORM))
    channel = F.coalesce(F.col("channel_mapped"), F.lit(TAXONOMY_DEFAULTS["channel_mapped"]))
    name = placement_name(F.col("ticket_geo"), F.col("ticket_brand"))
    cm, budget = F.lit("CM360"), F.coalesce(F.col("budget_usd"), F.lit(0.0))
    shell = _payload(cm, "CREATE_CAMPAIGN_SHELL", name=F.col("campaign_name"), start_date=F.col("start_date"))
    io = _payload(plat, "CREATE_INSERTION_ORDER", budget=budget, targeting=F.col("audience_detailed"))
    is_new = rt.contains("New Campaign") | rt.contains("New Placements")
    native = channel.isin(*NATIVE_CHANNELS)
    payloads = (
        F.when(is_new & native, F.array(
            shell, _payload(cm, "CREATE_NATIVE_PLACEMENT", placement_name=name, site=plat,
                            native_components=native_components(supplied)), io))
        .when(is_new, F.array(shell, _payload(cm, "CREATE_PLACEMENT", placement_name=name, site=plat), io))
        .when(rt.contains("Creative Rotation") | rt.contains("Retrafficking"), F.array(
            _payload(cm, "ROTATE_CREATIVES", placement_name=name,
                     new_assets=F.array(*[F.lit(a) for a in ROTATION_ASSETS]))))
        .when(rt == "Budget Change", F.array(_payload(plat, "UPDATE_BUDGET", budget=budget)))
        .when(rt == "New Line Item", F.array(_payload(plat, "CREATE_LINE_ITEM", targeting=F.col("audience_detailed"))))
        .when(rt == "Targeting Update", F.array(_payload(plat, "UPDATE_TARGETING", targeting=F.col("audience_detailed"),
                                                         geo=F.col("targeting_geo"))))
        .when((rt == "Site Tagging") | (rt == "Kochava"), F.array(
            _payload(cm, "CREATE_FLOODLIGHT_TAG", conversion_type=F.lit("Subscription"),
                                                              counting_method=F.lit(COUNTING_METHOD))))
    )
    empty = F.filter(F.array(_payload(cm, "NONE")), lambda x: F.lit(False))
    return t.withColumn("payloads", F.coalesce(payloads, empty)).withColumn("_geo_for_qa", F.col("targeting_geo"))


def ticket_payloads(with_p: DataFrame) -> DataFrame:
    """T-07: one row per payload (ticket, position, platform, action, fields), status Pending."""
    x = with_p.select("ticket_id", "campaign_id", F.posexplode("payloads").alias("position", "p"))
    return x.select("ticket_id", "position", "campaign_id", "p.platform", "p.action", "p.placement_name", "p.site",
                    "p.budget", "p.targeting", "p.geo", "p.conversion_type", "p.counting_method", F.lit("Pending").alias("status"))


def payload_json(with_p: DataFrame) -> DataFrame:
    """Payload bodies as JSON text (free-form dictionaries of the original), one row per payload."""
    x = with_p.select("ticket_id", F.posexplode("payloads").alias("position", "p"))
    return x.select("ticket_id", "position", "p.action", F.to_json(F.col("p")).alias("payload"))


def payload_fields(bodies: DataFrame) -> DataFrame:
    """The scalar fields of payload bodies (``payload_json``), read back from their text."""
    field = lambda name: F.get_json_object("payload", f"$.{name}")
    return bodies.select("ticket_id", "position", "action", field("platform").alias("platform"), field("placement_name").alias("placement_name"),
                         field("budget").cast("double").alias("budget"), field("counting_method").alias("counting_method"),
                         field("native_components.headline").alias("headline"), field("new_assets[0]").alias("first_asset"))


def _is_sponsorship(name: Column) -> Column:
    n = F.coalesce(name, F.lit(""))
    return n.contains("BES") | n.contains("Sponsorship")


def _qa(check: str, result: Column, details: Column) -> Column:
    return F.struct(F.lit(check).alias("check_name"), result.alias("result"), details.alias("details"))


def qa_results_array(check_native_placements: bool = False) -> Column:
    """T-10: nine checks (or one Fail when there are no payloads), computed from ``payloads``."""
    pay = F.col("payloads")
    geo = F.col("_geo_for_qa")
    sponsor = _is_sponsorship(F.col("campaign_name"))
    url = F.coalesce(F.col("landing_page"), F.lit(DEFAULT_LANDING_PAGE))
    actions = ["CREATE_PLACEMENT"] + (["CREATE_NATIVE_PLACEMENT"] if check_native_placements else [])
    placements = F.filter(pay, lambda p: p["action"].isin(*actions))
    bad_tax = F.exists(placements, lambda p: (
        F.size(F.split(F.coalesce(p["placement_name"], F.lit("")), r"\|", -1)) - 1) < 6)
    # Where a check finds something, and what its text names.
    found = {"Targeting": geo.isNull() | (geo == ""), "Frequency Cap": sponsor, "Content Exclusions": sponsor,
             "Landing Page": ~url.startswith("https://"), "Taxonomy Validation": bad_tax}
    named = {"Targeting": (geo, F.lit("")), "Landing Page": (F.lit(""), url)}
    checks = []
    for check, (text, finding, finding_text) in QA_TEXTS.items():
        result, details = F.lit("Pass"), F.lit(text)
        if check in found:
            of_text, of_finding = named.get(check, (F.lit(""), F.lit("")))
            result = F.when(found[check], F.lit(finding)).otherwise(result)
            details = F.when(found[check], F.concat(F.lit(finding_text), of_finding)).otherwise(F.concat(details, of_text))
        checks.append(_qa(check, result, details))
    none = F.array(_qa(*(F.lit(x) if k else x for k, x in enumerate(NOTHING_TO_QA))))
    return F.when(F.size(pay) > 0, F.array(*checks)).otherwise(none)


def qa_results(with_p: DataFrame, check_native_placements: bool = False) -> DataFrame:
    """T-10/T-16: one QA row per check per ticket."""
    x = with_p.select("ticket_id", "assignee", F.posexplode(qa_results_array(check_native_placements))
                      .alias("check_order", "q"))
    return x.select("ticket_id", "assignee", "check_order", F.col("q.check_name").alias("check_name"),
                    F.col("q.result").alias("result"), F.col("q.details").alias("details"))


def next_stage(with_p: DataFrame) -> DataFrame:
    """T-11: any Fail / Needs Review → QA, else Ready to Launch (a pure function of the QA results)."""
    qa = qa_results_array()
    issues = F.filter(qa, lambda q: q["result"].isin(*QA_ISSUES))
    return with_p.select("ticket_id", "stage", F.size(issues).alias("qa_issues"),
                         F.when(F.size(issues) > 0, F.lit("QA")).otherwise(F.lit("Ready to Launch"))
                         .alias("next_stage"))


def qa_gate(tickets: DataFrame, qa_log: DataFrame) -> DataFrame:
    """T-12: tickets in Ready to Launch / QA whose logged QA has a Fail or Needs Review are blocked;
    a blocked Ready to Launch ticket reverts to QA. The QA log is reduced per ticket (partial aggregate)
    before the join."""
    issues = qa_log.groupBy("ticket_id").agg(
        F.max(F.when(F.col("result").isin(*QA_ISSUES), 1).otherwise(0)).alias("_issue"))
    t = tickets.where(F.col("stage").isin("Ready to Launch", "QA")).select("ticket_id", "stage", "assignee")
    j = t.join(issues, "ticket_id", "left")
    blocked = F.coalesce(F.col("_issue"), F.lit(0)) == 1
    return j.select("ticket_id", "stage", "assignee",
                    F.when(blocked, F.lit("BLOCKED - QA Issues")).otherwise(F.lit("")).alias("needs_qa"),
                    F.when(blocked & (F.col("stage") == "Ready to Launch"), F.lit("QA"))
                    .otherwise(F.col("stage")).alias("new_stage"))


def row_tags(tickets: DataFrame, as_of: _dt.datetime = AS_OF) -> DataFrame:
    """T-14: first matching colour rule per ticket."""
    s = sla_status_col(as_of)
    tag = (F.when(s == "Breached", F.lit("red")).when(s == "At Risk", F.lit("orange"))
           .when(F.col("stage") == "Blocked", F.lit("gray"))
           .when(F.coalesce(F.col("auto_eligible"), F.lit(False)) & (F.col("stage") == "Trafficking"), F.lit("purple"))
           .when(_blank("assignee"), F.lit("yellow")))
    return tickets.select("ticket_id", s.alias("sla_status"), "stage", tag.alias("row_color"))


def qa_mix(qa_log: DataFrame) -> DataFrame:
    """T-15: pass / fail / needs-review counts per check."""
    r = F.col("result")
    return qa_log.groupBy("check_name").agg(
        F.count(F.lit(1)).alias("total"),
        F.sum(F.when(r == "Pass", 1).otherwise(0)).cast("long").alias("passed"),
        F.sum(F.when(r == "Fail", 1).otherwise(0)).cast("long").alias("failed"),
        F.sum(F.when(r == "Needs Review", 1).otherwise(0)).cast("long").alias("needs_review"),
    )


# -- tracking links, platform requests --------------------------------------------------------

# Device classes → (tracker type, destination) and the privacy macro suffix.
DEVICES = [
    ("Mobile", "acquisition", "https://apps.example.com/app"),
    ("CTV", "ctv_acquisition", "https://ctv.example.com/app"),
    ("Samsung Tizen", "ctv_acquisition", "https://tv.example.com/app"),
]
PRIVACY_MACROS = "&gdpr=${GDPR}&gdpr_consent=${GDPR_CONSENT_78}&us_privacy=${US_PRIVACY}"


def tracking_links(campaigns: DataFrame) -> DataFrame:
    """T-17: one tracker per campaign and device class (a fixed 3-way fan-out by explode, not a join)."""
    dev = F.array(*[F.struct(F.lit(d).alias("device"), F.lit(t).alias("type"), F.lit(u).alias("dest"))
                    for d, t, u in DEVICES])
    x = campaigns.select("campaign_id", "campaign_name", "platform", F.explode(dev).alias("d"))
    network = F.coalesce(F.col("platform"), F.lit("Unknown"))
    dev_code = F.regexp_replace(F.col("d.device"), " ", "")
    tracker_id = F.concat(F.lit("TRK-"), F.col("campaign_id"), F.lit("-"), dev_code)
    site = F.concat(F.lit("SITE-"), F.upper(F.regexp_replace(network, " ", "")))
    return x.select(
        "campaign_id", F.col("d.device").alias("device_type"), network.alias("network_name"),
        F.concat_ws("_", F.coalesce("campaign_name", F.lit("")), network, dev_code, F.lit("Tracker")).alias("tracker_name"),
        F.col("d.type").alias("tracker_type"), F.col("d.dest").alias("destination_url"),
        F.concat(F.lit("https://click.example.com/"), tracker_id, F.lit("?site_id="), site, F.lit(PRIVACY_MACROS))
        .alias("click_url"),
        F.concat(F.lit("https://imp.example.com/track/impression?tracker_id="), tracker_id, F.lit("&site_id="), site,
                 F.lit(PRIVACY_MACROS)).alias("impression_url"),
    )


def platform_requests(payloads: DataFrame, tickets: DataFrame) -> DataFrame:
    """T-18: request rows for new-campaign insertion orders on Meta / TikTok.

    Meta: daily budget in cents (int(budget × 100)); TikTok: campaign budget
    max(int(budget), 50) and ad-group budget max(int(budget), 20).
    """
    new = tickets.where(F.col("request_type").contains("New Campaign")).select("ticket_id")
    io = payloads.where((F.col("action") == "CREATE_INSERTION_ORDER") & F.col("platform").isin("Meta", "TikTok"))
    j = io.join(new, "ticket_id", "left_semi")
    b = F.coalesce(F.col("budget"), F.lit(0.0))
    reqs = (F.when(F.col("platform") == "Meta", F.array(
        F.struct(F.lit("campaign").alias("kind"), (b * 100).cast("long").alias("budget_value"))))
        .otherwise(F.array(
            F.struct(F.lit("campaign").alias("kind"), F.greatest(b.cast("long"), F.lit(50).cast("long")).alias("budget_value")),
            F.struct(F.lit("adgroup").alias("kind"), F.greatest(b.cast("long"), F.lit(20).cast("long")).alias("budget_value")))))
    return j.select("ticket_id", "platform", F.explode(reqs).alias("r")).select(
        "ticket_id", "platform", F.col("r.kind").alias("request_kind"), F.col("r.budget_value").alias("budget_value"))


# -- saved views ---------------------------------------------------------------------------------

URGENCY_ORDER = ["Critical", "High", "Medium", "Low"]


def view_my_queue(tickets: DataFrame, assignee: str) -> DataFrame:
    return tickets.where((F.col("assignee") == assignee) & (F.col("stage") != "Completed")).select(
        "ticket_id", "assignee", "stage", "urgency", "due_date").orderBy(F.col("due_date").asc_nulls_last(), "ticket_id")


def view_sla_dashboard(tickets: DataFrame, as_of: _dt.datetime = AS_OF) -> DataFrame:
    s = sla_status_col(as_of)
    return tickets.select("ticket_id", "urgency", "stage", s.alias("sla_status")).where(
        F.col("sla_status").isin("Breached", "At Risk")).orderBy(rank_of("urgency", URGENCY_ORDER, 5), "ticket_id")


def view_eligible(tickets: DataFrame) -> DataFrame:
    return tickets.where(F.coalesce(F.col("auto_eligible"), F.lit(False)) & (F.col("stage") == "Trafficking")).select(
        "ticket_id", "request_type", "created_date").orderBy("created_date", "ticket_id")


def view_engineer_backlog(tickets: DataFrame) -> DataFrame:
    return tickets.where((F.col("routed_to_role") == "Engineer") & (F.col("stage") != "Completed")).select(
        "ticket_id", "request_type", "urgency", "due_date").orderBy(
        rank_of("urgency", URGENCY_ORDER, 5), F.col("due_date").asc_nulls_last(), "ticket_id")


def view_tickets_by_region(tickets: DataFrame, campaigns: DataFrame) -> DataFrame:
    """Region is a lookup through the ticket's campaign (left join; counts per region)."""
    per_campaign = tickets.groupBy("campaign_id").agg(F.count(F.lit(1)).alias("n"))
    j = per_campaign.join(campaigns.select("campaign_id", "region"), "campaign_id", "left")
    return j.groupBy("region").agg(F.sum("n").alias("tickets"))


def view_qa_gate(tickets: DataFrame, gate: DataFrame) -> DataFrame:
    g = gate.select("ticket_id", "needs_qa")
    j = tickets.select("ticket_id", "stage", "urgency").join(g, "ticket_id", "left")
    return j.where((F.col("stage") == "QA") | (F.coalesce(F.col("needs_qa"), F.lit("")) != "")).orderBy(
        rank_of("urgency", URGENCY_ORDER, 5), "ticket_id")


def view_campaign_calendar(campaigns: DataFrame) -> DataFrame:
    return campaigns.select("campaign_id", "campaign_name", "start_date", "end_date").orderBy(
        F.col("start_date").asc_nulls_last(), "campaign_id")


def titles_from_campaigns(campaigns: DataFrame) -> DataFrame:
    """Titles re-derived from campaigns: one row per title, release date = first campaign start."""
    return campaigns.groupBy("title_id").agg(F.min("title_name").alias("title_name"),
                                             F.min("brand_code").alias("brand_code"),
                                             F.min("start_date").alias("release_date"))


def view_release_slate(campaigns: DataFrame) -> DataFrame:
    return titles_from_campaigns(campaigns).orderBy(F.col("release_date").asc_nulls_last(), "title_id")


def view_group_counts(tickets: DataFrame, campaigns: DataFrame) -> DataFrame:
    """Kanban by stage, tickets by platform, campaigns by region+channel and by brand code, as (view, group, n)."""
    parts = [
        tickets.groupBy(F.col("stage").alias("g")).count().select(F.lit("kanban_by_stage").alias("view_name"), "g", "count"),
        tickets.groupBy(F.col("platform").alias("g")).count().select(F.lit("tickets_by_platform").alias("view_name"), "g", "count"),
        campaigns.groupBy(F.concat_ws(" / ", "region", "channel").alias("g")).count().select(
            F.lit("global_campaigns").alias("view_name"), "g", "count"),
        campaigns.groupBy(F.col("brand_code").alias("g")).count().select(
            F.lit("brand_performance").alias("view_name"), "g", "count"),
    ]
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    return out.select("view_name", F.col("g").alias("group_key"), F.col("count").alias("row_count"))


def round_robin_assignments(tickets: DataFrame, roster: DataFrame) -> DataFrame:
    """W-05: unassigned tickets dealt round-robin to the members of their routed role, by ticket id."""
    from pacewise.operators.dedup import assign_round_robin

    work = tickets.where(_blank("assignee")).select("ticket_id", "routed_to_role")
    return assign_round_robin(work, roster, "routed_to_role", ["ticket_id"])


def roster_from_tickets(tickets: DataFrame) -> DataFrame:
    """Roster (role, member) = distinct non-empty assignees per role seen in the tickets."""
    return tickets.where(~_blank("assignee") & F.col("assignee_role").isNotNull()).select(
        F.col("assignee_role").alias("role"), F.col("assignee").alias("member")).distinct()
