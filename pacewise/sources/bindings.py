"""Bindings: the given TPC-H-style tables re-read as advertising-operations frames.

Each function is a projection (plus, for delivery, one equi-join) over the
given tables, so its work grows with them. List lookups are ``element_at`` on
literal arrays — no joins, no Python per row. The exact rules are documented
in FIXTURES.md §2; the DuckDB oracle (``pacewise.oracle``) states them again
independently in SQL.
"""

from __future__ import annotations

import datetime as _dt

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from pacewise.sources.tables import scan

# ---------------------------------------------------------------------------
# Fixed values (must equal the original data model for results to match).
# Ticket catalogue, in catalogue order: (type, routed_to, sla_hours, auto_eligible)
# ---------------------------------------------------------------------------
TICKET_TYPES = [
    ("New Campaign", "Trafficker", 24, True),
    ("New Placements", "Trafficker", 24, True),
    ("Creative Rotation", "Trafficker", 8, True),
    ("Retrafficking", "Trafficker", 24, True),
    ("URL Change", "Trafficker", 8, False),
    ("Placement Name Change", "Trafficker", 8, False),
    ("Discrepancy Investigation", "Trafficker", 48, False),
    ("Site Tagging", "Trafficker", 24, False),
    ("Kochava", "Trafficker", 24, False),
    ("Automation Bug Request", "Engineer", 48, False),
    ("Automation Feature Request", "Engineer", 72, False),
    ("Product Bug Fix", "Engineer", 24, False),
    ("New Entity Launch QA", "Trafficker", 48, False),
    ("Conversion Tagging QA", "Trafficker", 24, False),
    ("MLP QA", "Trafficker", 24, False),
    ("Login Request", "Project Manager", 72, False),
    ("CM Site Request", "Project Manager", 72, False),
    ("Training/Onboarding", "Trafficker", 72, False),
    ("Prisma Mapping Request", "Trafficker", 48, False),
    ("2ND GEAR New Campaign", "Trafficker", 24, True),
    ("2ND GEAR New Placements", "Trafficker", 24, True),
    ("2ND GEAR Creative Rotation", "Trafficker", 8, True),
    ("Other Request", "Trafficker", 48, False),
]
# Request types handled by the payload builder but absent from the catalogue.
HANDLER_ONLY_TYPES = [
    ("Budget Change", "Trafficker", 24, False),
    ("New Line Item", "Trafficker", 24, False),
    ("Targeting Update", "Trafficker", 24, False),
]
BINDING_TICKET_TYPES = TICKET_TYPES + HANDLER_ONLY_TYPES

# QA check catalogue: (check_name, check_details)
QA_CHECK_CATALOGUE = [
    ("Spec Compliance", "Creative matches size/duration/format spec"),
    ("Tracking", "All tags fire correctly on click and view events"),
    ("Targeting", "Geo/demo/device/content targeting verified"),
    ("Landing Page", "Click-through URL resolves and matches IO"),
    ("Frequency Cap", "Frequency cap set per flight requirements"),
    ("Content Exclusions", "Rating exclusions and genre blocks applied"),
    ("Taxonomy Validation", "Placement name follows taxonomy convention"),
    ("Floodlight Tags", "Conversion tags configured and firing"),
]

# Binding lists (FIXTURES.md §2), in index order. Rules name these objectives, channels, platforms,
# statuses, languages, stages and publishers.
NAMED_OBJECTIVES = ["Acq", "Awareness", "Engagement"]
CHANNELS_MAPPED = ["ProgDisplay", "ProgVideo", "ProgNative", "ProgCTV", "ProgAudio", "Social", "Search", "YouTube"]
CHANNELS = ["display", "video", "native", "ctv", "audio", "social", "search", "youtube"]
RAW_PLATFORMS = ["meta", "FACEBOOK", " Instagram ", "tiktok", "CM360", "dcm", "Campaign Manager", "dv360",
                 "amazon", "snap", "Yahoo DSP", " Spotify"]
STATUSES_B1 = ["Active", "Active", "Active", "Active", "Active", " Active ", "Paused", "Completed",
               "Pending Launch", "Draft"]
LANGUAGES = [" eng", "spa", "fra ", "deu", "por"]
STAGES = ["New", "In Review", "Trafficking", "QA", "Ready to Launch", "Live", "Completed", "Blocked",
          "Pending", "In Progress"]
PUBLISHERS = ["meta", "TikTok", "snapchat", "pinterest"]
# Invented values: no rule reads them.
REQUESTERS = ["Harbor Desk", "North Studio", "Quartz Team", "Field Office", "Orchard Group", "River Unit"]

CAMPAIGN_BATCHES = [
    ("b1", _dt.datetime(1999, 1, 1), "campaigns_b1.csv"),
    ("b2", _dt.datetime(1999, 6, 1), "campaigns_b2.csv"),
]
TICKET_BATCH = ("t1", _dt.datetime(1999, 6, 30, 6, 0, 0), "tickets_t1.csv")
QA_BATCH = ("q1", _dt.datetime(1999, 6, 30, 6, 0, 0), "qa_checks_q1.csv")
CREATED_OVERRIDE = _dt.datetime(1999, 6, 30, 2, 0, 0)


def pick(values: list, index: Column) -> Column:
    """values[index] for a 0-based integer index column."""
    return F.element_at(F.array(*[F.lit(v) for v in values]), (index % len(values)).cast("int") + 1)


def numbered(kind: str, index: Column, kinds: int) -> Column:
    """One of ``kinds`` values that no rule names, such as ``objective-3``."""
    return F.concat(F.lit(f"{kind}-"), (index % kinds).cast("string"))


def padded(key: Column, width: int = 7) -> Column:
    """The number in at least ``width`` digits; longer ones stay whole (``lpad`` alone would cut them)."""
    text = key.cast("string")
    return F.when(F.length(text) < width, F.lpad(text, width, "0")).otherwise(text)


def campaign_key(custkey: Column) -> Column:
    return F.concat(F.lit("CMP-"), padded(custkey))


def campaigns_bronze(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Bronze campaigns: batch b1 for every customer, batch b2 (status Paused) for k % 8 = 0.

    nation (25 rows) and region (5 rows) are fixed-size TPC-H dimensions, so
    broadcasting them is bounded. The second batch is a generator (explode)
    over one scan, not a second scan.
    """
    cust = scan(spark, sf_dir, "customer", "c_custkey", "c_name", "c_nationkey", "c_acctbal", "c_mktsegment")
    geo = (
        scan(spark, sf_dir, "nation", "n_nationkey", "n_name", "n_regionkey")
        .join(scan(spark, sf_dir, "region", "r_regionkey", "r_name"), F.col("n_regionkey") == F.col("r_regionkey"))
        .select("n_nationkey", "n_name", "n_regionkey", "r_name")
    )
    k = F.col("c_custkey")
    batches = F.when(k % 8 == 0, F.array(F.lit(1), F.lit(2))).otherwise(F.array(F.lit(1)))
    base = cust.join(F.broadcast(geo), F.col("c_nationkey") == F.col("n_nationkey"), "left").withColumn(
        "_b", F.explode(batches)
    )
    start = F.date_add(F.lit(_dt.date(1997, 1, 1)), ((k * 37) % 1100).cast("int"))
    prefix = F.when(k % 25 == 0, F.lit("SPX_Sponsorship_")).when(k % 25 == 1, F.lit("BES_")).otherwise(F.lit(""))
    b2 = F.col("_b") == 2
    return base.select(
        campaign_key(k).alias("campaign_id"),
        F.concat(F.lit("TTL-"), (k % 40).cast("string")).alias("title_id"),
        F.concat(F.lit("Title "), (k % 40).cast("string")).alias("title_name"),
        F.concat(F.lit(" "), F.col("c_mktsegment"), F.lit(" ")).alias("brand"),
        F.lower(F.substring("c_mktsegment", 1, 3)).alias("brand_code"),
        F.col("c_mktsegment").alias("segment"),
        F.concat(F.lower(F.col("c_mktsegment")), F.lit("_plus ")).alias("product"),
        F.concat(prefix, F.col("c_name")).alias("campaign_name"),
        F.when(k % 7 < 3, pick(NAMED_OBJECTIVES, k % 7)).otherwise(numbered("objective", k, 7)).alias("campaign_objective"),
        F.when(k % 31 != 0, F.lower(F.col("n_name"))).alias("targeting_geo"),
        F.col("n_name").alias("country"),
        pick(LANGUAGES, k).alias("language"),
        F.concat(F.lit("CL-"), F.col("n_regionkey").cast("string")).alias("geo_cluster"),
        F.col("r_name").alias("region"),
        pick(CHANNELS, k).alias("channel"),
        pick(CHANNELS_MAPPED, k).alias("channel_mapped"),
        pick(RAW_PLATFORMS, k).alias("platform"),
        (F.col("c_acctbal") * F.lit(400)).cast("double").alias("budget_usd"),
        start.alias("start_date"),
        F.date_add(start, (((k * 53) % 1500) - 20).cast("int")).alias("end_date"),
        F.when(b2, F.lit("Paused")).otherwise(pick(STATUSES_B1, k)).alias("status"),
        F.when(k % 17 == 0, F.lit(0)).otherwise(F.lit(100) + (k * 7919) % 2500).cast("int").alias("impressions_goal"),
        (F.lit(1) + k % 3).cast("int").alias("flight_priority"),
        numbered("tactic", k, 2).alias("audience_tactic"),
        numbered("strategy", k, 3).alias("audience_strategy"),
        numbered("audience", k, 4).alias("audience_detailed"),
        F.when(k % 9 == 0, F.concat(F.lit("http://www.example.com/c/"), k.cast("string")))
        .when(k % 9 == 1, F.lit(None).cast("string"))
        .otherwise(F.concat(F.lit("https://www.example.com/c/"), k.cast("string")))
        .alias("landing_page"),
        F.when(b2, F.lit(CAMPAIGN_BATCHES[1][1])).otherwise(F.lit(CAMPAIGN_BATCHES[0][1])).cast("timestamp").alias("_ingested_at"),
        F.when(b2, F.lit(CAMPAIGN_BATCHES[1][2])).otherwise(F.lit(CAMPAIGN_BATCHES[0][2])).alias("_source_file"),
        F.when(b2, F.lit("b2")).otherwise(F.lit("b1")).alias("_batch_id"),
    )


def delivery_bronze(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Bronze delivery: lineitem ⋈ orders (both large: shuffle join on the order key).

    delivery_id repeats naturally; l_partkey and l_suppkey are carried as the
    dedup tie-break so the "latest row per key" choice is total.
    """
    li = scan(spark, sf_dir, "lineitem", "l_orderkey", "l_linenumber", "l_partkey", "l_suppkey", "l_quantity",
              "l_extendedprice", "l_discount", "l_tax", "l_shipdate")
    orders = scan(spark, sf_dir, "orders", "o_orderkey", "o_custkey")
    j = li.join(orders, F.col("l_orderkey") == F.col("o_orderkey"))
    ship = F.col("l_shipdate").cast("timestamp")
    return j.select(
        F.concat(F.col("l_orderkey").cast("string"), F.lit("-"), F.col("l_linenumber").cast("string")).alias("delivery_id"),
        campaign_key(F.col("o_custkey")).alias("campaign_id"),
        ship.cast("date").alias("date"),
        (F.col("l_quantity").cast("int") - F.lit(5)).alias("impressions"),
        F.round(F.col("l_tax") * F.lit(100)).cast("int").alias("clicks"),
        F.lit(0.5).alias("ctr"),
        (F.col("l_extendedprice").cast("decimal(18,2)") - F.lit(2000).cast("decimal(18,2)")).cast("double").alias("spend_usd"),
        ((F.col("l_partkey") % 5) - 1).cast("int").alias("vast_errors"),
        (F.col("l_discount") * F.lit(12) - F.lit(0.1)).alias("viewability_rate"),
        (ship + F.expr("INTERVAL 1 DAY")).alias("_ingested_at"),
        F.lit("delivery.csv").alias("_source_file"),
        F.date_format(ship, "yyyyMMdd").alias("_batch_id"),
        F.col("l_partkey").alias("_src_partkey"),
        F.col("l_suppkey").alias("_src_suppkey"),
    )


def _ticket_frame(spark: SparkSession, sf_dir: str) -> DataFrame:
    orders = scan(spark, sf_dir, "orders", "o_orderkey", "o_custkey", "o_orderdate", "o_orderpriority")
    k = F.col("o_orderkey")
    idx = k % len(BINDING_TICKET_TYPES)
    created = F.when(k % 50 == 0, F.lit(CREATED_OVERRIDE).cast("timestamp")).otherwise(
        F.col("o_orderdate").cast("timestamp"))
    sla = F.when(k % 97 == 0, F.lit(0)).otherwise(pick([t[2] for t in BINDING_TICKET_TYPES], idx)).cast("int")
    urgency = (
        F.when(F.col("o_orderpriority") == "1-URGENT", F.lit("Critical"))
        .when(F.col("o_orderpriority") == "2-HIGH", F.lit(" High "))
        .when(F.col("o_orderpriority") == "3-MEDIUM", F.lit("Medium"))
        .when(F.col("o_orderpriority") == "5-LOW", F.lit("Low"))
        .otherwise(F.lit("N/S"))
    )
    m = k % 13
    assignee = (
        F.when(m == 0, F.lit(None).cast("string"))
        .when(m == 1, F.lit(""))
        .otherwise(F.concat(F.lit("user_"), F.lpad(m.cast("string"), 2, "0")))
    )
    request_type = pick([t[0] for t in BINDING_TICKET_TYPES], idx)
    role = pick([t[1] for t in BINDING_TICKET_TYPES], idx)
    return orders.select(
        k.alias("_k"),
        F.concat(F.lit("TKT-"), padded(k)).alias("ticket_id"),
        campaign_key(F.col("o_custkey")).alias("campaign_id"),
        F.concat(request_type, F.lit(" - "), campaign_key(F.col("o_custkey"))).alias("title"),
        request_type.alias("request_type"),
        role.alias("routed_to_role"),
        pick([t[3] for t in BINDING_TICKET_TYPES], idx).alias("auto_eligible"),
        urgency.alias("urgency"),
        pick(STAGES, F.floor(k / 26)).alias("stage"),
        pick(RAW_PLATFORMS, k).alias("platform"),
        F.concat(F.lit("nation_"), (k % 25).cast("string")).alias("targeting_geo"),
        F.concat(F.lit(" brand_"), (k % 5).cast("string"), F.lit(" ")).alias("brand"),
        pick(REQUESTERS, k).alias("requested_by"),
        created.alias("_created"),
        created.cast("date").alias("created_date"),
        F.when(k % 101 == 0, F.lit("n/a"))
        .otherwise(F.date_format(created + F.make_dt_interval(hours=sla), "yyyy-MM-dd HH:mm"))
        .alias("due_date"),
        assignee.alias("assignee"),
        F.when(assignee.isNotNull(), role).alias("assignee_role"),
        sla.alias("sla_hours"),
        F.lit("").alias("notes"),
    )


TICKET_COLUMNS = ["ticket_id", "campaign_id", "title", "request_type", "routed_to_role", "auto_eligible", "urgency",
                  "stage", "platform", "targeting_geo", "brand", "requested_by", "created_date", "due_date",
                  "assignee", "assignee_role", "sla_hours", "notes"]


def tickets_bronze(spark: SparkSession, sf_dir: str) -> DataFrame:
    batch, ts, src = TICKET_BATCH
    return _ticket_frame(spark, sf_dir).select(
        *TICKET_COLUMNS,
        F.lit(ts).cast("timestamp").alias("_ingested_at"),
        F.lit(src).alias("_source_file"),
        F.lit(batch).alias("_batch_id"),
    )


def tickets_created(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Tickets with their creation timestamp (for the three-state SLA rule)."""
    return _ticket_frame(spark, sf_dir).select(*TICKET_COLUMNS, F.col("_created").alias("created_at"))


def qa_checks_bronze(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Logged QA checks: tickets in QA or later × check index j (0..7), kept when (k + j) % 3 != 0."""
    batch, ts, src = QA_BATCH
    t = _ticket_frame(spark, sf_dir).where(F.col("stage").isin("QA", "Ready to Launch", "Live", "Completed"))
    t = t.withColumn("_j", F.explode(F.sequence(F.lit(0), F.lit(7)))).where((F.col("_k") + F.col("_j")) % 3 != 0)
    k, j = F.col("_k"), F.col("_j")
    bucket = (k * 8 + j) % 20
    result = F.when(bucket <= 2, F.lit("Fail")).when(bucket <= 7, F.lit("Needs Review")).otherwise(F.lit("Pass"))
    return t.select(
        F.concat(F.lit("QA-"), k.cast("string"), F.lit("-"), j.cast("string")).alias("qa_id"),
        "ticket_id",
        pick([c[0] for c in QA_CHECK_CATALOGUE], j).alias("check_name"),
        pick([c[1] for c in QA_CHECK_CATALOGUE], j).alias("check_details"),
        result.alias("result"),
        F.concat(F.lit("user_"), F.lpad(((k + j) % 5 + 2).cast("string"), 2, "0")).alias("checked_by"),
        F.date_format(F.col("_created") + F.make_dt_interval(hours=j.cast("int")), "yyyy-MM-dd'T'HH:mm:ss")
        .alias("checked_at"),
        F.lit(ts).cast("timestamp").alias("_ingested_at"),
        F.lit(src).alias("_source_file"),
        F.lit(batch).alias("_batch_id"),
    )


def conversion_events(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Conversion events from ``events``: one browser copy, plus a server copy 2 minutes later when id % 3 = 0."""
    ev = scan(spark, sf_dir, "events", "event_id", "ts", "user_id", "event_type", "value")
    eid, uid = F.col("event_id"), F.col("user_id")
    copies = F.when(eid % 3 == 0, F.array(F.lit("browser"), F.lit("server"))).otherwise(F.array(F.lit("browser")))
    ev = ev.withColumn("source_channel", F.explode(copies))
    ts = F.col("ts").cast("timestamp")
    m5 = uid % 5
    return ev.select(
        pick(PUBLISHERS, uid).alias("publisher"),
        F.when(F.col("event_type") == "signup", F.lit("CompleteRegistration"))
        .when(F.col("event_type") == "purchase", F.lit("Purchase"))
        .otherwise(F.col("event_type")).alias("event_name"),
        F.concat(F.lit("evt_"), eid.cast("string")).alias("event_id"),
        F.when(F.col("source_channel") == "server", ts + F.expr("INTERVAL 2 MINUTES")).otherwise(ts).alias("event_time"),
        "source_channel",
        F.concat(F.lit(" User"), uid.cast("string"), F.lit("@Example.com ")).alias("email"),
        F.when(m5 == 0, F.lit(None).cast("string")).when(m5 == 1, F.lit(""))
        .otherwise(F.concat(F.lit("555"), padded(uid))).alias("phone"),
        F.concat(F.lit("10.0."), (uid % 250).cast("string"), F.lit("."), (eid % 250).cast("string")).alias("ip_address"),
        F.when(F.col("source_channel") == "server", F.lit("server-agent/1.0")).otherwise(F.lit("Mozilla/5.0")).alias("user_agent"),
        F.col("value").alias("value"),
        F.lit("USD").alias("currency"),
    )


def landing_urls(spark: SparkSession, sf_dir: str) -> DataFrame:
    return scan(spark, sf_dir, "pages", "page_id", "url")


def ticket_types_dim(spark: SparkSession, include_handler_types: bool = False) -> DataFrame:
    """The ticket-type catalogue as a tiny dimension (23 rows; fixed size, safe to broadcast)."""
    rows = BINDING_TICKET_TYPES if include_handler_types else TICKET_TYPES
    return spark.createDataFrame(rows, "type string, routed_to string, sla_hours int, auto_eligible boolean")
