"""Conversion events: PII hashing, publisher routing, event-id dedup, landing-URL attribution.

The original sent one HTTP request per event; here the same decisions are
column expressions over the whole event table (sending is not built).
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

# Supported publishers (lower-cased) and the body shape each one uses.
PUBLISHER_ROUTES = ["meta", "tiktok", "snapchat"]


def hash_pii(c) -> Column:
    """E-01: SHA-256 hex of the lower-cased value without white space around it; empty or missing input gives ''."""
    x = F.col(c) if isinstance(c, str) else c
    bare = F.regexp_replace(x, r"(?U)^\s+|\s+$", "")  # trim() strips spaces only
    return F.when(x.isNull() | (x == ""), F.lit("")).otherwise(F.sha2(F.lower(bare), 256))


def hashed_events(events: DataFrame) -> DataFrame:
    return events.select("publisher", "event_id", "source_channel", hash_pii("email").alias("email_hash"),
                         hash_pii("phone").alias("phone_hash"))


def conversion_payloads(events: DataFrame) -> DataFrame:
    """E-02: route by publisher to the meta / tiktok / snapchat shape; anything else is kept as rejected.

    Key fields are columns; the body is also available as JSON via ``conversion_bodies``.
    """
    pub = F.lower(F.col("publisher"))
    route = F.when(pub.isin(*PUBLISHER_ROUTES), pub).otherwise(F.lit("rejected"))
    sent = route.isin("meta", "tiktok")
    return events.select(
        "publisher", "event_id", "event_name", "source_channel",
        route.alias("route"),
        F.when(route == "rejected", F.lit("rejected")).otherwise(F.lit("accepted")).alias("status"),
        F.when(sent, hash_pii("email")).alias("email_hash"),
        F.when(sent, hash_pii("phone")).alias("phone_hash"),
        F.when(sent, F.col("ip_address")).alias("client_ip"),
        F.when(sent, F.col("user_agent")).alias("client_user_agent"),
        F.when(route == "meta", F.unix_timestamp("event_time")).alias("event_time_epoch"),
        F.when(route == "tiktok", F.date_format("event_time", "yyyy-MM-dd'T'HH:mm:ss")).alias("event_time_text"),
        F.when(route != "rejected", F.col("value")).alias("value"),
        F.when(route != "rejected", F.col("currency")).alias("currency"),
    )


def conversion_bodies(payloads: DataFrame) -> DataFrame:
    """Request bodies as JSON text for the two publishers with a server API shape."""
    meta = F.to_json(F.struct(
        F.col("event_name"), F.col("event_time_epoch").alias("event_time"), F.lit("website").alias("action_source"),
        F.col("event_id"),
        F.struct(F.array("email_hash").alias("em"), F.array("phone_hash").alias("ph"),
                 F.col("client_ip").alias("client_ip_address"), F.col("client_user_agent")).alias("user_data"),
        F.struct("value", "currency").alias("custom_data")))
    tiktok = F.to_json(F.struct(
        F.col("event_name").alias("event"), F.col("event_id"), F.col("event_time_text").alias("timestamp"),
        F.struct(F.col("client_ip").alias("ip"), F.col("client_user_agent").alias("user_agent")).alias("context"),
        F.struct(F.col("email_hash").alias("email"), F.col("phone_hash").alias("phone_number")).alias("user"),
        F.struct("value", "currency").alias("properties")))
    return payloads.where(F.col("route").isin("meta", "tiktok")).select(
        "publisher", "event_id", "source_channel", "route",
        F.when(F.col("route") == "meta", meta).otherwise(tiktok).alias("body"))


def body_fields(bodies: DataFrame) -> DataFrame:
    """The scalar fields of request bodies (``conversion_bodies``), read back from their text under either shape."""
    field = lambda *names: F.coalesce(*[F.get_json_object("body", f"$.{n}") for n in names])
    return bodies.select("publisher", "event_id", "source_channel", "route", field("event_name", "event").alias("body_event"),
                         field("user_data.em[0]", "user.email").alias("body_email_hash"),
                         field("user_data.client_ip_address", "context.ip").alias("body_ip"),
                         field("custom_data.value", "properties.value").cast("double").alias("body_value"))


def conversion_dedup(events: DataFrame) -> DataFrame:
    """E-03: one event per (publisher, event_id) — the earliest copy (browser before server on ties).

    ROW_NUMBER = 1 is planned with a partial WindowGroupLimit before the
    shuffle, so duplicated ids never pile up in one reducer.
    """
    w = Window.partitionBy("publisher", "event_id").orderBy(F.col("event_time").asc(), F.col("source_channel").asc())
    return events.withColumn("_rn", F.row_number().over(w)).where(F.col("_rn") == 1).drop("_rn")


def url_attribution(pages: DataFrame, source_key: str = "ref", campaign_key: str = "page") -> DataFrame:
    """E-04: traffic source (lower-cased) and campaign from the landing URL's query string.

    ``try_parse_url`` returns NULL for malformed URLs instead of failing the job under ANSI mode.
    """
    u = F.col("url")
    return pages.select(
        "page_id", "url",
        F.lower(F.try_parse_url(u, F.lit("QUERY"), F.lit(source_key))).alias("source"),
        F.try_parse_url(u, F.lit("QUERY"), F.lit(campaign_key)).alias("campaign"),
        F.lower(u).startswith("https://").alias("is_https"),
    )
