"""Reference-data conformance: link campaigns to the market dimension and list orphaned keys.

The market dimension is derived from nation ⋈ region — 25 rows at every
scale — so broadcasting it is bounded. Orphan detection is a left-anti join;
fact-to-campaign checks (delivery, tickets) are shuffle anti-joins on the
campaign key and a salt, because both sides grow with the data and a campaign
(or the missing key) may hold much of it.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from pacewise.operators.skew import spread_join
from pacewise.sources.bindings import CHANNELS
from pacewise.sources.tables import scan


def markets_dim(spark: SparkSession, sf_dir: str) -> DataFrame:
    n = scan(spark, sf_dir, "nation", "n_nationkey", "n_name", "n_regionkey")
    r = scan(spark, sf_dir, "region", "r_regionkey", "r_name")
    return n.join(r, F.col("n_regionkey") == F.col("r_regionkey")).select(
        F.upper(F.col("n_name")).alias("market_code"), F.col("n_name").alias("market_country"),
        F.col("r_name").alias("market_region"))


def conform_campaigns(campaigns: DataFrame, markets: DataFrame) -> DataFrame:
    """Campaigns with their market attributes (left join: an unknown geo keeps the campaign, attributes NULL)."""
    j = campaigns.select("campaign_id", "targeting_geo", "region").join(
        F.broadcast(markets), F.col("targeting_geo") == F.col("market_code"), "left")
    return j.select("campaign_id", "targeting_geo", "market_country", "market_region",
                    F.coalesce(F.col("market_region") == F.col("region"), F.lit(False)).alias("region_consistent"))


def orphan_keys(campaigns: DataFrame, delivery: DataFrame, tickets: DataFrame, markets: DataFrame) -> DataFrame:
    """(entity, key_name, key_value) for references that do not resolve; NULL references count as orphans."""
    c_keys = campaigns.select("campaign_id")
    geo = campaigns.join(F.broadcast(markets), F.col("targeting_geo") == F.col("market_code"), "left_anti").select(
        F.lit("campaigns").alias("entity"), F.lit("targeting_geo").alias("key_name"),
        F.col("targeting_geo").alias("key_value"), F.col("campaign_id").alias("row_key"))
    d = spread_join(delivery.select("delivery_id", "campaign_id"), c_keys, "campaign_id", "delivery_id", "left_anti").select(
        F.lit("delivery").alias("entity"), F.lit("campaign_id").alias("key_name"), F.col("campaign_id").alias("key_value"),
        F.col("delivery_id").alias("row_key"))
    t = spread_join(tickets.select("ticket_id", "campaign_id"), c_keys, "campaign_id", "ticket_id", "left_anti").select(
        F.lit("tickets").alias("entity"), F.lit("campaign_id").alias("key_name"), F.col("campaign_id").alias("key_value"),
        F.col("ticket_id").alias("row_key"))
    return geo.unionByName(d).unionByName(t)


# Reference data of fixed size: channels, titles and users of the bindings (FIXTURES.md §2).
def channels_dim(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame([(c,) for c in CHANNELS], "channel string")


def titles_dim(spark: SparkSession, titles: int = 40) -> DataFrame:
    return spark.range(titles).select(F.concat(F.lit("TTL-"), F.col("id").cast("string")).alias("title_id"))


def users_dim(spark: SparkSession, users: int = 12) -> DataFrame:
    return spark.range(2, users + 1).select(F.concat(F.lit("user_"), F.lpad(F.col("id").cast("string"), 2, "0")).alias("user"))


def brands_dim(spark: SparkSession, sf_dir: str) -> DataFrame:
    return scan(spark, sf_dir, "customer", "c_mktsegment").select(F.upper(F.substring("c_mktsegment", 1, 3)).alias("brand_code")).distinct()


def link_report(links: list[tuple[str, str, DataFrame, DataFrame]]) -> DataFrame:
    """(entity, link, total_rows, linked_rows, orphan_rows) for links given as (entity, key, rows, one-column dimension).

    Rows are counted per key before the join, so a key that many rows share is
    one row in it. A NULL key is an orphan.
    """
    parts = []
    for entity, key, rows, dim in links:
        per_key = rows.groupBy(F.col(key).alias("_key")).agg(F.count(F.lit(1)).alias("n"))
        known = dim.select(F.col(dim.columns[0]).alias("_key"), F.lit(True).alias("_known"))
        sums = per_key.join(known, "_key", "left").agg(
            F.coalesce(F.sum("n"), F.lit(0)).alias("total_rows"), F.coalesce(F.sum(F.when(F.col("_known"), F.col("n"))), F.lit(0)).alias("linked_rows"))
        parts.append(sums.select(F.lit(entity).alias("entity"), F.lit(key).alias("link"), "total_rows", "linked_rows",
                                 (F.col("total_rows") - F.col("linked_rows")).alias("orphan_rows")))
    return reduce(DataFrame.unionByName, parts)
