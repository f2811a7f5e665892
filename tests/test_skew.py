"""Hot keys: the join of a deduplicated dimension goes by key and salt; hashing, dedup ties and long keys."""

import datetime as dt
import hashlib

from pyspark.sql import functions as F

from pacewise.operators.clean import silver_campaigns
from pacewise.operators.conversions import hash_pii
from pacewise.operators.dedup import dedup_latest
from pacewise.operators.skew import spread_join
from pacewise.sources import bindings as b
from tests.conftest import SF0001


def test_a_campaign_with_most_rows_spans_tasks(spark):
    dim = dedup_latest(spark.range(50).select(F.col("id").alias("k"), F.lit(dt.datetime(1999, 1, 1)).alias("_ingested_at"), F.lit("d").alias("d")), "k")
    facts = spark.range(6_000).select(F.col("id").alias("f"), F.when(F.col("id") % 10 < 6, F.lit(7)).when(F.col("id") % 10 == 6, F.lit(None))
                                      .otherwise(F.col("id") % 60).cast("long").alias("k"))
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        for how in ("left", "inner", "left_anti", "left_semi"):
            got = spread_join(facts, dim, "k", "f", how)
            want = facts.join(dim, "k", how)
            assert got.columns == want.columns and got.exceptAll(want).isEmpty() and want.exceptAll(got).isEmpty()
        joined = spread_join(facts, dim, "k", "f")
        plan = joined._jdf.queryExecution().executedPlan().toString()
        assert plan.count("hashpartitioning(k") >= 2 and "_salt" in plan.split("SortMergeJoin")[1].split("\n")[0]
        sizes = [r["n"] for r in facts.withColumn("s", F.pmod(F.xxhash64("f"), F.lit(8))).groupBy("k", "s").agg(F.count(F.lit(1)).alias("n")).collect()]
        assert max(sizes) < 6_000 * 0.6 / 6  # the campaign's 60 % lie in eight even parts
    finally:
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")


def test_hashes_ignore_any_white_space_around(spark):
    values = [" a@B.c ", "\ta@b.c\n", "a@b.c\r\n", " a@b.c\xa0"]
    got = [r[0] for r in spark.createDataFrame([(v,) for v in values], "v string").select(hash_pii("v")).collect()]
    assert set(got) == {hashlib.sha256(b"a@b.c").hexdigest()}


def test_versions_of_one_time_have_one_winner(spark):
    at = dt.datetime(1999, 1, 1)
    rows = [("k", at, "b1", "f1", n) for n in range(40)] + [("k", at, "b2", "f0", n) for n in range(40)]
    df = spark.createDataFrame(rows, "key string, _ingested_at timestamp, _batch_id string, _source_file string, n int")
    winners = {tuple(dedup_latest(df.repartition(p).orderBy(F.rand(p)), "key").first()) for p in (1, 3, 7)}
    assert len(winners) == 1 and next(iter(winners))[2] == "b2"


def test_long_keys_stay_whole(spark):
    keys = spark.range(9_999_990, 10_000_020)
    ids = [r[0] for r in keys.select(b.campaign_key(F.col("id"))).collect()]
    assert len(set(ids)) == 30 and ids[0] == "CMP-9999990" and ids[-1] == "CMP-10000019"
    assert spark.range(1).select(b.padded(F.lit(42))).first()[0] == "0000042"
    assert silver_campaigns(b.campaigns_bronze(spark, SF0001)).count() == 150
