"""positions_within against ROW_NUMBER on a fixture where one group holds most rows (brute-force check)."""

import pytest
from pyspark.sql import Window
from pyspark.sql import functions as F

from pacewise.operators.dedup import scd2_history
from pacewise.operators.sequence import positions_within


def test_positions_match_row_number_on_hot_group(spark):
    df = spark.range(0, 20000).select(
        F.when(F.col("id") % 10 < 7, F.lit("hot")).when(F.col("id") % 10 < 9, F.lit("warm"))
        .otherwise(F.lit(None).cast("string")).alias("g"),
        ((F.col("id") * 7919) % 100003).alias("o"))
    got = positions_within(df, ["g"], ["o"], "_pos", partitions=8)
    want = df.withColumn("_pos", F.row_number().over(Window.partitionBy("g").orderBy("o")) - 1)
    assert got.count() == df.count()
    assert got.exceptAll(want.select(*got.columns)).count() == 0


def test_scd2_keeps_first_and_changes(spark):
    rows = [("k", "A", 1), ("k", "A", 2), ("k", "B", 3), ("k", "B", 4), ("k", "A", 5), ("j", "X", 1)]
    df = spark.createDataFrame(rows, "key string, status string, t long").withColumn(
        "_ingested_at", F.timestamp_seconds("t"))
    h = scd2_history(df.drop("t"), "key", "status").orderBy("key", "_valid_from").collect()
    assert [(r.key, r.status, r._is_current) for r in h] == [
        ("j", "X", True), ("k", "A", False), ("k", "B", False), ("k", "A", True)]
    k = [r for r in h if r.key == "k"]
    assert k[0]._valid_to == k[1]._valid_from and k[1]._valid_to == k[2]._valid_from


SF01 = "/root/testdata/sf0.1"


@pytest.mark.parametrize("partitions", [4, 8, 32])
def test_positions_and_history_at_sf01_equal_windows(spark, partitions):
    """W-03 and W-05 carry extra columns and must not depend on how ranges were sampled."""
    before = spark.conf.get("spark.sql.shuffle.partitions")
    spark.conf.set("spark.sql.shuffle.partitions", str(partitions))
    try:
        orders = spark.read.parquet(f"{SF01}/orders.parquet").select(
            F.when(F.col("o_orderkey") % 10 < 6, F.lit("hot")).otherwise(F.col("o_orderpriority")).alias("g"), "o_orderkey",
            "o_custkey", "o_totalprice")
        got = positions_within(orders, ["g"], ["o_orderkey"], "_pos")
        want = orders.withColumn("_pos", F.row_number().over(Window.partitionBy("g").orderBy("o_orderkey")).cast("long") - 1)
        assert got.count() == orders.count()
        assert got.select(*want.columns).exceptAll(want).count() == 0

        versions = spark.read.parquet(f"{SF01}/orders.parquet").select(
            F.when(F.col("o_custkey") % 3 == 0, F.lit(-1)).otherwise(F.col("o_custkey")).alias("key"),
            F.col("o_orderstatus").alias("status"), F.col("o_orderdate").cast("timestamp").alias("_ingested_at"),
            F.col("o_orderkey").alias("_batch_id"), F.col("o_orderpriority").alias("extra"))
        got = scd2_history(versions, "key", "status", tie_breakers=["_batch_id"])
        w = Window.partitionBy("key").orderBy("_ingested_at", "_batch_id")
        kept = (versions.withColumn("_prev", F.lag("status").over(w)).withColumn("_n", F.row_number().over(w))
                .where((F.col("_n") == 1) | ~F.col("_prev").eqNullSafe(F.col("status"))).drop("_prev", "_n"))
        want = kept.withColumn("_valid_from", F.col("_ingested_at")).withColumn("_valid_to", F.lead("_ingested_at").over(w))
        want = want.withColumn("_is_current", F.col("_valid_to").isNull())
        assert got.count() == want.count()
        assert got.select(*want.columns).exceptAll(want).count() == 0
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", before)
